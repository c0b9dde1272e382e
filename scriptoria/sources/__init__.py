"""Readers: files to DataFrames with explicit schemas."""
