"""Spark-native analysis of large collections of structured texts.

Every public operator takes and returns DataFrames, so a whole batch of
questions is answered by one distributed plan.
"""
