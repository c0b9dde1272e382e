"""Importing this module registers every query."""

from scriptoria.plans import search_queries  # noqa: F401
from scriptoria.plans import navigation_queries  # noqa: F401
from scriptoria.plans import text_queries  # noqa: F401
from scriptoria.plans import morphology_queries  # noqa: F401
from scriptoria.plans import import_queries  # noqa: F401
from scriptoria.plans import linkage_queries, notes_queries  # noqa: F401
from scriptoria.plans import tei_queries  # noqa: F401
from scriptoria.plans import streaming_queries  # noqa: F401
from scriptoria.plans import storage_queries  # noqa: F401
