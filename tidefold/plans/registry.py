"""Queries by name."""

from . import fold_queries, log_queries, resolve_queries, stream_queries  # noqa: F401  they register themselves
from .base import QUERIES  # noqa: F401
