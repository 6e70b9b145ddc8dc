"""DuckDB twins of the queries, by name."""

from .base import ORACLES  # noqa: F401
