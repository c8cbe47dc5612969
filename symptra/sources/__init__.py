"""Readers and writers."""

from .readers import (
    read_latest_snapshot,
    read_population,
    read_samples,
    read_search_trends,
    read_submissions,
)
from .writers import write_samples, write_snapshot, write_table

__all__ = [
    "read_latest_snapshot",
    "read_population",
    "read_samples",
    "read_search_trends",
    "read_submissions",
    "write_samples",
    "write_snapshot",
    "write_table",
]
