"""All queries: importing the modules registers theirs."""

from __future__ import annotations

from . import kernels, recomposed, references, statistics  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
