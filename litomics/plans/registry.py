"""The engine's own queries by name, and their SQL."""

from __future__ import annotations

from . import curation, exports, files, omics, readers, search  # noqa: F401  they register their queries
from .relational import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
