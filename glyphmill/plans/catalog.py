"""All queries by name, each a function of (spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

from glyphmill.plans import counting, learning, parsing, scalars, signatures, sketches, stats, tokens  # noqa: F401
from glyphmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
