"""Imports every module that registers queries."""

from __future__ import annotations

from lexmere.operators import amending, anchors, checks, citing, documents, edits, filters, generation, labels, matching, numbers, proposals, quality, ranking, reading, retrieval, statistics, statutes, stores, transforms, trees, versions  # noqa: F401
from lexmere.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
from lexmere.streaming import caches, feeds  # noqa: F401
