"""Training-data operators: scans, classifiers, deduplication, sharding, mixing, BPE, fingerprints.

``queries()`` and ``oracle_sql()`` return what this subpackage registers. Nothing outside this
subpackage (and ``corpus_pipeline.py``, which counts as part of it) imports it.
"""

from __future__ import annotations

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
