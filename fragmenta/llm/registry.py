"""The subpackage's queries, and SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Modules with QUERIES: name -> (query, DuckDB SQL or None).
MODULES = (
    "bpe", "cotraining", "fill_in_middle", "jaccard_join", "knn_join", "language_id", "lm_score", "packing", "quality_rules", "ranked_search", "substring_dedup", "toxicity", "warc",
)


def _all() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"fragmenta.llm.{name}").QUERIES
    return out


def queries() -> dict:
    return {k: v[0] for k, v in _all().items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in _all().items() if v[1]}
