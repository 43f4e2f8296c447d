"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from postloom.llm import chat, exact_dedup, jaccard_join, line_dedup, mixing, packing, quality_model, quality_rules, sharding, substring_dedup

MODULES = (chat, exact_dedup, jaccard_join, line_dedup, mixing, packing, quality_model, quality_rules, sharding, substring_dedup)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
