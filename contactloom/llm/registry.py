"""All queries of this package and their SQL."""

from __future__ import annotations

from . import q_dedup, q_lines, q_mix, q_pack, q_pii, q_scan, q_topk, q_toxic

MODULES = (q_scan, q_dedup, q_lines, q_mix, q_pack, q_pii, q_topk, q_toxic)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
