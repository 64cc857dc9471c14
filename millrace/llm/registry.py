"""What the entry module adds to the engine's own queries."""

from __future__ import annotations

from millrace.llm import queries as q

QUERIES = {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}
ORACLES = {"op3_substring_dedup": q.OP3_SQL, "op4_url_filter": q.OP4_SQL, "op10_warc": q.OP10_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
