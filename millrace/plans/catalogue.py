"""All registered queries: importing the modules that hold them registers them."""

from __future__ import annotations

from millrace.plans import eventtime, nexmark, relational, scalars, scripts, streams  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
