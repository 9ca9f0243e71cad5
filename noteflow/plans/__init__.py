"""Registered queries of noteflow and their SQL."""

from noteflow.plans import rule_queries, store_queries  # noqa: F401
from noteflow.plans.registry import ORACLE_SQL, QUERIES


def oracles() -> dict[str, str]:
    return dict(ORACLE_SQL)


__all__ = ["QUERIES", "oracles"]
