"""All queries over the sample tables and, where SQL can say it, their check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, exploration, models, reports, retail, sql  # noqa: F401  three of them add to retail's queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: sql.run(plan) for name, plan in exploration.PLANS.items()} | retail.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: sql.text(plan, sql.OTHER) for name, plan in exploration.PLANS.items()} | retail.CHECKS
