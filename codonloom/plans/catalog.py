"""Registry of the core queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data_quality, feature_queries, profile_queries, registry, relational_queries, sequence_queries  # noqa: F401, I001 - they register their queries
from . import io_queries, model_queries  # noqa: F401 - builds on the others


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries()["rules_score"](spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(registry.QUERIES)
    found |= {k: v for k, v in vars(data_quality).items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}
    return found


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE) | data_quality.ORACLE
