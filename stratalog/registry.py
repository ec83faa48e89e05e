"""Named queries of the library and the SQL each one is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog import contained, recorded  # noqa: F401  they register their queries
from stratalog.oracles import ORACLES
from stratalog.queries import QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable(spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same rows."""
    return dict(ORACLES)
