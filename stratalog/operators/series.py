"""Time series: long form, ranges with padding, sliding buffers, synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def long_form(rows: DataFrame, ids: list[str], values: str) -> DataFrame:
    """One row per vector element: ids, index, value."""
    return rows.select(*ids, F.posexplode(values).alias("index", "value")).withColumn("index", F.col("index").cast("bigint"))


def padded_range(points: DataFrame, field: str, value: str, pad: float = 0.1, manual: dict[str, tuple[float, float]] | tuple[float, float] | None = None) -> DataFrame:
    """(field, low, high): min and max widened by ``pad`` of their span, a zero span counting as 1; no values give (-1, 1).

    ``manual`` replaces the range of all fields, or of those it names.
    """
    ranges = points.groupBy(field).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    span = F.when(F.col("_max") == F.col("_min"), F.lit(1.0)).otherwise(F.col("_max") - F.col("_min"))
    low, high = F.coalesce(F.col("_min") - span * pad, F.lit(-1.0)), F.coalesce(F.col("_max") + span * pad, F.lit(1.0))
    if isinstance(manual, tuple):
        low, high = F.lit(float(manual[0])), F.lit(float(manual[1]))
    for name, (a, b) in (manual if isinstance(manual, dict) else {}).items():
        low, high = F.when(F.col(field) == name, F.lit(float(a))).otherwise(low), F.when(F.col(field) == name, F.lit(float(b))).otherwise(high)
    return ranges.select(field, low.alias("low"), high.alias("high"))


def last_n(points: DataFrame, keys: list[str], order: list[str], n: int = 200) -> DataFrame:
    """The newest ``n`` points of each key: what a scrolling buffer holds at the end. Spark prunes by rank before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return points.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def sliding_mean(points: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Mean over a scrolling buffer of the last ``n`` points at each point."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), Window.currentRow)
    return points.withColumn("mean", F.avg(value).over(frame)).withColumn("held", F.count(F.lit(1)).over(frame))


def sample_series(spark: SparkSession, steps: int = 100, fields: int = 4, per_field: int = 5, seed: int = 42) -> DataFrame:
    """(t, field, values): trends with noise; fields are offset by 10, by 5 sin(0.2 t), by 20 and by -5 in turn."""
    base = spark.range(steps).select(F.col("id").alias("t")).withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(fields))))
    kind = F.pmod(F.col("f") - 1, F.lit(4))
    shift = F.when(kind == 0, 10.0).when(kind == 1, 5 * F.sin(F.col("t") * 0.2)).when(kind == 2, 20.0).otherwise(-5.0)
    values = F.array(*(F.col("t") * 0.1 + j + shift + F.randn(seed + j) for j in range(per_field)))
    return base.select("t", F.concat(F.lit("Field_"), "f").alias("field"), values.alias("values"))
