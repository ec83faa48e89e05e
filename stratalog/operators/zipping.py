"""Strict positional zips of streams, JSON attachments and empty sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.columns import guard

JSON, VIDEO = "application/json", "video/mp4"


def strict_zip(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides that share a position; a position that only one side has raises."""
    a, b = left.withColumn("_left", F.lit(1)), right.withColumn("_right", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.where(guard(F.col("_left").isNotNull() & F.col("_right").isNotNull(), "streams have different lengths")).drop("_left", "_right")


def json_elements(attachments: DataFrame) -> DataFrame:
    """(episode_id, name, idx, item) of JSON attachments: elements of an array, keys of an object; items are JSON text.

    A scalar and any media type but JSON raise. Videos need a decoder and are read elsewhere.
    """
    text = F.col("data").cast("string")
    kind = F.substring(F.ltrim(text), 1, 1)
    ok = guard(F.col("media_type") == JSON, "unsupported media type")
    items = F.when(kind == "[", F.from_json(text, "array<string>")).when(kind == "{", F.json_object_keys(text)).otherwise(F.raise_error(F.lit("a JSON scalar has no items")).cast("array<string>"))
    return attachments.where(ok).select("episode_id", "name", F.posexplode(items).alias("idx", "item")).withColumn("idx", F.col("idx").cast("bigint"))


def zip_items(items: DataFrame, names: list[str]) -> DataFrame:
    """(episode_id, idx, one column per name) of item streams (episode_id, name, idx, item); unequal lengths raise.

    One shuffle: a stream's items meet at their position. A name that an episode has twice raises too.
    """
    names = sorted(set(names))
    wanted = items.where(F.col("name").isin(names)).groupBy("episode_id", "idx").pivot("name", names).agg(F.struct(F.count(F.lit(1)).alias("n"), F.first("item").alias("item")))
    ok = None
    for n in names:
        one = F.coalesce(F.col(f"`{n}`.n"), F.lit(0)) == 1
        ok = one if ok is None else ok & one
    return wanted.where(guard(ok, "attachments have different lengths")).select("episode_id", "idx", *(F.col(f"`{n}`.item").alias(n) for n in names))


def empty_samples(lengths: DataFrame) -> DataFrame:
    """(episode_id, sample_idx) with as many empty samples as each episode is long."""
    return lengths.where("length > 0").select("episode_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("sample_idx"))


def zip_samples(samples: DataFrame, items: DataFrame) -> DataFrame:
    """Assembled samples with the attachment items at their positions; unequal lengths raise, equal names go to the attachment."""
    right = items.withColumnRenamed("idx", "sample_idx")
    clash = [c for c in right.columns if c in samples.columns and c not in ("episode_id", "sample_idx")]
    return strict_zip(samples.drop(*clash), right, ["episode_id", "sample_idx"])


def numbered(df: DataFrame, partition: str, *order: str) -> DataFrame:
    """``df`` with idx, its position from 0 in each partition."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(partition).orderBy(*order)).cast("bigint") - 1)
