"""Episode catalogues, topic catalogues, key resolution and counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.columns import guard
from stratalog.plans.slices import Index

NONE, SORT, SHUFFLE, REVERSE = "none", "sort", "shuffle", "reverse"


def hash_order(seed: int, *keys: Column) -> list[Column]:
    """A seeded pseudo-random total order: by md5 of "seed:key", then by key. The same in every run and engine."""
    text = F.concat(F.lit(f"{seed}:"), *[k.cast("string") for k in keys])
    return [F.md5(text.cast("binary")), *keys]


def rearranged(keys: list[Column], kind: str, seed: int = 0) -> list[Column]:
    """The order of a rearrangement of rows that come in the order of ``keys``."""
    if kind in (NONE, SORT):
        return [k.asc() for k in keys]
    if kind == SHUFFLE:
        return hash_order(seed, keys[-1])
    if kind == REVERSE:
        return [k.desc() for k in keys]
    raise ValueError(f"unknown rearrangement {kind!r}")


def episode_catalog(files: DataFrame, kind: str = SORT, seed: int = 0, slices: dict[str, list[Index]] | list[Index] | None = None) -> DataFrame:
    """(root, file) to (root, file, pos): each root's files rearranged, numbered from 0, then sliced.

    Slices are given per root or for all roots. Their indexes keep order and repeats and may count from the end; a root without
    indexes is not sliced; an index that no file has raises. Positions after slicing follow the index list. Numbering windows hold
    one root's file names; slicing is a join with the small index table.
    """
    pos = F.row_number().over(Window.partitionBy("root").orderBy(*rearranged([F.col("file")], kind, seed))).cast("bigint") - 1
    numbered = files.select("root", "file", pos.alias("pos"))
    if not slices:
        return numbered
    spark = files.sparkSession
    if isinstance(slices, list):
        names: list[tuple[str | None, list[Index]]] = [(None, slices)]
    else:
        names = [(root, idx) for root, idx in slices.items() if idx]
    for _, idx in names:
        if any(isinstance(i, str) for i in idx):
            raise TypeError("indexes with a suffix cannot index a catalogue")
    if not names:
        return numbered
    rows = [(root, n, int(i)) for root, idx in names for n, i in enumerate(idx)]
    wanted = spark.createDataFrame(rows, "root string, slot bigint, idx bigint")
    if isinstance(slices, list):
        wanted = numbered.select("root").distinct().crossJoin(F.broadcast(wanted.drop("root")))  # one row per root and index
    sizes = numbered.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    wanted = wanted.join(sizes, "root").where(guard((F.col("idx") < F.col("n")) & (F.col("idx") >= -F.col("n")), "slice index out of range"))
    wanted = wanted.select("root", "slot", F.when(F.col("idx") < 0, F.col("idx") + F.col("n")).otherwise(F.col("idx")).alias("pos"))
    sliced = numbered.join(wanted, ["root", "pos"]).select("root", "file", F.col("slot").alias("pos"))
    rest = numbered.join(F.broadcast(wanted.select("root").distinct()), "root", "left_anti").select("root", "file", "pos")
    return sliced.unionByName(rest)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``; a catalogue without a row raises here, when it is planned."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def all_files(catalog: DataFrame) -> DataFrame:
    """root -> its file names in catalogue order."""
    held = F.array_sort(F.collect_list(F.struct("pos", "file")))
    return catalog.groupBy("root").agg(F.transform(held, lambda s: s["file"]).alias("files"))


def topic_catalog(channels: DataFrame) -> DataFrame:
    """Distinct topics of each episode; channels without messages count."""
    return channels.select("episode_id", "topic").distinct()


def attachment_catalog(attachments: DataFrame) -> DataFrame:
    """Distinct attachment names of each episode."""
    return attachments.select("episode_id", "name").distinct()


def unknown_names(requested: Iterable[str], available: DataFrame, column: str) -> DataFrame:
    """Requested names that no row of ``available`` has."""
    spark = available.sparkSession
    asked = spark.createDataFrame([(n,) for n in sorted(set(requested))], f"{column} string")
    return asked.join(available.select(column).distinct(), column, "left_anti")


def resolve_keys(topics_available: set[str], attachments_available: set[str], keys: Iterable[str] | None = None, topics: Iterable[str] | None = None, attachments: Iterable[str] | None = None) -> tuple[set[str], set[str]]:
    """The topics and attachments of a request: None means all; each key joins the side that has it.

    Unknown topics or attachments, keys on neither side and keys on both raise ValueError.
    """
    own_topics = set(topics_available) if topics is None else set(topics)
    own_attachments = set(attachments_available) if attachments is None else set(attachments)
    for key in keys or ():
        sides = (key in topics_available) + (key in attachments_available)
        if sides != 1:
            raise ValueError(f"key {key!r} is {'ambiguous: a topic and an attachment have it' if sides else 'neither a topic nor an attachment'}")
        (own_topics if key in topics_available else own_attachments).add(key)
    for kind, own, known in (("topics", own_topics, topics_available), ("attachments", own_attachments, attachments_available)):
        if own - known:
            raise ValueError(f"unknown {kind} {sorted(own - known)}; available: {sorted(known)}")
    return own_topics, own_attachments


def topic_counts(messages: DataFrame) -> DataFrame:
    """Messages per episode and topic; channels of one topic are summed."""
    return messages.groupBy("episode_id", "topic").agg(F.count(F.lit(1)).alias("n"))


def equal_counts(counts: DataFrame) -> DataFrame:
    """Per episode the common message count of all its topics, or 0 if they differ."""
    return counts.groupBy("episode_id").agg(F.when(F.min("n") == F.max("n"), F.max("n")).otherwise(0).cast("bigint").alias("common"))


def episode_lengths(messages: DataFrame) -> DataFrame:
    """Length of each episode: the count that all its topics share; an episode without one raises."""
    return equal_counts(topic_counts(messages)).where(guard(F.col("common") > 0, "topics have different message counts")).select("episode_id", F.col("common").alias("length"))
