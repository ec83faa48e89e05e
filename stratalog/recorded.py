"""Queries over container files, payload bytes, datasets and streams (the others are in queries.py)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from stratalog import model as m
from stratalog.functions import columns as col
from stratalog.functions import payload as pay
from stratalog.operators import pipeline as pipe
from stratalog.operators import stamps as st
from stratalog.plans.dataset import DatasetConfig, EpisodeDataset, Levels
from stratalog.plans.slices import pick, resolve_slices
from stratalog.queries import query
from stratalog.sources import episodes as src
from stratalog.sources import indexed
from stratalog.sources.shared import moved, shared_folder
from stratalog.streaming import stateful

# ---- records of container files


@query
def attachment_scan(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as attachments of a file per nation, written and read back."""
    s = m.table(spark, d, "supplier")
    made = s.select(F.col("s_nationkey").cast("string").alias("episode_id"), F.col("s_name").alias("name"), F.lit("text/plain").alias("media_type"), (F.col("s_suppkey") + 1).alias("create_time"), F.col("s_suppkey").alias("log_time"), F.col("s_acctbal").cast("string").cast("binary").alias("data"))
    read = src.attachments(src.to_files(spark.createDataFrame([], m.MESSAGES), made))
    return read.select("episode_id", "name", "media_type", "create_time", "log_time", F.col("data").cast("string").cast("double").alias("balance"))


@query
def metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers as metadata records of a file per nation, written and read back."""
    c = m.table(spark, d, "customer")
    made = c.select(F.col("c_nationkey").cast("string").alias("episode_id"), F.col("c_name").alias("name"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("key"), F.col("c_custkey").cast("string")).alias("metadata"))
    read = src.metadata(src.to_files(spark.createDataFrame([], m.MESSAGES), metadata_=made))
    return read.select("episode_id", "name", F.col("metadata")["segment"].alias("segment"), F.col("metadata")["key"].cast("bigint").alias("key"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """events as messages whose schema is named after their topic."""
    return m.msg_log(spark, d).select(
        F.col("episode_id").cast("string").alias("episode_id"), "topic", F.concat(F.lit("log."), "topic").alias("schema_name"), "log_time", F.col("log_time").alias("publish_time"), "sequence", F.encode("topic", "utf-8").alias("data")
    )


@query
def schema_ids(spark: SparkSession, d: str) -> DataFrame:
    return src.schema_ids(_typed(spark, d)).select("episode_id", "schema_name", F.col("schema_id").cast("bigint").alias("schema_id"))


@query
def schema_scan(spark: SparkSession, d: str) -> DataFrame:
    """Schemas and the channels that name them, read from the summaries of written files."""
    files = src.to_files(_typed(spark, d))
    both = src.channels(files).join(src.schemas(files), ["episode_id", "schema_id"])
    return both.select("episode_id", "topic", F.col("name").alias("schema_name"))


# ---- payload bytes


@query
def compressed_image_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Compressed-image tables as bytes, dispatched to their decoder by schema name."""
    e = m.msg_log(spark, d).select("sequence", "log_time", F.encode("topic", "utf-8").alias("image"))
    read = pay.decode_columns(pay.encode_compressed_images(e, "image", "log_time"), {"image": "foxglove.CompressedImage"})
    return read.select(F.col("sequence").alias("event_id"), "image.format", "image.sec", "image.nsec", F.col("image.data").cast("string").alias("data"))


@query
def raw_image_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Raw-image tables as bytes, one- and three-channelled, dispatched to their decoder by schema name."""
    p = m.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("width"), (F.col("p_size") % 3 + 1).alias("height"), (F.col("p_size") % 2 * 2 + 1).alias("channels"))
    pixels = F.expr("cast(repeat('x', int(width * height * channels)) as binary)")
    image = F.struct("width", "height", "channels", F.lit("uint8").alias("dtype"), pixels.alias("data"))
    made = p.select("p_partkey", pay.raw_image(F.lit("cam"), image, F.lit(5), F.lit(5))["payload"].alias("image"))
    read = pay.decode_columns(pay.encode_raw_images(made, "image"), {"image": "foxglove.RawImage"})
    return read.select("p_partkey", "image.width", "image.height", F.col("image.channels").cast("bigint").alias("channels"), "image.dtype", "image.encoding", F.length("image.data").cast("bigint").alias("n_bytes"))


# ---- datasets


def _dataset(spark: SparkSession, d: str, **config: object) -> EpisodeDataset:
    """customer as a file per nation in the shared folder, with two aligned float-vector topics."""
    c = m.table(spark, d, "customer")
    topics = F.explode(F.create_map(F.lit("balance"), F.col("c_acctbal"), F.lit("key"), F.col("c_custkey").cast("double"))).alias("topic", "value")
    rows = c.select(F.concat(F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit(".mcap")).alias("episode_id"), F.col("c_custkey").alias("log_time"), topics)
    rows = rows.select("episode_id", "topic", F.lit("FloatArray").alias("schema_name"), "log_time", F.col("log_time").alias("publish_time"), F.lit(0).cast("bigint").alias("sequence"), pay.encode_float_arrays(F.array(F.col("value").cast("float"))).alias("data"))
    root = shared_folder(spark, "episodes")
    src.save_files(src.to_files(rows), root).write.format("noop").mode("overwrite").save()
    return EpisodeDataset(spark, DatasetConfig(root, topics=["balance", "key"], rearrange=Levels(dataset="none", episode="sort", sample="none"), **config))


@query
def episode_dataset(spark: SparkSession, d: str) -> DataFrame:
    """All samples of all files, concatenated in the order of the catalogue."""
    found = _dataset(spark, d).frame
    return found.select("pos", "sample_idx", F.col("key")[0].cast("bigint").alias("c_custkey"), F.round(F.col("balance")[0].cast("double"), 1).alias("balance"))


@query
def unflattened_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Episodes as rows: every second file of the catalogue, and how many customers each has by its index."""
    ds = _dataset(spark, d, flatten=False, world_size=2, rank=1)
    counts = indexed.counts(indexed.survey(indexed.list_files(spark, list(ds.all_files)))).where("topic = 'key'")
    name = lambda c: F.element_at(F.split(c, "/"), -1).alias("file")
    return ds.frame.select("pos", name("path")).join(counts.select(name("episode_id"), "n"), "file").withColumn("n_episodes", F.lit(len(ds)).cast("bigint"))


@query
def dataset_shard(spark: SparkSession, d: str) -> DataFrame:
    """One rank of two, resumed, its result kept in the cache."""
    found = _dataset(spark, d, world_size=2, rank=1, resume_from_sample=3, cache=True).frame
    return found.select("pos", F.col("key")[0].cast("bigint").alias("c_custkey"))


@query
def dataset_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Samples and episodes of a dataset, and its first and last sample."""
    with _dataset(spark, d, cache=True) as ds:
        ends = [int(ds[i]["key"][0]) for i in (0, -1)]
        return spark.createDataFrame([(len(ds), ds.episode_count(), *ends)], "n_samples bigint, n_episodes bigint, first_key bigint, last_key bigint")


@query
def slices_config(spark: SparkSession, d: str) -> DataFrame:
    """Slice settings by root, as a list for all roots, and absent, and the files of each region that they pick."""
    cases = {"list": [(2, 4), 0], "none": None, "number": 5, "dict": {"ASIA": 2, "EUROPE": [(0, 1), 3], "NOWHERE": 1}}
    files = m.episode_files(spark, d).groupBy("root").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()  # a row a root
    rows = []
    for name, case in cases.items():
        own = resolve_slices(case)
        for root, listed in files:
            picked = own.get(root, []) if isinstance(own, dict) else own or []
            rows += [(name, root, pos, file) for pos, file in enumerate(pick(listed, picked))]
    return spark.createDataFrame(rows, "name string, root string, pos bigint, file string")


@query
def wall_clock(spark: SparkSession, d: str) -> DataFrame:
    """The clock has one value a query, later than any event."""
    e = m.table(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), col.wall_clock_ms().alias("now"))
    return e.agg(F.countDistinct("now").alias("n_values"), F.min(F.col("now") > F.col("ts")).alias("later"))


# ---- streams


#: The last days of the first two of three slices in which events arrive.
_ARRIVALS = ("2024-01-11", "2024-01-21")


def _arriving(spark: SparkSession, rows: DataFrame, at: str, start: Callable[[DataFrame], Any]) -> None:
    """Rows that arrive in three slices by the time in column ``at``, a micro-batch each; the stream starts again for each.

    ``start`` makes a writer of the stream of rows.
    """
    root, written = shared_folder(spark, "arriving"), shared_folder(spark, "slices")
    day = F.date_format(at, "yyyy-MM-dd")
    slice_of = sum((day > last).cast("int") for last in _ARRIVALS)
    own = rows.drop(at)
    # Slices are written in one go: the rows are not made again for each.
    rows.select(*own.columns, slice_of.alias("_slice")).write.partitionBy("_slice").parquet(written)
    for n in range(len(_ARRIVALS) + 1):
        # The stream does not run while a slice arrives: it would see files of it one by one.
        if not moved(spark, f"{written}/_slice={n}", f"{root}/{n}"):
            spark.createDataFrame([], own.schema).write.parquet(f"{root}/{n}")
        stream = spark.readStream.schema(own.schema).option("recursiveFileLookup", "true").parquet(root)
        start(stream).trigger(availableNow=True).start().awaitTermination()


def _drained(spark: SparkSession, rows: DataFrame, at: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an operator makes of a stream, appended to a table in the shared folder."""
    out, log = shared_folder(spark, "stream"), shared_folder(spark, "stream-log")
    schema = []

    def start(stream: DataFrame) -> Any:  # noqa: ANN401
        made = operator(stream)
        schema[:] = [made.schema]
        return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append")

    _arriving(spark, rows, at, start)
    return spark.read.schema(schema[0]).parquet(out)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """events with when they arrive."""
    return m.table(spark, d, "events").withColumn("arrives", F.col("ts").cast("timestamp"))


def _when(df: DataFrame, events: DataFrame, key: str) -> DataFrame:
    return df.join(events.select(F.col("event_id").alias(key), "arrives"), key)


def _by_thirds(df: DataFrame, order: WindowSpec) -> DataFrame:
    """Rows of which each episode's first third arrives first."""
    days = F.array(F.lit("2024-01-01"), F.lit("2024-01-15"), F.lit("2024-01-30"))
    return df.withColumn("arrives", F.to_timestamp(F.element_at(days, F.ntile(3).over(order))))


@query
def stream_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Vectors assembled over three micro-batches and restarts."""
    events = _events(spark, d)
    rows = _when(m.messages_of(events).withColumn("value", F.array("value", F.lit(0.0))), events, "sequence")
    found = _drained(spark, rows, "arrives", lambda s: stateful.assemble(s, ["click", "view"]))
    return found.select(F.col("episode_id").alias("user_id"), "sample_idx", F.col("click")[0].alias("click"), F.col("view")[0].alias("view"))


@query
def stream_monotonic(spark: SparkSession, d: str) -> DataFrame:
    """Stamps repaired over three micro-batches and restarts; each brings a third of every user's stamps."""
    rows = _by_thirds(m.stamps(spark, d), Window.partitionBy("episode_id").orderBy("idx"))
    found = _drained(spark, rows, "arrives", lambda s: stateful.monotonic(s, st.repair_step(1_000_000)))
    return found.select(F.col("episode_id").alias("user_id"), "idx", "fixed")


@query
def counted_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """A shuffle buffer of 16 rows per user, its choices by a hash."""
    rows = m.table(spark, d, "events").select(F.col("user_id").alias("episode_id"), "event_id")
    return pipe.counted_shuffle(rows, 16, 42, ["event_id"]).select(F.col("episode_id").alias("user_id"), "event_id", "out_pos")


@query
def stream_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The same buffer over a stream that arrives in three slices of each user's rows."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = _by_thirds(m.table(spark, d, "events").select("user_id", F.col("user_id").alias("episode_id"), "event_id", F.lead("event_id").over(order).isNull().alias("last")), order).drop("user_id")
    found = _drained(spark, rows, "arrives", lambda s: stateful.bounded_shuffle(s, 16, 42, ["event_id"]))
    return found.select(F.col("episode_id").alias("user_id"), "event_id", "out_pos")


@query
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 events of each type, kept by an idempotent sink over three micro-batches and restarts."""
    path, log = shared_folder(spark, "latest"), shared_folder(spark, "latest-log")
    rows = _events(spark, d).select("event_type", "event_id", "value", "arrives")
    _arriving(spark, rows, "arrives", lambda s: stateful.keep_latest(s, path, log, ["event_type"], "event_id", 200))
    return stateful.current(spark, path, rows.drop("arrives").schema)
