"""Queries over container files that are written and read by their indexes (the others are in queries.py and recorded.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog import model as m
from stratalog.functions import payload as pay
from stratalog.queries import query
from stratalog.sources import datasource, indexed
from stratalog.sources.shared import shared_folder
from stratalog.streaming import stateful

#: 2024-01-15 and 2024-01-20, in nanoseconds.
_MIDDLE, _LATER = 1705276800000000000, 1705708800000000000


def _event_rows(spark: SparkSession, d: str, topics: tuple[str, ...] = ()) -> DataFrame:
    """events as float-vector messages in ten files, by the last digit of the user."""
    e = m.msg_log(spark, d)
    e = e.where(F.col("topic").isin(list(topics))) if topics else e
    file = F.concat(F.pmod("episode_id", F.lit(10)).cast("string"), F.lit(".mcap"))
    kept = e.select(file.alias("episode_id"), "topic", F.lit("FloatArray").alias("schema_name"), "log_time", F.col("log_time").alias("publish_time"), "sequence", F.array(F.col("value").cast("float")).alias("data"))
    return kept.withColumn("data", pay.encode_float_arrays("data"))


def _named(df: DataFrame) -> DataFrame:
    """Messages with their file's name and decoded value."""
    file = F.element_at(F.split("episode_id", "/"), -1)
    return df.select(file.alias("file"), "topic", F.col("sequence").alias("event_id"), F.round(pay.decode_float_arrays("data")[0].cast("double"), 2).alias("value"))


@query
def indexed_topic(spark: SparkSession, d: str) -> DataFrame:
    """One topic of a span of time, by the chunk indexes of written files: other chunks are not read."""
    index = indexed.save(indexed.file_parts(_event_rows(spark, d), chunk_bytes=1 << 16), shared_folder(spark, "indexed"))
    return _named(indexed.messages(index, ["click"], start=_MIDDLE, end=_LATER - 1))


@query
def written_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Files written through the data source and read through it, with a filter that it pushes to the indexes."""
    root = shared_folder(spark, "written")
    datasource.register(spark)
    parts = indexed.file_parts(_event_rows(spark, d), chunk_bytes=1 << 16)
    indexed.dealt_parts(parts).write.format("episodes").mode("append").save(root)
    read = spark.read.format("episodes").load(root)
    return _named(read.where(F.col("topic").isin("view", "error") & (F.col("log_time") < _MIDDLE)))


@query
def indexed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Messages by file and topic from the summaries, and how many bytes of chunks each topic's reader takes at most."""
    index = indexed.save(indexed.file_parts(_event_rows(spark, d), compression="", chunk_bytes=1 << 16), shared_folder(spark, "counted"))
    return indexed.counts(index).select(F.element_at(F.split("episode_id", "/"), -1).alias("file"), "topic", "n")


@query
def converted_files(spark: SparkSession, d: str) -> DataFrame:
    """A conversion of files, with all that it has to keep: schema bytes, channel metadata, silent channels, attachments, metadata records."""
    c, s, n = m.table(spark, d, "customer"), m.table(spark, d, "supplier"), m.table(spark, d, "nation")
    name = lambda key: F.concat(F.col(key).cast("string"), F.lit(".mcap")).alias("episode_id")
    messages = c.select(name("c_nationkey"), F.col("c_mktsegment").alias("topic"), F.lit("geo.Customer").alias("schema_name"), F.col("c_custkey").alias("log_time"), F.col("c_custkey").alias("publish_time"), F.lit(0).cast("bigint").alias("sequence"), F.col("c_name").cast("binary").alias("data"))
    schemas = n.select(name("n_nationkey"), F.explode(F.create_map(F.lit("geo.Customer"), F.col("n_name"), F.lit("geo.Nothing"), F.lit("unused"))).alias("name", "data"), F.lit("text").alias("encoding"))
    silent = n.select(name("n_nationkey"), F.lit("silent").alias("topic"), F.lit("geo.Nothing").alias("schema_name"), F.lit("text").alias("message_encoding"), F.create_map(F.lit("nation"), F.col("n_name")).alias("metadata"))
    spoken = messages.select("episode_id", "topic", "schema_name").distinct().select("*", F.lit("utf8").alias("message_encoding"), F.create_map(F.lit("segment"), F.col("topic")).alias("metadata"))
    items = s.select(name("s_nationkey"), F.col("s_name").alias("name"), F.lit("text/plain").alias("media_type"), F.col("s_suppkey").alias("create_time"), F.col("s_suppkey").alias("log_time"), F.col("s_name").cast("binary").alias("data"))
    records = n.select(name("n_nationkey"), F.lit("nation").alias("name"), F.create_map(F.lit("key"), F.col("n_nationkey").cast("string")).alias("metadata"))
    first, second = shared_folder(spark, "original"), shared_folder(spark, "converted")
    indexed.save(indexed.file_parts(messages, silent.unionByName(spoken), schemas.withColumn("data", F.col("data").cast("binary")), items, records), first)
    index = indexed.convert(spark, first, second, compression="")
    text = F.col("data").cast("string").alias("detail")
    found = [
        indexed.schemas(index).select("episode_id", F.lit("schema").alias("kind"), "name", "encoding", text),
        indexed.channels(index).select("episode_id", F.lit("channel").alias("kind"), F.col("topic").alias("name"), F.col("message_encoding").alias("encoding"), F.map_values("metadata")[0].alias("detail")),
        indexed.messages(index).select("episode_id", F.lit("message").alias("kind"), F.col("topic").alias("name"), F.col("schema_name").alias("encoding"), text),
        indexed.attachments(index).select("episode_id", F.lit("attachment").alias("kind"), "name", F.col("media_type").alias("encoding"), text),
        indexed.metadata(index).select("episode_id", F.lit("metadata").alias("kind"), "name", F.lit("").alias("encoding"), F.map_values("metadata")[0].alias("detail")),
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(F.element_at(F.split("episode_id", "/"), -1).alias("file"), "kind", "name", "encoding", "detail")


@query
def stream_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that arrive in three slices of time, streamed through assembly in a micro-batch each, over restarts from the checkpoint."""
    datasource.register(spark)
    root, out, log = (shared_folder(spark, f"arriving{x}") for x in ("", "-out", "-log"))
    rows = _event_rows(spark, d, ("click", "view"))
    slice_of = (F.col("log_time") >= _MIDDLE).cast("int") + (F.col("log_time") >= _LATER).cast("int")
    rows = rows.withColumn("episode_id", F.concat(slice_of.cast("string"), F.lit("-"), "episode_id"))
    kind = "user_digit string, sample_idx bigint, click double, view double"

    for n in range(3):
        indexed.save(indexed.file_parts(rows.where(slice_of == n)), root)
        read = spark.readStream.format("episodes").load(root)
        name = F.regexp_extract("episode_id", r"-(\d)\.mcap$", 1).alias("episode_id")
        values = read.select(name, "topic", "log_time", "sequence", pay.decode_float_arrays("data")[0].cast("double").alias("value"))
        made = stateful.assemble(values, ["click", "view"])
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema(kind.replace("user_digit", "episode_id")).parquet(out)
    return read.select(F.col("episode_id").cast("bigint").alias("user_digit"), "sample_idx", F.round("click", 2).alias("click"), F.round("view", 2).alias("view"))
