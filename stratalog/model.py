"""Physical tables of recorded episodes, and how the synthetic star-schema tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODES = "root string, file string, episode_id string, pos bigint"
SCHEMAS = "episode_id string, schema_id int, name string, encoding string, data binary"
CHANNELS = "episode_id string, channel_id int, topic string, message_encoding string, schema_id int, metadata map<string,string>"
MESSAGES = "episode_id string, channel_id int, topic string, schema_name string, log_time bigint, publish_time bigint, sequence bigint, data binary"
ATTACHMENTS = "episode_id string, name string, media_type string, create_time bigint, log_time bigint, data binary"
METADATA = "episode_id string, name string, metadata map<string,string>"

#: Payload schemas that are known, by the last part of their names: a float vector, a raw image and a compressed image (fixed values).
PAYLOAD_SCHEMAS = ("FloatArray", "RawImage", "CompressedImage")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def msg_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as interleaved messages: an episode per user, a topic per event type."""
    return messages_of(table(spark, sf_dir, "events"))


def messages_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("episode_id"), F.col("event_type").alias("topic"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("log_time"), F.col("event_id").alias("sequence"), "value"
    )


def aligned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as aligned messages: an episode per brand, topics size and price strictly in turn."""
    p = table(spark, sf_dir, "part")
    both = F.explode(F.array(F.struct(F.lit(0).alias("sequence"), F.lit("size").alias("topic"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit(1).alias("sequence"), F.lit("price").alias("topic"), F.col("p_retailprice").alias("value"))))
    return p.select(F.col("p_brand").alias("episode_id"), F.col("p_partkey").alias("log_time"), both.alias("m")).select("episode_id", "log_time", "m.sequence", "m.topic", "m.value")


def episode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and region as dataset roots with one file per nation."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("root"), F.concat("n_name", F.lit(".mcap")).alias("file"))


def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as the items of two JSON attachments, role and text, of an episode per conversation."""
    c = table(spark, sf_dir, "conversations")
    both = F.explode(F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"))).alias("name", "item")
    return c.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("idx"), both)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames: a stream per label, indexes from 0 in order of vec_id."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("bigint") - 1
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("stream"), rn.alias("idx"), "vec_id", "embedding")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a stream of samples: an episode per customer, in order of key."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("episode_id"), F.col("o_orderkey").alias("sample_id"), "o_totalprice", "o_orderstatus")


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frame stamps that are not monotonic: an episode per user."""
    return stamps_of(table(spark, sf_dir, "events"))


def stamps_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("idx"), F.round(F.col("value") * 100).cast("bigint").alias("stamp"))
