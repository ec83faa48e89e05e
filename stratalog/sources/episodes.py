"""Reading and writing recorded episodes: listings, container files of any Spark file system, and file-to-file conversion.

Files are read as bytes by Spark, so any store that Spark opens will do; parsing runs in Arrow batches with one task per group of
files. A container file is one row while it is read and has to stay under 2 GB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog import model
from stratalog.functions.columns import with_extension
from stratalog.functions.payload import encode_compressed_images
from stratalog.sources import mcap_format as mf

#: Rows that are Python objects at a time.
ROWS = 10_000


def _rows(table: pa.Table, order: list[str], where: pa.Array | None = None) -> Iterator[dict[str, Any]]:
    """Rows in order, all or those ``where`` holds, a part of them as Python objects at a time."""
    at = pc.sort_indices(table, [(c, "ascending") for c in order])
    for part in table.take(at if where is None else at.filter(where.take(at))).to_batches(max_chunksize=ROWS):
        yield from part.to_pylist()


def list_items(spark: SparkSession, directory: str, extension: str, with_directory: bool = False) -> list[str]:
    """Names in a directory, sorted, without descending: files with the extension (its dot optional), "." for all files, "" for
    directories. A missing directory is empty. ``with_directory`` puts the path before file names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    prefix = directory.removesuffix("/") + "/" if with_directory else ""
    found = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(path)]
    if not extension:
        return sorted(n for n, is_dir in found if is_dir)
    ending = "" if extension == "." else extension if extension.startswith(".") else f".{extension}"
    return sorted(prefix + n for n, is_dir in found if not is_dir and n.endswith(ending))


def filter_files(files: DataFrame, column: str, extension: str) -> DataFrame:
    """Rows whose file name has the extension."""
    return files.where(with_extension(F.col(column), extension))


def episode_files(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """(root, file) of the .mcap files of each root; no file at all raises."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    rows = [(root, name) for root in roots for name in list_items(spark, root, ".mcap")]
    if not rows:
        raise ValueError(f"no episodes in {roots}")
    return spark.createDataFrame(rows, "root string, file string")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file listings name it: with scheme and, where there is one, authority."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()


def read_bytes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(episode_id, content) of container files; a path is a file or a directory of them. The file's path is its episode."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mcap").load(paths)
    return files.select(F.col("path").alias("episode_id"), "content")


def _table(files: DataFrame, schema: str, rows_of: Callable[[str, bytes | memoryview], Iterator[tuple]]) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark.sql.pandas.types as t

        kinds = t.to_arrow_schema(target)
        for batch in batches:
            for episode, content in zip(batch.column("episode_id").to_pylist(), batch.column("content"), strict=True):
                rows = rows_of(episode, memoryview(content.as_buffer()).cast("B"))  # read where it lies
                while part := list(islice(rows, ROWS)):
                    cols = list(zip(*part, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(n).type) for c, n in zip(cols, names, strict=True)], names)

    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)
    return files.mapInArrow(parse, target)


def messages(files: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """All messages, or those of some topics: the selection is made while parsing, before payloads are copied out."""
    wanted = None if topics is None else set(topics)

    def rows(episode: str, content: bytes | memoryview) -> Iterator[tuple]:
        channels: dict[int, mf.Channel] = {}
        schemas: dict[int, str] = {}
        for r in mf.read_records(content):
            if isinstance(r, mf.Schema):
                schemas[r.id] = r.name
            elif isinstance(r, mf.Channel):
                channels[r.id] = r
            elif isinstance(r, mf.Message) and (wanted is None or channels[r.channel_id].topic in wanted):
                c = channels[r.channel_id]
                yield episode, r.channel_id, c.topic, schemas.get(c.schema_id), r.log_time, r.publish_time, r.sequence, r.data

    return _table(files, model.MESSAGES, rows)


def channels(files: DataFrame) -> DataFrame:
    """All channels, those without messages too; from the summary section where there is one."""

    def rows(episode: str, content: bytes | memoryview) -> Iterator[tuple]:
        found = [r for r in mf.read_summary(content) if isinstance(r, mf.Channel)] or [r for r in mf.read_records(content) if isinstance(r, mf.Channel)]
        for c in {c.id: c for c in found}.values():
            yield episode, c.id, c.topic, c.message_encoding, c.schema_id, list(c.metadata.items())

    return _table(files, model.CHANNELS, rows)


def schemas(files: DataFrame) -> DataFrame:
    def rows(episode: str, content: bytes | memoryview) -> Iterator[tuple]:
        found = [r for r in mf.read_summary(content) if isinstance(r, mf.Schema)] or [r for r in mf.read_records(content) if isinstance(r, mf.Schema)]
        for s in {s.id: s for s in found}.values():
            yield episode, s.id, s.name, s.encoding, s.data

    return _table(files, model.SCHEMAS, rows)


def attachments(files: DataFrame) -> DataFrame:
    def rows(episode: str, content: bytes | memoryview) -> Iterator[tuple]:
        for r in mf.read_records(content):
            if isinstance(r, mf.Attachment):
                yield episode, r.name, r.media_type, r.create_time, r.log_time, r.data

    return _table(files, model.ATTACHMENTS, rows)


def metadata(files: DataFrame) -> DataFrame:
    def rows(episode: str, content: bytes | memoryview) -> Iterator[tuple]:
        for r in mf.read_records(content):
            if isinstance(r, mf.Metadata):
                yield episode, r.name, list(r.metadata.items())

    return _table(files, model.METADATA, rows)


def counts(files: DataFrame) -> DataFrame:
    """(episode_id, topic, n) from the statistics, without a message scan; channels of one topic are summed."""

    def rows(episode: str, content: bytes | memoryview) -> Iterator[tuple]:
        summary = mf.read_summary(content)
        topic = {c.id: c.topic for c in summary if isinstance(c, mf.Channel)}
        for s in summary:
            if isinstance(s, mf.Statistics):
                for channel, n in s.channel_message_counts.items():
                    yield episode, topic[channel], n

    return _table(files, "episode_id string, topic string, n bigint", rows).groupBy("episode_id", "topic").agg(F.sum("n").alias("n"))


def schema_ids(messages_: DataFrame) -> DataFrame:
    """(episode_id, schema_name, schema_id): ids from 1 in order of name, as a writer registers them."""
    from pyspark.sql import Window

    names = messages_.select("episode_id", "schema_name").where("schema_name is not null").distinct()
    return names.withColumn("schema_id", F.row_number().over(Window.partitionBy("episode_id").orderBy("schema_name")))


def channel_ids(messages_: DataFrame, strict: bool = True) -> DataFrame:
    """(episode_id, topic, schema_name, channel_id): ids from 1 in order of first use. A topic with two schemas raises if strict."""
    from pyspark.sql import Window

    from stratalog.functions.columns import guard

    first = messages_.groupBy("episode_id", "topic").agg(F.min(F.struct("log_time", "sequence")).alias("first"), F.min("schema_name").alias("schema_name"), F.countDistinct("schema_name").alias("kinds"))
    if strict:
        first = first.where(guard(F.col("kinds") <= 1, "a topic has two schemas"))
    rank = F.row_number().over(Window.partitionBy("episode_id").orderBy("first", "topic"))
    return first.select("episode_id", "topic", "schema_name", rank.alias("channel_id"))


def to_files(messages_: DataFrame, attachments_: DataFrame | None = None, compression: str = "zstd", metadata_: DataFrame | None = None) -> DataFrame:
    """(episode_id, content): container files built per episode, messages in log order, attachments and metadata records behind them.

    A file is built in one task's memory.
    """
    m = messages_.select("episode_id", "topic", "schema_name", "log_time", "publish_time", "sequence", "data")
    if metadata_ is not None:  # travels with the messages
        m = m.unionByName(metadata_.select("episode_id", F.col("name").alias("meta"), "metadata"), allowMissingColumns=True)
    spark = messages_.sparkSession
    a = attachments_ if attachments_ is not None else spark.createDataFrame([], model.ATTACHMENTS)

    def build(rows: pa.Table, extra: pa.Table) -> pa.Table:
        writer = mf.Writer(compression)
        noted = pc.is_valid(rows.column("meta")).combine_chunks() if "meta" in rows.column_names else None
        for r in _rows(rows, ["log_time", "sequence", "topic"], None if noted is None else pc.invert(noted)):
            writer.register_channel(r["topic"], r["schema_name"] or "", strict=False)
            writer.add_message(r["topic"], r["data"] or b"", r["log_time"], r["publish_time"], r["sequence"])
        for r in _rows(extra, ["log_time", "name"]):
            writer.add_attachment(mf.Attachment(r["log_time"], r["create_time"], r["name"], r["media_type"], r["data"]))
        for r in _rows(rows, ["meta"], noted) if noted is not None else ():
            writer.add_metadata(mf.Metadata(r["meta"], dict(r["metadata"] or ())))
        episode = (rows if rows.num_rows else extra).column("episode_id")[0].as_py()
        return pa.table([pa.array([episode], pa.string()), pa.array([writer.finish()], pa.binary())], ["episode_id", "content"])

    return m.groupBy("episode_id").cogroup(a.groupBy("episode_id")).applyInArrow(build, "episode_id string, content binary")


def save_files(files: DataFrame, directory: str) -> DataFrame:
    """Write each content to directory/episode_id (a file name) from the executors and return (path, size).

    ``directory`` is a URI or path that driver and executors share; a file appears under its name only when it is complete.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(directory if "://" in directory else f"file://{directory}")
        fs.create_dir(base, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for name, content in zip(batch.column("episode_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content)
                fs.move(part, f"{base}/{name}")
                paths.append(f"{base}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return files.mapInArrow(put, "path string, size bigint")


def convert_videos(messages_: DataFrame, attachments_: DataFrame, video_frames: DataFrame, image_format: str = "jpeg") -> tuple[DataFrame, DataFrame]:
    """File-to-file conversion: (messages, attachments) with each video attachment turned into compressed-image messages.

    ``video_frames`` holds the frames (episode_id, name, pts, data), data being an image file's bytes of ``image_format``; one message
    each, a compressed-image table, goes to the channel named after the attachment, published and logged at its stamp. Other attachments
    and all messages stay; ids are handed out anew when written, by name. Metadata records go to to_files() as they are.
    """
    is_video = F.col("media_type") == "video/mp4"
    named = attachments_.where(is_video).select("episode_id", "name")
    frames = video_frames.join(named, ["episode_id", "name"], "left_semi")
    sequence = F.lit(0).cast("bigint")
    made = frames.select("episode_id", F.col("name").alias("topic"), F.lit("foxglove.CompressedImage").alias("schema_name"), F.col("pts").alias("log_time"), F.col("pts").alias("publish_time"), sequence.alias("sequence"), "data")
    made = encode_compressed_images(made, "data", "publish_time", image_format)
    kept = messages_.select("episode_id", "topic", "schema_name", "log_time", "publish_time", "sequence", "data")
    return kept.unionByName(made), attachments_.where(~is_video)
