"""Container files read by their indexes: summaries from the files' ends, then only the byte ranges that a question needs.

``survey`` reads the summaries: one small table with a row per channel, schema, chunk, attachment and metadata record. Questions about
names, counts and lengths stop there. ``messages`` selects chunks by topic and time in that table, deals runs of neighbouring chunks to
tasks by their bytes, and reads those: a file of any size, beyond 2 GB too, is read by many tasks, a chunk at a time. Attachments and
metadata records are read by their own ranges.

Files are opened through Arrow (local paths, S3, GCS, HDFS where its library is there). For stores that only Spark can open there is
``sources.episodes.read_bytes``, which reads files whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratalog import model
from stratalog.sources import mcap_format as mf

#: Bytes of a file whose chunks are read by one task, about, and of messages in a batch.
RUN_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Frames that a video announces but does not hold and that repeat its last one, at most.
FRAME_TOLERANCE = 5
#: What the index of files says; ``kind`` is channel, schema, chunk, attachment or metadata.
INDEX = (
    "episode_id string, kind string, id int, name string, encoding string, schema_id int, schema_name string, metadata map<string,string>, data binary, n bigint, "
    "offset bigint, length bigint, index_length bigint, start_time bigint, end_time bigint, channels map<int,struct<topic:string,schema_name:string>>, create_time bigint, size bigint"
)


#: Schemes of stores that Arrow opens by ranges.
SCHEMES = ("file", "s3", "gs", "gcs", "hdfs")


def by_ranges(path: str) -> bool:
    """Whether files there can be opened by ranges; others are read whole, by Spark."""
    return ":" not in path.split("/", 1)[0] or path.split(":", 1)[0] in SCHEMES


def open_ranges(uri: str) -> mf.Ranges:
    """A file's byte ranges, by a path or URI."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        system, path = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
    else:
        system, path = fs.FileSystem.from_uri(uri)
    source = system.open_input_file(path)
    return mf.Ranges(source, source.size())


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(episode_id, size) of container files; a path is a file or a directory of them. Contents are not read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mcap").load(paths)
    return files.select(F.col("path").alias("episode_id"), F.col("length").alias("size"))


def index_rows(episode: str, ranges: mf.Ranges) -> Iterator[dict[str, Any]]:
    """What a file's summary says, as rows of INDEX."""
    found = ranges.summary()
    schemas = {x.id: x for x in found if isinstance(x, mf.Schema)}
    channels = {x.id: x for x in found if isinstance(x, mf.Channel)}
    counts: dict[int, int] | None = next((x.channel_message_counts for x in found if isinstance(x, mf.Statistics)), None)
    if counts is None:  # a file that does not say has its messages counted
        counts = {}
        for x in found:
            if isinstance(x, mf.ChunkIndex):
                for channel, *_ in ranges.messages(x.offset, x.length, set(channels)):
                    counts[channel] = counts.get(channel, 0) + 1
    for s in schemas.values():
        yield {"kind": "schema", "id": s.id, "name": s.name, "encoding": s.encoding, "data": s.data}
    name_of = lambda c: schemas[c.schema_id].name if c.schema_id in schemas else None
    for c in channels.values():
        yield {"kind": "channel", "id": c.id, "name": c.topic, "encoding": c.message_encoding, "schema_id": c.schema_id, "schema_name": name_of(c), "metadata": list(c.metadata.items()), "n": counts.get(c.id, 0)}
    for x in found:
        if isinstance(x, mf.ChunkIndex):
            own = x.index_offsets or dict.fromkeys(channels, -1)  # an index that names no channels may hold any
            named = [(c, {"topic": channels[c].topic, "schema_name": name_of(channels[c])}) for c in own if c in channels]
            yield {"kind": "chunk", "offset": x.offset, "length": x.length, "index_length": x.index_length, "start_time": x.start_time, "end_time": x.end_time, "channels": named, "size": x.size}
        elif isinstance(x, mf.AttachmentIndex):
            yield {"kind": "attachment", "name": x.name, "encoding": x.media_type, "offset": x.offset, "length": x.length, "start_time": x.log_time, "end_time": x.log_time, "create_time": x.create_time, "size": x.size}
        elif isinstance(x, mf.MetadataIndex):
            yield {"kind": "metadata", "name": x.name, "offset": x.offset, "length": x.length}


def batches_of(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, cut by their number and, by the column ``weight``, their bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 if weight is None else 64 + len(row[weight] or b"")
        if size >= BATCH_BYTES:
            yield _columns(held, schema)
            held, size = [], 0
    if held:
        yield _columns(held, schema)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def survey(files: DataFrame) -> DataFrame:
    """INDEX of the files, from their summaries alone."""
    schema = _arrow(INDEX)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for episode in batch.column("episode_id").to_pylist():
                    for row in index_rows(episode, open_ranges(episode)):
                        yield tuple(row.get(f.name, episode if f.name == "episode_id" else None) for f in schema)

        yield from batches_of(rows(), schema, schema.get_field_index("data"))

    return files.select("episode_id").mapInArrow(read, INDEX)


def channels(index: DataFrame) -> DataFrame:
    """All channels, those without messages too."""
    own = index.where("kind = 'channel'")
    return own.select("episode_id", F.col("id").alias("channel_id"), F.col("name").alias("topic"), F.col("encoding").alias("message_encoding"), "schema_id", "metadata")


def schemas(index: DataFrame) -> DataFrame:
    return index.where("kind = 'schema'").select("episode_id", F.col("id").alias("schema_id"), "name", "encoding", "data")


def counts(index: DataFrame) -> DataFrame:
    """(episode_id, topic, n); channels of one topic are summed, channels without messages count 0."""
    return index.where("kind = 'channel'").groupBy("episode_id", F.col("name").alias("topic")).agg(F.sum("n").alias("n"))


def attachment_names(index: DataFrame) -> DataFrame:
    """(episode_id, name, media_type, create_time, log_time, size): attachments without their bytes."""
    own = index.where("kind = 'attachment'")
    return own.select("episode_id", "name", F.col("encoding").alias("media_type"), "create_time", F.col("start_time").alias("log_time"), "size")


def chunks(index: DataFrame, topics: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """The chunks that hold messages of any of the topics and may hold some of these times."""
    own = index.where("kind = 'chunk'")
    if topics is not None:
        own = own.where(F.exists(F.map_values("channels"), lambda c: c["topic"].isin(topics)))
    if start is not None:
        own = own.where(F.col("end_time") >= start)
    return own if end is None else own.where(F.col("start_time") <= end)


def _in_runs(own: DataFrame, index: DataFrame) -> DataFrame:
    """Ranges dealt to tasks in runs of neighbours; how many tasks follows from their bytes."""
    total = own.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // RUN_BYTES))
    run = F.expr(f"offset div {RUN_BYTES}")
    return own.repartition(int(tasks), "episode_id", run).sortWithinPartitions("episode_id", "offset")


def messages(index: DataFrame, topics: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Messages of some topics (None: all) and log times from ``start`` to ``end``; other chunks are not read."""
    wanted, schema = None if topics is None else set(topics), _arrow(model.MESSAGES)
    dealt = _in_runs(chunks(index, topics, start, end).select("episode_id", "offset", "length", "index_length", "channels"), index)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            path, ranges = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["episode_id"] != path:
                        path, ranges = r["episode_id"], open_ranges(r["episode_id"])
                    of = dict(r["channels"])
                    own = {c for c, x in of.items() if wanted is None or x["topic"] in wanted}
                    whole = 0 if len(own) == len(of) else r["index_length"] or 0
                    for channel, sequence, log_time, publish_time, data in ranges.messages(r["offset"], r["length"], own, start, end, whole):
                        yield path, channel, of[channel]["topic"], of[channel]["schema_name"], log_time, publish_time, sequence, bytes(data)

        yield from batches_of(rows(), schema, 7)

    return dealt.mapInArrow(read, model.MESSAGES)


def _records(index: DataFrame, kind: str, names: list[str] | None, ddl: str, row: Any, weight: int | None) -> DataFrame:  # noqa: ANN401
    own = index.where(F.col("kind") == kind).select("episode_id", "name", "offset", "length")
    if names is not None:
        own = own.where(F.col("name").isin(names))
    schema = _arrow(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            path, ranges = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["episode_id"] != path:
                        path, ranges = r["episode_id"], open_ranges(r["episode_id"])
                    yield row(path, ranges.record(r["offset"], r["length"]))

        yield from batches_of(rows(), schema, weight)

    return _in_runs(own, index).mapInArrow(read, ddl)


def attachments(index: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Attachments with their bytes, all or some names."""
    return _records(index, "attachment", names, model.ATTACHMENTS, lambda e, a: (e, a.name, a.media_type, a.create_time, a.log_time, a.data), 5)


def metadata(index: DataFrame) -> DataFrame:
    return _records(index, "metadata", None, model.METADATA, lambda e, m: (e, m.name, list(m.metadata.items())), None)


def bytes_read(index: DataFrame, topics: list[str] | None = None, start: int | None = None, end: int | None = None) -> int:
    """Bytes of the chunks that a question reads."""
    return chunks(index, topics, start, end).agg(F.sum("length")).first()[0] or 0


# ---- writing

#: Kinds of parts in the order in which they lie in a file.
_SCHEMA, _CHANNEL, _CHUNK, _ATTACHMENT, _METADATA = range(5)
_PARTS = (
    "episode_id string, kind int, place bigint, name string, encoding string, data binary, schema_name string, metadata map<string,string>, indexes map<int,binary>, counts map<int,bigint>, "
    "start_time bigint, end_time bigint, compressed_size bigint, size bigint, create_time bigint"
)


def registry(messages_: DataFrame, channels_: DataFrame | None = None, schemas_: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(schemas, channels) of files to be written, numbered anew by name: those given, and what the messages need besides.

    ``schemas_`` (episode_id, name, encoding, data) and ``channels_`` (episode_id, topic, schema_name, message_encoding, metadata) may hold
    names that no message uses. Of several entries of one name in an episode the first by content stays.
    """
    from pyspark.sql import Window

    from stratalog.functions.columns import guard

    used = messages_.select("episode_id", "topic", "schema_name").distinct()
    own = used.groupBy("episode_id", "topic").agg(F.min("schema_name").alias("schema_name"), F.count("schema_name").alias("kinds"))
    own = own.where(guard(F.col("kinds") <= 1, "a topic has two schemas")).select("episode_id", "topic", "schema_name", F.lit("flatbuffer").alias("message_encoding"), F.expr("cast(map() as map<string,string>)").alias("metadata"), F.lit(1).alias("late"))
    if channels_ is not None:
        own = channels_.select("episode_id", "topic", "schema_name", "message_encoding", "metadata", F.lit(0).alias("late")).unionByName(own)
    entry = F.struct("late", F.array_sort(F.map_entries("metadata")).alias("rank"), "message_encoding", "schema_name", "metadata")
    first = own.groupBy("episode_id", "topic").agg(F.min_by(F.struct("schema_name", "message_encoding", "metadata"), entry.dropFields("metadata")).alias("c")).select("episode_id", "topic", "c.*")
    numbered = first.withColumn("channel_id", F.row_number().over(Window.partitionBy("episode_id").orderBy("topic")))
    named = first.where("schema_name is not null").select("episode_id", F.col("schema_name").alias("name"), F.lit("flatbuffer").alias("encoding"), F.lit(b"").alias("data"), F.lit(1).alias("late"))
    if schemas_ is not None:
        named = schemas_.select("episode_id", "name", "encoding", F.coalesce("data", F.lit(b"")).alias("data"), F.lit(0).alias("late")).unionByName(named)
    kept = named.groupBy("episode_id", "name").agg(F.min(F.struct("late", "encoding", "data")).alias("s")).select("episode_id", "name", "s.encoding", "s.data")
    return kept.withColumn("schema_id", F.row_number().over(Window.partitionBy("episode_id").orderBy("name"))), numbered


def file_parts(
    messages_: DataFrame, channels_: DataFrame | None = None, schemas_: DataFrame | None = None, attachments_: DataFrame | None = None, metadata_: DataFrame | None = None, compression: str = "zstd", chunk_bytes: int = 4 << 20
) -> DataFrame:
    """The parts of files, a chunk or another record a row: chunks are built by many tasks, each of one topic in order of time.

    An episode's topic is dealt in runs of time, so a long episode's chunks are built in parallel too.
    """
    kept, numbered = registry(messages_, channels_, schemas_)
    schema = _arrow(_PARTS)
    ids = numbered.select("episode_id", "topic", "channel_id")
    rows = messages_.select("episode_id", "topic", "log_time", "publish_time", "sequence", "data").join(ids, ["episode_id", "topic"])
    tasks = max(messages_.sparkSession.sparkContext.defaultParallelism, int(messages_.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(tasks, "episode_id", "channel_id", "log_time", "sequence").sortWithinPartitions("episode_id", "channel_id", "log_time", "sequence")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk_rows() -> Iterator[tuple]:
            key, open_ = None, None
            for batch in batches:
                for e, c, t, p, s, d in zip(*(batch.column(n).to_pylist() for n in ("episode_id", "channel_id", "log_time", "publish_time", "sequence", "data")), strict=True):
                    if open_ is not None and ((e, c) != key or open_.size >= chunk_bytes):
                        yield _part(key[0], open_.build())
                        open_ = None
                    if open_ is None:
                        key, open_ = (e, c), mf.ChunkBuilder(compression)
                    open_.add(c, s, t, p, d or b"")
            if open_ is not None:
                yield _part(key[0], open_.build())

        def _part(episode: str, c: mf.Chunk) -> tuple:
            row = {"episode_id": episode, "kind": _CHUNK, "place": c.start_time, "name": f"{min(c.counts):05d}", "encoding": c.compression, "data": c.record, "indexes": list(c.indexes.items()), "counts": list(c.counts.items()), "start_time": c.start_time, "end_time": c.end_time, "compressed_size": c.compressed_size, "size": c.size}
            return tuple(row.get(f.name) for f in schema)

        yield from batches_of(chunk_rows(), schema, schema.get_field_index("data"))

    parts = dealt.mapInArrow(build, _PARTS)
    others = [
        kept.select("episode_id", F.lit(_SCHEMA).alias("kind"), F.col("schema_id").cast("bigint").alias("place"), "name", "encoding", "data"),
        numbered.select("episode_id", F.lit(_CHANNEL).alias("kind"), F.col("channel_id").cast("bigint").alias("place"), F.col("topic").alias("name"), F.col("message_encoding").alias("encoding"), "schema_name", "metadata"),
    ]
    if attachments_ is not None:
        others.append(attachments_.select("episode_id", F.lit(_ATTACHMENT).alias("kind"), F.col("log_time").alias("place"), "name", F.col("media_type").alias("encoding"), "data", F.col("log_time").alias("start_time"), "create_time"))
    if metadata_ is not None:
        others.append(metadata_.select("episode_id", F.lit(_METADATA).alias("kind"), F.lit(0).cast("bigint").alias("place"), "name", "metadata"))
    for other in others:
        parts = parts.unionByName(other, allowMissingColumns=True)
    return parts


class FileWriter:
    """Parts of one file in their order, written as they come."""

    def __init__(self, out: Any) -> None:  # noqa: ANN401
        self._writer = mf.Writer(out=out)

    def add(self, r: dict[str, Any]) -> None:
        w = self._writer
        if r["kind"] == _SCHEMA:
            w.register_schema(r["name"], r["encoding"], r["data"])
        elif r["kind"] == _CHANNEL:
            w.register_channel(r["name"], r["schema_name"], message_encoding=r["encoding"], metadata=dict(r["metadata"] or ()))
        elif r["kind"] == _CHUNK:
            w.add_chunk(mf.Chunk(r["data"], dict(r["indexes"]), dict(r["counts"]), r["start_time"], r["end_time"], r["encoding"], r["compressed_size"], r["size"]))
        elif r["kind"] == _ATTACHMENT:
            w.add_attachment(mf.Attachment(r["start_time"], r["create_time"], r["name"], r["encoding"], r["data"]))
        else:
            w.add_metadata(mf.Metadata(r["name"], dict(r["metadata"] or ())))

    def finish(self) -> int:
        self._writer.finish()
        return self._writer.size


def dealt_parts(parts: DataFrame) -> DataFrame:
    """Parts of each episode in one partition, in their order in the file."""
    return parts.repartition("episode_id").sortWithinPartitions("episode_id", "kind", "place", "name")


def save(parts: DataFrame, directory: str) -> DataFrame:
    """Write file_parts() through the ``episodes`` data source to directory/episode_id; the index of what lies there."""
    from stratalog.sources import datasource

    datasource.register(parts.sparkSession)
    dealt_parts(parts).write.format("episodes").mode("append").save(directory)
    return survey(list_files(parts.sparkSession, directory))


def convert(spark: SparkSession, paths: str | list[str], directory: str, codec: Any = None, image_format: str = "jpeg", compression: str = "zstd") -> DataFrame:  # noqa: ANN401
    """Convert files into others of the same names in a directory, video attachments into channels of compressed images; the new index.

    All else stays: schemas with their bytes, channels with their encoding and metadata, also those without messages, other attachments and
    metadata records. Numbers of schemas and channels are given out anew, by name. Without a ``codec`` videos stay attachments.
    """
    from stratalog.sources import episodes
    from stratalog.sources.video import decode_streams

    index = survey(list_files(spark, paths))
    named = lambda df: df.withColumn("episode_id", F.element_at(F.split("episode_id", "/"), -1))
    own, items = named(messages(index)), named(attachments(index))
    kept = named(index.where("kind = 'channel'").select("episode_id", F.col("name").alias("topic"), "schema_name", F.col("encoding").alias("message_encoding"), "metadata"))
    if codec is not None:
        video = items.where(F.col("media_type") == "video/mp4")
        frames = decode_streams(video.select(F.struct("episode_id", "name").alias("stream"), "data"), codec, tolerance=FRAME_TOLERANCE, ensure_base_stamp=False)
        frames = frames.select("stream.episode_id", "stream.name", "pts", "data")
        own, items = episodes.convert_videos(own, items, frames, image_format)
    return save(file_parts(own, kept, named(schemas(index)), items, named(metadata(index)), compression), directory)
