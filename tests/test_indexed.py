"""Container files by their indexes: ranges, push-down, writing with commit and abort, conversion, streams."""

import io
import os
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from stratalog import convert, model
from stratalog.functions.payload import decode_columns, encode_float_arrays
from stratalog.plans.dataset import DatasetConfig, EpisodeDataset, Levels
from stratalog.sources import datasource, indexed
from stratalog.sources import mcap_format as mf
from stratalog.sources.video import RawCodec


def in_memory(data):
    return mf.Ranges(pa.BufferReader(data), len(data))


def built(rows, by_topic=True, chunk_bytes=200, compression="zstd"):
    w = mf.Writer(compression, chunk_bytes=chunk_bytes, by_topic=by_topic)
    for topic in dict.fromkeys(r[0] for r in rows):
        w.register_channel(topic, "s")
    w.register_channel("silent", None, metadata={"k": "v"})
    for i, (topic, t, data) in enumerate(rows):
        w.add_message(topic, data, t, t + 1, i)
    w.add_attachment(mf.Attachment(1, 2, "a", "text/plain", b"abc"))
    w.add_metadata(mf.Metadata("m", {"x": "y"}))
    return w.finish()


def stripped(data):
    """The same file without a summary."""
    records = list(mf._records(data, 8, len(data) - 8))
    at, kept = 8, data[:8]
    for opcode, body in records:
        size = 9 + len(body)
        if opcode == mf.FOOTER:
            kept += mf._record(mf.FOOTER, struct.pack("<QQI", 0, 0, 0))
        elif at < _end_of_data(data):
            kept += data[at : at + size]
        at += size
    return kept + mf.MAGIC


def _end_of_data(data):
    at = 8
    for opcode, body in mf._records(data, 8, len(data) - 8):
        at += 9 + len(body)
        if opcode == mf.DATA_END:
            return at
    raise AssertionError


ROWS = hs.lists(hs.tuples(hs.sampled_from("abc"), hs.integers(0, 50), hs.binary(max_size=40)), max_size=60)


@settings(max_examples=60, deadline=None)
@given(ROWS, hs.booleans(), hs.sets(hs.sampled_from("abc")), hs.integers(0, 50), hs.integers(0, 50), hs.booleans())
def test_ranges_give_what_a_scan_gives(rows, by_topic, topics, start, end, bare):
    data = built(rows, by_topic)
    data = stripped(data) if bare else data
    ranges = in_memory(data)
    summary = ranges.summary()
    own = {c.id: c.topic for c in summary if isinstance(c, mf.Channel) and c.topic in topics}
    got = []
    for x in summary:
        if isinstance(x, mf.ChunkIndex) and (not x.index_offsets or set(own) & set(x.index_offsets)) and x.end_time >= start and x.start_time <= end:
            got += [(own[c], t, bytes(d), s) for c, s, t, _, d in ranges.messages(x.offset, x.length, set(own), start, end, x.index_length)]
    assert sorted(got) == sorted((t, at, d, i) for i, (t, at, d) in enumerate(rows) if t in topics and start <= at <= end)
    assert [ranges.record(x.offset, x.length) for x in summary if isinstance(x, mf.AttachmentIndex)] == [mf.Attachment(1, 2, "a", "text/plain", b"abc")]
    assert [ranges.record(x.offset, x.length).metadata for x in summary if isinstance(x, mf.MetadataIndex)] == [{"x": "y"}]
    assert [c.metadata for c in summary if isinstance(c, mf.Channel) and c.topic == "silent"] == [{"k": "v"}]


def test_bytes_follow_the_topic():
    data = built([("a", i, b"x" * 1000) for i in range(900)] + [("b", i, b"y" * 1000) for i in range(100)], chunk_bytes=20_000, compression="")
    ranges = in_memory(data)
    summary = ranges.summary()
    after = ranges.taken
    assert after < len(data) / 50
    own = {c.id for c in summary if isinstance(c, mf.Channel) and c.topic == "b"}
    n = sum(1 for x in summary if isinstance(x, mf.ChunkIndex) and own & set(x.index_offsets) for _ in ranges.messages(x.offset, x.length, own, index_length=0))
    assert n == 100
    assert ranges.taken - after < len(data) * 0.12


def test_truncated_and_foreign_files():
    data = built([("a", 1, b"x")])
    for bad in (data[:-1], data[:40], b"", data[:-8] + b"12345678"):
        with pytest.raises(ValueError, match="complete|truncated"):
            in_memory(bad).summary()
    w = mf.Writer()
    w.register_channel("a", None)
    w.add_message("a", b"", 1, 1, (1 << 32) - 1)
    with pytest.raises(ValueError, match="32 bits"):
        w.add_message("a", b"", 1, 1, 1 << 32)


def test_messages_outside_of_chunks():
    head = mf.MAGIC + mf._record(mf.HEADER, mf._text("") * 2) + mf.Writer._channel(mf.Channel(1, 0, "a", "x"))
    rows = b"".join(mf._record(mf.MESSAGE, struct.pack("<HIQQ", 1, i, i, i) + b"d") for i in range(3))
    data = head + rows + mf._record(mf.DATA_END, struct.pack("<I", 0)) + mf._record(mf.FOOTER, struct.pack("<QQI", 0, 0, 0)) + mf.MAGIC
    ranges = in_memory(data)
    found = [x for x in ranges.summary() if isinstance(x, mf.ChunkIndex)]
    assert [m[1] for x in found for m in ranges.messages(x.offset, x.length, {1}, start=1)] == [1, 2]


def test_stream_of_bytes_is_the_file_in_memory():
    out = io.BytesIO()
    for target in (out, None):
        w = mf.Writer(out=target, chunk_bytes=50)
        w.register_channel("a", "s")
        for i in range(20):
            w.add_message("a", b"xyz", i, i, i)
        whole = w.finish()
    assert out.getvalue() == whole


# ---- Spark


@pytest.fixture
def messages(spark):
    rows = [(f"{e}.mcap", t, "log.x" if t != "plain" else None, i, i, i, f"{e}{t}{i}".encode()) for e in range(3) for t in ("a", "b", "plain") for i in range(40)]
    return spark.createDataFrame(rows, "episode_id string, topic string, schema_name string, log_time bigint, publish_time bigint, sequence bigint, data binary")


def rows_of(df):
    return sorted((r.episode_id.rsplit("/", 1)[-1], r.topic, r.schema_name, r.log_time, r.sequence, bytes(r.data)) for r in df.collect())


def test_round_trip_by_index(spark, messages, tmp_path):
    index = indexed.save(indexed.file_parts(messages, chunk_bytes=300), str(tmp_path / "out"))
    want = rows_of(messages)
    assert rows_of(indexed.messages(index)) == want
    some = [r for r in want if r[1] in ("a", "plain") and 5 <= r[3] <= 9]
    assert rows_of(indexed.messages(index, ["a", "plain"], 5, 9)) == some
    assert indexed.bytes_read(index, ["a"]) < indexed.bytes_read(index) / 2
    assert indexed.bytes_read(index, ["a"], 5, 9) < indexed.bytes_read(index, ["a"]) / 2
    assert {(r.topic, r.n) for r in indexed.counts(index).collect()} == {("a", 40), ("b", 40), ("plain", 40)}
    assert rows_of(indexed.messages(index, [])) == []
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith(".") and not f.endswith(".crc")]


def test_filters_reach_the_index(spark, messages, tmp_path):
    indexed.save(indexed.file_parts(messages, chunk_bytes=300), str(tmp_path))
    datasource.register(spark)
    read = spark.read.format("episodes").load(str(tmp_path))
    want = rows_of(messages)
    assert rows_of(read) == want
    assert rows_of(read.where("topic = 'b' and log_time > 30 and log_time <= 35")) == [r for r in want if r[1] == "b" and 30 < r[3] <= 35]
    assert rows_of(read.where(F.col("topic").isin("a", "b")).where("log_time = 7")) == [r for r in want if r[1] in "ab" and r[3] == 7]
    assert read.where("topic = 'nothing'").count() == 0
    reader = datasource.EpisodeReader({"path": str(tmp_path)})
    whole = sum(length for p in reader.partitions() for _, length, _ in p.parts)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    list(reader.pushFilters([EqualTo(("topic",), "b"), GreaterThan(("log_time",), 30), LessThanOrEqual(("log_time",), 35)]))
    assert sum(length for p in reader.partitions() for _, length, _ in p.parts) < whole / 6
    list(reader.pushFilters([In(("topic",), ("a",))]))
    assert [p.parts for p in reader.partitions()] == [[]]
    assert spark.read.format("episodes").option("topics", "a").option("start", "39").load(str(tmp_path)).count() == 3


def test_long_file_is_read_by_many_tasks(spark, messages, tmp_path, monkeypatch):
    index = indexed.save(indexed.file_parts(messages.where("episode_id = '0.mcap'"), chunk_bytes=200), str(tmp_path))
    monkeypatch.setattr(indexed, "RUN_BYTES", 500)
    read = indexed.messages(index)
    used = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 3 and read.count() == 120


def test_aborted_job_leaves_nothing(spark, messages, tmp_path):
    datasource.register(spark)
    parts = indexed.file_parts(messages, chunk_bytes=300)
    bad = indexed.dealt_parts(parts).withColumn("place", F.when(F.col("episode_id") == "2.mcap", F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("place")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("episodes").mode("append").save(str(tmp_path / "out"))
    assert [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")] == [] if (tmp_path / "out").exists() else True
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []
    split = parts.where("kind <> 0").repartition(4)
    with pytest.raises(Exception, match="two partitions|not in order"):
        split.write.format("episodes").mode("append").save(str(tmp_path / "split"))
    assert not [f for f in os.listdir(tmp_path / "split") if f.endswith(".mcap")]
    with pytest.raises(Exception, match="appended"):
        parts.write.format("episodes").mode("overwrite").save(str(tmp_path / "out"))


def test_conversion_keeps_registries_and_turns_videos(spark, messages, tmp_path):
    video = RawCodec().encode(iter([(10 * i, bytes([i]) * 4) for i in range(3)]), str({"base_stamp": 100}), 10**9)
    channels = spark.createDataFrame([("0.mcap", "silent", "log.x", "json", {"unit": "m"}), ("0.mcap", "a", "log.x", "cdr", {})], "episode_id string, topic string, schema_name string, message_encoding string, metadata map<string,string>")
    schemas = spark.createDataFrame([("0.mcap", "log.x", "fbs", b"\x00\x01"), ("0.mcap", "unused", "fbs", None)], "episode_id string, name string, encoding string, data binary")
    items = spark.createDataFrame([("0.mcap", "t", "text/plain", 1, 2, b"text"), ("1.mcap", "cam", "video/mp4", 3, 4, video)], model.ATTACHMENTS)
    notes = spark.createDataFrame([("0.mcap", "n", {"k": "v"})], model.METADATA)
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    indexed.save(indexed.file_parts(messages, channels, schemas, items, notes), first)
    index = indexed.convert(spark, first, second, compression="")
    assert rows_of(indexed.messages(index)) == rows_of(messages)
    own = {(r.topic, r.message_encoding, tuple(r.metadata.items())) for r in indexed.channels(index).where("episode_id like '%0.mcap'").collect()}
    assert own == {("silent", "json", (("unit", "m"),)), ("a", "cdr", ()), ("b", "flatbuffer", ()), ("plain", "flatbuffer", ())}
    assert {(r.name, r.encoding, bytes(r.data)) for r in indexed.schemas(index).where("episode_id like '%0.mcap'").collect()} == {("log.x", "fbs", b"\x00\x01"), ("unused", "fbs", b"")}
    assert sorted((r.name, bytes(r.data)) for r in indexed.attachments(index).collect()) == [("cam", video), ("t", b"text")]
    assert [(r.name, r.metadata) for r in indexed.metadata(index).collect()] == [("n", {"k": "v"})]
    third = indexed.convert(spark, second, str(tmp_path / "three"), RawCodec())
    images = indexed.messages(third, ["cam"])
    assert [(r.schema_name, r.log_time) for r in images.orderBy("log_time").collect()] == [("foxglove.CompressedImage", 100 + 10 * i) for i in range(3)]
    assert decode_columns(images, {"data": "foxglove.CompressedImage"}).orderBy("log_time").select("data.data").first()[0] == b"\x00" * 4
    assert [r.name for r in indexed.attachments(third).collect()] == ["t"]
    assert rows_of(indexed.messages(third).where("topic <> 'cam'")) == rows_of(messages)


def test_conversion_command(spark, messages, tmp_path, capsys):
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    index = indexed.save(indexed.file_parts(messages), first)
    convert.main([first, second, "--compression", "none"])
    assert "3 files" in capsys.readouterr().out
    assert rows_of(indexed.messages(indexed.survey(indexed.list_files(spark, second)))) == rows_of(indexed.messages(index))


def test_topic_with_two_schemas_raises(spark, messages, tmp_path):
    both = messages.withColumn("schema_name", F.concat(F.lit("s"), (F.col("sequence") % 2).cast("string")))
    with pytest.raises(Exception, match="two schemas"):
        indexed.save(indexed.file_parts(both), str(tmp_path))


def test_stream_repeats_no_file(spark, messages, tmp_path):
    datasource.register(spark)
    root, out, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    os.mkdir(root)

    def run():
        read = spark.readStream.format("episodes").load(root)
        q = read.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).start()
        q.processAllAvailable()
        q.stop()

    for n in range(3):
        indexed.save(indexed.file_parts(messages.where(F.col("episode_id") == f"{n}.mcap")), root)
        run()
        run()  # nothing new
        assert spark.read.schema(model.MESSAGES).parquet(out).count() == 120 * (n + 1)
    assert rows_of(spark.read.schema(model.MESSAGES).parquet(out)) == rows_of(messages)
    stream = datasource.EpisodeStream({"path": root})
    with pytest.raises(ValueError, match="arrived or went"):
        stream.partitions({"files": 1, "last": os.path.join(root, "1.mcap")}, stream.latestOffset())


def test_episodes_as_rows(spark, messages, tmp_path):
    indexed.save(indexed.file_parts(messages.withColumn("schema_name", F.lit("FloatArray")).withColumn("data", encode_float_arrays(F.array(F.col("log_time").cast("float"))))), str(tmp_path))
    config = DatasetConfig(str(tmp_path), topics=["a", "b"], rearrange=Levels(dataset="none", episode="sort", sample="none"), flatten=False)
    ds = EpisodeDataset(spark, config)
    assert len(ds) == ds.episode_count() == 3
    assert [len(e) for e in ds] == [40, 40, 40]
    assert ds[-1][5].a == [5.0] and ds[-1].all_files == {str(tmp_path): ["2.mcap"]}
    with pytest.raises(IndexError):
        ds[3]
    with pytest.raises(ValueError, match="rearranged"):
        DatasetConfig(str(tmp_path), rearrange=Levels("shuffle", "none", "none"))
