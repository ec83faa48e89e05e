"""The dataset API over container files, and the streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from stratalog import model
from stratalog.functions.payload import decode_columns, encode_float_arrays
from stratalog.operators import assemble as asm
from stratalog.operators import stamps as st
from stratalog.plans.dataset import DatasetConfig, EpisodeDataset, IterableDataset, Levels, SampleDataset
from stratalog.sources import episodes as src
from stratalog.sources import mcap_format as mf
from stratalog.sources.video import RawCodec
from stratalog.streaming import assembly


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Two aligned episodes with a JSON attachment of the same length."""
    d = tmp_path_factory.mktemp("episodes")
    rows = []
    for e, n in (("e0.mcap", 4), ("e1.mcap", 3)):
        for i in range(n):
            for j, topic in enumerate(("/arm", "/eef")):
                rows.append((e, topic, "FloatArray", 10 * i + j, 10 * i + j, i, [float(i), float(j)]))
    m = spark.createDataFrame(rows, "episode_id string, topic string, schema_name string, log_time bigint, publish_time bigint, sequence bigint, v array<float>")
    m = m.withColumn("data", encode_float_arrays("v")).drop("v")
    a = spark.createDataFrame([(e, "log_stamps", "application/json", 1, 1, bytearray(json.dumps(list(range(n))).encode())) for e, n in (("e0.mcap", 4), ("e1.mcap", 3))], model.ATTACHMENTS)
    assert src.save_files(src.to_files(m, a), str(d)).count() == 2
    (d / "notes.txt").write_text("x")
    return str(d)


def test_listing(spark, root):
    assert src.list_items(spark, root, "mcap") == src.list_items(spark, root, ".mcap") == ["e0.mcap", "e1.mcap"]
    assert "notes.txt" in src.list_items(spark, root, ".")
    assert src.list_items(spark, root, "") == []
    assert src.list_items(spark, root + "/none", ".mcap") == []
    assert src.list_items(spark, root, "mcap", True)[0] == f"{root}/e0.mcap"
    with pytest.raises(ValueError):
        src.episode_files(spark, root + "/none")
    assert src.episode_files(spark, root).count() == 2


def test_sources(spark, root):
    files = src.read_bytes(spark, root)
    assert src.messages(files).count() == 14
    assert src.messages(files, ["/arm"]).count() == 7
    assert src.channels(files).count() == 4
    assert src.schemas(files).count() == 2
    assert src.metadata(files).count() == 0
    assert {r.n for r in src.counts(files).collect()} == {3, 4}
    assert src.schema_ids(src.messages(files)).count() == 2


def test_episode_dataset(spark, root):
    ds = EpisodeDataset(spark, DatasetConfig(root, topics=None, attachments=None, rearrange=Levels(episode="sort", dataset="none")))
    assert ds.all_files == {root: ["e0.mcap", "e1.mcap"]}
    assert len(ds) == 7
    rows = list(ds)
    assert [r["/arm"][0] for r in rows] == [0, 1, 2, 3, 0, 1, 2]
    assert [r["log_stamps"] for r in rows] == ["0", "1", "2", "3", "0", "1", "2"]
    assert ds[-1]["/arm"][0] == 2
    with pytest.raises(IndexError):
        ds[7]
    one = EpisodeDataset(spark, DatasetConfig(root, topics=["/arm"], attachments=[], keys=["/eef"], slices=Levels(dataset={root: [1]}), rearrange=Levels(episode="sort", dataset="none")))
    assert len(one) == 3
    halves = [EpisodeDataset(spark, DatasetConfig(root, topics=["/arm"], attachments=[], strict=False, world_size=2, rank=r, filter_fn=F.col("sample_idx") >= 0, cache=True)) for r in range(2)]
    assert sum(map(len, halves)) == 7
    assert halves[0][0] is not None
    for h in halves:
        h.close()
        h.close()
    none = EpisodeDataset(spark, DatasetConfig(root))
    assert len(none) == 7


def test_sample_dataset(spark, root):
    ds = SampleDataset(spark, DatasetConfig(f"{root}/e0.mcap", topics=["/arm"], attachments=[], rearrange=Levels(episode="reverse", dataset="none"), strict=False))
    assert [r["/arm"][0] for r in ds] == [3, 2, 1, 0]
    for bad in (root, [f"{root}/e0.mcap", f"{root}/e1.mcap"]):
        with pytest.raises(ValueError):
            SampleDataset(spark, DatasetConfig(bad))
    with pytest.raises(ValueError):
        SampleDataset(spark, DatasetConfig(f"{root}/e0.mcap", rearrange=Levels(episode="sort", dataset="none")))


def test_config_errors(spark, root):
    for bad in ({"world_size": 0}, {"rank": 1}, {"slices": Levels(sample=[1])}, {"rearrange": Levels(episode="x", dataset="none")}, {"rearrange": Levels(episode="none", dataset="reverse")}):
        with pytest.raises(ValueError):
            DatasetConfig(root, **bad)
    with pytest.raises(ValueError):
        EpisodeDataset(spark, DatasetConfig(root + "/none"))
    with pytest.raises(NotImplementedError):
        len(IterableDataset(spark, DatasetConfig(root)))
    read = lambda s, c: s.range(5).select(F.lit(1).alias("episode_id"), F.col("id").alias("sample_idx"))
    with IterableDataset(spark, DatasetConfig("", shuffle_buffer_size=2, seed=1), read) as ds:
        assert sorted(r.sample_idx for r in ds) == list(range(5))
        assert ds.batches(2, "sample_idx").count() == 3


def test_dataset_with_a_camera(spark, tmp_path):
    """Vectors, a camera and JSON stamps of each file, zipped; the joins to episode names are by equality."""
    rows = [(f"{i}a.mcap", "/arm", "FloatArray", 10 * j, 10 * j, j, [float(i), float(j)]) for i in range(2) for j in range(4 - i)]
    rows += [("a.mcap", "/arm", "FloatArray", 0, 0, 0, [9.0, 9.0])]  # its name ends those of the others
    m = spark.createDataFrame(rows, "episode_id string, topic string, schema_name string, log_time bigint, publish_time bigint, sequence bigint, v array<float>")
    m = m.withColumn("data", encode_float_arrays("v")).drop("v")
    lengths = {"0a.mcap": 4, "1a.mcap": 3, "a.mcap": 1}
    a = [(e, "/camera", "video/mp4", 1, 1, bytearray(RawCodec().encode(iter([(7 * j, f"{e}{j}".encode()) for j in range(n)]), "", 1_000_000_000))) for e, n in lengths.items()]
    a += [(e, "stamps", "application/json", 1, 1, bytearray(json.dumps(list(range(n))).encode())) for e, n in lengths.items()]
    src.save_files(src.to_files(m, spark.createDataFrame(a, model.ATTACHMENTS)), str(tmp_path)).count()
    with EpisodeDataset(spark, DatasetConfig(str(tmp_path), topics=["/arm"], attachments=["/camera", "stamps"], rearrange=Levels(episode="sort", dataset="none"))) as ds:
        got = list(ds)
        assert len(got) == 8 and "NestedLoop" not in ds.frame._jdf.queryExecution().executedPlan().toString()
    for r in got:
        name = r.episode_id.rpartition("/")[2]
        assert (bytes(r["/camera"].data).decode(), r["/camera"].pts, r["stamps"]) == (f"{name}{r.sample_idx}", 7 * r.sample_idx, str(r.sample_idx))
        assert list(r["/arm"]) == ([9.0, 9.0] if name == "a.mcap" else [float(name[0]), float(r.sample_idx)])


def test_index_into_a_filtered_dataset(spark, monkeypatch):
    from stratalog.plans import dataset

    monkeypatch.setattr(dataset, "LOOKUP_BLOCK", 8)
    read = lambda s, c: s.range(100).select(F.lit(1).alias("episode_id"), F.col("id").alias("sample_idx"))
    ds = IterableDataset(spark, DatasetConfig("", filter_fn=F.col("sample_idx") % 7 == 3), read)
    want = [i for i in range(100) if i % 7 == 3]
    assert [ds[i].sample_idx for i in (0, 5, -1, -4, len(want) - 1)] == [want[i] for i in (0, 5, -1, -4, len(want) - 1)]
    for i in (len(want), -len(want) - 1):
        with pytest.raises(IndexError):
            ds[i]


def test_convert(spark, root):
    files = src.read_bytes(spark, root)
    m, a = src.messages(files), src.attachments(files)
    video = a.withColumn("media_type", F.lit("video/mp4"))
    frames = a.select("episode_id", "name", F.lit(5).cast("bigint").alias("pts"), F.lit(b"jpg").alias("data"))
    out, rest = src.convert_videos(m, video, frames)
    assert out.count() == 16 and rest.count() == 0
    notes = spark.createDataFrame([("e0.mcap", "robot", {"arm": "left"})], model.METADATA)
    notes = notes.withColumn("episode_id", F.lit(files.select("episode_id").orderBy("episode_id").first()[0]))
    back = src.to_files(out, metadata_=notes)
    assert [(r.name, r.metadata) for r in src.metadata(back).collect()] == [("robot", {"arm": "left"})]
    images = decode_columns(src.messages(back, ["log_stamps"]).select("episode_id", "data"), {"data": "foxglove.CompressedImage"}).collect()
    assert [(r.data["format"], bytes(r.data["data"]), r.data["sec"], r.data["nsec"]) for r in images] == [("jpeg", b"jpg", 0, 5)] * 2
    again = src.messages(src.to_files(out))
    assert again.where("topic = 'log_stamps'").select("schema_name").distinct().first()[0] == "foxglove.CompressedImage"


def _stream(spark, df, tmp_path, parts):
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    schema = df.drop("part").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))


def _drain(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_assembly_stream_is_batch(spark, sf, tmp_path):
    log = model.msg_log(spark, sf)
    parted = log.withColumn("part", F.floor(F.percent_rank().over(__import__("pyspark").sql.Window.orderBy("log_time")) * 2.999).cast("int"))
    _drain(assembly.assemble_stream(_stream(spark, parted, tmp_path, 3), ["click", "view"]), "s1", "append", tmp_path)
    want = asm.assemble(log, ["click", "view"])
    got = spark.table("s1")
    assert got.count() == want.count() == 132
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_monotonic_stream_is_batch(spark, sf, tmp_path):
    stamps = model.stamps(spark, sf)
    parted = stamps.withColumn("part", F.floor(F.percent_rank().over(__import__("pyspark").sql.Window.orderBy("idx")) * 2.999).cast("int"))
    _drain(assembly.monotonic_stream(_stream(spark, parted, tmp_path, 3), 1000), "s2", "append", tmp_path)
    want = st.monotonic(stamps, 1000)
    assert spark.table("s2").exceptAll(want.select(*spark.table("s2").columns)).count() == 0
    assert spark.table("s2").count() == want.count()


def test_scrolling(spark, tmp_path):
    points = spark.range(30).select(F.col("id").alias("t"), F.lit("f").alias("field"), F.lit(0).cast("bigint").alias("index"), F.col("id").cast("double").alias("value"), (F.col("id") / 10).cast("int").alias("part"))
    _drain(assembly.scrolling_buffers(_stream(spark, points, tmp_path, 3), 4), "s3", "update", tmp_path)
    assert max(spark.table("s3").collect(), key=lambda r: r.t[-1])["values"] == [26.0, 27.0, 28.0, 29.0]


def test_a_file_is_built_from_parts_of_its_rows(spark, monkeypatch):
    """Python objects of 10,000 rows at a time: a file of metadata records costs little beside its bytes, built and read."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    made, n = [], 60_000
    notes = spark.createDataFrame([], model.METADATA)
    with monkeypatch.context() as m:
        m.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: made.append(f))
        src.to_files(spark.createDataFrame([], model.MESSAGES), metadata_=notes)
    empty = {"topic": pa.string(), "schema_name": pa.string(), "log_time": pa.int64(), "publish_time": pa.int64(), "sequence": pa.int64(), "data": pa.binary()}
    names = [f"note {i * 7919 % n:06d}" for i in range(n)]
    own = {"episode_id": ["e"] * n, **{c: pa.nulls(n, k) for c, k in empty.items()}, "meta": names, "metadata": pa.array([[("key", str(i))] for i in range(n)], pa.map_(pa.string(), pa.string()))}
    extra = {"episode_id": pa.string(), "name": pa.string(), "media_type": pa.string(), "create_time": pa.int64(), "log_time": pa.int64(), "data": pa.binary()}
    tracemalloc.start()
    file = made[0](pa.table(own), pa.table({c: pa.array([], k) for c, k in extra.items()})).column("content")[0].as_py()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(f"peak {peak / 1e6:.1f} MB of {n} records, file {len(file) / 1e6:.1f} MB")
    found = list(mf.read_records(memoryview(file)))
    assert [r.name for r in found] == sorted(names) and found[1].metadata == {"key": str(names.index(found[1].name))}
    assert peak < 25e6
