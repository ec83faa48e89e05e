"""Core operators against Python models, and their error paths."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from stratalog import model
from stratalog.functions import columns as col
from stratalog.functions import payload as pay
from stratalog.operators import assemble as asm
from stratalog.operators import catalog as cat
from stratalog.operators import pipeline as pipe
from stratalog.operators import series, zipping
from stratalog.operators import stamps as st
from stratalog.plans.slices import pick, resolve_slices, slice_indexes
from stratalog.sources import mcap_format as mf
from tests import models

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def log(spark, episodes):
    rows = [(e, t, i, i, float(v)) for e, seq in episodes.items() for i, (t, v) in enumerate(seq)]
    return spark.createDataFrame(rows, "episode_id bigint, topic string, log_time bigint, sequence bigint, value double")


def by_episode(df, topics):
    out = {}
    for r in df.orderBy("episode_id", "sample_idx").collect():
        out.setdefault(r.episode_id, []).append({t: r[t] for t in topics})
    return out


@few
@given(hs.dictionaries(hs.integers(0, 3), hs.lists(hs.tuples(hs.sampled_from("abc"), hs.integers(0, 99)), max_size=30), min_size=1))
def test_assemble_is_the_fold(spark, episodes):
    df = log(spark, episodes)
    for topics in (["a", "b"], ["a", "b", "c"]):
        want = {e: models.assemble(s, topics) for e, s in episodes.items()}
        assert by_episode(asm.assemble(df, topics), topics) == {e: s for e, s in want.items() if s}


def test_assemble_over_many_batches(spark):
    rng = random.Random(1)
    episodes = {e: [(rng.choice("abcd"), rng.randrange(100)) for _ in range(500)] for e in range(3)}
    df = log(spark, episodes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for reverse in (False, True):
            want = {e: models.assemble(s[::-1] if reverse else s, ["a", "b", "c"]) for e, s in episodes.items()}
            assert by_episode(asm.assemble(df, ["a", "b", "c"], reverse=reverse), ["a", "b", "c"]) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert by_episode(asm.assemble_in_columns(df, ["a", "b", "c"]), "abc") == {e: models.assemble(s, "abc") for e, s in episodes.items()}


def test_assemble_edges(spark):
    df = log(spark, {1: [("a", 1), ("a", 2), ("b", 3), ("b", 4)], 2: [("a", 1)]})
    assert by_episode(asm.assemble(df, ["a", "b", "a"]), "ab") == {1: [{"a": 2.0, "b": 3.0}]}
    assert asm.assemble(df, ["a", "z"]).count() == 0
    assert asm.assemble(df.limit(0), ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        asm.assemble(df, [])
    with pytest.raises(Exception, match="aligned"):
        asm.assemble(df, ["a", "b"], strict=True).collect()
    good = log(spark, {1: [("a", 1), ("b", 2), ("a", 3), ("b", 4)]})
    assert asm.assemble(good, ["a", "b"], strict=True).count() == 2


@pytest.mark.parametrize(
    ("spec", "want"),
    [((), []), (3, [0, 1, 2]), ((5, 8), [5, 6, 7]), ((5, 7, "s"), ["5s", "6s"]), ([(1, 4), (8, 10)], [1, 2, 3, 8, 9]), ([1, 2], [1, 2]), ([], []), ((4, 4), []), ([(0, 2, "a"), 7], ["0a", "1a", 7])],
)
def test_slices(spec, want):
    copy = list(spec) if isinstance(spec, list) else spec
    assert slice_indexes(spec) == want
    assert spec == copy


def test_slices_errors():
    for bad in ("x", (1,), (1, 2, 3, 4), ["x"], None):
        with pytest.raises(ValueError):
            slice_indexes(bad)
    assert resolve_slices({"r": 2}) == {"r": [0, 1]}
    assert resolve_slices([1]) == [1]
    assert resolve_slices(3) is None
    assert pick(["a", "b"], []) == ["a", "b"]
    assert pick(["a", "b"], [-1, 0, 0]) == ["b", "a", "a"]
    with pytest.raises(IndexError):
        pick(["a"], [1])
    with pytest.raises(TypeError):
        pick(["a"], ["0x"])


def test_catalog(spark):
    files = spark.createDataFrame([("r", f"f{i}") for i in range(5)] + [("s", "g")], "root string, file string")
    sliced = cat.episode_catalog(files, slices={"r": [4, 0, -1]})
    assert [r.file for r in sliced.where("root = 'r'").orderBy("pos").collect()] == ["f4", "f0", "f4"]
    assert sliced.where("root = 's'").count() == 1
    assert cat.episode_catalog(files, slices=[0]).count() == 2
    with pytest.raises(Exception, match="out of range"):
        cat.episode_catalog(files, slices={"r": [5]}).collect()
    with pytest.raises(TypeError):
        cat.episode_catalog(files, slices={"r": ["0x"]})
    with pytest.raises(ValueError):
        cat.episode_catalog(files, "sideways")
    with pytest.raises(Exception, match="no episodes"):
        cat.require_rows(files.limit(0), "no episodes").collect()
    shuffled = [r.file for r in cat.episode_catalog(files, cat.SHUFFLE, 7).where("root = 'r'").orderBy("pos").collect()]
    assert sorted(shuffled) == [f"f{i}" for i in range(5)]


def test_resolve_keys():
    assert cat.resolve_keys({"a", "b"}, {"v"}, ["v"], ["a"], []) == ({"a"}, {"v"})
    assert cat.resolve_keys({"a", "b"}, {"v"}) == ({"a", "b"}, {"v"})
    for args in (({"a"}, {"v"}, ["x"]), ({"a"}, {"a"}, ["a"]), ({"a"}, {"v"}, None, ["z"]), ({"a"}, {"v"}, None, None, ["z"])):
        with pytest.raises(ValueError):
            cat.resolve_keys(*args)


def test_ranks_cover_all_samples(spark, sf):
    numbered = pipe.number(model.samples(spark, sf), ["sample_id"])
    parts = [pipe.shard(numbered, 2, r, 2, w).select("sample_id") for r in range(2) for w in range(2)]
    total = parts[0]
    for p in parts[1:]:
        total = total.union(p)
    assert total.count() == total.distinct().count() == numbered.count()
    with pytest.raises(ValueError):
        pipe.shard(numbered, 0)


def test_pipeline_order(spark):
    df = spark.range(20).select(F.lit(1).alias("episode_id"), F.col("id"))
    out = pipe.run_pipeline(df, ["id"], world_size=2, rank=1, resume_from_sample=2, filter_fn=F.col("id") > 6, transform=lambda d: d.withColumn("x", F.col("id") * 2))
    assert [(r.id, r.x, r.pos) for r in out.orderBy("pos").collect()] == [(i, 2 * i, (i - 1) // 2 - 2) for i in range(7, 20, 2)]


def test_bounded_shuffle(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("episode_id"), "id")
    for size in (1, 4, 100):
        got = pipe.bounded_shuffle(df, size, 3, ["id"])
        for e in (0, 1):
            rows = [r.id for r in got.where(F.col("episode_id") == e).orderBy("out_pos").collect()]
            assert rows == [2 * i + e for i in models.bounded_shuffle(20, size, f"3:{e}")]
            assert all(rows.index(2 * i + e) >= i - size + 1 for i in range(20))
            if size == 1:
                assert rows == sorted(rows)


def test_batches(spark):
    df = spark.range(7).select(F.lit(1).alias("episode_id"), "id")
    assert [r["items"] for r in pipe.batches(df, 3, ["id"], "id").orderBy("batch_idx").collect()] == [[0, 1, 2], [3, 4, 5], [6]]
    with pytest.raises(Exception, match="short"):
        pipe.batches(df, 3, ["id"], "id", strict=True).collect()
    numbered = pipe.number(df, ["id"])
    assert [pipe.nth(numbered, i).first().id for i in (0, 6, -1, -7)] == [0, 6, 6, 0]
    assert pipe.nth(numbered, 7).first() is None


def test_zips(spark):
    items = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 1, "y"), (1, "b", 0, "z"), (1, "b", 1, "w")], "episode_id int, name string, idx bigint, item string")
    assert [(r.a, r.b) for r in zipping.zip_items(items, ["a", "b"]).orderBy("idx").collect()] == [("x", "z"), ("y", "w")]
    with pytest.raises(Exception, match="lengths"):
        zipping.zip_items(items.where("not (name = 'b' and idx = 1)"), ["a", "b"]).collect()
    with pytest.raises(Exception, match="lengths"):
        zipping.zip_items(items.union(items), ["a", "b"]).collect()
    a = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "episode_id int, sample_idx bigint, v int")
    with pytest.raises(Exception, match="lengths"):
        zipping.strict_zip(a, a.limit(1), ["episode_id", "sample_idx"]).collect()
    files = spark.createDataFrame([(1, "n", "application/json", bytearray(b'[1, {"a": 2}]')), (1, "o", "application/json", bytearray(b'{"k": 1, "l": 2}'))], "episode_id int, name string, media_type string, data binary")
    assert sorted((r.name, r.idx, r["item"]) for r in zipping.json_elements(files).collect()) == [("n", 0, "1"), ("n", 1, '{"a":2}'), ("o", 0, "k"), ("o", 1, "l")]
    for bad in (("application/json", b"3"), ("image/png", b"[]")):
        with pytest.raises(Exception, match="scalar|media"):
            zipping.json_elements(spark.createDataFrame([(1, "n", bad[0], bytearray(bad[1]))], files.schema)).collect()


@few
@given(hs.lists(hs.integers(1, 50), min_size=1, max_size=20), hs.integers(1, 9))
def test_monotonic(spark, stamps, delta):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(stamps)], "episode_id bigint, idx bigint, stamp bigint")
    assert [r.fixed for r in st.monotonic(df, delta).orderBy("idx").collect()] == models.monotonic(stamps, delta)
    assert [r.fixed for r in st.monotonic_unit(df).orderBy("idx").collect()] == models.monotonic(stamps, 1)


@few
@given(hs.lists(hs.integers(0, 60), min_size=1, max_size=10, unique=True), hs.lists(hs.integers(0, 70), min_size=1, max_size=8))
def test_nearest(spark, pts, targets):
    pts = sorted(pts)
    frames = spark.createDataFrame([(1, p, i) for i, p in enumerate(pts)], "episode_id int, pts bigint, n int")
    asked = spark.createDataFrame([(1, i, t) for i, t in enumerate(targets)], "episode_id int, target_id int, t bigint")
    got = {r.target_id: r.n for r in st.nearest_frames(asked, frames, ["n"]).collect()}
    assert got == {i: models.nearest(t, pts) for i, t in enumerate(targets)}


def test_padding_and_frames(spark):
    f = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "stream int, idx bigint, v string")
    want = spark.createDataFrame([(1, 4), (2, 1)], "stream int, expected bigint")
    assert sorted((r.stream, r.idx, r.v, r.padded) for r in st.pad_tail(f, want, 2).collect()) == [(1, 0, "a", False), (1, 1, "b", False), (1, 2, "b", True), (1, 3, "b", True), (2, 0, "c", False)]
    for tolerance, n in ((1, 4), (5, 1)):
        with pytest.raises(Exception, match="fit"):
            st.pad_tail(f, spark.createDataFrame([(1, n), (2, 1)], want.schema), tolerance).collect()
    assert st.select_frames(f, [0, 0]).count() == 2
    for bad in ([], [-1]):
        with pytest.raises(ValueError):
            st.select_frames(f, bad)
    with pytest.raises(Exception, match="range"):
        st.select_frames(f, [1]).collect()
    with pytest.raises(Exception, match="positive"):
        st.require_positive_start(spark.createDataFrame([(1, 0, 0)], "episode_id int, idx bigint, stamp bigint")).collect()
    assert st.repair_step() == 1_000_000
    assert st.repair_step(10) == 1


def test_float_array_bytes():
    for values in ([], [1.5], [0.1, -2.0, 3e8]):
        assert pay.decode_float_array(pay.encode_float_array(values)).tolist() == [float(x) for x in __import__("numpy").float32(values)]
    assert pay.decode_float_array(pay.encode_float_array(None)) is None
    flatbuffers = pytest.importorskip("flatbuffers")
    b = flatbuffers.Builder(64)
    b.StartVector(4, 2, 4)
    b.PrependFloat32(2.5)
    b.PrependFloat32(1.5)
    v = b.EndVector()
    b.StartObject(1)
    b.PrependUOffsetTRelativeSlot(0, v, 0)
    b.Finish(b.EndObject())
    assert pay.decode_float_array(bytes(b.Output())).tolist() == [1.5, 2.5]


def test_image_tables(spark):
    import numpy as np

    pixels = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    rows = [(pay.encode_raw_image(pixels, frame_id="cam"), pay.encode_compressed_image(b"jj", 1_500_000_000), pay.encode_float_array([1, 2])), (None, None, None)]
    df = spark.createDataFrame([tuple(None if x is None else bytearray(x) for x in r) for r in rows], "a binary, b binary, c binary")
    got = pay.decode_columns(df, {"a": "foxglove.RawImage", "b": "foxglove.CompressedImage", "c": "x.FloatArray"}).collect()
    assert (got[0].a.width, got[0].a.height, got[0].a.channels, got[0].a.encoding, got[0].a.frame_id) == (4, 2, 3, "8UC3", "cam")
    assert bytes(got[0].a.data) == pixels.tobytes()
    assert (got[0].b.sec, got[0].b.nsec, bytes(got[0].b.data)) == (1, 500_000_000, b"jj")
    assert got[0].c == [1.0, 2.0] and got[1].a is None
    with pytest.raises(KeyError):
        pay.decode_columns(df, {"a": "Other"})
    bad = spark.createDataFrame([(bytearray(pay.encode_compressed_image(b"x", 0, "png")),)], "b binary")
    with pytest.raises(Exception, match="jpeg"):
        pay.decode_columns(bad, {"b": "CompressedImage"}).collect()
    with pytest.raises(KeyError):
        pay.encode_raw_image(np.zeros((1, 1), dtype=np.int64))


def test_images(spark):
    for name, (channels, size, _) in pay.ENCODINGS.items():
        pixels = pay.decode_raw_image(2, 3, 2 * channels * size, name, bytes(6 * channels * size))
        assert pixels.shape == ((3, 2) if channels == 1 else (3, 2, channels))
    with pytest.raises(NotImplementedError):
        pay.decode_raw_image(1, 1, 1, "yuv", b"x")
    with pytest.raises(ValueError):
        pay.decode_raw_image(2, 1, 8, "mono8", b"xxxxxxxx")
    df = spark.createDataFrame([(2, 1, 9, "rgb8", bytearray(9))], "width int, height int, step int, encoding string, data binary")
    with pytest.raises(Exception, match="padded"):
        pay.check_raw_images(df).collect()
    with pytest.raises(ValueError):
        pay.add_message("audio")
    with pytest.raises(Exception, match="no encoding"):
        spark.range(1).select(pay.infer_encoding(F.lit("uint16"), F.lit(3))).collect()


def test_columns(spark):
    df = spark.createDataFrame([(1_700_000_000_123_456_789,), (-1,)], "t bigint")
    rows = df.select(col.split_stamp(F.col("t")).alias("s"), col.sec(F.col("t")).alias("sec"), col.nsec(F.col("t")).alias("nsec")).collect()
    assert [(r.s.sec, r.s.nsec) for r in rows] == [(1_700_000_000, 123_456_789), (-1, 999_999_999)]
    assert rows[1].sec == -1
    with pytest.raises(Exception, match="base stamp"):
        spark.range(1).select(col.base_stamp(F.lit("{}"), ensure=True)).collect()
    assert spark.range(1).select(col.base_stamp(F.lit("{'base_stamp': '17'}"))).first()[0] == 17
    assert spark.range(1).select(col.wall_clock_ms()).first()[0] > 1_600_000_000_000
    assert spark.range(1).select(col.index_label(F.col("id"), "_x")).first()[0] == "0_x"


def test_series(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "f string, v double")
    got = {r.f: (round(r.low, 6), round(r.high, 6)) for r in series.padded_range(df, "f", "v").collect()}
    assert got == {"a": (0.8, 3.2), "b": (4.9, 5.1), "c": (-1.0, 1.0)}
    assert series.padded_range(df, "f", "v", manual=(0, 1)).first().low == 0.0
    assert series.sample_series(spark, 10, 2, 3).count() == 20


def test_container_bytes():
    for compression in ("zstd", ""):
        w = mf.Writer(compression)
        w.register_channel("/a", "S", metadata={"k": "v"})
        with pytest.raises(ValueError):
            w.register_channel("/a", "S")
        assert w.register_channel("/a", "S", strict=False) == 1
        w.register_channel("/silent", "T")
        w.add_message("/a", b"xyz", 5, 6, 7)
        w.add_attachment(mf.Attachment(1, 2, "n", "application/json", b"[]"))
        w.add_metadata(mf.Metadata("m", {"x": "y"}))
        data = w.finish()
        records = list(mf.read_records(data))
        assert [r for r in records if isinstance(r, mf.Message)] == [mf.Message(1, 7, 5, 6, b"xyz")]
        assert [r.name for r in records if isinstance(r, (mf.Attachment, mf.Metadata))] == ["n", "m"]
        summary = mf.read_summary(data)
        assert [c.topic for c in summary if isinstance(c, mf.Channel)] == ["/a", "/silent"]
        assert [s.channel_message_counts for s in summary if isinstance(s, mf.Statistics)] == [{1: 1}]
        with pytest.raises(ValueError):
            list(mf.read_records(data[:-4]))
