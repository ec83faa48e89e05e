"""Video streams with the lossless codec, and the data source."""

import pytest
from pyspark.sql import functions as F

from stratalog.functions.payload import encode_float_arrays
from stratalog.sources import datasource, episodes, video
from tests import models


@pytest.fixture(scope="module")
def frames(spark):
    stamps = {1: [100, 250, 240, 240, 900], 2: [5, 6, 7]}
    rows = [(s, i, t, bytearray(f"{s}-{i}".encode() * 50)) for s, own in stamps.items() for i, t in enumerate(own)]
    return spark.createDataFrame(rows, "stream bigint, idx bigint, stamp bigint, data binary")


def test_round_trip(spark, frames):
    videos = video.encode_streams(frames, video.RawCodec(), 10_000)
    assert {r.stream: r.n_frames for r in videos.collect()} == {1: 5, 2: 3}
    rows = video.decode_streams(videos, video.RawCodec(), target_time_base=10_000).orderBy("stream", "idx").collect()
    assert [r.pts for r in rows if r.stream == 1] == models.monotonic([100, 250, 240, 240, 900], 10)
    assert [bytes(r.data)[:3] for r in rows if r.stream == 2] == [b"2-0", b"2-1", b"2-2"]
    some = video.decode_streams(videos, video.RawCodec(), [2, 0, 2], target_time_base=0).where("stream = 2").orderBy("idx").collect()
    assert [(r.idx, r.pts, r.padded) for r in some] == [(0, 5, False), (2, 7, False)]


class Short(video.RawCodec):
    """Announces two frames more than it has."""

    def decode(self, data):
        comment, count, unit, frames = super().decode(data)
        return comment, count + 2, unit, frames


def test_padding_and_errors(spark, frames):
    videos = video.encode_streams(frames, video.RawCodec()).where("stream = 2")
    rows = video.decode_streams(videos, Short(), tolerance=5).orderBy("idx").collect()
    assert [(r.idx, r.padded) for r in rows] == [(0, False), (1, False), (2, False), (3, True), (4, True)]
    assert rows[4].pts == rows[2].pts
    with pytest.raises(Exception, match="announced"):
        video.decode_streams(videos, Short(), tolerance=1).collect()
    with pytest.raises(Exception, match="out of range"):
        video.decode_streams(videos, video.RawCodec(), [3]).collect()
    for bad in ([], [-1]):
        with pytest.raises(ValueError):
            video.decode_streams(videos, video.RawCodec(), bad)
    with pytest.raises(Exception, match="positive"):
        video.encode_streams(frames.withColumn("stamp", F.lit(0).cast("bigint")), video.RawCodec()).collect()
    assert video.parse_base_stamp("{'base_stamp': '7'}") == 7
    assert video.parse_base_stamp("nonsense", ensure=False) == 0
    with pytest.raises(ValueError):
        video.parse_base_stamp("")


class Fitted(video.RawCodec):
    """Puts its geometry before each frame."""

    def __init__(self, width=None, height=None):
        self.shape = width, height

    def configured(self, width, height):
        return Fitted(width, height)

    def encode(self, frames, comment, time_base):
        return super().encode(((p, bytes(self.shape) + f) for p, f in frames), comment, time_base)


DESCRIBED = "stream bigint, idx bigint, stamp bigint, data binary, format string, width int, height int"
PPM = b"P6 # a comment\n2 1\n255\n"


def test_streams_set_up_by_their_first_frame(spark):
    rows = [(1, i, i + 1, bytes([i] * 12), None if i else "", 2, 2) for i in range(3)] + [(2, i, i + 1, PPM + bytes([i] * 6), "ppm", None, None) for i in range(2)]
    streams = video.encode_streams(spark.createDataFrame(rows, DESCRIBED), Fitted())
    assert sorted((r.stream, r.kind, r.width, r.height, r.n_frames) for r in streams.collect()) == [(1, "pixels", 2, 2, 3), (2, "ppm", 2, 1, 2)]
    frames = video.decode_streams(streams, Fitted()).orderBy("stream", "idx").collect()
    assert [bytes(r.data) for r in frames] == [bytes([2, 2] + [i] * 12) for i in range(3)] + [bytes([2, 1] + [i] * 6) for i in range(2)]
    assert video.encode_streams(spark.createDataFrame([], DESCRIBED), Fitted()).count() == 0
    narrow = spark.createDataFrame(rows, DESCRIBED.replace("stream bigint", "stream int"))
    assert sorted(video.encode_streams(narrow, Fitted()).select("stream").collect()) == [(1,), (2,)]
    own = spark.createDataFrame([(3, 0, 5, b"x", "mine", None, None)], DESCRIBED)
    assert video.encode_streams(own, Fitted(), decoders={"mine": lambda data: (1, 3, data * 3)}).select("kind", "width", "height").first() == ("mine", 1, 3)


@pytest.mark.parametrize(
    ("second", "says"),
    [
        ((bytes(6), None, 2, 1), "in a stream of"),  # another geometry
        (((PPM + bytes(6)), "ppm", None, None), "in a stream of"),  # another kind
        ((bytes(12), "jpeg", None, None), "no decoder"),
        ((bytes(12), None, None, 2), "need a width"),
        ((bytes(11), None, 2, 2), "need a width"),
        ((None, None, 2, 2), "need a width"),
        ((PPM + bytes(5), "ppm", None, None), "another size"),
        ((b"P5 2 1 255 ", "ppm", None, None), "not a portable pixmap"),
    ],
)
def test_frames_that_do_not_fit(spark, second, says):
    rows = [(1, 0, 1, bytes(12), None, 2, 2), (1, 1, 2, *second)]
    with pytest.raises(Exception, match=says):
        video.encode_streams(spark.createDataFrame(rows, DESCRIBED), video.RawCodec()).collect()


def test_codec_without_library():
    try:
        import av  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="av"):
            video.AvCodec(2, 2).encode(iter([]), "", 1)


def test_data_source(spark, tmp_path):
    rows = [("x.mcap", t, "S", i, i, i, [float(i)]) for i in range(3) for t in ("/a", "/b")]
    m = spark.createDataFrame(rows, "episode_id string, topic string, schema_name string, log_time bigint, publish_time bigint, sequence bigint, v array<float>")
    episodes.save_files(episodes.to_files(m.withColumn("data", encode_float_arrays("v")).drop("v")), str(tmp_path)).collect()
    datasource.register(spark)
    assert spark.read.format("episodes").load(str(tmp_path)).count() == 6
    assert spark.read.format("episodes").option("topics", "/a").load(f"{tmp_path}/x.mcap").count() == 3
    assert spark.read.format("episodes").option("table", "channels").load(str(tmp_path)).count() == 2
    assert spark.read.format("episodes").option("table", "attachments").load(str(tmp_path)).count() == 0
