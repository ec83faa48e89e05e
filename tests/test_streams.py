"""Streams with named state: values of any type, idle episodes, shuffles and sinks that run twice."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from stratalog import recorded
from stratalog.operators import assemble as asm
from stratalog.operators import pipeline
from stratalog.operators import stamps as stamps_
from stratalog.streaming import stateful


def stream_of(spark, df, folder):
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(folder))


def feed(df, folder, n):
    df.write.parquet(str(folder / f"{n}"))


def drain(made, folder):
    made.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start().awaitTermination(120)


KINDS = {"binary": lambda i: bytearray(b"%d" % i), "array<float>": lambda i: [float(i), 0.5], "struct<a:bigint,b:string>": lambda i: (i, str(i))}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_assembly_of_any_value(spark, tmp_path, kind):
    rows = [(i % 3, "abb"[i % 7 % 3], i, 0, KINDS[kind](i)) for i in range(90)]
    df = spark.createDataFrame(rows, f"episode_id bigint, topic string, log_time bigint, sequence bigint, value {kind}")
    (tmp_path / "in").mkdir()
    for n in range(3):
        feed(df.where((F.col("log_time") >= 30 * n) & (F.col("log_time") < 30 * n + 30)), tmp_path / "in", n)
        made = stateful.assemble(stream_of(spark, df, tmp_path / "in"), ["a", "b"])
        drain(made, tmp_path)
    want = asm.assemble(df, ["a", "b"])
    assert sorted(map(str, spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect())) and want.count() > 5


def test_idle_episodes_close(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1, 0, 1.0)], "episode_id bigint, topic string, log_time bigint, sequence bigint, value double")
    second = rows.withColumn("topic", F.lit("b")).withColumn("log_time", F.lit(2).cast("bigint"))
    more = [second.withColumn("topic", F.lit("a")).withColumn("log_time", F.lit(3).cast("bigint")), second.withColumn("log_time", F.lit(4).cast("bigint"))]
    folder = tmp_path / "in"
    folder.mkdir()
    made = stateful.assemble(stream_of(spark, rows, folder), ["a", "b"], idle_ms=1000)
    q = made.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    for n, df in enumerate([rows, second, *more]):  # timers keep such a stream running: it has no end to wait for
        feed(df.coalesce(1), folder, n)
        seen = time.time()
        while not any(p["numInputRows"] for p in q.recentProgress[-50:] if p["batchId"] >= n) and time.time() < seen + 20:
            time.sleep(0.2)
        time.sleep(4 if n == 0 else 0)
    deadline = time.time() + 20
    while not spark.table("idle").count() and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    # The first value of a was forgotten: the only sample is of the later two, the first of a new episode.
    assert [r.sample_idx for r in spark.table("idle").collect()] == [0]


@pytest.mark.parametrize("size", [1, 4])
def test_shuffle_stream_is_batch(spark, tmp_path, size):
    df = spark.range(60).select((F.col("id") % 2).alias("episode_id"), F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") >= 58).alias("last"))
    (tmp_path / "in").mkdir()
    for n in range(3):
        feed(df.where((F.col("k") >= 20 * n) & (F.col("k") < 20 * n + 20)), tmp_path / "in", n)
        made = stateful.bounded_shuffle(stream_of(spark, df, tmp_path / "in"), size, 5, ["k"])
        drain(made, tmp_path)
    want = pipeline.counted_shuffle(df.drop("last"), size, 5, ["k"])
    got = spark.read.schema(made.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.select(*got.columns).collect())
    places = [r.out_pos for r in want.where("episode_id = 0").orderBy("k").collect()]
    assert sorted(places) == list(range(30))
    assert all(p >= i - size + 1 for i, p in enumerate(places))


def test_sink_runs_twice(spark, tmp_path):
    points = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "key string, t bigint, value double")
    path = str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    for log in ("one", "two"):  # without its checkpoint a stream repeats its first batches
        for n in range(2):
            if log == "one":
                feed(points.where(F.col("t") % 2 == n), tmp_path / "in", n)
            stateful.keep_latest(stream_of(spark, points, tmp_path / "in"), path, str(tmp_path / log), ["key"], "t", 3).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(r.t for r in stateful.current(spark, path, points.schema).collect()) == [7, 8, 9]
    assert stateful.current(spark, str(tmp_path / "none"), points.schema).count() == 0


class Memory:
    """A bucket's state and timers, in memory."""

    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, key, value):  # noqa: N802
        return self.maps.setdefault(name, Map())

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Map(dict):
    getValue, updateValue, removeKey, iterator = dict.get, dict.__setitem__, dict.pop, lambda self: iter(self.items())  # noqa: N815


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def fed(processor, table, order, parts=3):
    """What a processor makes of slices of a bucket's episodes, each slice in one call."""
    memory, out = Memory(), []
    for rows in np.array_split(np.arange(len(table)), parts):
        processor.init(memory)
        own = table.sort_values(order).iloc[rows].sample(frac=1, random_state=1)
        out += list(processor.handleInputRows((0,), iter([own.iloc[:7], own.iloc[7:]]), Clock(0)))
    return sorted(pd.concat(out).itertuples(index=False, name=None))


def test_a_call_folds_all_episodes_of_a_bucket(spark):
    rng = np.random.default_rng(3)
    n = 240
    table = pd.DataFrame({"episode_id": rng.choice(["a", "b", "c", "d", "e"], n), "idx": np.arange(n), "stamp": rng.integers(0, 500, n)})
    name, kind = StructField("episode_id", StringType()), StructType([StructField(c, LongType()) for c in ("episode_id", "idx", "stamp", "fixed")])
    df = spark.createDataFrame(table)
    want = [tuple(r) for r in stamps_.monotonic(df, 3).collect()]
    assert fed(stateful.Repair(name, 3, kind, None), table, ["idx"]) == sorted(want)
    table["last"] = ~table["episode_id"].duplicated(keep="last")
    want = [tuple(r) for r in pipeline.counted_shuffle(df.select("episode_id", "idx"), 9, 5, ["idx"]).select("idx", "episode_id", "out_pos").collect()]
    assert fed(stateful.Shuffle(name, [StructField("idx", LongType())], ["idx"], 9, 5), table.drop(columns="stamp"), ["idx"]) == sorted(want)
    values = pd.DataFrame({"episode_id": table["episode_id"], "topic": rng.choice(["x", "y", "z"], n), "log_time": table["idx"], "sequence": 0, "value": rng.random(n)})
    want = [tuple(r) for r in asm.assemble(spark.createDataFrame(values), ["x", "y", "z"]).select("episode_id", "sample_idx", "x", "y", "z").collect()]
    assert fed(stateful.Assembly(name, ["x", "y", "z"], DoubleType(), kind, None), values, ["log_time"]) == sorted(want)


def test_each_episode_of_a_bucket_closes_on_its_own():
    memory = Memory()
    processor = stateful.Repair(StructField("episode_id", StringType()), 1, StructType([StructField(c, LongType()) for c in ("episode_id", "idx", "stamp", "fixed")]), 100)
    processor.init(memory)
    for now, episode in ((0, "a"), (0, "b"), (60, "b")):
        list(processor.handleInputRows((0,), iter([pd.DataFrame({"episode_id": [episode], "idx": [now], "stamp": [9]})]), Clock(now)))
    assert memory.timers == [100]
    list(processor.handleExpiredTimer((0,), Clock(100), None))
    assert sorted(k[0] for k in memory.maps["last"]) == ["b"] and memory.timers == [100, 160]


def test_stream_with_a_null_among_large_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    big = 2**60
    rows = [(e, i, (i * 7) % 11) for i in range(40) for e in (big, big + 1, None)]
    df = spark.createDataFrame(rows, "episode_id bigint, idx bigint, stamp bigint")
    (tmp_path / "in").mkdir()
    for n in range(2):
        feed(df.where(F.col("idx") >= 20 if n else F.col("idx") < 20).coalesce(1), tmp_path / "in", n)
        made = stateful.monotonic(stream_of(spark, df, tmp_path / "in"), 2)
        drain(made, tmp_path)
    assert made.schema["episode_id"].dataType == LongType()
    key = lambda r: (str(r[0]), r[1])
    got = spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, stamps_.monotonic(df, 2).collect()), key=key)


def test_arriving_rows_are_made_once(spark):
    made, seen = spark.sparkContext.accumulator(0), []

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(9).select("id", F.to_timestamp(F.when(F.col("id") < 4, "2024-01-01").otherwise("2024-01-30")).alias("at"))

    class Started:
        def trigger(self, **kind):
            return self

        start = awaitTermination = trigger  # noqa: N815

    def start(stream):
        seen.append(stream.schema)
        return Started()

    recorded._arriving(spark, rows.mapInArrow(count, rows.schema), "at", start)
    assert made.value == 9 and [s.names for s in seen] == [["id"]] * 3
