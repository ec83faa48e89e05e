"""Numbering by ranges, folds by chains, long episodes in many tasks: results against plain loops, and plans."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from stratalog.operators import assemble, chains, pipeline, segments
from stratalog.operators import stamps as stamps_


def plain_repair(stamps, marks, delta, last):
    out, mark, now = [], marks[0] if marks else None, last
    for t, m in zip(stamps, marks, strict=True):
        now = None if m != mark else now
        now, mark = t if now is None or t > now else now + delta, m
        out.append(now)
    return out


def plain_samples(codes, marks, n):
    out, held, mark = [], {}, None
    for i, (c, m) in enumerate(zip(codes, marks, strict=True)):
        held = held if m == mark else {}
        mark = m
        held[c] = i
        if len(held) == n:
            out.append((i, [held[t] for t in range(n)]))
            held = {}
    return out


RUNS = hs.lists(hs.tuples(hs.integers(-20, 60), hs.integers(0, 3), hs.booleans()), max_size=60)


@settings(max_examples=300, deadline=None)
@given(RUNS, hs.sampled_from([1, 2, 5, 13]), hs.one_of(hs.none(), hs.integers(-30, 70)), hs.integers(1, 4))
def test_chains_are_the_folds(rows, delta, last, n):
    marks = np.cumsum([r[2] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    stamps = np.array([r[0] for r in rows], dtype=np.int64)
    assert chains.repaired(stamps, delta, marks, last).tolist() == plain_repair(stamps.tolist(), marks.tolist(), delta, last)
    codes = np.array([r[1] % n for r in rows], dtype=np.int64)
    starts, ends = chains.segment_ends(marks)
    full, picked = chains.samples(codes, n, ends, starts)
    assert list(zip(full.tolist(), picked.tolist(), strict=True)) == plain_samples(codes.tolist(), marks.tolist(), n)


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_numbering_by_ranges(spark, monkeypatch, kind):
    rows = spark.range(3000).select(F.pmod(F.col("id") * 7919, F.lit(701)).cast(kind).alias("episode_id"), F.col("id").alias("k"))
    rows = rows.unionByName(spark.range(2000).select(F.lit(5).cast(kind).alias("episode_id"), (F.col("id") + 9000).alias("k")))
    rows = rows.unionByName(spark.range(3).select(F.lit(None).cast(kind).alias("episode_id"), F.col("id").alias("k")))
    whole = sorted(tuple(r) for r in pipeline.number(rows, ["k"]).collect())
    monkeypatch.setattr(pipeline, "COLLECTED_EPISODES", 10)
    monkeypatch.setattr(pipeline, "RANGES", 8)
    ranged = pipeline.number(rows, ["k"])
    assert sorted(tuple(r) for r in ranged.collect()) == whole
    assert [r[2] for r in sorted(whole, key=lambda r: r[2])] == list(range(5000))
    order = [r[0] for r in sorted(whole, key=lambda r: r[2])]
    assert order == sorted(order)
    plan = ranged._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "AllTuples" not in plan
    assert pipeline.number(rows.where("k < 0"), ["k"]).count() == 0


# ---- long episodes


@pytest.mark.parametrize("rows_of_block", [2, 50])
def test_long_folds_are_the_short_ones(spark, monkeypatch, rows_of_block):
    rng = np.random.default_rng(rows_of_block)
    n = 1500
    rows = [(int(rng.choice([1, 1, 1, 2, 3])), str(rng.choice(["a", "b", "b", "b", "c"])), int(i // 2), int(i), float(rng.integers(0, 99)), [float(i)]) for i in range(n)]
    df = spark.createDataFrame(rows, "episode_id bigint, topic string, log_time bigint, sequence bigint, value double, vec array<double>").repartition(6)
    monkeypatch.setattr(segments, "BLOCK_ROWS", rows_of_block)
    for topics, reverse in ((["a", "b"], True), (["a", "b", "c"], False), (["c"], True), (["a", "nothing"], False)):
        want = sorted(map(tuple, assemble.assemble(df, topics, reverse=reverse).collect()))
        assert sorted(map(tuple, segments.assemble_long(df, topics, reverse=reverse).collect())) == want
    vectors = df.drop("value").withColumnRenamed("vec", "value")
    assert sorted(map(tuple, segments.assemble_long(vectors, ["a", "b"]).collect())) == sorted(map(tuple, assemble.assemble(vectors, ["a", "b"]).collect()))
    stamps = df.select("episode_id", F.col("sequence").alias("idx"), F.col("value").cast("bigint").alias("stamp"))
    for delta in (1, 40):
        want = sorted(map(tuple, stamps_.monotonic(stamps, delta).collect()))
        assert sorted(map(tuple, segments.monotonic_long(stamps, delta).collect())) == want
    assert segments.monotonic_long(stamps.where("idx < 0"), 1).count() == 0
    monkeypatch.setattr(segments, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, segments.monotonic_long(stamps, 40).collect())) == want


def test_one_long_episode_in_many_tasks(spark):
    stamps = spark.range(400_000).select(F.lit(1).alias("episode_id"), F.col("id").alias("idx"), (F.xxhash64("id") % 1000 + F.col("id") * 10).alias("stamp"))
    fixed = segments.monotonic_long(stamps, 1000)
    assert fixed.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    own, short = (df.agg(F.sum("fixed"), F.max("fixed"), F.count("fixed")).first() for df in (fixed, stamps_.monotonic(stamps, 1000)))
    assert own == short
