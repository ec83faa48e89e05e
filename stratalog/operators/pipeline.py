"""The sample pipeline: number, shard, skip, filter, transform, shuffle; batches and positional access.

Positions are counted over the order (episode, position in the episode). They come from windows inside episodes and from the sizes of the
episodes before, a prefix sum over ranges of episodes, so no task sees the whole stream or all episodes.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratalog.functions.columns import guard
from stratalog.operators.catalog import hash_order
from stratalog.sources.shared import shared_folder

#: Episodes whose sizes are summed on the driver; ranges of episodes in which more are.
COLLECTED_EPISODES, RANGES = 100_000, 128


def offsets(sizes: DataFrame, episode: str) -> DataFrame:
    """(episode, _before): how many rows lie in the episodes before, from (episode, _n).

    Up to COLLECTED_EPISODES sizes are summed where they are collected. More are written once, cut into ranges by a sample of names, and
    summed in each range; only the ranges' totals are collected. No task sees all episodes.
    """
    spark = sizes.sparkSession
    few = sizes.select(episode, "_n").limit(COLLECTED_EPISODES + 1).collect()  # takes partitions until it has enough
    if few and len(few) <= COLLECTED_EPISODES:
        table = pa.table([pa.array([r[0] for r in few]), pa.array([r[1] for r in few])], [episode, "_n"]).sort_by(episode)
        n = table.column("_n").to_numpy()
        table = pa.table([table.column(episode), pa.array(np.cumsum(n) - n)], [episode, "_before"])
        return F.broadcast(spark.createDataFrame(table, StructType([sizes.schema[episode], StructField("_before", LongType())])))
    path = shared_folder(spark, "sizes")
    sizes.write.parquet(path)
    kept = spark.read.schema(sizes.schema).parquet(path)
    names = [r[0] for r in kept.where(F.col(episode).isNotNull()).orderBy(F.xxhash64(episode)).limit(8 * RANGES).orderBy(episode).select(episode).collect()]
    cuts = F.array(*map(F.lit, names[7::8])).cast(f"array<{sizes.schema[episode].dataType.simpleString()}>")
    placed = kept.withColumn("_range", F.size(F.filter(cuts, lambda c: c <= F.col(episode))))
    totals = {r[0]: r[1] for r in placed.groupBy("_range").agg(F.sum("_n")).collect()}  # RANGES + 1 rows
    order = sorted(totals)
    start = F.create_map(*(F.lit(x).cast("bigint") for i, r in enumerate(order) for x in (r, sum(totals[o] for o in order[:i]))))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy(episode).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select(episode, (inside + F.element_at(start, F.col("_range").cast("bigint"))).alias("_before"))


def number(samples: DataFrame, order: list[str], episode: str = "episode_id") -> DataFrame:
    """``samples`` with pos, the position from 0 in order of (episode, ``order``); the sizes of episodes are counted at once."""
    inside = F.row_number().over(Window.partitionBy(episode).orderBy(*order)).cast("bigint") - 1
    sizes = samples.where(F.col(episode).isNotNull()).groupBy(episode).agg(F.count(F.lit(1)).alias("_n"))
    return samples.withColumn("_in", inside).join(offsets(sizes, episode), episode).withColumn("pos", F.col("_in") + F.col("_before")).drop("_in", "_before")


def shard(numbered: DataFrame, world_size: int = 1, rank: int = 0, num_workers: int = 1, worker_id: int = 0) -> DataFrame:
    """Rows of one worker of one rank: position modulo (ranks x workers) is its part; pos is renumbered inside the part."""
    if world_size < 1 or num_workers < 1:
        raise ValueError("world_size and num_workers are 1 or more")
    total, part = world_size * num_workers, rank * num_workers + worker_id
    return numbered.where(F.pmod("pos", F.lit(total)) == part).withColumn("pos", F.expr(f"(pos - {part}) div {total}"))


def skip(numbered: DataFrame, n: int) -> DataFrame:
    """Without the first ``n`` positions; pos is renumbered. None are skipped for 0 or less."""
    return numbered if n <= 0 else numbered.where(F.col("pos") >= n).withColumn("pos", F.col("pos") - n)


def block_shuffle(numbered: DataFrame, block: int, seed: int, key: str) -> DataFrame:
    """out_pos: blocks of ``block`` positions stay in order, rows inside a block in seeded hash order; no Python, one shuffle by block."""
    if block < 1:
        raise ValueError("a block has one row or more")
    of_block = F.expr(f"pos div {block}")
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*hash_order(seed, F.col(key)))).cast("bigint") - 1
    return numbered.withColumn("_block", of_block).withColumn("out_pos", inside + F.col("_block") * block).drop("_block")


def buffer_order(n: int, size: int, rng: random.Random | Counter) -> Iterator[int]:
    """The order in which a bounded shuffle buffer emits positions 0..n-1."""
    held: list[int] = []
    for i in range(n):
        held.append(i)
        if len(held) >= size:
            yield held.pop(rng.randrange(len(held)))
    rng.shuffle(held)
    yield from held


class Counter:
    """Choices of a shuffle buffer by a hash of (seed, episode, step): they can be repeated anywhere, from any step on."""

    def __init__(self, seed: int, episode: object, step: int = 0) -> None:
        self._name, self.step = f"{seed}:{episode}", step

    def randrange(self, n: int) -> int:
        self.step += 1
        return int(hashlib.md5(f"{self._name}:{self.step - 1}".encode()).hexdigest()[:8], 16) % n

    def shuffle(self, held: list) -> None:
        """Take one after the other, by choice."""
        held[:] = [held.pop(self.randrange(len(held))) for _ in range(len(held))]


def counted_shuffle(samples: DataFrame, size: int, seed: int, order: list[str], episode: str = "episode_id") -> DataFrame:
    """bounded_shuffle() with choices by Counter, which SQL and streams can repeat."""
    return bounded_shuffle(samples, size, seed, order, episode, Counter)


def bounded_shuffle(samples: DataFrame, size: int, seed: int, order: list[str], episode: str = "episode_id", choices: type | None = None) -> DataFrame:
    """out_pos of each row under a shuffle buffer of ``size`` rows per episode, seeded by (seed, episode).

    A row never comes out more than size - 1 places early; size 1 changes nothing, 0 or less means no shuffle. The fold streams
    over sorted partitions and holds positions of one buffer only; rows are matched to them by position.
    """
    inside = F.row_number().over(Window.partitionBy(episode).orderBy(*order)).cast("bigint") - 1
    placed = samples.withColumn("_in", inside)
    if size <= 0:
        return placed.withColumnRenamed("_in", "out_pos")
    sizes = samples.groupBy(episode).agg(F.count(F.lit(1)).alias("_n"))
    schema = StructType([samples.schema[episode], StructField("_in", LongType()), StructField("out_pos", LongType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, first = [], 0
                for i in buffer_order(n, size, choices(seed, name) if choices else random.Random(f"{seed}:{name}")):
                    held.append(i)
                    if len(held) == 65_536:
                        yield _block(name, held, first)
                        held, first = [], first + 65_536
                if held:
                    yield _block(name, held, first)

    def _block(name, held: list[int], first: int) -> pa.RecordBatch:  # noqa: ANN001
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held), kind), pa.array(held, pa.int64()), pa.array(range(first, first + len(held)), pa.int64())], schema.names)

    kind = pa.int64() if samples.schema[episode].dataType == LongType() else pa.string() if samples.schema[episode].dataType.simpleString() == "string" else pa.int32()
    return placed.join(sizes.mapInArrow(emit, schema), [episode, "_in"]).drop("_in")


def run_pipeline(
    samples: DataFrame,
    order: list[str],
    *,
    episode: str = "episode_id",
    world_size: int = 1,
    rank: int = 0,
    num_workers: int = 1,
    worker_id: int = 0,
    resume_from_sample: int = 0,
    filter_fn: Column | Callable[[DataFrame], DataFrame] | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    shuffle_buffer_size: int = 0,
    seed: int = 0,
) -> DataFrame:
    """Number, shard, skip, filter, transform and block-shuffle, in this order, once over all samples.

    ``filter_fn`` is a boolean column or a DataFrame function, ``transform`` a DataFrame function that keeps pos. With a shuffle
    buffer, pos becomes the position after the shuffle of the rows that are left.
    """
    out = skip(shard(number(samples, order, episode), world_size, rank, num_workers, worker_id), resume_from_sample)
    if filter_fn is not None:
        out = out.where(filter_fn) if isinstance(filter_fn, Column) else filter_fn(out)
    if transform is not None:
        out = transform(out)
    if shuffle_buffer_size > 0:
        out = block_shuffle(out, shuffle_buffer_size, seed, "pos").drop("pos").withColumnRenamed("out_pos", "pos")
    return out


def nested_shards(samples: DataFrame, order: list[str], world_size: int, rank: int, episode: str = "episode_id") -> DataFrame:
    """The shard step applied twice, inside each episode and again over what that leaves: it covers only part of the samples."""
    inner = F.row_number().over(Window.partitionBy(episode).orderBy(*order)) - 1
    once = samples.withColumn("_i", inner).where(F.pmod("_i", F.lit(world_size)) == rank).drop("_i")
    return shard(number(once, order, episode), world_size, rank)


def nth(numbered: DataFrame, index: int) -> DataFrame:
    """The row at a position of the pipeline's output; negatives count from the end; no row beyond it."""
    if index >= 0:
        return numbered.where(F.col("pos") == index)
    n = numbered.agg(F.count(F.lit(1)).alias("_n"))
    return numbered.join(F.broadcast(n)).where(F.col("pos") == F.col("_n") + index).drop("_n")


def batches(samples: DataFrame, size: int, order: list[str], item: str, episode: str = "episode_id", strict: bool = False) -> DataFrame:
    """(episode, batch_idx, items): consecutive groups of ``size`` per episode; with ``strict`` a short last one raises."""
    if size < 1:
        raise ValueError("a batch has one row or more")
    pos = F.row_number().over(Window.partitionBy(episode).orderBy(*order)).cast("bigint") - 1
    placed = samples.select(episode, F.col(item).alias("_item"), pos.alias("_pos")).withColumn("batch_idx", F.expr(f"_pos div {size}"))
    held = F.array_sort(F.collect_list(F.struct("_pos", "_item")))  # at most ``size`` rows
    out = placed.groupBy(episode, "batch_idx").agg(F.transform(held, lambda s: s["_item"]).alias("items"))
    return out.where(guard(F.size("items") == size, "the last batch is short")) if strict else out
