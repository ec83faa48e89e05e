"""Folds over episodes of any length, each in many tasks.

Rows are dealt by ranges of (episode, order), so a long episode lies in several partitions, and packed into blocks. What a block does
to a fold's state has a short form whatever the state is: to a stamp, thresholds and the last stamp that follows from each; to an open
sample, for each topic that could complete it, how many samples follow and what is left open. Blocks with this form are written once.
The forms of an episode are composed one block after the other, from a few numbers a block; then every block is folded again on its
own, from the state that reaches it. Neither an episode nor its rows ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from stratalog.operators.assemble import ORDER, run_marks, topic_codes
from stratalog.operators.chains import chain, decided, doubled, last_of_chain, latest, next_complete, repaired, segment_ends
from stratalog.sources.shared import shared_folder

#: Rows and bytes of a block, at most about.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 8 << 20
#: States that are broadcast to the blocks, a few numbers each; more meet them by shuffling.
BROADCAST_BLOCKS = 100_000
_PLACE = [StructField("_part", IntegerType()), StructField("_seq", LongType())]


def _blocks(rows: DataFrame, order: list[Column], packed: dict[str, StructField], form: list[StructField], forms: Callable[[pa.Table], dict[str, Any]]) -> DataFrame:
    """A written table of blocks: (episode_id, _part, _seq, lists of the packed columns, what ``forms`` says of a block)."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(tasks, F.col("episode_id"), *order).sortWithinPartitions("episode_id", *order)
    dealt = dealt.select("episode_id", *packed)
    lists = [StructField(n, ArrayType(f.dataType)) for n, f in packed.items()]
    schema = StructType([rows.schema["episode_id"], *_PLACE, *lists, *form])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            n = table.num_rows
            cols = [table.column("episode_id").combine_chunks()[:1], pa.array([part], pa.int32()), pa.array([seq], pa.int64())]
            for name, kind in zip(packed, kinds[3:], strict=False):
                own = table.column(name).combine_chunks()
                cols.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own).cast(kind))
            said = forms(table)
            cols += [pa.array([said[f.name]], k) for f, k in zip(form, kinds[3 + len(packed) :], strict=True)]
            seq += 1
            return pa.RecordBatch.from_arrays(cols, schema.names)

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            starts, _ = segment_ends(run_marks(table.column("episode_id").combine_chunks()))
            edges = [*starts.tolist(), table.num_rows]
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                yield from map(block, _cut(table.slice(a, b - a)))
            held = table.slice(edges[-2])
            if held.num_rows >= BLOCK_ROWS or held.nbytes >= BLOCK_BYTES:
                yield from map(block, _cut(held))
                held = None
        if held is not None and held.num_rows:
            yield from map(block, _cut(held))

    path = shared_folder(spark, "blocks")
    dealt.mapInArrow(pack, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _cut(table: pa.Table) -> Iterator[pa.Table]:
    """Parts of bounded size."""
    step = max(1, min(BLOCK_ROWS, table.num_rows * BLOCK_BYTES // max(1, table.nbytes)))
    for at in range(0, table.num_rows, step):
        yield table.slice(at, step)


def _composed(blocks: DataFrame, form: list[StructField], state: list[StructField], step: Callable[[Any, dict[str, Any]], tuple[dict[str, Any], Any]]) -> DataFrame:
    """(_part, _seq, state before the block): ``step`` takes the state (None at an episode's begin) and a block's form, and gives it and the next."""
    names = [f.name for f in form]
    schema = StructType([*_PLACE, *state])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    dealt = blocks.select("episode_id", "_part", "_seq", *names).repartition("episode_id").sortWithinPartitions("episode_id", "_part", "_seq")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        episode, now, begun = None, None, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():  # a row a block
                now = now if begun and r["episode_id"] == episode else None
                episode, begun = r["episode_id"], True
                before, now = step(now, r)
                out.append((r["_part"], r["_seq"], *(before[f.name] for f in state)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

    return dealt.mapInArrow(compose, schema)


def _applied(blocks: DataFrame, packed: list[str], states: DataFrame, schema: StructType, fold: Callable[[dict[str, Any], dict[str, pa.Array]], list[pa.Array]]) -> DataFrame:
    """Rows that ``fold`` makes of each block and the state before it, behind the block's episode."""
    names = [c for c in states.columns if c not in ("_part", "_seq")]
    path = shared_folder(blocks.sparkSession, "states")
    states.write.parquet(path)
    kept = blocks.sparkSession.read.schema(states.schema).parquet(path)
    # Count, then broadcast: a state is a few numbers and one value a topic.
    met = blocks.select("episode_id", "_part", "_seq", *packed).join(F.broadcast(kept) if kept.count() <= BROADCAST_BLOCKS else kept, ["_part", "_seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                state = {n: batch.column(n)[i].as_py() for n in names}
                columns = fold(state, {n: batch.column(n)[i].values for n in packed})
                if len(columns[0]):
                    owner = batch.column("episode_id").take(pa.array(np.full(len(columns[0]), i)))
                    yield pa.RecordBatch.from_arrays([owner, *columns], schema.names)

    return met.mapInArrow(run, schema)


def _numbers(column: Any) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False).astype(np.int64)


def monotonic_long(stamps: DataFrame, delta: int) -> DataFrame:
    """stamps.monotonic() for episodes of any length: the same rows.

    A block that the repaired stamp ``last`` reaches keeps its first stamp that exceeds ``last`` by more than delta a row, which is a
    running maximum of the stamps less delta a row; all that follows depends on that row alone.
    """
    if delta < 1:
        raise ValueError("delta is 1 or more")
    form = [StructField("n", LongType()), StructField("thresholds", ArrayType(LongType())), StructField("finals", ArrayType(LongType()))]
    idx, stamp = stamps.schema["idx"], stamps.schema["stamp"]

    def forms(table: pa.Table) -> dict[str, Any]:
        own = _numbers(table.column("stamp"))
        n = len(own)
        u, jump = decided(own, delta, np.full(n, n))
        top = np.maximum.accumulate(u)
        records = np.flatnonzero(np.diff(top, prepend=top[0] - 1) > 0)
        ends, _ = last_of_chain(doubled(jump), records)
        finals = u[ends] + (n - 1) * delta
        kept = np.append(finals[1:] != finals[:-1], True)  # of equal ones that of the highest threshold
        return {"n": n, "thresholds": u[records][kept].tolist(), "finals": finals[kept].tolist()}

    def step(last: int | None, r: dict[str, Any]) -> tuple[dict[str, Any], int]:
        if last is None:
            return {"last": None}, r["finals"][0]
        at = int(np.searchsorted(np.array(r["thresholds"], dtype=np.int64), last, side="right"))
        return {"last": last}, r["finals"][at] if at < len(r["finals"]) else last + r["n"] * delta

    def fold(state: dict[str, Any], columns: dict[str, pa.Array]) -> list[pa.Array]:
        own = _numbers(columns["stamp"])
        return [columns["idx"], columns["stamp"], pa.array(repaired(own, delta, np.zeros(len(own), dtype=np.int64), state["last"]))]

    blocks = _blocks(stamps.select("episode_id", "idx", "stamp"), [F.col("idx").asc()], {"idx": idx, "stamp": stamp}, form, forms)
    states = _composed(blocks, form, [StructField("last", LongType())], step)
    return _applied(blocks, ["idx", "stamp"], states, StructType([stamps.schema["episode_id"], idx, stamp, StructField("fixed", LongType())]), fold)


def assemble_long(messages: DataFrame, topics: Iterable[str], reverse: bool = False) -> DataFrame:
    """assemble.assemble() for episodes of any length: the same rows.

    The first sample that a block completes ends at the latest first occurrence of the topics that the open sample lacks, so there is
    one case for each topic; the values that are open between blocks travel with the state, one a topic.
    """
    names = sorted(set(topics))
    if not names:
        raise ValueError("no topics requested")
    k, kind = len(names), messages.schema["value"].dataType
    many = ArrayType(LongType())
    form = [StructField(c, many) for c in ("firsts", "made", "open_from", "lasts")] + [StructField("last_values", ArrayType(kind))]
    state = [StructField("count", LongType()), StructField("holds", ArrayType(LongType())), StructField("held", ArrayType(kind))]
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in ORDER]

    def links(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row that completes a sample begun at each row, next begin): the end is len + 1, a begin that completes nothing leads there."""
        n = len(codes)
        full = np.append(next_complete(codes, k, np.full(n, n)), n)
        return full, np.append(np.where(full < n, full + 1, n + 1), n + 1)

    def forms(table: pa.Table) -> dict[str, Any]:
        codes = topic_codes(table.column("topic"), names)
        n = len(codes)
        _, jump = links(codes)
        firsts = np.array([int(np.argmax(codes == t)) if (codes == t).any() else n for t in range(k)], dtype=np.int64)
        open_from, made = last_of_chain(doubled(jump), np.minimum(firsts + 1, n))
        lasts = latest(codes, k, np.array([n - 1]))[0]
        values = table.column("value").combine_chunks().take(pa.array(lasts, mask=lasts < 0)).to_pylist()
        return {"firsts": np.where(firsts < n, firsts, -1).tolist(), "made": made.tolist(), "open_from": open_from.tolist(), "lasts": lasts.tolist(), "last_values": values}

    def step(now: tuple[int, dict[int, Any]] | None, r: dict[str, Any]) -> tuple[dict[str, Any], tuple[int, dict[int, Any]]]:
        count, held = now or (0, {})
        before = {"count": count, "holds": [int(t in held) for t in range(k)], "held": [held.get(t) for t in range(k)]}
        missing = [t for t in range(k) if t not in held]
        seen = {t: r["last_values"][t] for t in range(k) if r["lasts"][t] >= 0}
        if any(t not in seen for t in missing):
            return before, (count, held | seen)
        t = max(missing, key=lambda t: r["firsts"][t])
        return before, (count + r["made"][t], {x: v for x, v in seen.items() if r["lasts"][x] >= r["open_from"][t]})

    def fold(now: dict[str, Any], columns: dict[str, pa.Array]) -> list[pa.Array]:
        codes = topic_codes(pa.chunked_array([columns["topic"]]), names)
        n = len(codes)
        full, jump = links(codes)
        missing = [t for t in range(k) if not now["holds"][t]]
        firsts = [np.flatnonzero(codes == t)[:1] for t in missing]
        if any(not len(f) for f in firsts):
            return [pa.array([], pa.int64())]
        first = max(int(f[0]) for f in firsts)
        begun = chain(doubled(jump), np.array([first + 1]))
        rows = np.concatenate([[first], full[begun][full[begun] < n]])
        picked = latest(codes, k, rows)
        picked[0] = np.where(picked[0] < 0, n + np.arange(k), picked[0])
        values = pa.concat_arrays([columns["value"], pa.array(now["held"], columns["value"].type)])
        return [pa.array(now["count"] + np.arange(len(rows))), *(values.take(pa.array(picked[:, t])) for t in range(k))]

    own = messages.where(F.col("topic").isin(names)).select("episode_id", "topic", *ORDER, "value")
    blocks = _blocks(own, order, {"topic": messages.schema["topic"], "value": messages.schema["value"]}, form, forms)
    schema = StructType([messages.schema["episode_id"], StructField("sample_idx", LongType()), *(StructField(t, kind) for t in names)])
    return _applied(blocks, ["topic", "value"], _composed(blocks, form, state, step), schema, fold)
