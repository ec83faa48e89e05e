"""Streams with named state: assembly of values of any type, stamp repair, a bounded shuffle, and episodes that close when idle.

Each operator is a processor over the state store. Episodes are dealt to BUCKETS by a hash, and the processor runs once for each bucket of
a micro-batch, whose rows it folds together: what a call costs is not paid once an episode. The state is a map by episode, read and
written by key, so that a micro-batch touches the episodes it has rows of. Rows of an episode have to arrive in order across
micro-batches; inside one they are sorted. A restart from the checkpoint goes on where the state was.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, IntegralType, LongType, StringType, StructField, StructType

from stratalog.operators.chains import latest, repaired, samples
from stratalog.operators.pipeline import Counter

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that episodes are dealt to. A stream keeps the number for as long as its checkpoint lives.
BUCKETS = 4096


def with_state(spark: SparkSession) -> SparkSession:
    """Let new streams of the session keep named state, which needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return spark


def _plain(value: Any) -> Any:  # noqa: ANN401
    """A value as the state store takes it."""
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value.tolist()]
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, Row):
        return {n: _plain(v) for n, v in value.asDict().items()}
    return value.item() if isinstance(value, np.generic) else value


def _dealt(rows: DataFrame, episode: str) -> GroupedData:
    """Rows by bucket. Whole numbers that name episodes travel as text, which a null among them does not change."""
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(episode), F.lit(BUCKETS)).cast("int"))
    return placed.withColumn(episode, F.col(episode).cast(_name_kind(rows, episode))).groupBy("_bucket")


def _name_kind(rows: DataFrame, episode: str) -> DataType:
    kind = rows.schema[episode].dataType
    return StringType() if isinstance(kind, IntegralType) else kind


def _run(rows: DataFrame, episode: str, processor: StatefulProcessor, out: StructType, time_mode: str = "None") -> DataFrame:
    """What a processor makes of the buckets of a stream, in append mode."""
    named = StructType([StructField(f.name, _name_kind(rows, episode)) if f.name == episode else f for f in out])
    made = _dealt(rows, episode).transformWithStateInPandas(processor, named, "append", time_mode)
    return made.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name == episode else F.col(f"`{f.name}`") for f in out))


class _Runs:
    """The rows of a micro-batch's bucket: a run for each episode, in order inside."""

    def __init__(self, rows: Iterator[pd.DataFrame], key: str, order: list[str]) -> None:
        parts = [r for r in rows if len(r)]
        whole = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0] if parts else pd.DataFrame(columns=[key, *order])
        codes, names = pd.factorize(whole[key], use_na_sentinel=False)
        self.table = whole.assign(_run=codes).sort_values(["_run", *order], kind="stable", ignore_index=True)
        self.names = [None if e is None or e != e else _plain(e) for e in names]
        self.marks = self.table["_run"].to_numpy(dtype=np.int64)
        self.edges = np.searchsorted(self.marks, np.arange(len(self.names) + 1))


class _Closing(StatefulProcessor):
    """A processor whose episodes are forgotten when nothing arrived for ``idle_ms`` of processing time (None: never).

    A bucket has one timer, for the episode that may close first.
    """

    def __init__(self, key: StructField, idle_ms: int | None) -> None:
        self._key, self._idle = key.name, idle_ms
        self._named = StructType([StructField("episode", key.dataType)])

    def _watch(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        if self._idle is not None:
            self._seen = handle.getMapState("seen", self._named, "at bigint")

    def _wait(self, timers: Any, episodes: list) -> None:  # noqa: ANN401
        if self._idle is not None:
            now = timers.getCurrentProcessingTimeInMs()
            for episode in episodes:
                self._seen.updateValue((episode,), (now,))
            if not list(self._handle.listTimers()):
                self._handle.registerTimer(now + self._idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        now, left = timerValues.getCurrentProcessingTimeInMs(), []
        for episode, at in [(k[0], v[0]) for k, v in self._seen.iterator()]:
            if at + self._idle > now:
                left.append(at)
                continue
            out = self.ended(episode)
            self.forget(episode)
            self._seen.removeKey((episode,))
            if len(out):
                yield out
        if left:
            self._handle.registerTimer(min(left) + self._idle)

    def ended(self, episode: Any) -> pd.DataFrame:  # noqa: ANN401
        """What a closed episode still yields."""
        return self._empty

    def forget(self, episode: Any) -> None:  # noqa: ANN401
        raise NotImplementedError

    def close(self) -> None:
        pass


class Assembly(_Closing):
    def __init__(self, key: StructField, names: list[str], kind: DataType, out: StructType, idle_ms: int | None) -> None:
        super().__init__(key, idle_ms)
        self._names, self._empty = names, pd.DataFrame(columns=out.names)
        self._kind = StructType([StructField("n", LongType()), StructField("topics", ArrayType(StringType())), StructField("values", ArrayType(kind))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._watch(handle)
        self._held = handle.getMapState("held", self._named, self._kind)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        runs = _Runs(rows, self._key, ["log_time", "sequence"])
        own_topics, own_values = runs.table["topic"].tolist(), runs.table["value"].tolist()
        counts, topics, values, edges = [], [], [], [0]
        for r, episode in enumerate(runs.names):  # values that are held come before the episode's own
            count, held, held_values = self._held.getValue((episode,)) or (0, [], [])
            a, b = runs.edges[r], runs.edges[r + 1]
            counts.append(count)
            topics += [*held, *own_topics[a:b]]
            values += [*held_values, *own_values[a:b]]
            edges.append(len(topics))
        if not topics:
            return
        codes = pd.Categorical(topics, categories=self._names).codes.astype(np.int64)
        k, starts, ends = len(self._names), np.array(edges[:-1]), np.array(edges[1:])
        full, picked = samples(codes, k, np.repeat(ends, ends - starts), starts)
        made = np.searchsorted(full, edges)  # an episode's samples lie between its edges
        rest = latest(codes, k, ends - 1)
        for r, episode in enumerate(runs.names):
            first, after = made[r], made[r + 1]
            left = int(full[after - 1]) + 1 if after > first else starts[r]
            kept = [(self._names[t], _plain(values[at])) for t, at in enumerate(rest[r].tolist()) if at >= left]
            self._held.updateValue((episode,), (counts[r] + int(after - first), [t for t, _ in kept], [v for _, v in kept]))
        self._wait(timerValues, runs.names)
        if len(full):
            owner = np.repeat(np.arange(len(runs.names)), np.diff(made))
            columns = {self._key: [runs.names[r] for r in owner], "sample_idx": np.arange(len(full)) - made[owner] + np.array(counts)[owner]}
            yield pd.DataFrame(columns | {name: [values[i] for i in picked[:, t]] for t, name in enumerate(self._names)})

    def forget(self, episode: Any) -> None:  # noqa: ANN401
        self._held.removeKey((episode,))


def assemble(messages: DataFrame, topics: Iterable[str], idle_ms: int | None = None) -> DataFrame:
    """assemble() over a stream of (episode_id, topic, log_time, sequence, value), values of any type; append mode.

    An episode that was idle for ``idle_ms`` is closed: its open sample goes, and what arrives later begins a new one from sample 0.
    """
    with_state(messages.sparkSession)
    names = sorted(set(topics))
    kind = messages.schema["value"].dataType
    out = StructType([messages.schema["episode_id"], StructField("sample_idx", LongType()), *(StructField(t, kind) for t in names)])
    wanted = messages.where(F.col("topic").isin(names)).select("episode_id", "topic", "log_time", "sequence", "value")
    processor = Assembly(StructField("episode_id", _name_kind(wanted, "episode_id")), names, kind, out, idle_ms)
    return _run(wanted, "episode_id", processor, out, "ProcessingTime" if idle_ms is not None else "None")


class Repair(_Closing):
    def __init__(self, key: StructField, delta: int, out: StructType, idle_ms: int | None) -> None:
        super().__init__(key, idle_ms)
        self._delta, self._empty = delta, pd.DataFrame(columns=out.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._watch(handle)
        self._last = handle.getMapState("last", self._named, "stamp bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        runs = _Runs(rows, self._key, ["idx"])
        if not runs.names:
            return
        lasts = {r: found[0] for r, e in enumerate(runs.names) if (found := self._last.getValue((e,))) is not None}
        # The last stamp of an episode goes before its rows: a fold keeps the first stamp of a run.
        at, before = runs.edges[list(lasts)], list(lasts.values())
        stamps = np.insert(runs.table["stamp"].to_numpy(dtype=np.int64), at, before)
        fixed = repaired(stamps, self._delta, np.insert(runs.marks, at, list(lasts)))
        fixed = np.delete(fixed, at + np.arange(len(at)))
        for episode, end in zip(runs.names, runs.edges[1:].tolist(), strict=True):
            self._last.updateValue((episode,), (int(fixed[end - 1]),))
        self._wait(timerValues, runs.names)
        yield runs.table.assign(fixed=fixed)[self._empty.columns.tolist()]

    def forget(self, episode: Any) -> None:  # noqa: ANN401
        self._last.removeKey((episode,))


def monotonic(stamps: DataFrame, delta: int, idle_ms: int | None = None) -> DataFrame:
    """monotonic() over a stream of (episode_id, idx, stamp): a late stamp is pushed forward, never dropped; append mode."""
    with_state(stamps.sparkSession)
    out = StructType([stamps.schema["episode_id"], stamps.schema["idx"], stamps.schema["stamp"], StructField("fixed", LongType())])
    own = stamps.select("episode_id", "idx", "stamp")
    processor = Repair(StructField("episode_id", _name_kind(own, "episode_id")), delta, out, idle_ms)
    return _run(own, "episode_id", processor, out, "ProcessingTime" if idle_ms is not None else "None")


class Shuffle(StatefulProcessor):
    """A shuffle buffer per episode in a map state; the row with ``last`` empties it."""

    def __init__(self, episode: StructField, fields: list[StructField], order: list[str], size: int, seed: int) -> None:
        self._episode, self._names, self._order, self._size, self._seed = episode.name, [f.name for f in fields], order, size, seed
        self._named = StructType([StructField("episode", episode.dataType)])
        self._kind = StructType([StructField("step", LongType()), StructField("out", LongType()), StructField("held", ArrayType(StructType(fields)))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getMapState("held", self._named, self._kind)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        runs = _Runs(rows, self._episode, self._order)
        own = list(zip(*(map(_plain, runs.table[n].tolist()) for n in self._names), strict=True))
        ends = np.asarray(runs.table["last"] == True, dtype=bool)  # noqa: E712
        owners, made, places = [], [], []
        for r, episode in enumerate(runs.names):
            step, place, held = self._held.getValue((episode,)) or (0, 0, [])
            held = [tuple(map(_plain, h)) for h in held]
            a, b = runs.edges[r], runs.edges[r + 1]
            choose, out = Counter(self._seed, episode, step), []
            for row in own[a:b]:
                held.append(row)
                if len(held) >= self._size:
                    out.append(held.pop(choose.randrange(len(held))))
            if ends[a:b].any():
                choose.shuffle(held)
                out, held = out + held, []
            self._held.updateValue((episode,), (choose.step, place + len(out), held))
            owners += [episode] * len(out)
            made += out
            places += range(place, place + len(out))
        if made:
            yield pd.DataFrame(made, columns=self._names).assign(**{self._episode: owners, "out_pos": places})

    def close(self) -> None:
        pass


def bounded_shuffle(rows: DataFrame, size: int, seed: int, order: list[str], episode: str = "episode_id", last: str = "last") -> DataFrame:
    """pipeline.counted_shuffle() over a stream: out_pos of each row under a buffer of ``size`` rows per episode; append mode.

    A true ``last`` says that an episode ends with this row, which empties its buffer; a buffer that is never ended keeps its rows.
    """
    if size < 1:
        raise ValueError("a buffer has one row or more")
    with_state(rows.sparkSession)
    out = StructType([*(f for f in rows.schema if f.name != last), StructField("out_pos", LongType())])
    processor = Shuffle(StructField(episode, _name_kind(rows, episode)), [f for f in rows.schema if f.name not in (episode, last)], order, size, seed)
    return _run(rows.withColumnRenamed(last, "last"), episode, processor, out)


def keep_latest(points: DataFrame, path: str, log: str, keys: list[str], order: str, n: int) -> Any:  # noqa: ANN401
    """Start a stream whose newest ``n`` points of each key lie in a table at path/<batch>: each micro-batch merges into the one before.

    The sink is idempotent: a batch that runs again replaces what it wrote, from the same table before it. current() names the newest.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        from stratalog.operators.series import last_n

        spark = batch.sparkSession
        before = [b for b in batches_at(spark, path) if b < batch_id]
        whole = batch if not before else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/{max(before)}"))
        last_n(whole, keys, [order], n).write.mode("overwrite").parquet(f"{path}/{batch_id}")
        for old in before[:-1]:  # the one before stays for a batch that runs again
            _delete(spark, f"{path}/{old}")

    return points.writeStream.foreachBatch(merge).option("checkpointLocation", log)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def batches_at(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete tables of keep_latest(), in order."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = [s.getPath() for s in fs.listStatus(base) if s.isDirectory() and s.getPath().getName().isdigit()]
    return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest table of keep_latest()."""
    found = batches_at(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{found[-1]}") if found else spark.createDataFrame([], schema)
