"""Sequential operators over streams: sample assembly, stamp repair and scrolling buffers with keyed state.

Messages of an episode have to arrive in order across micro-batches, as a recorder writes them; inside a batch they are sorted. State
is one value per topic (or one stamp) per open episode, kept in the session's state store.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType


def assemble_stream(messages: DataFrame, topics: Iterable[str]) -> DataFrame:
    """assemble() over a stream of (episode_id, topic, log_time, sequence, value double); append mode."""
    names = sorted(set(topics))
    out = StructType([messages.schema["episode_id"], StructField("sample_idx", LongType()), *(StructField(t, DoubleType()) for t in names)])
    state_type = StructType([StructField("n", LongType()), StructField("topics", ArrayType(StringType())), StructField("values", ArrayType(DoubleType()))])

    def fold(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, seen, values = state.get if state.exists else (0, [], [])
        held = dict(zip(seen, values, strict=True))
        rows = []
        for r in pd.concat(list(parts)).sort_values(["log_time", "sequence"]).itertuples():
            held[r.topic] = r.value
            if len(held) == len(names):
                rows.append((key[0], n, *(held[t] for t in names)))
                n, held = n + 1, {}
        state.update((n, list(held), [float(v) for v in held.values()]))
        yield pd.DataFrame(rows, columns=out.names)

    wanted = messages.where(F.col("topic").isin(names))
    return wanted.groupBy("episode_id").applyInPandasWithState(fold, out, state_type, "append", GroupStateTimeout.NoTimeout)


def monotonic_stream(stamps: DataFrame, delta: int) -> DataFrame:
    """monotonic() over a stream of (episode_id, idx, stamp): a late stamp is pushed forward, never dropped."""
    out = StructType([stamps.schema["episode_id"], stamps.schema["idx"], stamps.schema["stamp"], StructField("fixed", LongType())])

    def fold(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("idx")
        fixed = []
        for t in rows["stamp"]:
            last = t if last is None or t > last else last + delta
            fixed.append(last)
        state.update((int(last),))
        yield rows.assign(fixed=fixed)[out.names]

    return stamps.groupBy("episode_id").applyInPandasWithState(fold, out, StructType([StructField("last", LongType())]), "append", GroupStateTimeout.NoTimeout)


def scrolling_buffers(points: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` values of each (field, index) after each micro-batch, from (t, field, index, value); update mode."""
    out = StructType([StructField("field", StringType()), StructField("index", LongType()), StructField("t", ArrayType(LongType())), StructField("values", ArrayType(DoubleType()))])
    state_type = StructType([StructField("t", ArrayType(LongType())), StructField("values", ArrayType(DoubleType()))])

    def scroll(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, values = (list(x) for x in state.get) if state.exists else ([], [])
        for r in pd.concat(list(parts)).sort_values("t").itertuples():
            t.append(int(r.t))
            values.append(float(r.value))
        t, values = t[-n:], values[-n:]
        state.update((t, values))
        yield pd.DataFrame([(key[0], int(key[1]), t, values)], columns=out.names)

    return points.groupBy("field", "index").applyInPandasWithState(scroll, out, state_type, "update", GroupStateTimeout.NoTimeout)
