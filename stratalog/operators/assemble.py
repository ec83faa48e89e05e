"""Sample assembly: one row whenever every requested topic has been seen since the last one.

Messages are dealt by episode and sorted inside partitions; a fold then streams over Arrow batches. Between batches it keeps the
last row of each topic of the open sample and the sample count, so memory does not depend on an episode's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratalog.functions.columns import guard
from stratalog.operators.catalog import equal_counts, topic_counts
from stratalog.operators.chains import latest, samples, segment_ends

ORDER = ("log_time", "sequence")


def topic_codes(topics: pa.ChunkedArray, names: list[str]) -> np.ndarray:
    """The place of each topic among ``names``."""
    return pc.index_in(topics.combine_chunks(), pa.array(names, topics.type)).to_numpy(zero_copy_only=False).astype(np.int64)


def run_marks(keys: pa.Array) -> np.ndarray:
    """Numbers that are equal for equal keys."""
    return np.asarray(keys.dictionary_encode().indices.fill_null(-1)).astype(np.int64)


def assemble(messages: DataFrame, topics: Iterable[str], reverse: bool = False, strict: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """(episode_id, sample_idx, one column per topic) from (episode_id, topic, log_time, sequence, value).

    In order of (log_time, sequence), or from the end with ``reverse``, the last value of each topic is kept; a row is emitted
    and the values cleared when all topics have one. Trailing incomplete samples are dropped. ``strict`` also asks that all topics
    of an episode, requested or not, have equal counts and that as many samples come out; otherwise it raises. Known ``counts``
    (episode_id, topic, n) save counting the messages.
    """
    names = sorted(set(topics))
    if not names:
        raise ValueError("no topics requested")
    value_type = messages.schema["value"].dataType
    schema = StructType([messages.schema["episode_id"], StructField("sample_idx", LongType()), *(StructField(t, value_type) for t in names)])
    # The filter reaches the scan and only four narrow columns are shuffled, once, by episode.
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in ORDER]
    dealt = messages.where(F.col("topic").isin(names)).select("episode_id", "topic", *ORDER, "value").repartition("episode_id").sortWithinPartitions("episode_id", *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        open_episode, count = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if carry is None else pa.concat_tables([carry, table])).combine_chunks()
            if not table.num_rows:
                continue
            episodes = table.column("episode_id").combine_chunks()
            codes = topic_codes(table.column("topic"), names)
            starts, ends = segment_ends(run_marks(episodes))
            full, rows = samples(codes, len(names), ends, starts)
            run = np.searchsorted(starts, full, side="right") - 1
            of_run = np.bincount(run, minlength=len(starts))
            before = np.cumsum(of_run) - of_run
            base = count if episodes[0].as_py() == open_episode else 0
            index = np.arange(len(full)) - before[run] + np.where(run == 0, base, 0)
            open_episode, count = episodes[len(episodes) - 1].as_py(), int(of_run[-1]) + (base if len(starts) == 1 else 0)
            left = full[-1] + 1 if of_run[-1] else starts[-1]
            rest = latest(codes, len(names), np.array([len(codes) - 1]))[0]
            carry = table.take(pa.array(np.sort(rest[rest >= left])))
            if len(full):
                values = table.column("value").combine_chunks()
                cols = [episodes.take(pa.array(full)), pa.array(index), *(values.take(pa.array(rows[:, i])) for i in range(len(names)))]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    found = dealt.select("episode_id", "topic", "value").mapInArrow(fold, schema)
    if not strict:
        return found
    common = equal_counts(topic_counts(messages) if counts is None else counts)
    made = found.groupBy("episode_id").agg(F.count(F.lit(1)).alias("made"))
    ok = common.join(made, "episode_id", "left").where(guard((F.col("common") > 0) & (F.col("common") == F.coalesce("made", F.lit(0))), "topics are not aligned"))
    return found.join(ok.select("episode_id"), "episode_id", "left_semi")


def assemble_in_columns(messages: DataFrame, topics: Iterable[str]) -> DataFrame:
    """The same by a Catalyst fold over one array per episode, without Python; for short episodes, since an episode is one row."""
    names = sorted(set(topics))
    rows = messages.where(F.col("topic").isin(names)).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "topic", "value"))).alias("rows"))
    kind = messages.schema["value"].dataType.simpleString()
    empty = F.expr(f"cast(map() as map<string,{kind}>)")
    zero = F.struct(empty.alias("now"), F.expr(f"cast(array() as array<map<string,{kind}>>)").alias("done"))

    def step(acc, row):  # noqa: ANN001, ANN202
        now = F.map_concat(F.map_filter(acc["now"], lambda k, _: k != row["topic"]), F.create_map(row["topic"], row["value"]))
        full = F.size(now) == len(names)
        return F.struct(F.when(full, empty).otherwise(now).alias("now"), F.when(full, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"))

    done = rows.select("episode_id", F.posexplode(F.aggregate("rows", zero, step, lambda acc: acc["done"])).alias("sample_idx", "sample"))
    return done.select("episode_id", F.col("sample_idx").cast("bigint").alias("sample_idx"), *(F.col("sample")[t].alias(t) for t in names))
