"""Frame stamps: monotonic repair, relative and absolute stamps, padding, index selection and nearest-frame look-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratalog.functions.columns import NS, guard
from stratalog.operators.assemble import run_marks
from stratalog.operators.chains import repaired


def repair_step(time_base: int = NS) -> int:
    """What a stamp that does not rise is set beyond the one before: a thousandth of the time base, 1 at least."""
    return max(time_base // 1000, 1)


def monotonic(stamps: DataFrame, delta: int) -> DataFrame:
    """``stamps`` (episode_id, idx, stamp) with fixed: the stamp where it exceeds the fixed one before, else that plus delta.

    Written with k, the number of rows before, fixed - k * delta is not a running maximum for delta over 1: a row that keeps its stamp
    decides which one is next to keep its own. The fold streams over sorted partitions, follows these chains and holds one number.
    """
    if delta < 1:
        raise ValueError("delta is 1 or more")
    schema = StructType([stamps.schema["episode_id"], stamps.schema["idx"], stamps.schema["stamp"], StructField("fixed", LongType())])
    dealt = stamps.select("episode_id", "idx", "stamp").repartition("episode_id").sortWithinPartitions("episode_id", "idx")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        episode, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            episodes = batch.column("episode_id")
            stamps = batch.column("stamp").to_numpy(zero_copy_only=False).astype(np.int64)
            out = repaired(stamps, delta, run_marks(episodes), last if episodes[0].as_py() == episode else None)
            episode, last = episodes[batch.num_rows - 1].as_py(), int(out[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], schema.names)

    return dealt.mapInArrow(fold, schema)


def monotonic_unit(stamps: DataFrame) -> DataFrame:
    """monotonic() for delta 1 in closed form: row number plus the running maximum of stamp minus row number; no Python."""
    order = Window.partitionBy("episode_id").orderBy("idx")
    rn = F.row_number().over(order).cast("bigint")
    numbered = stamps.withColumn("_rn", rn)
    running = F.max(F.col("stamp") - F.col("_rn")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("fixed", F.col("_rn") + running).drop("_rn")


def require_positive_start(stamps: DataFrame) -> DataFrame:
    """``stamps``; an episode whose first stamp is not positive raises."""
    first = stamps.groupBy("episode_id").agg(F.min_by("stamp", "idx").alias("_first")).where(guard(F.col("_first") > 0, "the first stamp must be positive"))
    return stamps.join(first.select("episode_id"), "episode_id", "left_semi")


def relative(fixed: DataFrame) -> DataFrame:
    """pts: the fixed stamp minus its episode's first, the base."""
    base = fixed.groupBy("episode_id").agg(F.min_by("fixed", "idx").alias("base"))
    return fixed.join(base, "episode_id").withColumn("pts", F.col("fixed") - F.col("base"))


def absolute(base: Column, pts: Column, target_time_base: int, stream_num: int = 1, stream_den: int = NS) -> Column:
    """(base + pts) x target time base x stream time base (a ratio), exactly, rounded down."""
    whole = (base + pts).cast("decimal(38,0)") * F.lit(target_time_base * stream_num).cast("decimal(19,0)")
    return F.floor(whole / F.lit(stream_den).cast("decimal(10,0)")).cast("bigint")


def pad_tail(frames: DataFrame, expected: DataFrame, tolerance: int, stream: str = "stream") -> DataFrame:
    """Each stream's frames brought to its expected number by repeating the last, up to ``tolerance`` of them.

    A larger deficit, or a surplus, raises; so does any deficit with tolerance 0. padded marks repeats.
    """
    payload = [c for c in frames.columns if c not in (stream, "idx")]
    last = frames.groupBy(stream).agg(F.count(F.lit(1)).alias("seen"), F.max_by(F.struct(*payload), "idx").alias("last"))
    need = last.join(expected, stream).withColumn("missing", F.col("expected") - F.col("seen"))
    need = need.where(guard((F.col("missing") >= 0) & (F.col("missing") <= tolerance), "frame count does not fit"))
    fill = need.where("missing > 0").select(stream, F.explode(F.sequence(F.col("seen"), F.col("expected") - 1)).alias("idx"), *(F.col(f"last.{c}").alias(c) for c in payload), F.lit(True).alias("padded"))
    kept = frames.join(need.select(stream), stream, "left_semi").select(stream, "idx", *payload, F.lit(False).alias("padded"))
    return kept.unionByName(fill)


def select_frames(frames: DataFrame, indices: list[int], stream: str = "stream") -> DataFrame:
    """Frames at the distinct indices of each stream. No index, a negative one, or one beyond a stream's end raises."""
    wanted = sorted(set(indices))
    if not wanted or wanted[0] < 0:
        raise ValueError("frame indexes are 0 or more, and one at least")
    ends = frames.groupBy(stream).agg(F.max("idx").alias("_end")).where(guard(F.col("_end") >= wanted[-1], "frame index out of range"))
    return frames.where(F.col("idx").isin(wanted)).join(ends.select(stream), stream, "left_semi")


def nearest_frames(targets: DataFrame, frames: DataFrame, carried: list[str]) -> DataFrame:
    """For each target (episode_id, target_id, t) the nearest frame (episode_id, pts, ``carried``); nulls after the last frame.

    The first frame at or after t is taken unless the one before is strictly closer. One shuffle by episode: targets and frames
    are interleaved by time and each target looks to both sides by window.
    """
    frame = F.struct(F.col("pts").alias("pts"), *carried)
    kind = f"struct<pts:bigint,{','.join(f'{c}:{frames.schema[c].dataType.simpleString()}' for c in carried)}>"
    f = frames.select("episode_id", F.col("pts").alias("t"), F.lit(None).cast(targets.schema["target_id"].dataType).alias("target_id"), frame.cast(kind).alias("frame"))
    both = f.unionByName(targets.select("episode_id", "t", "target_id", F.lit(None).cast(kind).alias("frame")))
    is_target = F.col("frame").isNull().cast("int")
    back = Window.partitionBy("episode_id").orderBy("t", is_target.desc(), *carried_key(carried, desc=False))
    ahead = back.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_next", F.first("frame", ignorenulls=True).over(ahead)).withColumn("_prev", F.last("frame", ignorenulls=True).over(behind))
    seen = seen.where(F.col("frame").isNull())
    closer = F.col("_prev").isNotNull() & (F.col("t") - F.col("_prev.pts") < F.col("_next.pts") - F.col("t"))
    return seen.withColumn("_best", F.when(F.col("_next").isNotNull() & closer, F.col("_prev")).otherwise(F.col("_next"))).select("episode_id", "target_id", "t", "_best.*")


def carried_key(carried: list[str], desc: bool) -> list[Column]:
    """Order of frames with equal stamps: by what they carry."""
    return [F.col(f"frame.{c}").desc() if desc else F.col(f"frame.{c}").asc() for c in carried]
