"""Exchange of word-window hashes between document blocks and hash ranges, as packed arrays.

Documents are dealt once to blocks of a few megabytes of text, in a table bucketed by block, so that each phase reads its blocks
without moving text. A block asks about the distinct hashes of its windows: one row per block and range of hashes, holding sorted keys
as byte planes of their differences (high planes are nearly all zero and vanish in compression) with a value or two per key. A task per
range merges the questions and answers with one value per key in the order asked, so answers carry no keys. Blocks recompute their keys
to read the answers.

A key that many blocks hold does not pile up in one task: blocks form groups of GROUP_BLOCKS, a group's questions about a coarse range are
merged first, and only the merged ones meet those of other groups. Work follows the keys asked about, never blocks times ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import save, save_bucketed

#: Text bytes of a document block, about, and keys of a hash range, at most about (at six bytes a word).
BLOCK_BYTES, RANGE_KEYS = 2 << 20, 3 << 19
#: Blocks whose questions are merged first, and bits of the coarse ranges in which they are.
GROUP_BLOCKS, COARSE_BITS = 4096, 10
#: Blocks of a bucket, and buckets of a table, at most.
BUCKET_BLOCKS, MOST_BUCKETS = 6, 50_000
QUESTION = "part bigint, range bigint, asker bigint, n int, keys binary, v0 binary, v1 binary"
_REPLY = "part bigint, range bigint, asker bigint, n int, a0 binary, a1 binary"
#: Answers to nobody: what summary() makes of a range.
SUMMARY = -1


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes: plane count, then all low bytes, all second bytes, and so on."""
    values = values.astype(np.uint64)
    top = int(values.max()) if len(values) else 0
    planes = max(1, (top.bit_length() + 7) // 8)
    raw = values.astype("<u8").view(np.uint8).reshape(len(values), 8)
    return bytes([planes]) + np.ascontiguousarray(raw[:, :planes].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The inverse of pack()."""
    planes = data[0]
    raw = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :planes] = raw.T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


@dataclass(frozen=True)
class Layout:
    """How many blocks, groups and hash ranges, and how many hash bits keep collisions equally rare at every size."""

    blocks: int
    range_bits: int
    word_bits: int
    group_blocks: int
    most_coarse_bits: int

    @property
    def groups(self) -> int:
        return -(-(self.blocks + 1) // self.group_blocks)

    @property
    def coarse_bits(self) -> int:
        return self.range_bits if self.groups == 1 else min(self.range_bits, self.most_coarse_bits)


def layout(docs: DataFrame, orders: int = 1) -> Layout:
    """The layout for these documents with ``orders`` windows a word, from one scan of text lengths.

    All numbers follow the data alone.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    ranges = max(1, -(-size * orders // (6 * RANGE_KEYS)))
    return Layout(blocks=max(1, -(-size // BLOCK_BYTES)), range_bits=(ranges - 1).bit_length(), word_bits=max(20, (size // 4).bit_length()), group_blocks=GROUP_BLOCKS, most_coarse_bits=COARSE_BITS)


def deal(docs: DataFrame, plan: Layout, block: Column, name: str) -> DataFrame:
    """``docs`` with their ``block``, written once and bucketed by it.

    ``block`` may use any column and ``spread``, a number that is another for each row, so that repeated rows and rows
    without an id spread too.
    """
    buckets = max(1, min(MOST_BUCKETS, -(-plan.blocks // BUCKET_BLOCKS)))
    dealt = docs.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())).withColumn("block", block.cast("bigint")).drop("spread")
    return save_bucketed(dealt, name, "block", buckets)


def cuts(keys: np.ndarray, bits: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranges that hold any of the sorted ``bits``-bit keys, by their ``top`` highest bits; where each begins, and the end)."""
    ranges = keys >> np.uint64(bits - top) if top else np.zeros(len(keys), dtype=np.uint64)
    starts = np.flatnonzero(np.diff(ranges, prepend=~ranges[:1]))
    return ranges[starts].astype(np.int64), np.append(starts, len(keys))


def questions(plan: Layout, block: int, orders: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]], wanted: Callable[[int], bool] = lambda i: True) -> pa.Table:
    """A block's questions: for each (order, key bits, sorted distinct keys, values, more values or None) one row a ``wanted`` range."""
    cols: dict[str, list] = {c: [] for c in ("part", "range", "asker", "n", "keys", "v0", "v1")}
    for n, bits, keys, values, more in orders:
        ranges, at = cuts(keys, bits, plan.coarse_bits)
        for i, a, b in zip(ranges.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if wanted(i):
                row = (block // plan.group_blocks, i, block, n, pack_sorted(keys[a:b]), pack(values[a:b]), None if more is None else pack(more[a:b]))
                for held, v in zip(cols.values(), row, strict=True):
                    held.append(v)
    return _table(cols, 4)


def _table(cols: dict[str, list], numbers: int) -> pa.Table:
    kinds = [pa.int64()] * (numbers - 1) + [pa.int32()] + [pa.binary()] * (len(cols) - numbers)
    return pa.table([pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)], list(cols))


Values = tuple[np.ndarray, np.ndarray]
#: (both values in order of keys, where each key begins, how many asked) to both merged values.
Merge = Callable[[Values, np.ndarray, np.ndarray], Values]
#: (asker, its own values, the merged values of its keys) to its answer.
Answer = Callable[[int, Values, Values], tuple[bytes | None, bytes | None]]
#: (order, distinct keys, merged values) to what is answered to SUMMARY, or None.
Summary = Callable[[int, np.ndarray, Values], bytes | None]


def _merged(rows: pa.Table, merge: Merge) -> tuple[list[int], np.ndarray, Values, np.ndarray, np.ndarray, Values]:
    """(askers, where their keys end, values as asked, sort order, key starts in that order, merged values) and distinct keys last."""
    parts = [unpack_sorted(x) for x in rows.column("keys").to_pylist()]
    own0 = [unpack(x) for x in rows.column("v0").to_pylist()]
    own1 = [np.zeros(len(p), dtype=np.uint64) if x is None else unpack(x) for p, x in zip(parts, rows.column("v1").to_pylist(), strict=True)]
    keys, own = np.concatenate(parts), (np.concatenate(own0), np.concatenate(own1))
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    size = np.diff(np.append(starts, len(keys)))
    total = merge((own[0][order], own[1][order]), starts, size)
    return rows.column("asker").to_pylist(), np.cumsum([len(p) for p in parts]), own, order, size, total, keys[order][starts]


def _orders(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    of = table.column("n").to_numpy()
    for n in np.unique(of).tolist():
        yield n, table.filter(pa.array(of == n))


def _tell(out: dict[str, list], rows: tuple, n: int, part: int, place: int, total: Values, answer: Answer) -> None:
    """Append each asker's answer, from the values of all distinct keys of a range."""
    askers, ends, own, order, size, _, _ = rows
    full = []
    for values in total:
        spread = np.empty(len(order), dtype=np.uint64)
        spread[order] = np.repeat(values, size)
        full.append(spread)
    for asker, a, b in zip(askers, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        told = answer(asker, (own[0][a:b], own[1][a:b]), (full[0][a:b], full[1][a:b]))
        for held, v in zip(out.values(), (part, place, asker, n, *told), strict=True):
            held.append(v)


def _reply() -> dict[str, list]:
    return {c: [] for c in ("part", "range", "asker", "n", "a0", "a1")}


def exchange(asked: DataFrame, plan: Layout, bits: Callable[[int], int], merge: Merge, answer: Answer, name: str, summary: Summary = lambda n, keys, total: None) -> DataFrame:
    """Answers (part, range, asker, n, a0, a1) to the questions, one for each, as a saved table; ``bits``: key bits by order."""

    def whole(table: pa.Table) -> pa.Table:
        """A range of all blocks' questions (or of all groups'): the answers."""
        out = _reply()
        place = int(table.column("range")[0].as_py())
        for n, rows in _orders(table):
            merged = _merged(rows, merge)
            _tell(out, merged, n, 0, place, merged[5], answer if plan.groups == 1 else lambda asker, own, total: (pack(total[0]), pack(total[1])))
            told = summary(n, merged[6], merged[5])
            if told is not None:
                for held, v in zip(out.values(), (0, place, SUMMARY, n, told, None), strict=True):
                    held.append(v)
        return _table(out, 4)

    if plan.groups == 1:
        return save(asked.groupBy("range").applyInArrow(whole, _REPLY), name)
    shift = plan.range_bits - plan.coarse_bits

    def fold(table: pa.Table) -> pa.Table:
        """A coarse range of one group's questions: the group's own questions about fine ranges."""
        cols: dict[str, list] = {c: [] for c in ("part", "range", "asker", "n", "keys", "v0", "v1")}
        part = int(table.column("part")[0].as_py())
        for n, rows in _orders(table):
            *_, total, keys = _merged(rows, merge)
            ranges, at = cuts(keys, bits(n), plan.range_bits)
            for i, a, b in zip(ranges.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for held, v in zip(cols.values(), (part, i, part, n, pack_sorted(keys[a:b]), pack(total[0][a:b]), pack(total[1][a:b])), strict=True):
                    held.append(v)
        return _table(cols, 4)

    def pass_on(table: pa.Table, told: pa.Table) -> pa.Table:
        """A coarse range of one group: what the fine ranges say, to its blocks."""
        out = _reply()
        if not table.num_rows:
            return _table(out, 4)
        part, place = int(table.column("part")[0].as_py()), int(table.column("range")[0].as_py())
        replies = {n: rows.sort_by("range") for n, rows in _orders(told)}
        for n, rows in _orders(table):
            merged = _merged(rows, merge)
            total = tuple(np.concatenate([unpack(x) for x in replies[n].column(c).to_pylist()]) for c in ("a0", "a1"))
            assert len(total[0]) == len(merged[6]), "answers do not fit the questions"
            _tell(out, merged, n, part, place, total, answer)
        return _table(out, 4)

    asked = save(asked, f"{name}-asked")
    told = save(asked.groupBy("part", "range").applyInArrow(fold, QUESTION).groupBy("range").applyInArrow(whole, _REPLY), f"{name}-groups")
    mine = told.where(F.col("asker") != SUMMARY).select(F.col("asker").alias("part"), F.shiftright("range", shift).alias("coarse"), "range", "n", "a0", "a1")
    passed = asked.groupBy("part", "range").cogroup(mine.groupBy("part", "coarse")).applyInArrow(pass_on, _REPLY)
    return save(passed, name).unionByName(told.where(F.col("asker") == SUMMARY))


def answers(table: pa.Table, column: str, n: int, count: int) -> np.ndarray:
    """What a block was told about order ``n``, one packed piece a range, in the order of its sorted keys."""
    rows = zip(table.column("n").to_pylist(), table.column("range").to_pylist(), table.column(column).to_pylist(), strict=True)
    parts = [unpack(x) for order, _, x in sorted((r for r in rows if r[0] == n), key=lambda r: r[1])]
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    assert len(out) == count, "answers do not fit the questions"
    return out
