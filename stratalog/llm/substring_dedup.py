"""Substring dedup: fixed-block anchors, probed by every rolling window, hits extended to maximal exact repeats.

A 13-word window always holds one whole block of 7 words that begins at a multiple of 7 in its document. So the index holds only
non-overlapping 7-word reference blocks, a seventh of all positions; every rolling 7-word window of every document probes it. Only
13-word windows around a probe or anchor that hit another document are extended: their first document decides which of them
repeat, and overlapping repeats join to maximal exact ones.

Text moves to its block of documents once, hashes in packed rows (see packed.py); nothing grows with the square of a passage's
frequency, and a phase's shuffle files go before the next begins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.packed import QUESTION, SUMMARY, Values, answers, deal, exchange, layout, pack, questions
from stratalog.llm.textvec import Words, window_starts, windows, words_of

_U = np.uint64


def _anchor_keys(words: Words, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, key index of each rolling window, its position, whether it is an aligned block)."""
    at = window_starts(words.first, k)
    h = windows(words.hashes, k, seed=1)[at] >> _U(64 - bits)
    keys, index = np.unique(h, return_inverse=True)
    doc = np.searchsorted(words.first, at, side="right") - 1
    return keys, index, at, (at - words.first[doc]) % k == 0


def _candidates(words: Words, hit: np.ndarray, k: int, size: int) -> np.ndarray:
    """Positions of the ``size``-word windows that hold a hit ``k``-word window (``hit``: their positions)."""
    at = window_starts(words.first, size)
    marks = np.zeros(len(words.hashes) + 2, dtype=np.int64)
    marks[hit + 1] = 1
    upto = np.cumsum(marks)
    return at[upto[at + size - k + 1] > upto[at]]


def _signed(ids: np.ndarray) -> np.ndarray:
    """Document ids as non-negative numbers, small for ids near 0."""
    return ((ids << 1) ^ (ids >> 63)).view(np.uint64)


def _ids(packed: np.ndarray) -> np.ndarray:
    return (packed >> _U(1)).view(np.int64) ^ -((packed & _U(1)).view(np.int64))


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text that is left): one row per input row.

    A window is ``window`` consecutive words of a document, unchanged. Each word goes that is covered by a window whose words
    also start in a document with a smaller id, judged on the input. Null texts have no words; rows without an id count as
    larger than all others and not as repeats of one another; rows with the same id do not repeat each other. An empty table gives no
    rows; texts of any length are taken whole. Ids must be integers. Windows are compared by 64-bit hashes of their words. Other
    columns are ignored.
    """
    k = (window + 1) // 2
    plan = layout(docs)
    id_type = dict(docs.dtypes)["doc_id"]
    docs = deal(docs.select("doc_id", "text"), plan, F.pmod(F.xxhash64("doc_id", "text", "spread"), F.lit(plan.blocks)), "ss-docs")
    bits = min(64, plan.word_bits + 11)
    last = np.iinfo(np.int64).max

    def texts_of(table: pa.Table) -> tuple[Words, np.ndarray]:
        return words_of(table.column("text").combine_chunks()), table.column("doc_id").cast(pa.int64()).fill_null(last).to_numpy()

    def probe(table: pa.Table) -> pa.Table:
        """Each distinct anchor-sized window, with flags: 1 for an aligned block, 2 for two documents."""
        words, ids = texts_of(table)
        keys, index, at, aligned = _anchor_keys(words, k, bits)
        doc = ids[np.searchsorted(words.first, at, side="right") - 1]
        flags = np.zeros(len(keys), dtype=np.uint64)
        flags[index[aligned]] = 1
        order = np.argsort(index, kind="stable")
        if len(order):
            starts = np.flatnonzero(np.diff(index[order], prepend=-1))
            flags |= (np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)).astype(np.uint64) << _U(1)
        return questions(plan, int(table.column("block")[0].as_py()), [(0, bits, keys, flags, None)])

    def meet(values: Values, starts: np.ndarray, size: np.ndarray) -> Values:
        return np.bitwise_or.reduceat(values[0], starts) | ((size > 1).astype(np.uint64) << _U(1)), values[1][starts]

    def live(asker: int, own: Values, total: Values) -> tuple[bytes, None]:
        return pack(total[0] == 3), None

    def window_keys(words: Words, hits: pa.Table) -> tuple[np.ndarray, ...]:
        """(positions, distinct keys, key index, document) of the windows around hits."""
        keys, index, at, _ = _anchor_keys(words, k, bits)
        at = _candidates(words, at[answers(hits, "a0", 0, len(keys)).astype(bool)[index]], k, window)
        distinct, index = np.unique(windows(words.hashes, window, seed=2)[at] if len(at) else np.zeros(0, dtype=np.uint64), return_inverse=True)
        return at, distinct, index, np.searchsorted(words.first, at, side="right") - 1

    def extend(table: pa.Table, hits: pa.Table) -> pa.Table:
        """Each distinct window around a hit, with its smallest document here."""
        if not table.num_rows:
            return questions(plan, 0, [])
        words, ids = texts_of(table)
        _, keys, index, doc = window_keys(words, hits)
        return questions(plan, int(table.column("block")[0].as_py()), [(1, 64, keys, _signed(_lowest(index, ids[doc], len(keys))), None)])

    def first_of(values: Values, starts: np.ndarray, size: np.ndarray) -> Values:
        return _signed(np.minimum.reduceat(_ids(values[0]), starts)), values[1][starts]

    def earlier(asker: int, own: Values, total: Values) -> tuple[bytes, None]:
        return pack(_ids(total[0]) < _ids(own[0])), None

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (table.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.string())], names)
        words, ids = texts_of(table)
        at, keys, index, doc = window_keys(words, told)
        before = answers(told, "a0", 1, len(keys)).astype(bool)
        low = _lowest(index, ids[doc], len(keys))
        repeat = before[index] | (ids[doc] > low[index]) if len(at) else np.zeros(0, dtype=bool)
        marks = np.zeros(len(words.hashes) + 1, dtype=np.int32)
        np.add.at(marks, at[repeat], 1)
        np.add.at(marks, at[repeat] + window, -1)
        gone = np.cumsum(marks[:-1]) > 0
        texts = _kept(words, gone)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
        digests = [hashlib.sha256(t).hexdigest() for t in texts]
        return pa.table([table.column("doc_id"), pa.array(words.counts), pa.array(removed.astype(np.int64)), pa.array(digests), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names)

    asked = docs.groupBy("block").applyInArrow(probe, QUESTION)
    hits = exchange(asked, plan, lambda n: bits, meet, live, "ss-hits")
    asked = docs.groupBy("block").cogroup(hits.groupBy("asker")).applyInArrow(extend, QUESTION)
    firsts = exchange(asked, plan, lambda n: 64, first_of, earlier, "ss-firsts")
    told = hits.unionByName(firsts).where(F.col("asker") != SUMMARY)
    return docs.groupBy("block").cogroup(told.groupBy("asker")).applyInArrow(cut, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def _lowest(index: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The smallest document id of each key."""
    out = np.full(n, np.iinfo(np.int64).max)
    order = np.argsort(index, kind="stable")
    if n:
        out[:] = np.minimum.reduceat(ids[order], np.flatnonzero(np.diff(index[order], prepend=-1)))
    return out


def _kept(words: Words, gone: np.ndarray) -> list[bytes]:
    """Of each document the words that stay, joined by one space: whole arrays of bytes are moved, not words."""
    stay = ~gone
    starts, ends = words.starts[stay], words.ends[stay]
    marks = np.zeros(len(words.data) + 1, dtype=np.int8)
    marks[starts] += 1
    np.subtract.at(marks, ends, 1)
    own = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    stops = np.cumsum(ends - starts + 1)  # each word and a space
    out = np.full(int(stops[-1]) if len(stops) else 0, 32, dtype=np.uint8)
    place = np.ones(len(out), dtype=bool)
    place[stops - 1] = False
    out[place] = words.data[own]
    whole = out.tobytes()
    edges = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(stay)))[words.first]]
    return [whole[a : b - 1] if b > a else b"" for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
