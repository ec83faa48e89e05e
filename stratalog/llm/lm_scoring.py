"""Deleted interpolation: trigram, bigram and unigram maximum-likelihood estimates mixed by context-frequency buckets.

Counts of all n-grams of all training texts and the counts that every text needs travel in one exchange: document blocks ask hash
ranges about their distinct n-grams, stating how often their training texts hold them, and are answered with the totals (see
packed.py). A tenth of the training texts, chosen by hash, is held out once more and dealt to blocks of its own: their n-gram counts
without themselves give the estimates on which expectation-maximisation learns the weights, one set for each pair of frequency buckets
of the two contexts. Each iteration is one distributed sum. Scoring then uses the counts of all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import id_fold, save
from stratalog.llm.packed import QUESTION, SUMMARY, Values, answers, deal, exchange, layout, pack, questions, unpack
from stratalog.llm.textvec import mix64, windows, words_of

_U = np.uint64
_BOS, _END = mix64(np.array([0xB05, 0xE0D], dtype=np.uint64))
#: Context counts fall into bucket 0 (unseen) or 1 + floor(log2(count)), at most 15.
BUCKETS = 16
#: The hash ranges are asked in so many passes over the texts, so that a fraction of the n-grams is on disk at a time.
PASSES = 2
#: One training text in so many is held out to learn the weights.
HELD_SHARE = 10
ITERATIONS = 12


@dataclass
class Grams:
    """The n-grams of a block: distinct keys by order, and for each predicted token where its five counts are."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    at: list[np.ndarray]
    owner: np.ndarray
    first: np.ndarray  # tokens that begin a text


def _grams(texts: pa.Array, train: np.ndarray, bits: int) -> Grams:
    """``train`` says which texts are counted. ``at``: trigram, its context, bigram, its context, unigram of each token."""
    words = words_of(texts, lower=True)
    n = words.counts
    first = np.concatenate(([0], np.cumsum(n + 3)))
    flat = np.full(int(first[-1]), _BOS, dtype=np.uint64)
    doc = words.doc_of()
    flat[np.arange(len(doc)) + 3 * doc + 2] = words.hashes
    flat[first[1:] - 1] = _END
    owner = np.repeat(np.arange(len(n)), n + 3)
    place = np.arange(len(flat)) - first[owner]
    keys, counts, index = [], [], []
    for k in (1, 2, 3):
        at = np.flatnonzero(place >= k - 1)  # windows that end here, inside their document
        h = flat if k == 1 else windows(flat, k, seed=k)[at - k + 1] >> _U(64 - bits)
        distinct, inverse = np.unique(h, return_inverse=True)
        keys.append(distinct)
        counts.append(np.bincount(inverse[train[owner[at]]], minlength=len(distinct)))
        full = np.zeros(len(flat), dtype=np.int32)
        full[at] = inverse
        index.append(full)
    asked = np.flatnonzero(place >= 2)
    return Grams(keys, counts, [index[2][asked], index[1][asked - 1], index[1][asked], index[0][asked - 1], index[0][asked]], owner[asked], place[asked] == 2)


def _components(grams: Grams, totals: list[np.ndarray], part: slice, n_tokens: int, n_types: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight cell of each token of a part, its four estimates [tokens, 4])."""
    c3, x3, c2, x2, c1 = (totals[k][i[part]].astype(np.float64) for k, i in zip((2, 1, 1, 0, 0), grams.at, strict=True))
    x2[grams.first[part]] /= 2  # two begin marks a text
    parts = np.empty((len(c1), 4))
    parts[:, 0] = np.divide(c3, x3, out=np.zeros_like(c3), where=x3 > 0)
    parts[:, 1] = np.divide(c2, x2, out=np.zeros_like(c2), where=x2 > 0)
    parts[:, 2] = c1 / max(1, n_tokens)
    parts[:, 3] = 1 / (n_types + 1)
    return _bucket(x3) * BUCKETS + _bucket(x2), parts


def _parts(n: int, most: int = 1 << 16) -> list[slice]:
    return [slice(a, min(n, a + most)) for a in range(0, n, most)]


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))), BUCKETS - 1), 0).astype(np.int64)


def learn_weights(events: DataFrame, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights [cell, 4] by expectation-maximisation over held-out events (cells, parts: packed arrays).

    A cell's sums get ten events of the whole held-out set's average added, so that rare cells are not over-fitted; weights of
    estimates that a cell's contexts never have stay zero.
    """
    cells = BUCKETS * BUCKETS
    possible = np.ones((cells, 4))
    possible[:BUCKETS, 0] = 0
    possible[::BUCKETS, 1] = 0
    weights = possible / possible.sum(axis=1, keepdims=True)
    for _ in range(iterations):

        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((cells, 4))
            for batch in batches:
                for cell, parts in zip(batch.column("cells").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                    c, p = np.frombuffer(cell, dtype=np.uint8), np.frombuffer(parts, dtype=np.float32).reshape(-1, 4).astype(np.float64)
                    share = weights[c] * p
                    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
                    sums += np.stack([np.bincount(c, weights=share[:, i], minlength=cells) for i in range(4)], axis=1)
            at = np.flatnonzero(sums.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(sums[at, i]) for i in range(4))], ["cell", "w0", "w1", "w2", "w3"])

        found = events.mapInArrow(expect, "cell int, w0 double, w1 double, w2 double, w3 double").groupBy("cell").agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(4)))
        sums = np.zeros((cells, 4))
        for row in found.collect():  # 256 rows at most
            sums[row[0]] = row[1:]
        average = sums.sum(axis=0) / max(1e-9, sums.sum()) if sums.sum() else np.full(4, 0.25)
        sums = (sums + 10 * np.maximum(average, 1e-6)) * possible
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def weights_learn_from(folds: int = 5, held_fold: int = 1) -> Column:
    """Whether a row (doc_id, text) is of the training texts held out to learn the weights: a tenth by hash, at every size."""
    return (id_fold(F.col("doc_id"), folds) != held_fold) & (F.pmod(F.xxhash64(F.lit("weights"), "doc_id", "text"), F.lit(HELD_SHARE)) == 0)


def score_texts(docs: DataFrame, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    The model learns from the texts whose id fold (crc32 of the id as text modulo ``folds``) is not ``held_fold``; every text is
    scored. Tokens are the words, A-Z lower-cased, and one end mark. base_score is the add-half unigram log10 probability, score
    the mixed model's. A null text counts as empty, a null id as the empty text for its fold; repeated rows count repeatedly;
    with nothing to learn from, every estimate but the uniform one is 0. An empty table gives no rows; texts of any length are taken
    whole. Words are compared by 64-bit hashes, longer n-grams by hashes wide enough for one wrong lookup in two million. Other
    columns are ignored.
    """
    plan = layout(docs, orders=3)
    bits = min(64, plan.word_bits + 20)
    id_type = dict(docs.dtypes)["doc_id"]
    held_blocks = max(1, plan.blocks // HELD_SHARE)
    rest = max(1, plan.blocks - held_blocks)
    place = F.xxhash64("doc_id", "text", "spread")
    block = F.when(weights_learn_from(folds, held_fold), F.pmod(place, F.lit(held_blocks))).otherwise(F.pmod(place, F.lit(rest)) + held_blocks)
    docs = docs.select("doc_id", "text").withColumn("held_out", id_fold(F.col("doc_id"), folds) == held_fold)
    docs = deal(docs, plan, block, "lm-docs")

    def grams_of(table: pa.Table) -> tuple[Grams, np.ndarray]:
        train = ~table.column("held_out").to_numpy().astype(bool)
        return _grams(table.column("text").combine_chunks(), train, bits), train

    def asker(turn: int):  # noqa: ANN202
        def ask(table: pa.Table) -> pa.Table:
            grams, _ = grams_of(table)
            own = int(table.column("block")[0].as_py())
            orders = [(n, 64 if n == 1 else bits, keys, counts, counts if own < held_blocks else None) for n, keys, counts in zip((1, 2, 3), grams.keys, grams.counts, strict=True)]
            return questions(plan, own, orders, lambda i: i % PASSES == turn)

        return ask

    def add(values: Values, starts: np.ndarray, size: np.ndarray) -> Values:
        return np.add.reduceat(values[0], starts), np.add.reduceat(values[1], starts)

    def tell(asker: int, own: Values, total: Values) -> tuple[bytes | None, bytes | None]:
        """Totals; to blocks of held texts also their own share of them."""
        return pack(total[0]), pack(total[1]) if asker < held_blocks else None

    def tokens_and_types(n: int, keys: np.ndarray, total: Values) -> bytes | None:
        if n != 1:
            return None
        real = (keys != _BOS) & (total[0] > 0)
        return pack(np.array([total[0][real].sum(), real.sum()], dtype=np.uint64))

    told = None
    for turn in range(PASSES):
        asked = docs.groupBy("block").applyInArrow(asker(turn), QUESTION)
        part = exchange(asked, plan, lambda n: 64 if n == 1 else bits, add, tell, "lm-counts", tokens_and_types)
        told = part if told is None else told.union(part)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2, dtype=np.uint64)
        for batch in batches:
            for x in batch.column("a0").to_pylist():
                sums += unpack(x)
        yield pa.RecordBatch.from_arrays([pa.array([int(sums[0])]), pa.array([int(sums[1])])], ["tokens", "types"])

    found = told.where(F.col("asker") == SUMMARY).select("a0").mapInArrow(add_up, "tokens bigint, types bigint").agg(F.sum("tokens"), F.sum("types")).first()
    n_tokens, n_types = int(found[0] or 0), int(found[1] or 0)

    def observe(table: pa.Table, counts: pa.Table) -> pa.Table:
        """Estimates for the tokens of held texts, from the counts of the other training texts."""
        out: list[list[bytes]] = [[], []]
        if table.num_rows:
            grams, _ = grams_of(table)
            kept = [answers(counts, "a0", n, len(k)) - answers(counts, "a1", n, len(k)) for n, k in zip((1, 2, 3), grams.keys, strict=True)]
            for part in _parts(len(grams.owner)):
                cell, parts = _components(grams, kept, part, n_tokens, n_types)
                out[0].append(cell.astype(np.uint8).tobytes())
                out[1].append(parts.astype(np.float32).tobytes())
        return pa.table([pa.array(x, pa.binary()) for x in out], ["cells", "parts"])

    some = told.where((F.col("asker") >= 0) & (F.col("asker") < held_blocks))
    events = docs.where(F.col("block") < held_blocks).groupBy("block").cogroup(some.groupBy("asker")).applyInArrow(observe, "cells binary, parts binary")
    weights = learn_weights(save(events, "lm-events"))

    def score(table: pa.Table, counts: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [table.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        grams, _ = grams_of(table)
        totals = [answers(counts, "a0", n, len(k)) for n, k in zip((1, 2, 3), grams.keys, strict=True)]
        n = table.num_rows
        sums = np.zeros((4, n))
        for part in _parts(len(grams.owner)):
            cell, parts = _components(grams, totals, part, n_tokens, n_types)
            mixed = np.log10((weights[cell] * parts).sum(axis=1))
            c = totals[0][grams.at[4][part]].astype(np.float64)
            base = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
            for i, w in enumerate((None, c > 0, base, mixed)):
                sums[i] += np.bincount(grams.owner[part], weights=w, minlength=n)
        cols = [table.column("doc_id"), table.column("held_out"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(n, n_tokens, dtype=np.int64)), pa.array(sums[2]), pa.array(sums[3])]
        return pa.table(cols, names)

    joined = docs.groupBy("block").cogroup(told.where("asker >= 0").select("asker", "range", "n", "a0").groupBy("asker"))
    return joined.applyInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
