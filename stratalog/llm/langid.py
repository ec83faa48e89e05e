"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is a map with one small dense array per task and a keyed sum; the model is a languages x features matrix of
log-probabilities, broadcast once; scoring gathers matrix columns for a batch of texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURE_BITS = 16
ORDERS = (1, 2, 3)
#: The broadcast matrix has 4 bytes for each of 65,536 features a language: 256 MB at this many languages.
MOST_LANGUAGES = 1000
_SLICE_CHARS = 1 << 18
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased texts: (features in order of documents, first feature of each document, has a letter).

    Runs of anything but letters count as one space; n-grams stay inside their document.
    """
    texts = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), lengths)
    letter = _letter_table()[points]
    has_letter = np.bincount(doc, weights=letter, minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    if len(keep):
        keep[0] = True
    points = np.where(letter, points, np.uint32(32))[keep]
    doc = doc[keep]
    grams, docs = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, dtype=np.uint32)
        for j in range(n):
            h = (h ^ points[j : j + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        inside = doc[:m] == doc[n - 1 :]
        grams.append((h >> np.uint32(32 - FEATURE_BITS))[inside])
        docs.append(doc[:m][inside])
    if not grams:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64), has_letter
    gram, owner = np.concatenate(grams), np.concatenate(docs)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return gram[order].astype(np.int64), first, has_letter


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(row offset, texts) with a bounded number of characters each; null texts are empty."""
    start, held, size = 0, [], 0
    for row in range(0, batch.num_rows, 256):  # few texts at a time become Python strings
        for i, text in enumerate(batch.column("text").slice(row, 256).to_pylist(), row):
            held.append(text or "")
            size += len(held[-1])
            if size >= _SLICE_CHARS:
                yield start, held
                start, held, size = i + 1, [], 0
    if held:
        yield start, held


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [languages, features + 1]) from all rows with text and lang; the last column is the prior.

    Counts cover every training row; they are summed by key in Spark, and what reaches the driver is at most one number per
    language and feature.
    """
    width = 1 << FEATURE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in _parts(batch):
                grams, first, has_letter = features(texts)
                own = np.array(langs[start : start + len(texts)], dtype=object)
                for lang in dict.fromkeys(own):
                    mine = np.flatnonzero((own == lang) & has_letter)
                    row = held.setdefault(lang, np.zeros(width + 1, dtype=np.int64))
                    row[width] += len(mine)
                    mask = np.repeat(np.isin(np.arange(len(texts)), mine), np.diff(first))
                    row[:width] += np.bincount(grams[mask], minlength=width)
        for lang, row in held.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], ["lang", "feature", "n"])

    labelled = docs.select("text", "lang").where("text is not null and lang is not null")
    # Counted before anything of them is collected.
    if labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"the matrix is made for {MOST_LANGUAGES} languages at most")
    seen = labelled.mapInArrow(count, "lang string, feature bigint, n bigint")
    table = seen.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), width + 1))
    if langs:
        place = {lang: i for i, lang in enumerate(langs)}
        counts[[place[x] for x in table.column("lang").to_pylist()], table.column("feature").to_numpy()] = table.column("n").to_numpy()
    logs = np.log(counts + 0.5)
    logs[:, :width] -= np.log((counts[:, :width] + 0.5).sum(axis=1, keepdims=True))
    logs[:, width] -= np.log((counts[:, width] + 0.5).sum()) if langs else 0
    return langs, logs.astype(np.float32)


def _labels(batch: pa.RecordBatch, langs: list[str], logs: np.ndarray, width: int) -> Iterator[tuple[str, bool, float]]:
    """(language, has a letter, posterior) of each row."""
    for _, texts in _parts(batch):
        grams, first, has_letter = features(texts)
        if not langs:
            yield from (("und", bool(ok), 0.0) for ok in has_letter)
            continue
        # A zero behind the last text, so that an empty last document has a place to sum from.
        sums = np.stack([np.add.reduceat(np.append(row[grams].astype(np.float64), 0.0), np.minimum(first[:-1], len(grams))) for row in logs])
        sums = np.where(np.diff(first) > 0, sums, 0) + logs[:, width : width + 1]
        best = sums.argmax(axis=0)
        odds = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
        for b, ok, p in zip(best, has_letter, odds, strict=True):
            yield (langs[b], True, float(p)) if ok else ("und", False, 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score: the most probable language and its posterior probability.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned. One row per input row, no shuffle;
    ties go to the first language by name; null ids are passed on.
    """
    langs, logs = model
    width = 1 << FEATURE_BITS
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_labels(batch, langs, shared.value, width))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([p for p, _, _ in found], pa.string()), pa.array([s for _, _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least_score: float = 0.5) -> DataFrame:
    """The rows whose language is identified with ``least_score`` or more, all columns unchanged; ``und`` goes."""
    langs, logs = model
    width = 1 << FEATURE_BITS
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [s for _, _, s in _labels(batch, langs, shared.value, width)]
            yield batch.filter(pa.array([s >= least_score and s > 0 for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
