"""Links between the tokens of two tokenizers over the same bytes, counted through a dictionary of token groups.

Byte offsets at which tokens of both tokenizers end cut a text into groups, and every A token of a group is linked with every B token of
it. Text repeats its words, so there are far fewer distinct groups than groups: a task interns the groups of a chunk of texts, and keeps
for each text only which groups it has and how often. From there all work is on distinct groups:

1. chunks' groups meet by their ids (the exact key) in a dictionary, with the number of documents that hold each;
2. each distinct group is expanded to its links once, an id pair's count being the documents of its groups added up, less what a document
   counts more than once because it holds the pair in several distinct groups (which the chunks report);
3. counts and whether they are their A id's highest are joined to the links of the distinct groups and added up by group, and
4. come back by group to the chunks, where each text multiplies them by how often it has the group.

Texts move never; what a chunk keeps of them is numbers. Groups that very many chunks have are joined by a broadcast of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import save
from stratalog.llm.packed import pack, unpack
from stratalog.llm.textvec import mix64, slices

#: Where the tokenizer files are, unless a path is given.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The pattern that splits a text before A's merges: part of the public byte-level format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are aligned at a time, and of a chunk, which has a dictionary of its own.
SLICE_BYTES, CHUNK_BYTES = 2 << 20, 8 << 20
#: What a text counts in a chunk besides its characters.
TEXT_BYTES = 256
#: Groups that more than one in so many of all chunks' groups are: a hundred thousand at most, joined by a broadcast.
HOT_SHARE, HOT_CHUNKS = 100_000, 256
#: Pair counts that are broadcast; of more, the links meet them by shuffling.
BROADCAST_PAIRS = 200_000
#: Longest text that the faster of two equal encoders of A is given.
FAST_BYTES = 1 << 20

_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
_COLUMNS = {
    "chunk": "string", "doc": "int", "doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string", "own": "binary", "times": "binary",
    "place": "int", "key": "binary", "docs": "bigint", "a_id": "int", "b_id": "int", "surplus": "bigint",
}
_CHUNKS = ", ".join(f"{name} {kind}" for name, kind in _COLUMNS.items())
_DOC = ["chunk", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own", "times"]


def _unicode_bytes() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteLevel:
    """A: ids and byte lengths of a byte-level BPE vocabulary in the ``tokenizers`` format."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._plain = Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, byte = model["model"]["vocab"], _unicode_bytes()
        special = {t["content"] for t in model.get("added_tokens", [])}
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = token.encode() if token in special else bytes(byte[c] for c in token)
        self._fast = self._ranked(vocab, model["model"]["merges"], special)

    def _ranked(self, vocab: dict[str, int], merges: list, special: set[str]):  # noqa: ANN202
        """An encoder by ranks, where ids are the order of the merges, which makes it equal and a few times faster; else None."""
        made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
        ranks = {self.pieces[i]: i for t, i in vocab.items() if t not in special}
        if made != sorted(m for m in made if m is not None) or any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != len(made) + 256:
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        slow = [i for i, t in enumerate(texts) if self._fast is None or len(t) > FAST_BYTES]
        if len(slow) < len(texts):
            kept = set(slow)
            for i, t in enumerate(texts):
                if i not in kept:
                    out[i] = self._fast.encode_ordinary(t)
        for i in slow:
            out[i] = self._plain.encode(texts[i], add_special_tokens=False).ids
        return out


class Pieces:
    """B: ids and bytes of a piece vocabulary with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("\u2581", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizers(folder: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers of a folder, loaded once a process."""
    return ByteLevel(f"{folder}/{A_FILE}"), Pieces(f"{folder}/{B_FILE}")


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, where each text's begin, and the end)."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate([np.array(x, dtype=np.int64) for x in ids]) if ids else np.zeros(0, np.int64)), first


def _usable(texts: list[str], a: list[list[int]], b: list[list[int]], pieces: tuple[list[bytes], list[bytes]]) -> list[bool]:
    """Whether the tokens of both say exactly the bytes of a space and the text."""
    return [bool(t) and b"".join(map(pieces[0].__getitem__, x)) == (raw := f" {t}".encode()) and b"".join(map(pieces[1].__getitem__, y)) == raw for t, x, y in zip(texts, a, b, strict=True)]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


class Groups:
    """The groups of some texts: A and B ids with the number of their group, numbered over all texts."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray]) -> None:
        """``a`` and ``b``: (ids, first of each text); ``sizes``: bytes of each id. Texts' bytes are the same on both sides."""
        self.a, self.b = a[0], b[0]
        ends_a, ends_b = np.cumsum(sizes[0][self.a]), np.cumsum(sizes[1][self.b])
        cut = np.intersect1d(ends_a, ends_b, assume_unique=True)  # tokens of no bytes do not occur
        self.of_a, self.of_b = np.searchsorted(cut, ends_a), np.searchsorted(cut, ends_b)
        self.n = len(cut)
        self.n_a, self.n_b = np.bincount(self.of_a, minlength=self.n), np.bincount(self.of_b, minlength=self.n)
        self.first = np.append(self.of_a, self.n)[a[1]]  # of each text, and the end
        self.text = np.repeat(np.arange(len(a[1]) - 1), np.diff(self.first))

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(``a1,a2|b1;`` of all groups as bytes, where each text's begin, and the end)."""
        before_a = np.concatenate([[0], np.cumsum(self.n_a)])
        before_b = np.concatenate([[0], np.cumsum(self.n_b)])
        place_a = np.arange(len(self.a)) + before_b[self.of_a]
        place_b = np.arange(len(self.b)) + before_a[self.of_b + 1]
        ids, sign = np.zeros(len(self.a) + len(self.b), dtype=np.int64), np.full(len(self.a) + len(self.b), ord(","), dtype=np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        sign[place_a[before_a[1:] - 1]], sign[place_b[before_b[1:] - 1]] = ord("|"), ord(";")
        width = len(str(int(ids.max()))) if len(ids) else 1
        digits = np.empty((len(ids), width + 1), dtype=np.uint8)
        rest = ids.copy()
        for k in range(width - 1, -1, -1):
            rest, digits[:, k] = rest // 10, rest % 10 + 48
        digits[:, width] = sign
        used = 1 + np.searchsorted(10 ** np.arange(1, width, dtype=np.int64), ids, side="right")  # digits of each id
        shown = np.arange(width + 1)[None, :] >= (width - used)[:, None]
        at = np.concatenate([[0], np.cumsum(used + 1)])
        return digits[shown], at[(before_a + before_b)[self.first]]

    def hashes(self, seed: int) -> np.ndarray:
        """A hash of the ids of each group."""
        base = np.uint64(0x9E3779B97F4A7C15)
        out = mix64((self.n_a.astype(np.uint64) << np.uint64(32)) + self.n_b.astype(np.uint64) + np.uint64(seed))
        for ids, of, counts, salt in ((self.a, self.of_a, self.n_a, 1), (self.b, self.of_b, self.n_b, 2)):
            placed = mix64((ids.astype(np.uint64) << np.uint64(32)) + _within(counts).astype(np.uint64) * np.uint64(4) + np.uint64(salt + 4 * seed) * base)
            out += np.add.reduceat(placed, np.cumsum(counts) - counts) if len(counts) else np.zeros(0, np.uint64)
        return mix64(out)

    def interned(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each group's distinct group, a group for each of these); equal hashes of unlike groups are told apart."""
        for seed in range(64):
            _, one, own = np.unique(self.hashes(seed), return_index=True, return_inverse=True)
            if self._alike(one[own]):
                return own, one
        raise RuntimeError("no hash without collisions found")

    def _alike(self, other: np.ndarray) -> bool:
        """Whether each group has the ids of its ``other``."""
        if (self.n_a != self.n_a[other]).any() or (self.n_b != self.n_b[other]).any():
            return False
        for ids, counts in ((self.a, self.n_a), (self.b, self.n_b)):
            start = np.cumsum(counts) - counts
            if (ids != ids[np.repeat(start[other], counts) + _within(counts)]).any():
                return False
        return True

    def keys(self, of: np.ndarray) -> list[bytes]:
        """Exact keys of some groups: the number of A ids, then all ids, as 32-bit integers."""
        start_a, start_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        n_a, n_b = self.n_a[of], self.n_b[of]
        size = 1 + n_a + n_b
        at = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), dtype="<i4")
        flat[at] = n_a
        flat[np.repeat(at + 1, n_a) + _within(n_a)] = self.a[np.repeat(start_a[of], n_a) + _within(n_a)]
        flat[np.repeat(at + 1 + n_a, n_b) + _within(n_b)] = self.b[np.repeat(start_b[of], n_b) + _within(n_b)]
        raw, ends = flat.tobytes(), (4 * (at + size)).tolist()
        return [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def links_of(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(A id << 32 | B id of the distinct links of a group, how often each)."""
    flat = np.frombuffer(key, dtype="<i4").astype(np.int64)
    a, b = flat[1 : 1 + flat[0]], flat[1 + flat[0] :]
    (a, times_a), (b, times_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return ((a[:, None] << 32) | b[None, :]).ravel(), (times_a[:, None] * times_b[None, :]).ravel()


class _Chunk:
    """Groups of the texts of a chunk by number, and what is reported of them."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.links: list[np.ndarray] = []
        self.docs = np.zeros(0, dtype=np.int64)
        self.surplus: dict[int, int] = {}

    def add(self, keys: list[bytes]) -> np.ndarray:
        """The numbers of these groups; new ones are expanded to links here, once."""
        out = np.empty(len(keys), dtype=np.int64)
        for i, key in enumerate(keys):
            n = self.number.get(key)
            if n is None:
                n = self.number[key] = len(self.keys)
                self.keys.append(key)
                self.links.append(links_of(key)[0])
            out[i] = n
        self.docs = np.concatenate([self.docs, np.zeros(len(self.keys) - len(self.docs), dtype=np.int64)])
        return out

    def hold(self, text: np.ndarray, own: np.ndarray) -> None:
        """Texts ``text`` have the distinct groups ``own``: count documents, and pairs that a text has in several groups."""
        self.docs += np.bincount(own, minlength=len(self.docs))
        used, back = np.unique(own, return_inverse=True)
        counts = np.array([len(self.links[g]) for g in used.tolist()], dtype=np.int64)
        flat = np.concatenate([self.links[g] for g in used.tolist()]) if len(used) else np.zeros(0, np.int64)
        pairs, pair = np.unique(flat, return_inverse=True)
        start = np.cumsum(counts) - counts
        several = np.bincount(pair, minlength=len(pairs)) > 1  # only pairs of several groups can be in a text twice
        if not several.any():
            return
        keep = several[pair]
        kept = np.add.reduceat(keep.astype(np.int64), start)
        pair, first = pair[keep], np.cumsum(kept) - kept
        n = kept[back]
        at = np.repeat(first[back], n) + _within(n)
        held = np.sort(np.repeat(text, n) * np.int64(len(pairs)) + pair[at])
        again = held[1:][held[1:] == held[:-1]] % len(pairs)
        for p, times in zip(*(x.tolist() for x in np.unique(again, return_counts=True)), strict=True):
            key = int(pairs[p])
            self.surplus[key] = self.surplus.get(key, 0) + times


def _align(texts: list[str], folder: str, chunk: _Chunk) -> tuple[dict[str, list], list[bytes], list[bytes]]:
    """Of each text: its numbers and digest, and which groups it has and how often, packed."""
    a_side, b_side = tokenizers(folder)
    a, b = a_side.encode([f" {t}" for t in texts]), b_side.encode(texts)
    good = _usable(texts, a, b, (a_side.pieces, b_side.pieces))
    flat_a, flat_b = _flat([x if ok else [] for x, ok in zip(a, good, strict=True)]), _flat([x if ok else [] for x, ok in zip(b, good, strict=True)])
    sizes = tuple(np.array([len(p) for p in side.pieces], dtype=np.int64) for side in (a_side, b_side))
    groups = Groups(flat_a, flat_b, sizes)
    spelled, at = groups.spelled()
    raw, at = spelled.tobytes(), at.tolist()
    digests = [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1], at[1:], strict=True)]
    of, one = groups.interned()
    number = chunk.add(groups.keys(one))[of]
    most = np.int64(max(1, len(chunk.keys)))
    held, times = np.unique(groups.text * most + number, return_counts=True)
    text, own = held // most, held % most
    chunk.hold(text, own)
    ends = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    links = np.concatenate([[0], np.cumsum(groups.n_a.astype(np.int64) * groups.n_b)])
    columns = {
        "n_a": np.diff(flat_a[1]).tolist(), "n_b": np.diff(flat_b[1]).tolist(), "n_groups": np.diff(groups.first).tolist(),
        "n_links": np.diff(links[groups.first]).tolist(), "groups_sha256": digests,
    }
    packed = [(pack(np.diff(own[s:e], prepend=0)), pack(times[s:e])) for s, e in zip(ends[:-1], ends[1:], strict=True)]
    return columns, [p[0] for p in packed], [p[1] for p in packed]


def _batch(**columns: list) -> pa.RecordBatch:
    """A batch of the chunks' table: the given columns, null others."""
    n = len(next(iter(columns.values())))
    kinds = {name: _KINDS[kind] for name, kind in _COLUMNS.items()}
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in kinds.items()], list(kinds))


def chunks(docs: DataFrame, folder: str) -> DataFrame:
    """A saved table of three kinds of rows: a text's numbers with its groups, a chunk's distinct groups, and pairs counted too often."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def report() -> Iterator[pa.RecordBatch]:
            for s in range(0, len(chunk.keys), 50_000):
                keys = chunk.keys[s : s + 50_000]
                yield _batch(chunk=[name] * len(keys), place=list(range(s, s + len(keys))), key=keys, docs=chunk.docs[s : s + 50_000].tolist())
            pairs = list(chunk.surplus)
            if pairs:
                yield _batch(a_id=[p >> 32 for p in pairs], b_id=[p & 0xFFFFFFFF for p in pairs], surplus=list(chunk.surplus.values()))

        chunk, name, size, count = _Chunk(), uuid.uuid4().hex, 0, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                columns, own, times = _align(texts, folder, chunk)
                yield _batch(chunk=[name] * len(texts), doc=list(range(count, count + len(texts))), doc_id=part.column("doc_id").to_pylist(), own=own, times=times, **columns)
                size, count = size + sum(map(len, texts)) + TEXT_BYTES * len(texts), count + len(texts)
                if size >= CHUNK_BYTES:
                    yield from report()
                    chunk, name, size, count = _Chunk(), uuid.uuid4().hex, 0, 0
        yield from report()

    return save(docs.select("doc_id", "text").mapInArrow(align, _CHUNKS), "align-chunks")


def _expanded(groups: DataFrame) -> DataFrame:
    """(key, docs, a_id, b_id, times): the links of each distinct group."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2_000):
                part = batch.slice(s, 2_000)
                found = [links_of(k) for k in part.column("key").to_pylist()]
                n = np.array([len(f[0]) for f in found], dtype=np.int64)
                for low, high in _runs(n, 200_000):
                    pairs, times = np.concatenate([f[0] for f in found[low:high]]), np.concatenate([f[1] for f in found[low:high]])
                    rows = pa.array(np.repeat(np.arange(low, high), n[low:high]))
                    a, b = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("key").take(rows), part.column("docs").take(rows), pa.array(a), pa.array(b), pa.array(times)], ["key", "docs", "a_id", "b_id", "times"])

    return groups.mapInArrow(expand, "key binary, docs bigint, a_id int, b_id int, times bigint")


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``most`` in all, one element at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def pair_counts(table: DataFrame, links: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): in how many documents an id pair is linked, and whether that is its A id's highest."""
    extra = table.where("surplus is not null").select("a_id", "b_id", (-F.col("surplus")).alias("n"))
    counts = links.select("a_id", "b_id", F.col("docs").alias("n")).unionByName(extra).groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    counts = save(counts, "align-counts")
    highest = counts.groupBy("a_id").agg(F.max("n").alias("highest"))  # a row an entry of A's vocabulary, at most
    return counts.join(F.broadcast(highest), "a_id").select("a_id", "b_id", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of (doc_id, text).

    ``n_links`` counts the pairs of an A and a B token in one group, ``n_best`` those whose id pair is linked in as many documents as
    any pair of its A id, ``count_sum`` adds up these numbers of documents over all links. ``groups_sha256`` is the digest of the ids
    of all groups in order.

    Null and empty texts, and texts whose tokens do not spell them, have no tokens: zeros and an empty digest. Each row is a document,
    repeated rows and rows without an id too. A text is encoded whole, in the memory of one task. An empty table gives no rows. Other
    columns are ignored.
    """
    table = chunks(docs, folder)
    own = table.where("place is not null").select("chunk", "place", "key", "docs")
    groups = save(own.groupBy("key").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("held")), "align-groups")
    links = _expanded(groups.select("key", "docs"))
    counted = save(pair_counts(table, links), "align-pairs")
    pairs = F.broadcast(counted) if counted.count() <= BROADCAST_PAIRS else counted
    told = links.join(pairs, ["a_id", "b_id"]).groupBy("key").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    told = save(told, "align-told")

    most = max(HOT_CHUNKS, (groups.agg(F.sum("held")).first()[0] or 0) // HOT_SHARE)
    hot = groups.where(F.col("held") > most).select("key")
    asked = own.select("chunk", "place", "key")
    if hot.count():  # HOT_SHARE at most
        broadcast = F.broadcast(told.join(F.broadcast(hot), "key"))
        answered = asked.join(broadcast, "key").unionByName(asked.join(F.broadcast(hot), "key", "left_anti").join(told, "key"))
    else:
        answered = asked.join(told, "key")
    answers = answered.select("chunk", "place", "n_best", "count_sum")

    def multiply(rows: pa.Table, told: pa.Table) -> pa.Table:
        """A chunk: each text's groups times what is known of them."""
        n = told.num_rows
        best, total, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), told.column("place").to_numpy()
        best[at], total[at] = told.column("n_best").to_numpy(), told.column("count_sum").to_numpy()
        n_best, count_sum = [], []
        for own, times in zip(rows.column("own").to_pylist(), rows.column("times").to_pylist(), strict=True):
            own, times = np.cumsum(unpack(own)).astype(np.int64), unpack(times).astype(np.int64)
            n_best.append(int((times * best[own]).sum()))
            count_sum.append(int((times * total[own]).sum()))
        rest = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        columns = [rows.column(c) for c in rest] + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), rows.column("groups_sha256")]
        return pa.table(columns, [*rest, "n_best", "count_sum", "groups_sha256"])

    texts = table.where("doc is not null").select(*_DOC).withColumnRenamed("chunk", "of")
    result = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return texts.groupBy("of").cogroup(answers.groupBy("chunk")).applyInArrow(multiply, result)
