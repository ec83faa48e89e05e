"""Vector compression to short codes: each part of a vector becomes the number of its codebook's nearest entry.

Components become integers, floor(4096 * x), so distances, sums and ties are exact and do not depend on the order of addition. Nearest
entries are found in a ball tree over the entries of a part position: a node is an entry and the radii that the entries on its near and
far side keep from it. By the triangle inequality a side whose radii lie further from the query's distance to the node than the best
distance so far holds nothing nearer. Radii and distances are square roots in double precision, so bounds are rounded outward, sides on
the very bound are visited, and the squared distances that decide are integers.

Codebooks are small (parts * entries * width of a part) and go to the executors in the function that uses them; a round sends back one
sum per part, entry and component and partition, added up in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import save

#: Components are multiples of one over this.
SCALE = 4096
#: Entries of a leaf of the tree, which are compared one by one.
LEAF = 3
#: Vectors that are coded together.
SLICE = 1 << 14
#: Labels whose sums are broadcast; of more, those that hold over a 10,000th of the rows are, and the others are joined by shuffling.
BROADCAST_LABELS, HOT_SHARE = 50_000, 10_000


@dataclass(frozen=True)
class Ball:
    """An entry, the distances from it that bound its near and far side, and the sides; a leaf has only ``entries``."""

    entries: tuple[int, ...]
    near_radius: float = 0.0
    far_radius: float = 0.0
    near: Ball | None = None
    far: Ball | None = None


def _up(x: np.ndarray) -> np.ndarray:
    """Not below what the double was rounded from."""
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def squared(parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows from an entry."""
    apart = parts - entry
    return np.einsum("ij,ij->i", apart, apart)


def build_tree(entries: np.ndarray, among: tuple[int, ...] | None = None) -> Ball:
    """A ball tree over the rows of ``entries``: the node is the entry furthest from the first, its sides split at the median distance."""
    among = tuple(range(len(entries))) if among is None else among
    if len(among) <= LEAF:
        return Ball(among)
    own = np.array(among)
    centre = own[np.argmax(squared(entries[own], entries[own[0]]))]
    rest = own[own != centre]
    apart = squared(entries[rest], entries[centre])
    order = np.argsort(apart, kind="stable")
    rest, roots = rest[order], np.sqrt(apart[order].astype(np.float64))
    half = len(rest) // 2
    return Ball((int(centre),), float(_up(roots[half - 1])), float(_down(roots[half])), build_tree(entries, tuple(rest[:half].tolist())), build_tree(entries, tuple(rest[half:].tolist())))


class _Search:
    """Nearest entries of many parts at once: each node sees the rows that could find something nearer in it."""

    def __init__(self, entries: np.ndarray, parts: np.ndarray) -> None:
        self.entries, self.parts = entries, parts
        self.best = np.full(len(parts), np.iinfo(np.int64).max, dtype=np.int64)
        self.code = np.full(len(parts), len(entries), dtype=np.int64)
        self.seen = 0

    def _try(self, entry: int, rows: np.ndarray) -> np.ndarray:
        found = squared(self.parts[rows], self.entries[entry])
        self.seen += len(rows)
        better = (found < self.best[rows]) | ((found == self.best[rows]) & (entry < self.code[rows]))
        at = rows[better]
        self.best[at], self.code[at] = found[better], entry
        return found

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        return _up(np.sqrt(self.best[rows].astype(np.float64)))

    def visit(self, ball: Ball, rows: np.ndarray) -> None:
        if not len(rows):
            return
        found = [self._try(entry, rows) for entry in ball.entries]
        if ball.near is None:
            return
        root = np.sqrt(found[0].astype(np.float64))
        low, high = _down(root), _up(root)
        inside = root <= (ball.near_radius + ball.far_radius) / 2
        self.visit(ball.near, rows[inside])
        self.visit(ball.far, rows[~inside])
        reach = self._reach(rows)
        self.visit(ball.far, rows[inside & (_down(ball.far_radius - high) <= reach)])
        self.visit(ball.near, rows[~inside & (_down(low - ball.near_radius) <= reach)])


def nearest_entries(tree: Ball, entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each row; of equally near ones that of lowest index."""
    search = _Search(entries, parts)
    search.visit(tree, np.arange(len(parts)))
    return search.code, search.best


def _bound(width: int) -> int:
    """Components saturate here, so that no squared distance over all parts leaves 62 bits: 2**27 for 64 components."""
    return int(min(1 << 28, np.sqrt(2.0**62 / width) // 2))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of rows of doubles, saturated."""
    most = _bound(values.shape[1])
    return np.clip(np.floor(values * SCALE), -most, most).astype(np.int64)


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of rows of ``width`` finite components, these as a matrix of doubles) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    right = np.flatnonzero(sizes == width)
    values = column.take(pa.array(right)).flatten()
    x = np.asarray(values.cast(pa.float64()).fill_null(np.nan)).reshape(-1, width)
    fine = np.isfinite(x).all(axis=1)
    return right[fine], x[fine]


def _least(held: dict, key, row: tuple, entries: int) -> None:  # noqa: ANN001
    """Keep the smallest row of each of the smallest keys; a null key is the largest."""
    if key not in held or row < held[key]:
        held[key] = row
        if len(held) > 4 * entries:
            kept = sorted(held, key=lambda k: (k is None, k or 0))[:entries]
            for k in set(held) - set(kept):
                del held[k]


def _seeds(cleaned: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids: a few rows a partition, then the smallest of these."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            ids = np.asarray(batch.column("vec_id").fill_null(0))
            null = np.asarray(batch.column("vec_id").is_null())
            order = np.lexsort((ids, null))
            near, count = [], 0
            for i in order.tolist():  # stops behind the rows of the smallest ids of the batch
                key = None if null[i] else int(ids[i])
                if not near or near[-1] != key:
                    count += 1
                    if count > entries:
                        break
                    near.append(key)
                _least(held, key, tuple(np.frombuffer(batch.column("ints")[i].as_py(), dtype="<i4").tolist()), entries)
        kept = sorted(held, key=lambda k: (k is None, k or 0))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array([list(held[k]) for k in kept], pa.list_(pa.int64()))], ["vec_id", "ints"])

    few = cleaned.select("vec_id", "ints").mapInArrow(first, "vec_id bigint, ints array<bigint>")
    rows = few.groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    return np.array([r.ints for r in rows], dtype=np.int64)


@dataclass(frozen=True)
class Codebooks:
    """Entries as integers [parts, entries, width of a part]."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components as decimals, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _coder(books: np.ndarray):  # noqa: ANN202
    """A function from integer vectors to (codes, squared distances) [rows, parts]."""
    trees = [build_tree(b) for b in books]
    parts, _, width = books.shape

    def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, errors = np.zeros((len(x), parts), dtype=np.int64), np.zeros((len(x), parts), dtype=np.int64)
        for p in range(parts):
            codes[:, p], errors[:, p] = nearest_entries(trees[p], books[p], np.ascontiguousarray(x[:, p * width : (p + 1) * width]))
        return codes, errors

    return code


def _vectors(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integer vectors) of a batch of cleaned rows, in slices."""
    column = batch.column("ints")
    for start in range(0, batch.num_rows, SLICE):
        part = column.slice(start, SLICE)
        yield start, np.frombuffer(b"".join(part.to_pylist()), dtype="<i4").reshape(len(part), width).astype(np.int64)


def clean(embeddings: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, ints as little-endian 32-bit integers) of the rows that take part, as a saved table, and how many components they have."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    first = rows.where(usable).agg(F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", F.size("embedding").alias("width"))).alias("least")).first().least
    width = first.width if first else 0

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _rows(batch.column("embedding"), width)
            kept = integers(x).astype("<i4")
            binary = [row.tobytes() for row in kept]
            rest = batch.drop_columns(["embedding"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(binary, pa.binary())], [*rest.schema.names, "ints"])

    fields = rows.drop("embedding").schema.add("ints", "binary")
    if not width:
        return rows.where("false").drop("embedding").withColumn("ints", F.lit(None).cast("binary")), 0
    return save(rows.mapInArrow(convert, fields), "codes-vectors"), width


def train(cleaned: DataFrame, width: int, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks of cleaned rows: the vectors of the smallest ids, then ``rounds`` of assigning all parts and averaging, rounded down."""
    books = _seeds(cleaned, entries).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds):

        def gather(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            code = _coder(books)
            n, k, w = books.shape
            counts, sums = np.zeros((n, k), dtype=np.int64), np.zeros((n, k, w), dtype=np.int64)
            for batch in batches:
                for _, x in _vectors(batch, width):
                    codes, _ = code(x)
                    for p in range(n):
                        own = x[:, p * w : (p + 1) * w]
                        counts[p] += np.bincount(codes[:, p], minlength=k)
                        order = np.argsort(codes[:, p], kind="stable")
                        used, starts = np.unique(codes[order, p], return_index=True)
                        sums[p, used] += np.add.reduceat(own[order], starts, axis=0) if len(order) else 0
            p, e = np.nonzero(counts)
            place = np.tile(np.arange(w), len(p))
            cols = [np.repeat(p, w), np.repeat(e, w), place, np.repeat(counts[p, e], w), sums[p, e].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["part", "entry", "place", "n", "total"])

        told = cleaned.select("ints").mapInArrow(gather, "part bigint, entry bigint, place bigint, n bigint, total bigint")
        exact = F.sum(F.col("total").cast("decimal(20,0)")).alias("total")
        moved = books.copy()
        for r in told.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), exact).collect():  # a row per component of the codebooks
            moved[r.part, r.entry, r.place] = int(r.total) // r.n
        books = moved
    return Codebooks(books)


def _with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors summed over rows of its label; nulls are one label. A sum beyond a long is null."""
    by_label = save(coded.groupBy("label").agg(F.count(F.lit(1)).alias("held"), F.sum(F.col("error").cast("decimal(20,0)")).alias("total")), "codes-labels")
    sums = by_label.select(F.col("label").alias("of"), "held", F.expr("try_cast(total as bigint)").alias("label_error"))
    labels, rows = by_label.agg(F.count(F.lit(1)), F.sum("held")).first()
    same = coded["label"].eqNullSafe(sums["of"])
    if labels <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums.drop("held")), same).drop("of")
    hot = F.broadcast(sums.where(F.col("held") > (rows or 0) // HOT_SHARE).drop("held"))  # HOT_SHARE at most
    marked = coded.join(hot, same, "left").withColumnsRenamed({"label_error": "hot_error"}).withColumn("is_hot", F.col("hot_error").isNotNull()).drop("of")
    found = marked.where("is_hot").drop("is_hot").withColumnRenamed("hot_error", "label_error")
    rest = marked.where("not is_hot").drop("is_hot", "hot_error")
    return found.unionByName(rest.join(sums.drop("held"), rest["label"].eqNullSafe(sums["of"])).drop("of"))


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for (vec_id, label, embedding): one row per vector that takes part.

    ``code`` has two hexadecimal digits per part (so up to 256 ``entries``), ``error`` the squared distances of the parts from their
    entries summed, ``label_error`` that over all rows of the label, ``codebooks_sha256`` the digest of all entries.

    Vectors that are null or hold null or non-finite components are left out, and so are those whose length is not that of the usable
    vector of smallest id or cannot be cut into ``parts`` (empty ones too). Components beyond 2**27 / 4096 (for 64 of them) saturate
    there. Repeated rows are coded each; a repeated id gives the codebooks one entry, its smallest vector; rows without an id come
    last there. With fewer ids than ``entries`` the codebooks are smaller. An empty table gives no rows. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    cleaned, width = clean(embeddings, parts)
    if not width:
        return cleaned.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = train(cleaned, width, parts, entries, rounds)
    held = books.entries

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(held)
        for batch in batches:
            for start, x in _vectors(batch, width):
                codes, errors = code(x)
                rest = batch.slice(start, len(x)).drop_columns(["ints"])
                hexed = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(hexed, pa.string()), pa.array(errors.sum(axis=1))], [*rest.schema.names, "code", "error"])

    coded = save(cleaned.mapInArrow(assign, cleaned.drop("ints").schema.add("code", "string").add("error", "long")), "codes-rows")
    return _with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
