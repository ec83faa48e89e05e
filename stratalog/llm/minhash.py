"""MinHash near-duplicate detection: universal hash minima, banding, verification on full sets, connected components.

Plan, with nothing but narrow rows between the passes over texts:

1. one map over the texts gives each document its set size, a 128-bit digest of the set, 200 minima folded into 40 band keys,
   and a 200-bit sketch of the minima;
2. documents with equal sets collapse to their smallest id (a keyed minimum), so copies never meet each other again;
3. band buckets with two members or more give candidates. First every document meets one pivot of its buckets, that whose sketch
   is nearest, if it is near at all; whole texts decide, and components come from alternating large-star and small-star;
4. then, in each bucket that still spans several components, the members outside its largest component meet all members of other
   components in that bucket, in blocks of texts: no pair that shares a bucket is left out unless it is in one component already.

A pair with similarity 0.8 shares no bucket with probability (1 - 0.8^5)^40, about 1e-7. No bucket, group or candidate list is
capped. Stars with many members are dealt over salted tasks, and the joins of the component search take nodes with very many edges
by a broadcast of bounded size. MOST_BITS spares hopeless pairs in the first meeting only; the second one has no such filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import drop_saved, save
from stratalog.llm.textvec import mix64, slices, window_starts, windows, words_of

BANDS, ROWS = 40, 5
#: Sketch bits that may differ: at similarity 0.8, 20 of 200 do on average; 45 are six standard deviations more.
MOST_BITS = 45
#: Star members that one task verifies against one centre.
STAR_TASK = 256
#: Up to so many rows of ids and places, some 50 bytes each, are broadcast to the texts; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Texts of a chunk in the last comparison; a block has two chunks.
BLOCK = 256
#: A node with this share of all edges, and HEAVY_LEAST of them, is joined by broadcast: at most twice 1 / HEAVY_SHARE such nodes.
HEAVY_SHARE, HEAVY_LEAST = 1 / 1000, 256

_N = BANDS * ROWS
_SEEDS = mix64(np.arange(1, 2 * _N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _SEEDS[:_N] | np.uint64(1), _SEEDS[_N:]
_SKETCH = [f"s{i}" for i in range(4)]


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit shingle hashes in order of documents and ascending, first index of each document).

    A text with fewer than ``k`` words has its whole word sequence as one shingle; one without words has none.
    """
    words = words_of(texts, lower=True)
    n_docs = len(words.first) - 1
    at = window_starts(words.first, k)
    hashes = [windows(words.hashes, k, seed=k)[at]] if len(at) else []
    owner = [np.searchsorted(words.first, at, side="right") - 1] if len(at) else []
    counts = words.counts
    for short in range(1, k):
        docs = np.flatnonzero(counts == short)
        if len(docs):
            hashes.append(windows(words.hashes, short, seed=short)[words.first[docs]])
            owner.append(docs)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(n_docs + 1, dtype=np.int64)
    h, doc = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of every universal hash (multiply-shift, 32 bits) over each non-empty set: [sets, 200]."""
    starts = first[:-1]
    out = np.empty((len(starts), _N), dtype=np.uint32)
    work = np.empty(len(h), dtype=np.uint64)
    for i in range(_N):
        np.multiply(h, _A[i], out=work)
        np.add(work, _B[i], out=work)
        out[:, i] = np.minimum.reduceat((work >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _describe(k: int):  # noqa: ANN202
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, first = shingle_sets(batch.column("text"), k)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                n = len(sizes)
                digest = np.zeros((n, 2), dtype=np.uint64)
                bands = np.zeros((n, BANDS), dtype=np.int64)
                sketch = np.zeros((n, 4), dtype=np.int64)
                if len(full):
                    dense = np.append(first[full], len(h))
                    digest[full, 0] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), dense[:-1])
                    digest[full, 1] = np.add.reduceat(mix64(h + np.uint64(0x14057B7EF767814F)), dense[:-1])
                    minima = signatures(h, dense)
                    rows = minima.reshape(len(full), BANDS, ROWS).astype(np.uint64)
                    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(ROWS):
                        key = mix64(key * np.uint64(0xD1342543DE82EF95) + rows[:, :, r])
                    bands[full] = key.view(np.int64)
                    bits = (minima & 1).astype(np.int64).reshape(len(full), 4, _N // 4)
                    sketch[full] = (bits << np.arange(_N // 4, dtype=np.int64)).sum(axis=2)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(digest.tobytes())]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), packed, lists, *(pa.array(sketch[:, i]) for i in range(4))],
                    ["doc_id", "n_shingles", "digest", "bands", *_SKETCH],
                )

    return describe


def _with_texts(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """``placed`` with the text of each id; up to BROADCAST_ROWS of it meet the texts where those are read."""
    placed = save(placed, "mh-placed")
    small = placed.count() <= BROADCAST_ROWS
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(placed) if small else placed, "id")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (center, id), those whose full sets have at least ``percent`` % in common.

    Texts travel once per pair, to a task per centre and salt; a centre with many members is dealt over many tasks.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    stars = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / STAR_TASK).cast("int").alias("salts"))
    members = pairs.join(stars, "center").select("center", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "id", F.lit(0).alias("role"))
    centres = stars.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("center").alias("id"), F.lit(-1).alias("role"))
    dealt = _with_texts(members.unionByName(centres), docs).repartition("center", "salt").sortWithinPartitions("center", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for whole in batches:
            for batch in slices(whole, "text"):
                h, first = shingle_sets(batch.column("text"), k)
                centers, salts, ids, roles = (batch.column(c).to_pylist() for c in ("center", "salt", "id", "role"))
                a, b = [], []
                for i, (center, salt, other, role) in enumerate(zip(centers, salts, ids, roles, strict=True)):
                    own = h[first[i] : first[i + 1]]
                    if now != (center, salt):
                        now, held = (center, salt), []
                    if role < 0:  # the centre comes first; rows of one id may have several texts
                        held.append(own.copy())
                        continue
                    for mine in held if len(own) else ():
                        if len(mine):
                            both = np.concatenate((mine, own))
                            both.sort()
                            common = int((both[1:] == both[:-1]).sum())
                            if 100 * common >= percent * (len(both) - common):
                                a.append(center)
                                b.append(other)
                                break
                kind = batch.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    return dealt.select("center", "salt", "id", "role", "text").mapInArrow(compare, f"a {id_type}, b {id_type}").distinct()


def compare_blocks(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (key, id, component, major, n_major, n_minor) of one bucket and different components, alike enough.

    All pairs of a block are compared, and as many of the alike ones reported as join what is alike: fewer than its members.
    ``major`` marks the members of one component of the bucket. Members are dealt to chunks of about BLOCK texts, major ones apart;
    each chunk of others meets all chunks, and a task's block is one such pair of chunks. So a text of the major component travels
    once a chunk of others, and intersections of a block come from products of its sets' incidence matrices.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    placed = members
    for side in ("n_major", "n_minor"):  # members to chunks
        placed = placed.withColumn(side, F.ceil(F.col(side) / BLOCK).cast("int"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.when(F.col("major"), F.col("n_major")).otherwise(F.col("n_minor"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    with_major = F.when(F.col("n_major") > 0, F.transform(upto(F.col("n_major")), lambda j: block(0, F.col("chunk"), j))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))
    among = F.transform(upto(F.col("n_minor")), lambda o: block(1, F.least(F.col("chunk"), o), F.greatest(F.col("chunk"), o)))
    blocks = F.when(F.col("major"), F.transform(upto(F.col("n_minor")), lambda i: block(0, i, F.col("chunk")))).otherwise(F.concat(with_major, among))
    placed = placed.select("key", "id", "component", F.explode(blocks).alias("block")).select("key", "block.kind", "block.i", "block.j", "id", "component")
    dealt = _with_texts(placed, docs).repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if len({c for _, c, _ in held}) > 1:
                h, first = shingle_sets(pa.array([t for _, _, t in held], pa.string()), k)
                common = _intersections(h, first)
                size = np.diff(first)
                part = np.unique([c for _, c, _ in held], return_inverse=True)[1]
                alike = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (part[:, None] != part[None, :]) & (size > 0)[:, None]
                x, y = _forest(alike, part)
                ids = [i for i, _, _ in held]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in x], kind), pa.array([ids[i] for i in y], kind)], ["a", "b"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for key, which, i, j, own, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, which, i, j) != now:
                    yield from close()
                    now, held = (key, which, i, j), []
                held.append((own, component, text))
        if held:
            yield from close()

    return dealt.select("key", "kind", "i", "j", "id", "component", "text").mapInArrow(compare, f"a {id_type}, b {id_type}").distinct()


def _intersections(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by slices of the incidence matrix."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.argsort(h, kind="stable")
    column = np.cumsum(np.diff(h[order], prepend=h[order[:1]]) != 0)
    shared = np.bincount(column, minlength=1)[column] > 1  # shingles of one set meet nothing
    doc, column = doc[order][shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, n), dtype=np.float32)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, (a, a + width))
        part = np.zeros((n, width), dtype=np.float32)
        part[doc[low:high], column[low:high] - a] = 1
        out += part @ part.T
    np.fill_diagonal(out, np.diff(first))
    return out.astype(np.int64)


def _join_totals(rows: DataFrame, totals: DataFrame, key: str, heavy: int) -> DataFrame:
    """``rows`` with the other columns of ``totals`` (one row a key, n: its rows): keys of ``heavy`` rows or more come by broadcast."""
    names = [c for c in totals.columns if c != key]
    hot = F.broadcast(totals.where(F.col("n") >= heavy).select(F.col(key).alias("hot"), F.struct(*names).alias("told")))
    both = rows.join(hot, F.col(key) == F.col("hot"), "left")
    light = both.where("hot is null").select(*rows.columns).join(totals.where(F.col("n") < heavy), key).select(*rows.columns, *names)
    return light.union(both.where("hot is not null").select(*rows.columns, *(F.col(f"told.{c}") for c in names)))


def _heavy(rows: int) -> int:
    return max(HEAVY_LEAST, int(rows * HEAVY_SHARE))


def _forest(alike: np.ndarray, part: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of alike members that join all alike ones, members of one part being joined already."""
    root = list(range(int(part.max()) + 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: tuple[list[int], list[int]] = ([], [])
    for i, own in enumerate(part.tolist()):
        near = np.flatnonzero(alike[i, :i])
        for j in near[np.unique(part[near], return_index=True)[1]].tolist():  # one member of each part
            a, b = find(own), find(int(part[j]))
            if a != b:
                root[a] = b
                out[0].append(j)
                out[1].append(i)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), by alternating large-star and small-star.

    Each round is two keyed minima and two joins, written as a table; rounds grow with the logarithm of the size. Ids without
    an edge are absent; self-edges and repeated edges are ignored; null ends too.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    while not _are_stars(now):
        heavy = _heavy(now.count())
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _join_totals(both, low, "u", heavy).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _join_totals(large, low, "u", heavy).select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        after = save(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "cc-edges")
        drop_saved(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: then every edge leads to its component's smallest id."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).union(edges.select("v", F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("n"))
    return seen.agg(F.coalesce(F.bool_or(F.expr("out > 1 or (out > 0 and n > out)")), F.lit(False))).first()[0] is False


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked if their sets of distinct ``shingle``-word shingles (A-Z lower-cased) have ``percent`` % of their union
    in common; component_id is the smallest doc_id reachable and kept marks it. A text with fewer words is one shingle; null
    and empty texts have none, link with nothing and are kept. Rows without an id link with nothing and are kept, with a null
    component_id. Repeated rows share their component, so both are kept or neither; rows that share an id but not their text are
    one document with several texts, and a link of any is its link. An empty table gives no rows; texts of any length are taken
    whole. Other columns are ignored.
    """
    described = save(docs.select("doc_id", "text").mapInArrow(_describe(shingle), f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles bigint, digest binary, bands array<bigint>, " + ", ".join(f"{s} bigint" for s in _SKETCH)), "mh-sets")
    linked = described.where("n_shingles > 0 and doc_id is not null")
    classes = save(linked.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep")), "mh-classes")
    named = classes.select(F.col("digest").alias("own"), F.col("n_shingles").alias("size"), "rep")
    of_rep = linked.join(named, (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("own")) & (F.col("n_shingles") == F.col("size")))
    reps = save(of_rep.select("rep", "digest", "bands", *_SKETCH).dropDuplicates(["rep", "digest"]), "mh-reps")
    keyed = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("key")).distinct()
    heavy = _heavy(reps.count() * BANDS)
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.xxhash64("id")).alias("center")).where("n > 1")
    buckets = save(_join_totals(keyed, full, "key", heavy).select("key", "id", "center"), "mh-buckets")

    # An id with several texts links their classes.
    several = linked.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1").select("doc_id")
    same_id = linked.join(several, "doc_id").select("doc_id", F.col("digest").alias("mine"), F.col("n_shingles").alias("own_size")).join(named, (F.col("mine") == F.col("own")) & (F.col("own_size") == F.col("size")))
    same_id = same_id.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    sketch = reps.select("rep", *_SKETCH)
    apart = sum((F.bit_count(F.col(f"l{s}").bitwiseXOR(F.col(f"r{s}"))) for s in _SKETCH), F.lit(0))
    left, right = (sketch.select(F.col("rep").alias(side), *(F.col(s).alias(f"{m}{s}") for s in _SKETCH)) for side, m in (("center", "l"), ("id", "r")))
    pairs = buckets.where("id <> center").select("center", "id").distinct()
    pairs = pairs.join(left, "center").join(right, "id").withColumn("apart", apart).where(F.col("apart") <= MOST_BITS)
    pairs = save(pairs.groupBy("id").agg(F.min_by("center", F.struct("apart", "center")).alias("center")).select("center", "id"), "mh-pairs")
    edges = verify(pairs, docs, shingle, percent) if pairs.take(1) else same_id.limit(0)
    found = save(connected_components(edges.union(same_id)), "mh-components")

    labelled = buckets.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members"))
    tops = parts.groupBy("key").agg(F.min_by(F.struct("component", "n"), F.struct((-F.col("n")).alias("fewer"), "component")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("members").alias("members")).where("parts > 1")
    tops = tops.groupBy("n", "members").agg(F.min("key").alias("key"), F.min_by("top", "key").alias("top"))  # buckets of the same members count once
    tops = tops.select("key", "n", F.col("top.component").alias("top"), F.col("top.n").alias("n_major"), (F.col("n") - F.col("top.n")).alias("n_minor"))
    apart_yet = _join_totals(labelled, tops, "key", heavy).select("key", "id", "component", (F.col("component") == F.col("top")).alias("major"), "n_major", "n_minor")
    apart_yet = save(apart_yet, "mh-open")
    if apart_yet.take(1):
        more = save(compare_blocks(apart_yet, docs, shingle, percent), "mh-edges")
        if more.take(1):
            to = found.select(F.col("id").alias("of"), "component")
            ends = more.join(to, F.col("a") == F.col("of"), "left").select(F.coalesce("component", "a").alias("a"), "b")
            ends = ends.join(to, F.col("b") == F.col("of"), "left").select("a", F.coalesce("component", "b").alias("b"))
            joined = save(connected_components(ends), "mh-joined").select(F.col("id").alias("old"), F.col("component").alias("new"))
            every = found.union(joined.join(found, F.col("old") == F.col("id"), "left_anti").select("old", "old"))
            found = every.join(joined, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component"))
    of_class = classes.join(found, F.col("rep") == F.col("id"), "left").select("digest", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component"))
    labelled = described.select("doc_id", "n_shingles", "digest").where("n_shingles > 0 and doc_id is not null")
    labelled = labelled.join(of_class, (labelled["digest"] == of_class["digest"]) & (F.col("n_shingles") == F.col("n"))).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = described.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("n_shingles") >= 0, F.col("doc_id")).alias("component_id"))
    return labelled.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
