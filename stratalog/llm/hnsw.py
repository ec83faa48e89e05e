"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph per shard, results merged.

A shard's graph is a row of flat arrays: vectors, the ids that share each vector, and per layer the members, a fixed-width
neighbour matrix and the layer's own entry points. Layers are built from the top one down: nodes come in batches of a share of what
the layer holds, find their neighbours by searching the graph as it stands and among their batch, keep diverse ones and are linked
back. A node that no path from the layer's entries reaches gets one, or becomes an entry itself, so
every vector of a shard can be found whatever its clusters. All searches of a batch advance together, in a few numpy calls a step.

Graph search is in single precision and only proposes candidates: all of them are scored in double precision, and a search whose last
candidate is not clearly worse than its k-th best is repeated with twice the breadth.

Equal vectors are one node with their smallest ids, gathered before the shuffle: a vector that a third of the rows share costs a
task no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import save
from stratalog.llm.textvec import mix64

#: Neighbours a node chooses, and the most it has with those that chose it.
CHOSEN, MOST = 24, 48
#: Candidates that a search for neighbours finds and the diversity heuristic sees.
BUILD_EF = 96
#: Nodes that are added together, at most.
BATCH = 1024
#: A layer has one node in so many of the layer below.
LAYER = 16
#: Breadth of a search, and of its way through the upper layers.
EF, UPPER_EF = 512, 16
#: Bytes of vectors and vectors of a shard, about, and shards, at least. Recall at one breadth falls with the vectors of a shard, so
#: these two are chosen together: at a full shard of normal vectors, the hardest case, a breadth of 512 finds 0.98 of the nearest.
SHARD_BYTES, SHARD_ROWS, LEAST_SHARDS = 16 << 20, 16_384, 8
#: Queries that one task searches on one shard: about as many bytes as the shard.
QUERY_BYTES = 16 << 20
#: Unit-vector scores closer than this may be in either order in single precision.
ROUNDING = 4e-6


@dataclass
class Layer:
    """Members (node numbers), their neighbours as places among the members (-1: none), and extra entry places."""

    members: np.ndarray
    graph: np.ndarray
    entries: np.ndarray


def _augment(x: np.ndarray) -> np.ndarray:
    """Unit-length rows whose nearest neighbours for a query with a 0 added are those of largest inner product."""
    x = x.astype(np.float64)
    x = x / max(np.abs(x).max(), np.finfo(np.float64).tiny)
    norms = (x**2).sum(axis=1)
    most = norms.max()
    return (np.concatenate([x, np.sqrt(np.maximum(most - norms, 0))[:, None]], axis=1) / np.sqrt(most)).astype(np.float32)


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows a[i] and b[j], by slices."""
    out = np.empty(len(i), dtype=np.float32)
    for s in range(0, len(i), 1 << 16):
        out[s : s + (1 << 16)] = np.einsum("id,id->i", a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]])
    return out


def beam(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, spread: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) [queries, ef] of the best found from ``entry`` [queries, any number], best first, -1 and -inf for none."""
    done_nodes = np.full((len(queries), ef), -1, dtype=np.int64)
    done_scores = np.full((len(queries), ef), -np.inf, dtype=np.float32)
    who = np.arange(len(queries))  # the queries still under way
    seen = np.zeros((len(queries), len(x)), dtype=bool)
    nodes, scores = done_nodes.copy(), done_scores.copy()
    open_ = np.zeros(nodes.shape, dtype=bool)
    fresh = entry.astype(np.int64)
    while len(who):
        fresh = np.sort(fresh, axis=1)
        row = np.arange(len(who))[:, None]
        new = (fresh >= 0) & ~seen[row, np.maximum(fresh, 0)]
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        at, col = np.nonzero(new)
        seen[at, fresh[at, col]] = True
        found = np.full(fresh.shape, -np.inf, dtype=np.float32)
        found[at, col] = _dots(queries, who[at], x, fresh[at, col])
        nodes = np.concatenate([nodes, np.where(new, fresh, -1)], axis=1)
        scores = np.concatenate([scores, found], axis=1)
        open_ = np.concatenate([open_, new], axis=1)
        best = np.argpartition(-scores, ef - 1, axis=1)[:, :ef]
        nodes, scores, open_ = nodes[row, best], scores[row, best], open_[row, best]
        busy = open_.any(axis=1)
        if busy.sum() <= 0.7 * len(who):
            done_nodes[who[~busy]], done_scores[who[~busy]] = nodes[~busy], scores[~busy]
            who, seen, nodes, scores, open_ = who[busy], seen[busy], nodes[busy], scores[busy], open_[busy]
            row = np.arange(len(who))[:, None]
            if not len(who):
                break
        k = min(spread, ef)
        top = np.argpartition(-np.where(open_, scores, -np.inf), k - 1, axis=1)[:, :k]
        live = open_[row, top]
        open_[row, top] = False
        fresh = np.where(live[:, :, None], graph[np.where(live, nodes[row, top], 0)], -1).reshape(len(who), -1).astype(np.int64)
    order = np.argsort(-done_scores, axis=1, kind="stable")
    row = np.arange(len(queries))[:, None]
    return done_nodes[row, order], done_scores[row, order]


def _search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """beam() over slices of the queries that bound what is held of the nodes they have seen."""
    step = max(16, (1 << 24) // max(1, len(x)))
    parts = [beam(x, graph, queries[a : a + step], entry[a : a + step], ef) for a in range(0, len(queries), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _choose(x: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates [nodes, k], nearest first, ``most`` each: those nearer to the node than to any taken before, then others."""
    out = np.full((len(near), most), -1, dtype=np.int32)
    for a in range(0, len(near), 512):
        own, to_own = near[a : a + 512], sims[a : a + 512]
        held = x[np.maximum(own, 0)]
        among = held @ held.transpose(0, 2, 1)
        kept = np.zeros(own.shape, dtype=bool)
        closest = np.full(own.shape, -np.inf, dtype=np.float32)  # similarity to the nearest kept one
        count = np.zeros(len(own), dtype=np.int64)
        for c in range(own.shape[1]):
            take = (own[:, c] >= 0) & (to_own[:, c] > closest[:, c]) & (count < most)
            kept[:, c] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, among[:, :, c]), closest)
        order = np.argsort(~kept, axis=1, kind="stable")[:, :most]
        out[a : a + len(own), : order.shape[1]] = own[np.arange(len(own))[:, None], order]
    return out


def _link(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
    """Give ``nodes`` neighbours from their candidates, and the chosen ones links back; full lists keep the diverse."""
    n = len(x)
    mine = near != nodes[:, None]
    order = np.argsort(~(mine & (near >= 0)), axis=1, kind="stable")  # the node itself goes
    row = np.arange(len(nodes))[:, None]
    near, sims = np.where(mine, near, -1)[row, order], np.where(mine, sims, -np.inf)[row, order]
    chosen = _choose(x, near, sims, CHOSEN)
    source, target = np.repeat(nodes, CHOSEN), chosen.ravel().astype(np.int64)
    source, target = source[target >= 0], target[target >= 0]
    touched = np.unique(np.concatenate([nodes, target]))
    kept = graph[touched].astype(np.int64)
    old = np.repeat(touched, kept.shape[1])[kept.ravel() >= 0]
    pairs = np.unique(np.concatenate([source * n + target, target * n + source, old * n + kept.ravel()[kept.ravel() >= 0]]))
    a, b = pairs // n, pairs % n
    close = _dots(x, a, x, b)
    order = np.lexsort((-close, a))
    a, b, close = a[order], b[order], close[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    fits = place < 2 * MOST
    at = np.searchsorted(touched, a[fits])
    wide = np.full((len(touched), 2 * MOST), -1, dtype=np.int64)
    values = np.full(wide.shape, -np.inf, dtype=np.float32)
    wide[at, place[fits]], values[at, place[fits]] = b[fits], close[fits]
    graph[touched] = wide[:, :MOST]
    over = wide[:, MOST] >= 0  # the others keep all they have
    graph[touched[over]] = _choose(x, wide[over], values[over], MOST)


def _reach(graph: np.ndarray, start: np.ndarray, reached: np.ndarray) -> None:
    """Mark in ``reached`` all that links lead to from ``start``."""
    reached[start] = True
    while len(start):
        ends = np.unique(graph[start])
        start = ends[(ends >= 0) & ~reached[np.maximum(ends, 0)]]
        reached[start] = True


def _connect(x: np.ndarray, graph: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(graph with added columns, extra entries): after this every node is reached from ``first`` or an extra entry."""
    reached = np.zeros(len(x), dtype=bool)
    _reach(graph, first, reached)
    entries: list[int] = []
    while not reached.all():
        lost = np.flatnonzero(~reached)
        links = graph[lost]
        known = (links >= 0) & reached[np.maximum(links, 0)]
        near = known.any(axis=1)
        if near.any():  # a neighbour of it that is reached gets a link to it
            lost = lost[near]
            known, links = known[near], links[near]
            turn = lost % known.sum(axis=1)  # spread over the reached neighbours
            to = links[np.arange(len(lost)), (np.cumsum(known, axis=1) > turn[:, None]).argmax(axis=1)]
            order = np.argsort(to, kind="stable")
            lost, to = lost[order], to[order]
            place = np.arange(len(to)) - np.searchsorted(to, to)
            more = np.full((len(x), int(place.max()) + 1), -1, dtype=np.int32)
            more[to, place] = lost
            graph = np.concatenate([graph, more], axis=1)
        else:  # an island
            lost = lost[:1]
            entries.append(int(lost[0]))
        _reach(graph, lost, reached)
    width = int((graph >= 0).sum(axis=1).max()) if len(graph) else 0
    order = np.argsort(graph < 0, axis=1, kind="stable")[:, : max(1, width)]
    return np.take_along_axis(graph, order, axis=1), np.array(entries, dtype=np.int32)


def build_layers(x: np.ndarray) -> list[Layer]:
    """The layers over unit rows, the lowest with all nodes first."""
    draw = mix64(np.arange(1, len(x) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) / 2.0**64
    level = np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(LAYER)).astype(np.int64)
    order = np.lexsort((draw, -level))  # each layer is a head of this: upper nodes come first
    layers: list[Layer] = []
    for low in range(int(level.max()), -1, -1):
        members = order[: int((level >= low).sum())]
        own = x[members]
        graph = np.full((len(members), MOST), -1, dtype=np.int32)
        size = min(len(members), BUILD_EF)
        every = np.tile(np.arange(size), (size, 1))
        sims = own[:size] @ own[:size].T
        by = np.argsort(-sims, axis=1, kind="stable")
        _link(own, graph, np.arange(size), np.take_along_axis(every, by, axis=1), np.take_along_axis(sims, by, axis=1))
        at = size
        while at < len(members):
            nodes = np.arange(at, min(len(members), at + min(BATCH, max(32, at // 4))))
            found, near = _search(own, graph, own[nodes], descend(x, layers, own[nodes]) if layers else np.zeros((len(nodes), 1), dtype=np.int64), BUILD_EF)
            sims = own[nodes] @ own[nodes].T  # the nodes of a batch meet each other here
            np.fill_diagonal(sims, -np.inf)
            k = min(BUILD_EF // 2, len(nodes))
            others = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            found, near = np.concatenate([found, nodes[others]], axis=1), np.concatenate([near, np.take_along_axis(sims, others, axis=1)], axis=1)
            by = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_EF]
            _link(own, graph, nodes, np.take_along_axis(found, by, axis=1), np.take_along_axis(near, by, axis=1))
            at = int(nodes[-1]) + 1
        graph, entries = _connect(own, graph, np.arange(len(layers[0].members)) if layers else np.zeros(1, dtype=np.int64))
        layers.insert(0, Layer(members.astype(np.int32), graph, entries))
    return layers


def descend(x: np.ndarray, layers: list[Layer], queries: np.ndarray, ef: int = UPPER_EF) -> np.ndarray:
    """Where to begin in the layer below ``layers`` (places there are node places here: each layer is a head of the next)."""
    entry = np.zeros((len(queries), 1), dtype=np.int64)
    for layer in reversed(layers):
        extra = np.broadcast_to(layer.entries.astype(np.int64), (len(queries), len(layer.entries)))
        entry, _ = _search(x[layer.members], layer.graph, queries, np.concatenate([entry, extra], axis=1), min(ef, UPPER_EF))
    return entry


def search_layers(x: np.ndarray, layers: list[Layer], queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) [queries, ef] found for unit queries, best first, -1 for none."""
    lowest = layers[0]
    entry = descend(x, layers[1:], queries)
    extra = np.broadcast_to(lowest.entries.astype(np.int64), (len(queries), len(lowest.entries)))
    nodes, scores = _search(x[lowest.members], lowest.graph, queries, np.concatenate([entry, extra], axis=1), ef)
    return np.where(nodes >= 0, lowest.members[np.maximum(nodes, 0)], -1), scores


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays with their shapes and kinds, one after the other."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        head = f"{a.dtype.str}|{','.join(map(str, a.shape))}".encode()
        out += [len(head).to_bytes(4, "little"), head, np.ascontiguousarray(a).tobytes()]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    view, at, out = memoryview(data), 4, []
    for _ in range(int.from_bytes(view[:4], "little")):
        size = int.from_bytes(view[at : at + 4], "little")
        kind, _, shape = bytes(view[at + 4 : at + 4 + size]).decode().partition("|")
        shape = tuple(int(s) for s in shape.split(",") if s)
        at += 4 + size
        count = int(np.prod(shape))
        out.append(np.frombuffer(view, dtype=np.dtype(kind), count=count, offset=at).reshape(shape))
        at += count * np.dtype(kind).itemsize
    return out


def _vectors(batch: pa.RecordBatch, dtype: type) -> tuple[list[int], list[bytes]]:
    """(ids, vectors as bytes) of the rows that take part, -0 made 0."""
    ids, out = [], []
    for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
        if i is None or not v.is_valid or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0)
        if len(x) and np.isfinite(x).all() and x.any():
            ids.append(i)
            out.append(x.tobytes())
    return ids, out


def nearest_in_shard(x: np.ndarray, unit_x: np.ndarray, layers: list[Layer], ids: np.ndarray, first: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, ef: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores): each query's ``k`` best of one shard, by score, then id.

    ``ids[first[i]:first[i + 1]]`` share vector i. The breadth doubles for queries whose last candidate may be as near as their k-th.
    """
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    longest = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max())
    unit = q / np.abs(q).max(axis=1, keepdims=True)
    unit = np.concatenate([unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1).astype(np.float32)
    waiting, breadth = np.arange(len(q)), ef
    while len(waiting):
        if breadth > ef and 4 * breadth >= len(x):  # so many ties that the rest of the shard may as well be scored
            nodes, near = np.broadcast_to(np.arange(len(x)), (len(waiting), len(x))), np.full((len(waiting), 1), -np.inf)
        else:
            nodes, near = search_layers(unit_x, layers, unit[waiting], min(breadth, len(x)))
        again = []
        for i, row, last in zip(waiting, nodes, near[:, -1], strict=True):
            row = row[row >= 0]
            score = x[row].astype(np.float64) @ q[i]
            member = np.concatenate([ids[first[r] : first[r + 1]] for r in row]) if len(row) else np.zeros(0, np.int64)
            score = np.repeat(score, first[row + 1] - first[row])
            other = member != q_ids[i]
            member, score = member[other], score[other]
            best = np.lexsort((member, -score))[:k]
            kth = score[best[-1]] / (longest * np.linalg.norm(q[i])) if len(best) == k else -np.inf
            if len(row) == nodes.shape[1] < len(x) and not last < kth - ROUNDING:
                again.append(i)
            else:
                out.append((int(q_ids[i]), member[best], score[best]))
        waiting, breadth = np.array(again, dtype=np.int64), breadth * 2
    return out


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query row, itself left out.

    Nearness is the inner product in double precision on the vectors as given; ties go to the smaller vec_id. Fewer candidates
    than ``k`` are all returned. ``ef`` is the breadth of the search, the same in every shard. Rows with a null id, or a vector that is
    null, empty, zero or has null or non-finite components, take no part; candidates have the query's dimension. Of repeated ids a query is searched once for each distinct vector, and a
    candidate is named once. An empty table gives no rows. Other columns are ignored.
    """
    dtype = np.float32 if "float" in dict(embeddings.dtypes)["embedding"] else np.float64
    width = np.dtype(dtype).itemsize
    rows = embeddings.select("vec_id", "embedding")
    size, count = rows.agg(F.sum(F.greatest(F.size("embedding"), F.lit(0)).cast("bigint")), F.count("embedding")).first()
    shards = max(LEAST_SHARDS, -(-(size or 0) * width // SHARD_BYTES), -(-count // SHARD_ROWS))
    most_ids = k + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct vectors of a part of the rows with their smallest ids."""

        def flush() -> pa.RecordBatch:
            keys = list(held)
            ids = [sorted(held[v])[:most_ids] for v in keys]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["vec", "ids"])

        held: dict[bytes, set[int]] = {}
        taken = 0
        for batch in batches:
            for i, v in zip(*_vectors(batch, dtype), strict=True):
                own = held.get(v)
                if own is None:
                    own = held[v] = set()
                    taken += len(v) + 200
                own.add(i)
                if len(own) > 4 * most_ids:
                    held[v] = set(sorted(own)[:most_ids])
                if taken >= 16 << 20:
                    yield flush()
                    taken = 0
        yield flush()

    def build(table: pa.Table) -> pa.Table:
        merged: dict[bytes, set[int]] = {}
        for v, ids in zip(table.column("vec").to_pylist(), table.column("ids").to_pylist(), strict=True):
            merged.setdefault(v, set()).update(ids)
        shard = table.column("shard")[0].as_py()
        out: dict[str, list] = {"shard": [], "dim": [], "graph": []}
        for size in sorted({len(v) for v in merged}):
            vecs = sorted(v for v in merged if len(v) == size)
            x = np.frombuffer(b"".join(vecs), dtype=dtype).reshape(len(vecs), -1)
            ids = [sorted(merged[v])[:most_ids] for v in vecs]
            first = np.cumsum([0, *map(len, ids)])
            flat = np.array([i for own in ids for i in own], dtype=np.int64)
            layers = build_layers(_augment(x))
            out["shard"].append(shard)
            out["dim"].append(x.shape[1])
            out["graph"].append(_pack([x, flat, first, *(a for layer in layers for a in (layer.members, layer.graph, layer.entries))]))
        return pa.table([pa.array(out["shard"], pa.int32()), pa.array(out["dim"], pa.int32()), pa.array(out["graph"], pa.binary())], list(out))

    distinct = rows.mapInArrow(gather, "vec binary, ids array<bigint>").withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    index = save(distinct.groupBy("shard").applyInArrow(build, "shard int, dim int, graph binary"), "hnsw-index")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = _vectors(batch, dtype)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["query_id", "vec"])

    queries = save(rows.where(is_query).mapInArrow(clean, "query_id bigint, vec binary").distinct(), "hnsw-queries")
    asked_bytes = queries.agg(F.sum(F.octet_length("vec").cast("bigint"))).first()[0] or 0
    groups = max(1, -(-asked_bytes // QUERY_BYTES))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("query_id", "vec"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(asked: pa.Table, graphs: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        vecs = asked.column("vec").to_pylist()
        all_ids = asked.column("query_id").to_numpy()
        for dim, graph in zip(graphs.column("dim").to_pylist(), graphs.column("graph").to_pylist(), strict=True):
            mine = [i for i, v in enumerate(vecs) if len(v) == dim * width]
            if not mine:
                continue
            x, ids, first, *flat = _unpack(graph)
            layers = [Layer(*flat[i : i + 3]) for i in range(0, len(flat), 3)]
            q = np.frombuffer(b"".join(vecs[i] for i in mine), dtype=dtype).reshape(len(mine), dim).astype(np.float64)
            for own, member, score in nearest_in_shard(x, _augment(x), layers, ids, first, q, all_ids[mine], k, ef):
                for held, values in zip(out, (np.full(len(member), own), member, score), strict=True):
                    held.append(values)
        cols = [np.concatenate(held) if held else np.zeros(0) for held in out]
        return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], ["query_id", "vec_id", "score"])

    found = queries.groupBy("shard", "part").cogroup(parts.groupBy("shard", "part")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
