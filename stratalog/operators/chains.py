"""Sequential folds without a loop over rows: each row points to the row at which the fold's state is next decided, and whole chains of such
pointers are followed by doubling, in a few numpy calls."""

from __future__ import annotations

import numpy as np


def doubled(jump: np.ndarray) -> list[np.ndarray]:
    """Jumps of 1, 2, 4, ... links; ``jump`` has a last node that points to itself, at which all chains end."""
    tables, end = [jump], len(jump) - 1
    while (tables[-1][:-1] < end).any():
        tables.append(tables[-1][tables[-1]])
    return tables


def chain(tables: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """All nodes of the chains from ``starts`` (disjoint, in rising order), without the end, in order."""
    end = len(tables[0]) - 1
    found = starts[starts < end]
    for table in reversed(tables):
        onward = table[found]
        found = np.concatenate([found, onward[onward < end]])
    return np.sort(found)


def last_of_chain(tables: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last node before the end, number of nodes) of the chain from each start; a start at the end has (end, 0)."""
    end = len(tables[0]) - 1
    at, count = starts.copy(), (starts < end).astype(np.int64)
    for k in range(len(tables) - 1, -1, -1):
        onward = tables[k][at]
        go = onward < end
        at, count = np.where(go, onward, at), count + np.where(go, 1 << k, 0)
    return at, count


def segment_ends(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where runs of equal marks begin, where each row's run ends)."""
    starts = np.flatnonzero(np.diff(marks, prepend=marks[:1] - 1)) if len(marks) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(marks))[: len(starts)]
    return starts, np.repeat(ends, ends - starts)


def next_above(u: np.ndarray, bound: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each bound the first place from ``after`` on where ``u`` is greater, or len(u)."""
    n = len(u)
    tables = [u]
    while 2 << (len(tables) - 1) <= n:
        half, prev = 1 << (len(tables) - 1), tables[-1]
        tables.append(np.maximum(prev[:-half], prev[half:]))
    at = after.copy()
    for k in range(len(tables) - 1, -1, -1):
        fits = at + (1 << k) <= n
        low = np.zeros(len(at), dtype=bool)
        low[fits] = tables[k][at[fits]] <= bound[fits]
        at = at + np.where(low, 1 << k, 0)
    return at


def next_complete(codes: np.ndarray, n_topics: int, ends: np.ndarray) -> np.ndarray:
    """For each row the first row from it on by which all topics occurred in its run, or len(codes)."""
    n = len(codes)
    last = np.zeros(n, dtype=np.int64)
    for t in range(n_topics):
        own = np.append(np.flatnonzero(codes == t), n)
        np.maximum(last, own[np.searchsorted(own, np.arange(n))], out=last)
    return np.where(last < ends, last, n)


def samples(codes: np.ndarray, n_topics: int, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows at which samples are complete, row of each topic's value [samples, topics]) of runs that begin at ``starts`` with no value held."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros((0, n_topics), dtype=np.int64)
    full = next_complete(codes, n_topics, ends)
    jump = np.append(np.where(full < n, np.minimum(full + 1, n), n), n)
    # A sample that ends with its run has no successor: the next run's chain begins at its own start.
    jump[:-1] = np.where((full < n) & (full + 1 < ends), jump[:-1], n)
    begun = chain(doubled(jump), starts)
    begun = begun[full[begun] < n]
    return full[begun], latest(codes, n_topics, full[begun])


def latest(codes: np.ndarray, n_topics: int, rows: np.ndarray) -> np.ndarray:
    """The last row of each topic at or before each of ``rows`` [rows, topics], -1 for none."""
    out = np.full((len(rows), n_topics), -1, dtype=np.int64)
    for t in range(n_topics):
        own = np.flatnonzero(codes == t)
        at = np.searchsorted(own, rows, side="right") - 1
        out[:, t] = np.where(at >= 0, own[at] if len(own) else -1, -1)
    return out


def decided(stamps: np.ndarray, delta: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stamps less delta a row, for each row that keeps its stamp the next one that does in its run or len(stamps))."""
    n = len(stamps)
    u = stamps - np.arange(n, dtype=np.int64) * delta
    onward = next_above(u, u - delta, np.arange(1, n + 1))
    return u, np.append(np.where(onward < ends, onward, n), n)


def repaired(stamps: np.ndarray, delta: int, marks: np.ndarray, last: int | None = None) -> np.ndarray:
    """Stamps of runs of equal ``marks``, where one that does not exceed the repaired one before becomes that plus ``delta``.

    ``last`` is the repaired stamp before the first run, None where that begins anew.
    """
    n = len(stamps)
    if not n:
        return stamps
    starts, ends = segment_ends(marks)
    u, jump = decided(stamps, delta, ends)
    if last is not None:
        first = next_above(u, np.array([last]), np.array([0]))[0]
        starts = starts.copy()
        starts[0] = first if first < ends[0] else n
    kept = chain(doubled(jump), np.sort(starts))
    owner = np.searchsorted(kept, np.arange(n), side="right") - 1
    held = u[kept[owner]] if len(kept) else u
    if last is not None:  # rows before the first that keeps its stamp
        owner = np.where(np.arange(n) < starts[0], -1, owner) if starts[0] < n else np.where(np.arange(n) < ends[0], -1, owner)
        held = np.where(owner < 0, last + delta, held)
    return held + np.arange(n, dtype=np.int64) * delta
