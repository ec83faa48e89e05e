"""Plain Python models of the operators, written from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def words(text, lower=False):
    found = WORD.findall(text or "")
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(table) for w in found] if lower else found


def removed(docs, size=13):
    """op5: {doc_id: (n_words, n_removed, sha256)} for distinct ids."""
    first = {}
    for i, text in sorted(docs):
        w = words(text)
        for a in range(len(w) - size + 1):
            first.setdefault(tuple(w[a : a + size]), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = set()
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < i:
                gone.update(range(a, a + size))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, k):
    w = words(text, True)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else (tuple(w[a : a + k]) for a in range(len(w) - k + 1)))


def components(docs, k, percent=80):
    """op7: {doc_id: (n_shingles, component)} from all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in docs}
    by_set = defaultdict(list)
    for i, s in sets.items():
        by_set[s].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    reps = []
    for s, ids in by_set.items():
        if s:
            reps.append((min(ids), s))
            for i in ids:
                join(min(ids), i)
    holders = defaultdict(list)
    for n, (_, s) in enumerate(reps):
        for x in s:
            holders[x].append(n)
    for n, (i, s) in enumerate(reps):
        common = Counter(m for x in s for m in holders[x] if m < n)
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(reps[m][1]) - c):
                join(i, reps[m][0])
    return {i: (len(s), find(i)) for i, s in sets.items()}


def base_scores(docs):
    """op1: {doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    counts = Counter()
    for i, text in docs:
        if fold(i, 5) != 1:
            counts.update([*words(text, True), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in docs:
        tokens = [*words(text, True), None]
        score = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out[i] = (fold(i, 5) == 1, len(tokens), sum(counts[t] > 0 for t in tokens), n, score)
    return out
