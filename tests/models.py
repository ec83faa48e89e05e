"""Plain Python models of the sequential operators, written from their definitions."""

import random


def assemble(rows, topics):
    """rows: [(topic, value)] in order -> [{topic: value}]."""
    out, now = [], {}
    for topic, value in rows:
        if topic in topics:
            now[topic] = value
            if len(now) == len(topics):
                out.append(now)
                now = {}
    return out


def monotonic(stamps, delta):
    out = []
    for t in stamps:
        out.append(t if not out or t > out[-1] else out[-1] + delta)
    return out


def bounded_shuffle(n, size, seed):
    rng, buf, out = random.Random(seed), [], []
    for i in range(n):
        buf.append(i)
        if len(buf) >= size:
            out.append(buf.pop(rng.randrange(len(buf))))
    rng.shuffle(buf)
    return out + buf


def nearest(t, pts):
    """Index of the nearest frame by the look-up rule; None after the last."""
    for i, p in enumerate(pts):
        if p >= t:
            return i - 1 if i and t - pts[i - 1] < p - t else i
    return None
