"""Token alignment, vector codes and licence scans against plain models."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from stratalog.llm import license_scan, oracles, registry, token_alignment, vector_codes
from stratalog.llm.token_alignment import TOKENIZERS, tokenizers

Q = registry.queries()


# ---- op11


@pytest.fixture(scope="module")
def plain_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")


def brute_alignment(texts, plain):
    """Rows in order of the texts, by comparing all token ranges of a group one by one."""
    a_model, b_model = plain
    a_vocab = {i: t for t, i in a_model.get_vocab().items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}

    def a_bytes(i):
        return bytes(byte[c] for c in a_vocab[i])

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for text in texts:
        groups = []
        if text:
            a, b = a_model.encode(f" {text}", add_special_tokens=False).ids, b_model.encode(text)
            raw = f" {text}".encode()
            if b"".join(map(a_bytes, a)) == raw == b"".join(map(b_bytes, b)):
                i = j = at_a = at_b = 0
                own_a, own_b = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        own_a.append(a[i])
                        at_a, i = at_a + len(a_bytes(a[i])), i + 1
                    else:
                        own_b.append(b[j])
                        at_b, j = at_b + len(b_bytes(b[j])), j + 1
                    if at_a == at_b and own_a and own_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        docs.append(groups)
    held = Counter(p for groups in docs for p in {(x, y) for a, b in groups for x in a for y in b})
    highest = {}
    for (x, _), n in held.items():
        highest[x] = max(n, highest.get(x, 0))
    out = []
    for groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        best = sum(held[p] == highest[p[0]] for p in links)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), best, sum(held[p] for p in links), digest))
    return out


def aligned(df):
    return sorted((tuple(r) for r in token_alignment.align(df).collect()), key=str)


def test_alignment_of_whole_table(spark, sf, plain_tokenizers):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *row) for r, row in zip(docs, brute_alignment([r.text for r in docs], plain_tokenizers), strict=True)]
    assert sorted((tuple(r) for r in Q["op11_alignment"](spark, sf).collect()), key=str) == sorted(want, key=str)


ODD = [
    None, "", " ", "\n\n\t ", "a", "naïve \U0001f600 İstanbul ſ", "x▁y", "\x00\x01 b", "<s> <|endoftext|> <unk> <0x41>", "aaaa" * 300, "  " * 700, "12345678901234567890", "日本語のテキスト 한국어", "Ⅷ ﬁ ½ é", "word word word", "word word word",
]


def test_alignment_of_odd_rows(spark, plain_tokenizers, monkeypatch):
    rows = [(i, t, 1, b"k") for i, t in enumerate(ODD)] + [(None, "word", 2, None), (None, "word", 2, None), (3, "word", 1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, place int, key binary").repartition(3)
    want = sorted(((r[0], *x) for r, x in zip(rows, brute_alignment([r[1] for r in rows], plain_tokenizers), strict=True)), key=str)
    assert aligned(df) == want
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(token_alignment, "HOT_CHUNKS", 1)
    assert aligned(df) == want
    assert token_alignment.align(df.where("false")).collect() == []


def test_alignment_in_small_chunks(spark, sf, plain_tokenizers, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    chunk = token_alignment.CHUNK_BYTES
    whole = aligned(docs)
    try:
        token_alignment.CHUNK_BYTES, token_alignment.SLICE_BYTES = 20_000, 5_000
        folder = TOKENIZERS
        table = token_alignment.chunks(docs.coalesce(1), folder)
        assert table.where("doc is not null").select("chunk").distinct().count() >= 1
        assert aligned(docs) == whole
    finally:
        token_alignment.CHUNK_BYTES, token_alignment.SLICE_BYTES = chunk, 2 << 20


@settings(max_examples=60, deadline=None)
@given(hs.text(max_size=60))
def test_encoders_of_a_agree(text):
    a, _ = tokenizers(TOKENIZERS)
    assert a._fast is not None
    assert a._fast.encode_ordinary(text) == a._plain.encode(text, add_special_tokens=False).ids


def test_colliding_groups_are_told_apart(monkeypatch):
    sizes = (np.ones(9, dtype=np.int64), np.ones(9, dtype=np.int64))
    groups = token_alignment.Groups((np.array([1, 2, 1, 3]), np.array([0, 4])), (np.array([5, 5, 5, 5]), np.array([0, 4])), sizes)
    real = token_alignment.Groups.hashes
    monkeypatch.setattr(token_alignment.Groups, "hashes", lambda self, seed: np.zeros(self.n, dtype=np.uint64) if not seed else real(self, seed))
    own, one = groups.interned()
    assert len(one) == 3 and own[0] == own[2] and len({*own.tolist()}) == 3
    raw, at = groups.spelled()
    assert raw.tobytes() == b"1|5;2|5;1|5;3|5;" and at.tolist() == [0, 16]


# ---- op12


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda r: kept[r][0])[:entries]
    books = [[list(cut[r][p]) for r in first] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, own in held.items():
                books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[lab], digest) for (i, lab, _), f, e in zip(kept, found, errors, strict=True)), key=str)


def coded(df, **kw):
    return sorted((tuple(r) for r in vector_codes.compress(df, **kw).collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.lists(hs.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=40), hs.lists(hs.lists(hs.integers(-5, 5), min_size=2, max_size=2), min_size=1, max_size=30), hs.sampled_from([1, 10**8]))
def test_ball_tree_is_exact(entries, parts, scale):
    entries, parts = np.array(entries, dtype=np.int64) * scale, np.array(parts, dtype=np.int64) * scale
    code, apart = vector_codes.nearest_entries(vector_codes.build_tree(entries), entries, parts)
    all_ = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert apart.tolist() == all_.min(axis=1).tolist()
    assert code.tolist() == all_.argmin(axis=1).tolist()


def test_ball_tree_leaves_entries_out():
    rng = np.random.default_rng(1)
    entries = rng.integers(-9999, 9999, (256, 2))
    search = vector_codes._Search(entries, rng.integers(-9999, 9999, (2000, 2)))
    search.visit(vector_codes.build_tree(entries), np.arange(2000))
    assert search.seen < 2000 * 256 / 4


def test_codes_against_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.choice([-1.5, -0.25, 0.0, 0.1, 2.0], 16)], [None, 1, 2][i % 3]) for i in rng.permutation(150)]
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [float("nan")] * 16, 2), (1003, [float("inf")] + [0.0] * 15, 2), (1004, [], 1), (1005, [0.5] * 24, 1), (1006, [0.5] * 3, None), (-1, [float("-inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("ints", F.lit(1)).withColumn("held", F.lit(2)).repartition(5)
    want = brute_codes(rows[:150])
    assert coded(df) == want
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert coded(df) == want
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 2)
    assert coded(df) == want
    few = [r for r in rows[:150] if r[0] < 5]
    assert coded(spark.createDataFrame(few, "vec_id bigint, embedding array<float>, label int")) == brute_codes([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in few])
    assert coded(df.where("vec_id >= 1000 and vec_id not in (1005)")) == []
    assert coded(df.where("false")) == []


def test_codes_of_repeated_rows(spark):
    rows = [(7, [1.0] * 8, 1), (7, [1.0] * 8, 1), (7, [0.0] * 8, None), (None, [5e9] * 8, None), (None, [-5e9] * 8, None)]
    got = coded(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), rounds=0)
    assert len(got) == 5 and len({r[4] for r in got}) == 1
    assert [r[1] for r in got if r[0] == 7 and r[3] == 0] == []  # id 7 gives the smaller vector to the codebook
    with pytest.raises(ValueError, match="hexadecimal"):
        vector_codes.compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), entries=257)


# ---- op13


MIT = license_scan.NOTICES[0].text


def brute_licenses(text):
    import re

    words = re.findall(license_scan.WORD, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    stands = lambda p: [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    base, labels, shares = [], set(), [0.0]
    for t in license_scan.TEMPLATES:
        body = license_scan.words_of(t.text)
        keys = [license_scan.words_of(k) for k in t.keys or (t.text,)]
        offset = [next(i for i in range(len(body)) if body[i : i + len(k)] == k) for k in keys]
        for at in stands(keys[0]):
            s = at - offset[0]
            if all(any(abs(i - s - o) <= license_scan.SLACK for i in stands(k)) for k, o in zip(keys[1:], offset[1:], strict=True)):
                window = lambda p: words[max(0, s + p - license_scan.SLACK) : max(0, s + p + license_scan.SLACK + 1)]  # noqa: B023, E731
                n = sum(w in window(p) for p, w in enumerate(body))
                if n * 100 >= license_scan.LEAST_SHARE * len(body):
                    labels.add(t.label)
                    shares.append(n / len(body))
            if t.base:
                base.append((at, t.label))
    joined = lambda x: ",".join(sorted(set(x)))
    return (len(words), len(base), min((a for a, _ in base), default=None), max((a for a, _ in base), default=None), joined(lab for _, lab in base), joined(labels), max(shares))


LICENSED = [
    None, "", "no licence here", "All rights\nreserved", "ALL RIGHTS RESERVED. all rights reserved", "all rights-reserved all  rights", "Licensed under CC BY-NC 4.0.", "cc by cc by-sa", "GNU General Public License, version 3.", "général public license",
    MIT, "// " + MIT.replace(" ", " * ", 9), MIT.replace("Software", "Program"), MIT.replace("free of charge", "for money"), " ".join(MIT.split()[:60]), "x " * 500 + MIT.upper() + " y" * 500, MIT.replace("publish,", "publish, one two three four five six seven,"),
    "SPDX-License-Identifier: Apache-2.0", "Kelvin K cc0 1.0 İ", "mit\x00license", license_scan.NOTICES[4].text + " " + license_scan.NOTICES[2].text, "all rights reserved " * 3000, "permission notice " * 2000, "software without restriction to deal in the " * 400,
]


def test_licenses_against_plain_scan(spark):
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(LICENSED)] + [(None, "All rights reserved", 1, "x", "y")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, words int, candidates string, standing string").repartition(3)
    got = sorted((tuple(r) for r in license_scan.scan_licenses(df).drop("found").collect()), key=str)
    assert got == sorted(((r[0], *brute_licenses(r[1])) for r in rows), key=str)
    assert license_scan.scan_licenses(df.where("false")).collect() == []
    labels = {r.doc_id: r.labels for r in license_scan.scan_licenses(df).collect()}
    assert labels[10] == "mit" and labels[12] == "" and labels[13] == "" and labels[16] == "mit" and labels[20] == "apache-2.0,bsd-2-clause"


def test_license_plan_has_no_python(spark, sf):
    plan = Q["op13_licenses"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(("name", "sql"), [("op12_vector_codes", oracles.vector_codes()), ("op13_licenses", oracles.licenses())])
def test_query_is_its_sql(spark, sf, name, sql):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = Q[name](spark, sf)
    want = c.execute(f"select {', '.join(sorted(df.columns))} from ({sql})").fetchall()
    assert sorted((tuple(r[x] for x in sorted(df.columns)) for r in df.collect()), key=str) == sorted(want, key=str)
