"""Secret scans: fixed patterns, and credential-context values weighed by password guess cost.

The guess cost of a value is the least sum of log10 costs over all ways to cut it into dictionary words, dates, repeats,
keyboard walks and brute-force characters; a dynamic programme over end positions finds it in time linear in the length. The
dictionary is a short list of common passwords and the most frequent words of the corpus itself, counted over all texts outside of
credential contexts, so that no secret teaches itself.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.textvec import slices

#: Spans of one start are listed in this order.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Names that announce a credential beyond those of ASSIGN: an identifier with such a word among its parts, or at the end of one, six parts
#: from the end at most; behind it a scheme perhaps; and credentials in the user part of an address.
_WORD = r"pwd|pass(?:phrase|code|word|wd)?s?|credentials?|auth(?:orization)?|private_?key|client_?secret|access_?key|session_?id|secrets?|tokens?|api_?keys?"
_NAMED = rf"(?:(?:password|passwd|passphrase|secret|token|api_?key|access_?key|private_?key)s?|(?<![A-Za-z0-9])(?:{_WORD}))(?:[_.-]{{1,2}}[A-Za-z0-9]{{1,24}}){{0,6}}"
CONTEXT = re.compile(
    rf"""(?:{_NAMED}["']?\x20*(?:[:=]|=>|\bis\b)\x20*["']?(?:(?:bearer|basic|digest|token)\x20+)?|\bbearer["']?(?:\x20+|\x20*[:=]\x20*["']?)|://[^\s:/@]+:)([^\s"'<>,;@]+)""",
    re.IGNORECASE | re.ASCII,
)
#: Every match of CONTEXT holds one of these.
_TELLING = ("://", "pass", "pwd", "token", "secret", "key", "auth", "bearer", "credential", "session")


def announces(text: str) -> bool:
    """Whether CONTEXT can match at all: most texts hold none of its words."""
    low = text.lower()
    return any(w in low for w in _TELLING)


def contexts(text: str) -> Iterator[re.Match[str]]:
    """Matches of CONTEXT."""
    return CONTEXT.finditer(text) if announces(text) else iter(())


#: Common passwords by rough rank: cheap to guess.
COMMON = {
    w: i + 1
    for i, w in enumerate(
        """password admin love you user login master welcome test hello secret root dragon monkey letmein shadow sunshine
        princess football baseball hockey tiger summer winter spring autumn monday friday sunday computer internet server
        system office mail home house family happy lucky magic power super hero ninja pirate wizard knight soldier player
        gamer music guitar money gold silver diamond black white red blue green yellow purple pink cheese coffee pepper
        key token access default guest public private config pass word""".split()
    )
}
#: Words of a dictionary that is learnt, at most (a broadcast of some 30 bytes each), how often each must occur, and letters of one.
MOST_WORDS, LEAST_COUNT, LONGEST = 20_000, 5, 24
#: What a value of letters alone must cost beyond the threshold of others: unknown words of a language are no secrets.
LETTERS_EXTRA = 4.0
_WORDS = re.compile(rf"(?<![^\W\d_])[^\W\d_]{{3,{LONGEST}}}(?![^\W\d_])")
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
_NEXT = {pair for row in _ROWS for i in range(len(row) - 1) for pair in (row[i : i + 2], row[i + 1] + row[i])}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")


def _cased(part: str) -> float:
    """What capitals add to the cost of a word or walk."""
    upper = sum(c.isupper() for c in part)
    return 0.3 * min(upper, len(part) - upper) + 0.3 if upper else 0.0


def guess_cost(value: str, words: Mapping[str, int] = COMMON) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs; 0 for the empty text.

    Segments are words by rank (of 3 to 24 letters), dates, three or more equal characters, three or more neighbours on a keyboard
    row, and single characters. Of repeats and walks that go on for over 64 characters only the last three ends are tried, which
    keeps the time linear: an earlier end only helps a word that begins with three of the same or neighbouring letters.

    >>> guess_cost("password") < 1 < guess_cost("k3xQ9vTz")
    True
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:  # a capital whose small form is longer
        low = value
    best = [0.0] + [float("inf")] * n

    def offer(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    def ends(start: int, stop: int) -> range:
        return range(start + 3 if stop - start <= 64 else stop - 2, stop + 1)

    run_end = walk_end = 0
    for i in range(n):
        here, ch = best[i], value[i]
        size = 26 if ch.isalpha() else 10 if ch.isdigit() else 33
        offer(i + 1, here + log10(size))
        if ch.isalpha():
            for j in range(i + 3, min(n, i + LONGEST) + 1):
                if rank := words.get(low[i:j]):
                    offer(j, here + log10(rank) + _cased(value[i:j]))
        elif ch.isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if _DATE.fullmatch(value, i, j):
                    offer(j, here + log10(365 * 100))
        if i >= run_end:
            run_end = i + 1
            while run_end < n and value[run_end] == ch:
                run_end += 1
        for j in ends(i, run_end):
            offer(j, here + log10(size * (j - i)))
        if i >= walk_end - 1:
            walk_end = i + 1
            while walk_end < n and low[walk_end - 1 : walk_end + 1] in _NEXT:
                walk_end += 1
        for j in ends(i, walk_end):
            offer(j, here + log10(47 * (j - i)) + (_cased(value[i:j]) if j - i <= 32 else 0.0))
    return best[n]


def find_spans(text: str, least_cost: float = 10.0, words: Mapping[str, int] = COMMON) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start, then kind; end is exclusive.

    ``guess`` spans are the credential-context values, whatever their length and characters, whose guess cost is ``least_cost`` or
    more (LETTERS_EXTRA more for letters alone), and that no other span touches.
    """
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    starts: list[int] = []  # the base spans as disjoint stretches
    stops: list[int] = []
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if stops and start <= stops[-1]:
            stops[-1] = max(stops[-1], end)
        else:
            starts.append(start)
            stops.append(end)
    for m in contexts(text):
        value = m[1].rstrip(".=-)")
        start, end = m.start(1), m.start(1) + len(value)
        at = bisect_right(starts, end - 1)  # stretches that begin before the value ends
        if not value or (at and stops[at - 1] > start):
            continue
        if guess_cost(value, words) >= least_cost + (LETTERS_EXTRA if value.isalpha() else 0.0):
            spans.append(("guess", start, end))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def learn_words(docs: DataFrame, most: int = MOST_WORDS, least_count: int = LEAST_COUNT) -> dict[str, int]:
    """Ranks of words: COMMON first, then the ``most`` most frequent letter runs of all texts, ties by code point.

    Words are counted over every text, lower-cased, outside of credential contexts; one that occurs less than ``least_count``
    times is none. A task holds a bounded number of words at a time; ranks come from a keyed sum.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        held: Counter[str] = Counter()
        for whole in batches:
            for batch in slices(whole, "text"):
                for text in batch.column("text").to_pylist():
                    if text:
                        held.update(_WORDS.findall((CONTEXT.sub(" ", text) if announces(text) else text).lower()))
                    if len(held) > 200_000:
                        yield flush()
        yield flush()

    seen = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = seen.where(F.col("n") >= least_count).orderBy(F.col("n").desc(), "word").limit(most).select("word").collect()
    return COMMON | {w: len(COMMON) + i + 1 for i, w in enumerate(r.word for r in top) if w not in COMMON}


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones merged, replaced by ``[secret]``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, least_cost: float = 10.0, words: Mapping[str, int] | None = None) -> DataFrame:
    """Secrets of every text: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, redacted.

    ``words`` is the dictionary of the guess cost, learnt from these texts where it is not given. One row per input row, none for an
    empty table; scanning is a map without shuffle and linear in the text, however long. Null text counts as empty (no spans;
    ``redacted`` stays null); a null id is passed on; repeated rows stay repeated; other columns are ignored. ``redacted`` is the
    text without its secrets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(learn_words(docs) if words is None else words))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string, redacted string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                for text in batch.column("text").to_pylist():
                    spans = find_spans(text, least_cost, shared.value) if text else []
                    count = [sum(s[0] == k for s in spans) for k in KINDS]
                    base = joined([s for s in spans if s[0] != "guess"])
                    rows.append((*count, hashlib.sha256(base.encode()).hexdigest(), joined(spans), redact(text, spans) if spans else text))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 3, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "redacted"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, least_cost: float = 10.0, words: Mapping[str, int] | None = None) -> DataFrame:
    """All rows and columns, with each secret in ``text`` replaced and ``n_chars``, where there is one, counted anew.

    ``words`` as for scan_secrets. Null texts stay null, repeated rows stay repeated, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(learn_words(docs) if words is None else words))
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                found = [find_spans(t, least_cost, shared.value) if t else [] for t in texts]
                texts = [redact(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)]
                cols = dict(zip(names, batch.columns, strict=True))
                cols["text"] = pa.array(texts, batch.schema.field("text").type)
                if "n_chars" in cols:
                    old = cols["n_chars"].to_pylist()
                    cols["n_chars"] = pa.array([len(t) if spans else n for t, spans, n in zip(texts, found, old, strict=True)], batch.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
