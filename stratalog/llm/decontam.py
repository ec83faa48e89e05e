"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question whose parameters were changed has the template of its
original. All template windows of the benchmark are hashed; a document's windows are probed at a stride that cannot miss a run of
``least_run`` tokens. Each hit fixes a diagonal between document and item; along it all runs of equal template tokens are measured
and cut where the values in their placeholders stop to map one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import save

WINDOW = 8
LEAST_RUN = 13
#: Up to so many (hash, item, position) rows of 24 bytes are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 2_000_000
#: The benchmark itself is broadcast, as tokens, up to so many bytes of text and so many items.
BROADCAST_BYTES, BROADCAST_ITEMS = 32 << 20, 500_000
#: Placeholders of numbers, names and units.
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
UNITS = (
    "km|kg|mg|cm|mm|ml|mph|kmh|kph|miles?|metres?|meters?|kilometers?|kilometres?|grams?|kilograms?|pounds?|lbs?|ounces?|oz|litres?|liters?|gallons?|"
    "hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|inches|inch|feet|foot|yards?|watts?|volts?|joules?|newtons?|g|m|l|s"
)
#: A capital in the middle of a sentence begins a name.
_NAME = r"[\x20\x09-\x0D](?<=[\p{Ll},;][\x20\x09-\x0D])[\x20\x09-\x0D]*(\p{Lu}[\p{L}\p{M}]*)"
_NUMBER = r"(\d[\d.,:/]*)"
_UNIT = rf"(\x01[\d.,:/]*)[\x20\x09-\x0D]?({UNITS})(?![\p{{L}}\p{{M}}])"


def template(text: Column, values: bool) -> Column:
    """The template tokens of a text; with ``values`` each placeholder is followed by what it stands for.

    Tokens are runs of letters, lower-cased, and placeholders; all else separates. Null gives no tokens.
    """
    text = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "   ")
    text = F.regexp_replace(text, _NAME, f" {NAME}$1" if values else f" {NAME}")
    text = F.regexp_replace(text, _NUMBER, f"{NUMBER}$1" if values else NUMBER)
    text = F.regexp_replace(text, _UNIT, f"$1 {UNIT}$2 " if values else f"$1 {UNIT} ")
    # A placeholder is a token of its own, with or without value.
    return F.regexp_extract_all(F.lower(text), F.lit(r"\x01[\d.,:/]*|[\x02\x03]?[\p{L}\p{M}]+" if values else r"[\p{L}\p{M}]+|[\x01-\x03]"), F.lit(0))


def _starts(n: Column, window: int, stride: int) -> Column:
    return F.when(n >= window, F.sequence(F.lit(0), n - window, F.lit(stride)))


def _windows(tokens: Column, starts: Column, window: int) -> Column:
    return F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i + 1, window)))


def _probes(docs: DataFrame, window: int, stride: int) -> DataFrame:
    """(doc_id, nth, key) of every ``stride``-th window of a table's texts.

    The outer form keeps rows without windows until they are dropped here: no filter on the windows is pushed below them, which would
    make the template a second time.
    """
    tokens = docs.where("doc_id is not null").select("doc_id", template(F.col("text"), False).alias("tokens"))
    starts = tokens.withColumn("starts", _starts(F.size("tokens"), window, stride))
    return starts.select("doc_id", F.posexplode_outer(_windows(F.col("tokens"), F.col("starts"), window)).alias("nth", "key")).where("key is not null")


def _runs(pairs: DataFrame, least_run: int) -> DataFrame:
    """(doc_id, item_id, run, exact) of the stretches of each diagonal that count; pairs: (a, b, same, slot) of all its places."""
    key = ["doc_id", "item_id", "shift", "head", "digest"]  # repeated ids may have other texts
    rows = pairs.distinct().withColumn("digest", F.xxhash64("pairs"))
    rows = rows.select(*key, "least", F.posexplode("pairs").alias("at", "p")).select(*key, "least", "at", "p.*")
    rows = rows.withColumn("live", F.col("same") & F.col("slot"))
    line = Window.partitionBy(*key).orderBy("at")
    sofar = line.rowsBetween(Window.unboundedPreceding, 0)
    # The last place before, with one of the values and not the other: where it is older than the value's last place, that one's own break covers it.
    for one, other in (("a", "b"), ("b", "a")):
        last = Window.partitionBy(*key, "live", one).orderBy("at")
        rows = rows.withColumn(f"clash_{one}", F.when(F.col("live") & (F.lag(other).over(last) != F.col(other)), F.lag("at").over(last) + 1))
    no = F.when(~F.col("same"), F.col("at") + 1)
    rows = rows.withColumn("start", F.max(F.coalesce(F.greatest(no, "clash_a", "clash_b"), F.lit(0))).over(sofar))
    rows = rows.withColumn("copy", F.max(F.when(~F.col("same") | (F.col("slot") & (F.col("a") != F.col("b"))), F.col("at") + 1).otherwise(0)).over(sofar))
    # Words by half: a row of twice ``least`` or more that is has a half that is.
    rows = rows.withColumn("near", F.collect_list(~F.col("slot")).over(line.rowsBetween(2 - 2 * least_run, 0)))
    sizes = F.when(F.size("near") >= F.col("least"), F.sequence(F.col("least"), F.least(F.col("least") * 2 - 1, F.size("near"))))
    half = F.filter(sizes, lambda k: F.size(F.filter(F.slice("near", -k, k), lambda word: word)) * 2 >= k)
    rows = rows.withColumn("worded", F.max(F.col("at") + 1 - F.array_min(half)).over(sofar))
    for c in ("start", "copy"):
        rows = rows.withColumn(f"{c}_ends", F.coalesce(F.lead(c).over(line) != F.col(c), F.lit(True)) & (F.col("at") + 1 - F.col(c) >= F.col("least")))
    exact = F.col("copy") <= F.col("start")
    rows = rows.withColumn("mapped", F.when(F.col("start_ends") & (exact | (F.col("worded") >= F.col("start"))), F.col("start")))
    around = F.first("mapped", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("copied", F.when(F.col("copy_ends") & F.coalesce(around > F.col("copy"), F.lit(True)), F.col("copy")))
    rows = rows.where("mapped is not null or copied is not null")
    return rows.groupBy("doc_id", "item_id").agg(
        F.max(F.col("at") + 1 - F.least("mapped", "copied") - F.when(F.col("head") & (F.least("mapped", "copied") == 0), 1).otherwise(0)).cast("bigint").alias("run"), F.max(F.col("copied").isNotNull() | (F.col("mapped").isNotNull() & exact)).alias("exact")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_run: int = LEAST_RUN) -> DataFrame:
    """(doc_id, item_id, run, exact): pairs of a document and a benchmark item whose passage it holds.

    Every run of equal template tokens on a diagonal is cut to the longest stretches in which the values of the placeholders map
    one to one between item and document. Such a stretch counts if it has ``least_run`` tokens or more (or is the whole item, if
    that is shorter) and holds as many in a row of which half are words. A
    stretch with equal values needs no words. ``run`` is the longest stretch that counts; ``exact`` says that one has equal values.
    The first word of an item may be a name or a unit in the document; ``run`` leaves it out then, as it is no equal template token.
    Items of under ``window`` tokens are found where they stand whole, with equal values. Null texts match nothing; rows without an id are not reported; repeated rows and repeated items give one pair each. Other
    columns are ignored.
    """
    items = benchmark.where("item_id is not null").select("item_id", template(F.col("text"), False).alias("tokens"))
    index = items.withColumn("starts", _starts(F.size("tokens"), window, 1)).where("starts is not null")
    index = index.select("item_id", F.posexplode(_windows(F.col("tokens"), F.col("starts"), window)).alias("item_at", "key"))
    # What goes before an item decides whether its first word is a placeholder in a document.
    heads = F.explode(F.transform(F.array(F.lit(NAME), F.lit(UNIT)), lambda m: F.xxhash64(F.concat(F.array(m), F.slice("tokens", 2, window - 1))))).alias("key")
    index = index.unionByName(items.where(F.size("tokens") >= window).select("item_id", F.lit(0).alias("item_at"), heads))
    index = save(index.distinct(), "dc-index")
    n_items, n_bytes = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    small = index.count() <= BROADCAST_ROWS and n_items <= BROADCAST_ITEMS and n_bytes <= BROADCAST_BYTES
    stride = max(1, least_run - window + 1)
    hits = _probes(docs, window, stride).join(F.broadcast(index) if small else index, "key").select("doc_id", "item_id", (F.col("nth") * stride - F.col("item_at")).alias("shift"))
    # An item shorter than least_run is whole only where it begins, which the stride may pass over: probe those everywhere.
    brief = items.where((F.size("tokens") >= window) & (F.size("tokens") < least_run))
    brief = brief.select("item_id", F.xxhash64(F.slice("tokens", 1, window)).alias("key")).unionByName(brief.select("item_id", heads))
    brief = save(brief.distinct(), "dc-brief")
    if stride > 1 and brief.take(1):
        every = _probes(docs, window, 1).join(F.broadcast(brief) if small else brief, "key")
        hits = hits.unionByName(every.select("doc_id", "item_id", F.col("nth").alias("shift")))
    hits = save(hits.distinct(), "dc-hits")
    few = hits.count() <= BROADCAST_ROWS
    found = docs.select("doc_id", "text").join(F.broadcast(hits) if few else hits, "doc_id")
    found = found.select("doc_id", "item_id", "shift", template(F.col("text"), True).alias("d"))
    valued = benchmark.where("item_id is not null").select("item_id", template(F.col("text"), True).alias("i"))
    found = found.join(F.broadcast(valued) if small else valued, "item_id")
    first = F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("i"), F.size("d") - F.col("shift")) - first
    found = found.withColumn("i", F.slice("i", first + 1, length)).withColumn("whole", F.size("i"))
    found = found.withColumn("d", F.slice("d", first + F.col("shift") + 1, F.col("whole")))
    mark = f"[{NUMBER}{NAME}{UNIT}]"
    kind = lambda t: F.when(t.rlike("^" + mark), F.substring(t, 1, 1)).otherwise(t)
    # The first word of an item is the same word if it is taken for a name or unit in the document.
    head = (first == 0) & F.get("d", F.lit(0)).rlike(f"^[{NAME}{UNIT}]") & (F.substring(F.get("d", F.lit(0)), 2, 1 << 30) == F.get("i", F.lit(0)))
    found = found.withColumn("head", F.coalesce(head, F.lit(False)))
    found = found.withColumn("d", F.when(F.col("head"), F.concat(F.slice("i", 1, 1), F.slice("d", 2, F.size("d")))).otherwise(F.col("d")))
    pairs = F.zip_with("i", "d", lambda a, b: F.struct(a.alias("a"), b.alias("b"), (kind(a) == kind(b)).alias("same"), a.rlike("^" + mark).alias("slot")))
    sizes = items.select("item_id", F.size("tokens").alias("size")).groupBy("item_id").agg(F.max("size").alias("size"))
    found = found.join(F.broadcast(sizes) if small else sizes, "item_id")
    runs = _runs(found.select("doc_id", "item_id", "shift", "head", F.least(F.lit(least_run), "size").alias("least"), pairs.alias("pairs")), least_run)
    # Items of under ``window`` tokens: their values too are looked for, at their own length.
    bare = lambda t: F.when(t.rlike(f"^{NUMBER}"), F.regexp_replace(t, "[.,:/]+$", "")).otherwise(t)
    worded = lambda at: F.concat(F.array(F.regexp_replace(F.get(at, F.lit(0)), f"^[{NAME}{UNIT}]", "")), F.slice(at, 2, window))
    tiny = benchmark.where("item_id is not null").select("item_id", F.transform(template(F.col("text"), True), bare).alias("tokens")).where((F.size("tokens") > 0) & (F.size("tokens") < window))
    tiny = save(tiny.select("item_id", F.size("tokens").alias("n"), F.xxhash64(worded(F.col("tokens"))).alias("key")).distinct(), "dc-tiny")
    lengths = [n for (n,) in tiny.select("n").distinct().orderBy("n").collect()]  # all below ``window``
    if lengths:
        every = docs.where("doc_id is not null").select("doc_id", F.transform(template(F.col("text"), True), bare).alias("tokens"))
        keys = [F.transform(_starts(F.size("tokens"), n, 1), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(worded(F.slice("tokens", i + 1, n))).alias("key"))) for n in lengths]  # noqa: B023
        keys = [F.coalesce(k, F.array().cast("array<struct<n:int,key:bigint>>")) for k in keys]
        every = every.select("doc_id", F.explode_outer(F.array_distinct(F.concat(*keys))).alias("w")).where("w is not null").select("doc_id", "w.*")
        every = every.join(F.broadcast(tiny) if small else tiny, ["n", "key"]).select("doc_id", "item_id", "n").distinct()
        runs = runs.unionByName(every.select("doc_id", "item_id", F.col("n").cast("bigint").alias("run"), F.lit(True).alias("exact")))
    return runs.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("exact").alias("exact"))
