"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are counted once into a narrow table of distinct rows with their number of copies; everything after it moves a few dozen bytes
a document. Sources get integer numbers of blocks by highest quotients, each source's blocks are apportioned to its groups of hash
shards and each group's to its shards the same way, and inside a shard a seeded order of the documents says which words of which documents
the blocks hold. A shard holds about ``shard_docs`` documents and a group about ``GROUP_SHARDS`` shards however large the source is, so no
window ever sees a whole hot source; rows without an id are placed by their text, and copies of a row are one row with a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import WORD, save

#: Up to so many source rows (a rank, a name and five numbers each) are broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000
#: Up to so many quota rows (a source and a shard, four numbers) are broadcast; beyond, the join shuffles.
BROADCAST_QUOTAS = 200_000
#: Documents of a shard, and shards of a group, about: what one window sorts.
SHARD_DOCS, GROUP_SHARDS = 2_000, 2_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, n_docs) to the same plus rank and target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight. That fixed point has a closed form: with the sources in order
    of cap/weight, a source is capped if its own cap is no more than its share of what the sources before it left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name).cast("bigint"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    ranked = ranked.withColumn("cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.sum("cap").over(by_ratio) + F.col("cap")
    heavy = F.sum("weight").over(every) - F.sum("weight").over(by_ratio) + F.col("weight")
    ranked = ranked.withColumn("level", left.cast("double") / heavy.cast("double"))
    open_level = F.min_by("level", F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("cap") / F.col("weight"))).over(every)
    ranked = ranked.withColumn("open_level", open_level)
    target = F.when(F.col("open_level").isNull() | (F.col("cap") / F.col("weight") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("weight"))
    return ranked.withColumn("target", target).select("source", "source_size", "n_docs", "rank", "target")


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: add ``out``, the seats of each party of a group that has ``seats`` of them to give.

    The rounded proportional share is at most n/2 seats of a group off, so only the few quotients around it are compared:
    their number is bounded by a constant a party, whatever the number of seats. Ties go to the smaller party.
    """
    keys = group or [F.lit(0)]
    of_group = Window.partitionBy(*keys)
    total, n = F.sum(votes).over(of_group).cast("double"), F.count(F.lit(1)).over(of_group)
    share = F.when(total > 0, F.floor(F.col(votes) * F.col(seats) / total + 0.5)).otherwise(0).cast("bigint")
    reach = F.when(total > 0, F.ceil(F.col(votes) * n * 2 / total) + 2).otherwise(1).cast("bigint")
    base = parties.withColumn("_base", share).withColumn("_reach", reach).withColumn("_total", total)
    base = base.withColumn("_miss", F.when(F.col("_total") > 0, F.col(seats) - F.sum("_base").over(of_group)).otherwise(0))
    tried = base.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("_miss") == 0, 0).otherwise(F.col("_reach") - 1).cast("bigint"))))
    up = F.col(votes) / (2 * (F.col("_base") + F.col("_step")) + 1)
    down = F.when(F.col("_step") < F.col("_base"), -F.col(votes) / (2 * (F.col("_base") - 1 - F.col("_step")) + 1))
    tried = tried.withColumn("_quotient", F.when(F.col("_miss") >= 0, up).otherwise(down))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_quotient").desc_nulls_last(), party, "_step"))
    moved = F.when((place <= F.abs("_miss")) & F.col("_quotient").isNotNull(), F.signum("_miss")).otherwise(0).cast("bigint")
    kept = [c for c in parties.columns if c not in (*group, party)]
    return tried.withColumn("_moved", moved).groupBy(*group, party).agg(*(F.first(c).alias(c) for c in kept), (F.first("_base") + F.sum("_moved")).alias(out))


def _place(seed: int) -> Column:
    """A row's place in the seeded order: by its id, or by its text where it has none."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), F.coalesce("text", F.lit(""))))
    return F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))


def _lined_up(docs: DataFrame, seed: int, block_words: int, shard_docs: int, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Distinct (doc_id, source, size, place) with copies, source_size, target, and passes, rest and upto.

    The mix takes ``passes`` times all words of a shard and then its first ``rest`` ones; ``upto`` counts the words of the shard up to
    and with the row's last copy.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _place(seed).alias("place"))
    sized = save(rows.groupBy("doc_id", "source", "size", "place").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_docs")), weights, cap)
    sources = sources.withColumn("blocks", F.floor(F.sum("source_size").over(Window.partitionBy()) / block_words).cast("bigint"))
    sources = apportion(sources, [], "rank", "target", "blocks", "source_blocks")
    sources = sources.withColumn("shards", F.ceil(F.col("n_docs") / shard_docs).cast("bigint"))
    sources = save(sources.withColumn("groups", F.ceil(F.col("shards") / GROUP_SHARDS).cast("bigint")).withColumnRenamed("source", "source_name"), "mix-sources")
    small = sources.count() <= BROADCAST_SOURCES
    placed = sized.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("source_name")))
    shard = F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") % F.col("shards")
    placed = placed.select("doc_id", "source", "size", "copies", "source_size", "target", "place", "rank", "source_blocks", "groups", shard.alias("shard"))
    quotas = placed.groupBy("rank", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size"), F.first("source_blocks").alias("source_blocks"), F.first("groups").alias("groups"))
    quotas = save(quotas.withColumn("part", F.col("shard") % F.col("groups")), "mix-shards")
    parts = quotas.groupBy("rank", "part").agg(F.sum("shard_size").alias("part_size"), F.first("source_blocks").alias("source_blocks"))
    parts = apportion(parts, ["rank"], "part", "part_size", "source_blocks", "part_blocks").select("rank", "part", "part_blocks")
    quotas = apportion(quotas.join(parts, ["rank", "part"]), ["rank", "part"], "shard", "shard_size", "part_blocks", "shard_blocks")
    words = F.least(F.col("shard_blocks") * block_words, F.col("shard_size") * cap)
    quotas = save(quotas.select("rank", "shard", "shard_size", words.alias("quota")), "mix-quotas")
    stream = Window.partitionBy("rank", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(stream))
    lined = lined.join(F.broadcast(quotas) if quotas.count() <= BROADCAST_QUOTAS else quotas, ["rank", "shard"])
    lined = lined.withColumn("passes", F.when(F.col("shard_size") > 0, F.expr("quota div shard_size")).otherwise(0))
    return lined.withColumn("rest", F.col("quota") - F.col("passes") * F.col("shard_size")).select("doc_id", "source", "size", "place", "copies", "source_size", "target", "passes", "rest", "upto")


def _taken(size: Column, before: Column) -> Column:
    """The words taken of a stretch of ``size`` words that ``before`` words of its shard go before."""
    return (F.col("passes") * size + F.greatest(F.lit(0).cast("bigint"), F.least(size, F.col("rest") - before))).cast("bigint")


def mix_sources(docs: DataFrame, seed: int = 17, block_words: int = 16, shard_docs: int = SHARD_DOCS, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns doc_id, source, size, source_size, target, taken, one row per input row; repeated rows stay repeated. Null text has
    size 0 and is taken 0 times; null source is a source of its own, ordered last; a row without an id is ordered by its text. An
    empty table gives an empty result; texts of any length are counted whole; other columns are ignored. A source's taken words differ
    from its target by about a block; no document is taken more than ``cap`` times.
    """
    lined = _lined_up(docs, seed, block_words, shard_docs, weights, cap).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    before = F.col("upto") - F.col("size") * (F.col("copies") - F.col("copy") + 1)
    return lined.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("size"), before).alias("taken"))


def mix_rows(docs: DataFrame, seed: int = 17, block_words: int = 16, shard_docs: int = SHARD_DOCS, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with all their columns and size, source_size, target, taken.

    As mix_sources(), but exact copies of a row share evenly what is taken of them all (whole words, the remainder of less than a word
    a copy is left). Columns of ``docs`` with one of the four names are replaced.
    """
    lined = _lined_up(docs, seed, block_words, shard_docs, weights, cap)
    whole = F.col("size") * F.col("copies")
    shares = lined.select(F.struct("doc_id", "source", "size", "place").alias("row"), "source_size", "target", F.floor(_taken(whole, F.col("upto") - whole) / F.col("copies")).alias("taken"))
    kept = docs.drop("size", "source_size", "target", "taken")
    # The row travels as one column, so that no name in it clashes with those made here.
    mine = F.struct(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), _place(seed).alias("place"))
    named = kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("input"), mine.alias("mine"))
    joined = named.join(shares.where("taken > 0").hint("merge"), F.col("mine").eqNullSafe(F.col("row")))
    return joined.select("input.*", F.col("mine.size").alias("size"), "source_size", "target", "taken")


#: The same rows by DuckDB, for the default parameters.
ORACLE = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('17:' || coalesce(doc_id::varchar, '')) as place from documents),
named as (select source, sum(size)::bigint as source_size, count(*)::bigint as n_docs from sized group by source),
ranked as (
  select *, row_number() over (order by source nulls last) as rank from named),
weighed as (select *, 1 + (rank - 1) % 3 as weight, source_size * 3 as cap from ranked),
levels as (
  select *, ((sum(source_size) over () - sum(cap) over w + cap)::double / (sum(weight) over () - sum(weight) over w + weight)::double) as level
  from weighed window w as (order by cap::double / weight, rank)),
opened as (select *, (select arg_min(level, cap::double / weight) from levels where cap::double / weight > level) as open_level from levels),
targets as (
  select source, source_size, n_docs, rank,
    case when open_level is null or cap::double / weight <= level then cap::double else open_level * weight end as target,
    floor(sum(source_size) over () / 16)::bigint as blocks from opened),
s0 as (
  select *, floor(target * blocks / nullif(sum(target) over (), 0) + 0.5)::bigint as b0, count(*) over () as n, sum(target) over () as v from targets),
s1 as (select *, coalesce(blocks - sum(b0) over (), 0) as miss from s0),
s2 as (
  select rank, miss, k, case when miss >= 0 then target / (2 * (b0 + k) + 1) when k < b0 then -target / (2 * (b0 - 1 - k) + 1) end as quotient
  from s1, unnest(range(0, coalesce(ceil(target * n * 2 / nullif(v, 0)), 0)::bigint + 2)) as u(k)),
s3 as (select *, row_number() over (order by quotient desc nulls last, rank, k) as place from s2),
s4 as (select rank, coalesce(sum(sign(miss)) filter (place <= abs(miss) and quotient is not null), 0)::bigint as moved from s3 group by rank),
sources as (select s1.*, coalesce(b0, 0) + moved as source_blocks, ceil(n_docs / {SHARD_DOCS})::bigint as shards from s1 join s4 using (rank)),
placed as (
  select d.doc_id, d.source, d.size, s.source_size, s.target, d.place, s.rank, s.source_blocks,
    cast('0x' || substr(d.place, 1, 8) as bigint) % s.shards as shard
  from sized d join sources s on d.source is not distinct from s.source),
q0 as (select rank, shard, sum(size)::bigint as shard_size, any_value(source_blocks) as blocks from placed group by 1, 2),
q1 as (
  select *, floor(shard_size * blocks / nullif(sum(shard_size) over (partition by rank), 0)::double + 0.5)::bigint as b0,
    count(*) over (partition by rank) as n, sum(shard_size) over (partition by rank)::double as v from q0),
q2 as (select *, coalesce(blocks - sum(b0) over (partition by rank), 0) as miss from q1),
q3 as (
  select rank, shard, miss, k, case when miss >= 0 then shard_size / (2 * (b0 + k) + 1) when k < b0 then -shard_size / (2 * (b0 - 1 - k) + 1) end as quotient
  from q2, unnest(range(0, coalesce(ceil(shard_size * n * 2 / nullif(v, 0)), 0)::bigint + 2)) as u(k)),
q4 as (select *, row_number() over (partition by rank order by quotient desc nulls last, shard, k) as place from q3),
q5 as (select rank, shard, coalesce(sum(sign(miss)) filter (place <= abs(miss) and quotient is not null), 0)::bigint as moved from q4 group by 1, 2),
quotas as (
  select q2.rank, q2.shard, shard_size, least((coalesce(b0, 0) + moved) * 16, shard_size * 3)::bigint as quota
  from q2 join q5 using (rank, shard)),
lined as (
  select p.*, shard_size, quota, sum(size) over (partition by p.rank, p.shard order by place, doc_id, size rows unbounded preceding)::bigint as upto
  from placed p join quotas q on p.rank = q.rank and p.shard = q.shard)
select doc_id, size, source_size, target,
  (coalesce(quota // nullif(shard_size, 0), 0) * size
   + greatest(0, least(size, quota - coalesce(quota // nullif(shard_size, 0), 0) * shard_size - upto + size)))::bigint as taken
from lined
"""
