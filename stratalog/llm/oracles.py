"""DuckDB SQL with the rows of the queries that SQL can express; mixing's is beside its operator."""

WARC = r"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, unhex(sha1(payload))::bit::varchar as bits from p),
t as (select *, max(page_id) over (partition by bits) as top from d)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5),
    lambda j: cast(substr(bits, i * 5 + j + 1, 1) as int) * (16 >> j)))::int, 1)), '') as payload_digest,
  case when page_id is not distinct from top then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from top then top end as refers_to
from t
"""

SUBSTRING = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (select doc_id, unnest(range(1, len(words) - 11)) as pos, words from docs where len(words) >= 13),
keyed as (select doc_id, pos, array_to_string(words[pos:pos + 12], ' ') as key from windows),
firsts as (select key, min(doc_id) as first from keyed group by 1),
gone as (select distinct doc_id, unnest(range(pos, pos + 13)) as pos from keyed join firsts using (key) where first < doc_id),
placed as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from docs),
kept as (
  select placed.doc_id, count(*) filter (gone.pos is not null) as n_removed, string_agg(word, ' ' order by placed.pos) filter (gone.pos is null) as kept
  from placed left join gone on placed.doc_id = gone.doc_id and placed.pos = gone.pos group by 1)
select docs.doc_id, len(words) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join kept on docs.doc_id = kept.doc_id
"""

MINHASH = r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
shingles as (
  select distinct doc_id, words[pos] || ' ' || words[pos + 1] as s from (select doc_id, words, unnest(range(1, len(words))) as pos from docs)
  union all select doc_id, words[1] from docs where len(words) = 1),
sizes as (select doc_id, count(*) as n from shingles group by 1),
sets as (select doc_id, n, list_sort(list(s)) as members from shingles join sizes using (doc_id) group by 1, 2),
classes as (select members, n, min(doc_id) as rep from sets group by 1, 2),
named as (select doc_id, rep, n from sets join classes using (members, n)),
own as (select s.doc_id, s.s from shingles s where s.doc_id in (select rep from classes)),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from own a join own b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
edges as materialized (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as materialized (select a, b from edges union all select b, a from edges),
reach(id, other) as (select rep, rep from classes union select reach.id, e.b from reach join both_ways e on e.a = reach.other),
found as (select id, min(other) as component from reach group by 1)
select docs.doc_id, coalesce(named.n, 0) as n_shingles, coalesce(component, docs.doc_id) as component_id, coalesce(component, docs.doc_id) = docs.doc_id as kept
from docs left join named on docs.doc_id = named.doc_id left join found on found.id = named.rep
"""


def _template(table: str, key: str) -> str:
    """Valued template tokens of a table's texts by position; the name rule is put without look-behind."""
    space = r"[\x20\x09-\x0D]"
    units = "km|kg|mg|cm|mm|ml|mph|kmh|kph|miles?|metres?|meters?|kilometers?|kilometres?|grams?|kilograms?|pounds?|lbs?|ounces?|oz|litres?|liters?|gallons?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|inches|inch|feet|foot|yards?|watts?|volts?|joules?|newtons?|g|m|l|s"
    text = "translate(coalesce(text, ''), chr(1) || chr(2) || chr(3) || chr(4), '    ')"
    text = rf"regexp_replace({text}, '([\p{{Ll}},;])({space}+)', '\1\2' || chr(4), 'g')"
    text = rf"replace(regexp_replace({text}, '{space}+\x04(\p{{Lu}}[\p{{L}}\p{{M}}]*)', ' ' || chr(2) || '\1', 'g'), chr(4), '')"
    text = rf"regexp_replace({text}, '(\d[\d.,:/]*)', chr(1) || '\1', 'g')"
    text = rf"regexp_replace({text} || ' ', '(\x01[\d.,:/]*){space}?({units})([^\p{{L}}\p{{M}}])', '\1 ' || chr(3) || '\2 \3', 'g')"
    text = rf"lower(regexp_replace({text}, '(\x01[\d.,:/]*)|([^\p{{L}}\p{{M}}\x01-\x03]+)', ' \1 ', 'g'))"
    tokens = f"list_filter(regexp_split_to_array({text}, ' +'), lambda t: t <> '')"
    listed = f"select {key}, {tokens} as tokens from {table} where {key} is not null"
    return f"select {key}, len(tokens) as size, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from ({listed})"


#: By the rules, over all stretches: on each diagonal of a document and an item that share 8 template tokens in a row, a stretch is a run
#: of places with equal template tokens; two of its slots clash if one has equal values where the other side has not. Stretches that hold
#: no clash and cannot be longer are mapped; those without unequal values that cannot be longer are verbatim. A mapped one counts if it has
#: 13 tokens (or the item's, if fewer) and is verbatim or holds as many in a row of which half are words; a verbatim one counts from the
#: same length, unless a mapped one that counts holds it. Items of under 8 tokens have a rule of their own; the tables have none.
DECONTAM = f"""
with d as materialized (select *, case when ascii(token) <= 3 then token[1] else token end as kind from ({_template("documents", "doc_id")})),
i as materialized (select *, case when ascii(token) <= 3 then token[1] else token end as kind from ({_template("benchmark", "item_id")})),
dw as (select doc_id, pos, string_agg(kind, ' ') over w as key, count(*) over w as n from d window w as (partition by doc_id order by pos rows between current row and 7 following)),
iw as (select item_id, pos, string_agg(kind, ' ') over w as key, count(*) over w as n from i window w as (partition by item_id order by pos rows between current row and 7 following)),
shifts as materialized (select distinct doc_id, item_id, dw.pos - iw.pos as shift from dw join iw using (key) where dw.n = 8 and iw.n = 8),
places as (
  select s.doc_id, s.item_id, s.shift, i.pos, least(13, i.size) as least, i.token as a, d.token as b, ascii(i.kind) <= 3 as slot, d.kind = i.kind as same,
    i.pos = 1 and ascii(d.token) in (2, 3) and d.token[2:] = i.token as head
  from shifts s join i on i.item_id = s.item_id join d on d.doc_id = s.doc_id and d.pos = i.pos + s.shift),
pairs as materialized (
  select *, pos - row_number() over (partition by doc_id, item_id, shift order by pos) as island from places where same or head),
spans as (
  select x.doc_id, x.item_id, x.shift, x.island, x.pos as s, y.pos as e, x.least, x.head from pairs x join pairs y
  on x.doc_id = y.doc_id and x.item_id = y.item_id and x.shift = y.shift and x.island = y.island and y.pos - x.pos + 1 >= x.least),
slots as materialized (select * from pairs where slot and not head),
clashes as materialized (
  select x.doc_id, x.item_id, x.shift, x.pos as s, y.pos as e from slots x join slots y
  on x.doc_id = y.doc_id and x.item_id = y.item_id and x.shift = y.shift and x.island = y.island and x.pos < y.pos and (x.a = y.a) <> (x.b = y.b)),
unequal as materialized (select doc_id, item_id, shift, pos from slots where a <> b),
clean as (
  select *, not exists (from unequal u where u.doc_id = n.doc_id and u.item_id = n.item_id and u.shift = n.shift and u.pos between n.s and n.e) as verbatim
  from spans n where not exists (from clashes c where c.doc_id = n.doc_id and c.item_id = n.item_id and c.shift = n.shift and c.s >= n.s and c.e <= n.e)),
mapped as (
  select * from clean n where not exists (from clean o where o.doc_id = n.doc_id and o.item_id = n.item_id and o.shift = n.shift
    and o.s <= n.s and o.e >= n.e and o.e - o.s > n.e - n.s)),
copied as (
  select * from clean n where verbatim and not exists (from clean o where o.verbatim and o.doc_id = n.doc_id and o.item_id = n.item_id and o.shift = n.shift
    and o.s <= n.s and o.e >= n.e and o.e - o.s > n.e - n.s)),
worded as (
  select n.doc_id, n.item_id, n.shift, n.s, n.e from spans n join pairs p on p.doc_id = n.doc_id and p.item_id = n.item_id and p.shift = n.shift and p.pos between n.s and n.e
  group by all having 2 * count(*) filter (not p.slot) >= count(*)),
counted as (
  select * from mapped n where verbatim or exists (from worded w where w.doc_id = n.doc_id and w.item_id = n.item_id and w.shift = n.shift and w.s >= n.s and w.e <= n.e)),
results as (
  select doc_id, item_id, s, e, head, verbatim from counted union all
  select doc_id, item_id, s, e, head, true from copied n where not exists (from counted o where o.doc_id = n.doc_id and o.item_id = n.item_id and o.shift = n.shift and o.s <= n.s and o.e >= n.e))
select doc_id, item_id, max(e - s + 1 - head::int)::bigint as run, bool_or(verbatim) as exact from results group by 1, 2
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds of the codebooks one after the other: entry by entry distances, ties by the smallest (distance, entry)."""
    ctes = [
        "kept as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v, len(embedding) // %d as w from embeddings"
        " where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)" % parts,
        f"parts as materialized (select vec_id, label, p, v[p * w + 1:(p + 1) * w] as own from (select *, unnest(range({parts})) as p from kept))",
        f"b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, own as entry from parts where vec_id in (select vec_id from kept order by vec_id limit {entries}))",
    ]
    for r in range(rounds + 1):
        apart = "cast(list_sum(list_transform(list_zip(own, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
        ctes.append(f"a{r} as materialized (select vec_id, label, p, own, min({{'d': {apart}, 'e': e}}) as best from parts join b{r} using (p) group by all)")
        if r < rounds:
            ctes.append(
                f"m{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by pos) as entry from"
                f" (select p, best.e as e, pos, cast(sum(own[pos]) as bigint) as s, count(*) as n from (select p, best, own, unnest(range(1, len(own) + 1)) as pos from a{r}) group by all) group by all)"
            )
            ctes.append(f"b{r + 1} as materialized (select b{r}.p, b{r}.e, coalesce(m{r}.entry, b{r}.entry) as entry from b{r} left join m{r} on b{r}.p = m{r}.p and b{r}.e = m{r}.e)")
    ctes.append(f"digest as (select sha256(string_agg(array_to_string(entry, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})")
    ctes.append(f"coded as materialized (select vec_id, label, string_agg(lower(printf('%02x', cast(best.e as integer))), '' order by p) as code, cast(sum(best.d) as bigint) as error from a{rounds} group by all)")
    return f"with {', '.join(ctes)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, digest"


def licenses() -> str:
    """Every place of every phrase by comparing word lists, and every template at each place of its leading phrase."""
    from stratalog.llm.license_scan import LEAST_SHARE, SLACK, TEMPLATES, WORD, words_of

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases, keys, bodies = {}, [], []
    for n, t in enumerate(TEMPLATES):
        body = words_of(t.text)
        for k, key in enumerate(t.keys or (t.text,)):
            own = tuple(words_of(key))
            at = next(i for i in range(len(body)) if tuple(body[i : i + len(own)]) == own)
            keys.append(f"({n}, {k}, {phrases.setdefault(own, len(phrases))}, {at})")
        bodies.append(f"({n}, '{t.label}', {str(t.base).lower()}, {listed(body)})")
    return rf"""
with docs as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') as words from documents),
phrases(phrase, ws) as (values {", ".join(f"({n}, {listed(p)})" for p, n in phrases.items())}),
keys(template, k, phrase, back) as (values {", ".join(keys)}),
templates(template, label, base, body) as (values {", ".join(bodies)}),
tokens as materialized (select r, unnest(words) as w, generate_subscripts(words, 1) - 1 as i from docs),
standing as materialized (select r, phrase, i as place from phrases join tokens on w = ws[1] join docs using (r) where words[i + 1:i + len(ws)] = ws),
leads as (select r, template, place - back as s from standing join keys using (phrase) where k = 0),
whole as (select * from leads where not exists (select 1 from keys where keys.template = leads.template and k > 0 and not exists (
  select 1 from standing where standing.r = leads.r and standing.phrase = keys.phrase and abs(standing.place - leads.s - keys.back) <= {SLACK}))),
counted as (select r, template, s, label, body, list_sum(list_transform(range(0, len(body)), lambda p:
  case when list_contains(words[greatest(s + p - {SLACK}, 0) + 1:s + p + {SLACK} + 1], body[p + 1]) then 1 else 0 end)) as covered
  from whole join templates using (template) join docs using (r)),
found as (select r, label, covered / len(body) as share from counted where covered * 100 >= {LEAST_SHARE} * len(body)),
base as (select r, label, place from standing join keys using (phrase) join templates using (template) where base),
b as (select r, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by 1),
f as (select r, string_agg(distinct label, ',' order by label) as labels, max(share) as score from found group by 1)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from docs left join b using (r) left join f using (r)
"""
