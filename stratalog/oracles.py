"""DuckDB SQL with the rows of each query. Queries that depend on Python's random generator have none."""

from __future__ import annotations


def _assemble(topics: list[str], order: str = "ts, event_id", user: str = "user_id") -> str:
    listed = ", ".join(f"'{t}'" for t in topics)
    first = ", ".join(f"min(pos) filter (event_type = '{t}')" for t in topics)
    later = ", ".join(f"lateral (select min(pos) p from m where m.user_id = r.user_id and event_type = '{t}' and pos > r.p1) l{i}" for i, t in enumerate(topics))
    ends = ", ".join(f"l{i}.p" for i in range(len(topics)))
    full = " and ".join(f"l{i}.p is not null" for i in range(len(topics)))
    values = ", ".join(f"max_by(m.value, m.pos) filter (m.event_type = '{t}') as \"{t}\"" for t in topics)
    return f"""
with recursive m as (
  select {user} as user_id, event_type, value, row_number() over (partition by {user} order by {order}) as pos
  from events where event_type in ({listed})),
r(user_id, i, p0, p1) as (
  select user_id, 0::bigint, 0::bigint, greatest({first}) from m group by 1 having count(distinct event_type) = {len(topics)}
  union all
  select r.user_id, r.i + 1, r.p1, greatest({ends}) from r, {later} where {full})
select r.user_id, r.i as sample_idx, {values}
from r join m on m.user_id = r.user_id and m.pos > r.p0 and m.pos <= r.p1 group by 1, 2"""


_SAMPLES = "select o_custkey as episode_id, o_orderkey as sample_id, *, row_number() over (order by o_custkey, o_orderkey) - 1 as pos from orders"
_ALIGNED = "select p_brand as episode_id, p_partkey as log_time, 'size' as topic, p_size::double as value from part union all select p_brand, p_partkey, 'price', p_retailprice from part"
_FRAMES = "select label as stream, row_number() over (partition by label order by vec_id) - 1 as idx, vec_id from embeddings"
_STAMPS = "select user_id, event_id as idx, round(value * 100)::bigint as stamp, row_number() over (partition by user_id order by event_id) as rn from events"
_UNIT = f"select user_id, idx, rn + max(stamp - rn) over (partition by user_id order by idx) as fixed from ({_STAMPS})"
_RELATIVE = f"select *, first_value(fixed) over (partition by user_id order by idx) as base from ({_UNIT})"
_FILES = "select r_name as root, n_name || '.mcap' as file from nation join region on n_regionkey = r_regionkey"
_CUSTOMERS = "select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 as sample_idx, row_number() over (order by c_nationkey, c_custkey) - 1 as pos from customer"
_NS = "epoch_us(ts) * 1000"

_FILE = "(user_id % 10) || '.mcap' as file, event_type as topic, event_id, round(value::float::double, 2) as value from events"

ORACLES = {
    "indexed_topic": f"select {_FILE} where event_type = 'click' and ts >= '2024-01-15' and ts < '2024-01-20'",
    "written_episodes": f"select {_FILE} where event_type in ('view', 'error') and ts < '2024-01-15'",
    "indexed_counts": "select (user_id % 10) || '.mcap' as file, event_type as topic, count(*) as n from events group by 1, 2",
    "converted_files": """
select n_nationkey || '.mcap' as file, 'schema' as kind, 'geo.Customer' as name, 'text' as encoding, n_name as detail from nation
union all select n_nationkey || '.mcap', 'schema', 'geo.Nothing', 'text', 'unused' from nation
union all select n_nationkey || '.mcap', 'channel', 'silent', 'text', n_name from nation
union all select distinct c_nationkey || '.mcap', 'channel', c_mktsegment, 'utf8', c_mktsegment from customer
union all select c_nationkey || '.mcap', 'message', c_mktsegment, 'geo.Customer', c_name from customer
union all select s_nationkey || '.mcap', 'attachment', s_name, 'text/plain', s_name from supplier
union all select n_nationkey || '.mcap', 'metadata', 'nation', '', n_nationkey::varchar from nation""",
    "stream_files": 'select user_id as user_digit, sample_idx, round(click::float::double, 2) as click, round("view"::float::double, 2) as "view" from (' + _assemble(["click", "view"], user="user_id % 10") + ")",
    "assemble_2": _assemble(["click", "view"]),
    "assemble_3": _assemble(["click", "purchase", "view"]),
    "assemble_reverse": _assemble(["click", "view"], "ts desc, event_id desc"),
    "assemble_catalyst": _assemble(["click", "view"]),
    "assemble_strict_roundtrip": "select p_brand, row_number() over (partition by p_brand order by p_partkey) - 1 as sample_idx, p_size::double as size, p_retailprice as price from part",
    "topic_counts": "select user_id, event_type as topic, count(*) as n from events group by 1, 2",
    "equal_counts": "select user_id, case when min(n) = max(n) then max(n) else 0 end as common from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1",
    "episode_length_ok": "select p_brand, count(*) as length from part group by 1",
    "topic_catalog": "select distinct user_id, event_type as topic from events",
    "attachment_catalog": "select distinct conv_id, name from conversations, (values ('role'), ('text')) v(name)",
    "unknown_topics": "select topic from (values ('click'), ('view'), ('camera'), ('joint')) v(topic) where topic not in (select event_type from events)",
    "requested_union": "select event_type as topic from events union select 'click' union select 'camera'",
    "catalog_sorted": f"select root, file, row_number() over (partition by root order by file) - 1 as pos from ({_FILES})",
    "catalog_shuffled": f"select root, file, row_number() over (partition by root order by md5('42:' || file), file) - 1 as pos from ({_FILES})",
    "catalog_reversed": f"select root, file, row_number() over (partition by root order by file desc) - 1 as pos from ({_FILES})",
    "catalog_sliced": f"""
with c as (select root, file, row_number() over (partition by root order by file) - 1 as pos, count(*) over (partition by root) as n from ({_FILES})),
w(root, slot, idx) as (values ('ASIA', 0, 1), ('ASIA', 1, 2), ('ASIA', 2, 0), ('EUROPE', 0, -1), ('EUROPE', 1, 0))
select c.root, c.file, w.slot::bigint as pos from c join w on c.root = w.root and c.pos = case when w.idx < 0 then w.idx + c.n else w.idx end
union all select root, file, pos from c where root not in ('ASIA', 'EUROPE')""",
    "catalog_by_root": f"select root, string_agg(file, ',' order by file) as files from ({_FILES}) group by 1",
    "catalog_size": f"select root, count(*) as n_files from ({_FILES}) group by 1",
    "extension_filter": f"select root || '/' || file as path from ({_FILES}) where file like '%.mcap'",
    "slice_index_table": """
select name, pos, idx, n_name || '.mcap' as file from (
  select 'int' as name, i::bigint as pos, i::varchar as idx from range(0, 4) t(i)
  union all select 'pair', i - 5, i::varchar from range(5, 8) t(i)
  union all select 'suffix', i - 5, i || '_x' from range(5, 7) t(i)
  union all select 'list', pos::bigint, idx from (values (0, '1'), (1, '2'), (2, '3'), (3, '8'), (4, '9'), (5, '12')) v(pos, idx))
left join nation on n_nationkey::varchar = idx""",
    "shard": f"select episode_id, sample_id, (pos - 5) // 6 as pos from ({_SAMPLES}) where pos % 6 = 5",
    "resume": f"select episode_id, sample_id, pos // 2 - 100 as pos from ({_SAMPLES}) where pos % 2 = 0 and pos // 2 >= 100",
    "pipeline_full": f"""
select episode_id, sample_id, cents, row_number() over (partition by b order by md5('42:' || p), p) - 1 + b * 64 as pos from (
  select episode_id, sample_id, round(o_totalprice * 100)::bigint as cents, (pos - 1) // 2 - 10 as p, ((pos - 1) // 2 - 10) // 64 as b
  from ({_SAMPLES}) where pos % 2 = 1 and (pos - 1) // 2 >= 10 and o_orderstatus = 'F')""",
    "pipeline_nested_literal": """
select episode_id, sample_id, pos // 2 as pos from (
  select *, row_number() over (order by episode_id, sample_id) - 1 as pos from (
    select o_custkey as episode_id, o_orderkey as sample_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders) where i % 2 = 0)
where pos % 2 = 0""",
    "filter_map": "select l_orderkey, l_linenumber, round(l_extendedprice * 100)::bigint as cents from lineitem where l_quantity > 45 and l_returnflag = 'R'",
    "block_shuffle": """
select event_id, pos, row_number() over (partition by pos // 64 order by md5('42:' || event_id), event_id) - 1 + (pos // 64) * 64 as out_pos
from (select event_id, row_number() over (order by user_id, event_id) - 1 as pos from events)""",
    "nth": f"select sample_id, pos from ({_SAMPLES}) where pos = 37",
    "nth_negative": f"select sample_id, pos from ({_SAMPLES}) where pos = (select count(*) - 3 from orders)",
    "first_k": "select o_custkey as episode_id, o_orderkey as sample_id from orders order by 1, 2 limit 25",
    "batches": f"""
select episode_id, i // 4 as batch_idx, string_agg(sample_id::varchar, ',' order by i) as items
from (select episode_id, sample_id, row_number() over (partition by episode_id order by sample_id) - 1 as i from ({_SAMPLES})) group by 1, 2""",
    "batches_strict": """
select p_partkey as episode_id, 0::bigint as batch_idx, string_agg((p_partkey * 10 + i)::varchar, ',' order by i) as items from part, range(0, 5) t(i) group by 1""",
    "zip_json": "select conv_id, turn, role, text from conversations",
    "zip_samples": f"select *, sample_idx * 10 as log_stamp from ({_assemble(['click', 'view'])})",
    "json_attachments": "select conv_id, turn, role from conversations",
    "json_props": "select event_id, (props->>'$.k')::bigint as k from events",
    "empty_samples": "select p_brand, i as sample_idx from (select p_brand, count(*) as n from part group by 1), lateral (select unnest(range(0, n)) as i)",
    "nearest_frame": f"""
with f as (select user_id, {_NS} as pts, event_id from events where event_type = 'view'),
t as (select user_id, {_NS} as t, event_id as target_id from events where event_type = 'error'),
a as (select t.*, f.pts as np, f.event_id as ne from t asof left join f on t.user_id = f.user_id and t.t <= f.pts),
b as (select a.*, f.pts as pp, f.event_id as pe from a asof left join f on a.user_id = f.user_id and a.t >= f.pts)
select user_id, target_id, case when np is not null and pp is not null and t - pp < np - t then pe else coalesce(ne, -1) end as event_id from b""",
    "assemble_long": "select * exclude (user_id) from (" + _assemble(["click", "purchase", "view"], user="'all'") + ")",
    "monotonic_ms": f"""
with recursive s as ({_STAMPS}),
r as (select user_id, idx, rn, stamp as fixed from s where rn = 1
  union all select s.user_id, s.idx, s.rn, case when s.stamp > r.fixed then s.stamp else r.fixed + 1000 end from r join s on s.user_id = r.user_id and s.rn = r.rn + 1)
select user_id, idx, fixed from r""",
    "monotonic_unit": _UNIT,
    "relative_stamp": f"select user_id, idx, base, fixed - base as pts from ({_RELATIVE})",
    "absolute_stamp": f"select user_id, idx, (fixed::hugeint * 1000000000 // 90000)::bigint as ns from ({_RELATIVE})",
    "sec_nsec": f"select event_id, {_NS} // 1000000000 as sec, {_NS} % 1000000000 as nsec from events",
    "tail_pad": f"""
with f as ({_FRAMES}), n as (select stream, count(*) as seen, max_by(vec_id, idx) as last from f group by 1)
select stream, idx, vec_id, false as padded from f
union all select stream, seen + i, last, true from n, lateral (select unnest(range(0, stream % 4)) as i)""",
    "frame_indices": f"select stream, idx, vec_id from ({_FRAMES}) where idx in (0, 3, 7)",
    "base_stamps": "select event_id, case when event_id % 3 > 0 then event_id * 1000 else 0 end as base from events",
    "float_explode": "select vec_id, generate_subscripts(embedding, 1) - 1 as index, unnest(embedding) as value from embeddings",
    "array_length": "select vec_id, case when vec_id % 7 > 0 then len(embedding) else 0 end::bigint as n, vec_id % 7 = 0 as is_none from embeddings",
    "array_element": "select vec_id, embedding[4]::double as v3, 0.0::double as v99 from embeddings",
    "floatarray_roundtrip": "select vec_id, generate_subscripts(embedding, 1) - 1 as index, unnest(embedding) as value from embeddings",
    "field_fanout": """
select l_orderkey, l_linenumber, l_partkey, '/line/quantity' as topic, l_quantity as value from lineitem
union all select l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount from lineitem
union all select l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax from lineitem""",
    "message_builders": f"select event_id as sequence, event_type as topic, 'foxglove.CompressedImage' as schema_name, {_NS} + 1 as log_time, 'jpeg' as format, {_NS} // 1000000000 as sec, {_NS} % 1000000000 as nsec from events",
    "encoding_lookup": """
select p_partkey, encoding, channels::bigint as channels, itemsize::bigint as itemsize, dtype from part join (values (0, 'rgb8', 3, 1, 'uint8'), (1, 'bgr8', 3, 1, 'uint8'), (2, '8UC3', 3, 1, 'uint8'), (3, 'rgba8', 4, 1, 'uint8'),
  (4, 'bgra8', 4, 1, 'uint8'), (5, 'mono8', 1, 1, 'uint8'), (6, '8UC1', 1, 1, 'uint8'), (7, 'mono16', 1, 2, 'uint16'), (8, '16UC1', 1, 2, 'uint16'), (9, '32FC1', 1, 4, 'float32')) v(i, encoding, channels, itemsize, dtype) on i = p_partkey % 10""",
    "encoding_inference": "select p_partkey, dtype, dims::bigint as dims, encoding from part join (values (0, 'uint8', 2, '8UC1'), (1, 'uint8', 3, '8UC3'), (2, 'uint16', 2, '16UC1'), (3, 'float32', 2, '32FC1')) v(i, dtype, dims, encoding) on i = p_partkey % 4",
    "all_encodings": """
select p_partkey, encoding, ((p_size % 5 + 1) * (p_size % 3 + 1) * channels)::bigint as n, ((p_size % 5 + 1) * (p_size % 3 + 1) * channels * pixel)::bigint as total
from part join (values (0, 'rgb8', 3, 120), (1, 'bgr8', 3, 120), (2, '8UC3', 3, 120), (3, 'rgba8', 4, 120), (4, 'bgra8', 4, 120), (5, 'mono8', 1, 120), (6, '8UC1', 1, 120), (7, 'mono16', 1, 376), (8, '16UC1', 1, 376), (9, '32FC1', 1, 1)) v(i, encoding, channels, pixel)
on i = p_partkey % 10""",
    "raw_image_check": "select p_partkey, ((p_size % 5 + 1) * (p_size % 3 + 1) * 3)::bigint as n_bytes, 3::bigint as channels, 'uint8' as dtype from part",
    "pixel_sums": "select p_partkey, ((p_size % 5 + 1) * (p_size % 3 + 1) * 3 * ascii('x'))::bigint as total from part",
    "convert_union": f"""
select event_type as topic, 'FloatArray' as schema_name, event_id as log_time, props as payload from events
union all select 'cam' || stream, 'foxglove.CompressedImage', idx, vec_id::varchar from ({_FRAMES}) where stream <> 3""",
    "configured_streams": f"""
select stream, idx, ((stream % 4 + 1) * (stream % 3 + 1) * 3)::bigint as n_bytes, chr((97 + vec_id % 26)::int) as pixel, case when stream % 2 = 1 then 'ppm' else 'pixels' end as kind,
(stream % 4 + 1)::int as width, (stream % 3 + 1)::int as height, count(*) over (partition by stream) as n_frames from ({_FRAMES})""",
    "video_zip": f"select stream::varchar as episode_id, idx, vec_id::varchar as frame, idx * 10 + 10 as stamp from ({_FRAMES})",
    "attachment_media": "select 'color/' || label as name, count(*) as n from embeddings where label % 2 = 0 group by 1",
    "container_roundtrip": f"select user_id::varchar as episode_id, event_type as topic, {_NS} as log_time, event_id as sequence, value from events where event_type in ('click', 'view')",
    "container_counts": "select user_id::varchar as episode_id, event_type as topic, count(*) as n from events group by 1, 2",
    "attachment_scan": "select s_nationkey::varchar as episode_id, s_name as name, 'text/plain' as media_type, s_suppkey + 1 as create_time, s_suppkey as log_time, s_acctbal as balance from supplier",
    "metadata_scan": "select c_nationkey::varchar as episode_id, c_name as name, c_mktsegment as segment, c_custkey as key from customer",
    "schema_ids": "select user_id::varchar as episode_id, 'log.' || event_type as schema_name, row_number() over (partition by user_id order by event_type) as schema_id from (select distinct user_id, event_type from events)",
    "schema_scan": "select distinct user_id::varchar as episode_id, event_type as topic, 'log.' || event_type as schema_name from events",
    "compressed_image_bytes": f"select event_id, 'jpeg' as format, {_NS} // 1000000000 as sec, {_NS} % 1000000000 as nsec, event_type as data from events",
    "raw_image_bytes": """
select p_partkey, (p_size % 5 + 1)::bigint as width, (p_size % 3 + 1)::bigint as height, (p_size % 2 * 2 + 1)::bigint as channels, 'uint8' as dtype,
  case when p_size % 2 = 0 then '8UC1' else '8UC3' end as encoding, ((p_size % 5 + 1) * (p_size % 3 + 1) * (p_size % 2 * 2 + 1))::bigint as n_bytes from part""",
    "episode_dataset": f"select pos, sample_idx, c_custkey, round(c_acctbal::float::double, 1) as balance from ({_CUSTOMERS})",
    "dataset_shard": f"select (pos - 1) // 2 - 3 as pos, c_custkey from ({_CUSTOMERS}) where pos % 2 = 1 and (pos - 1) // 2 >= 3",
    "dataset_lengths": f"select count(*) as n_samples, count(distinct c_nationkey) as n_episodes, min_by(c_custkey, pos) as first_key, max_by(c_custkey, pos) as last_key from ({_CUSTOMERS})",
    "slices_config": f"""
with f as (select root, file, row_number() over (partition by root order by file) - 1 as i, count(*) over (partition by root) as n from ({_FILES})),
c(name, root, pos, i) as (values ('list', null, 0, 2), ('list', null, 1, 3), ('list', null, 2, 0), ('dict', 'ASIA', 0, 0), ('dict', 'ASIA', 1, 1), ('dict', 'EUROPE', 0, 0), ('dict', 'EUROPE', 1, 3))
select name, f.root, pos::bigint as pos, file from c join f on f.i = c.i and (c.root is null or c.root = f.root)
union all select name, root, i, file from f, (values ('none'), ('number')) v(name)
union all select 'dict', root, i, file from f where root not in ('ASIA', 'EUROPE')""",
    "wall_clock": "select 1::bigint as n_values, true as later",
    "stream_assembly": _assemble(["click", "view"]),
    "stream_monotonic": f"""
with recursive s as ({_STAMPS}),
r as (select user_id, idx, rn, stamp as fixed from s where rn = 1
  union all select s.user_id, s.idx, s.rn, case when s.stamp > r.fixed then s.stamp else r.fixed + 1000 end from r join s on s.user_id = r.user_id and s.rn = r.rn + 1)
select user_id, idx, fixed from r""",
    "stream_latest": "select event_type, event_id, value from events qualify row_number() over (partition by event_type order by event_id desc) <= 200",
    "unflattened_dataset": """
with f as (select c_nationkey, count(*) as n, row_number() over (order by c_nationkey) - 1 as i from customer group by 1)
select lpad(c_nationkey::varchar, 3, '0') || '.mcap' as file, (i - 1) // 2 as pos, n, (select count(*) from f where i % 2 = 1) as n_episodes from f where i % 2 = 1""",
    "channel_ids": "select user_id as episode_id, event_type as topic, row_number() over (partition by user_id order by min(ts), event_type) as channel_id from events group by 1, 2",
    "field_range": """
select event_type, case when event_type = 'error' then 0.0::double else round(min(value) - s * 0.1, 6) end as low, case when event_type = 'error' then 5.0::double else round(max(value) + s * 0.1, 6) end as high
from (select event_type, value, (case when max(value) over w = min(value) over w then 1.0::double else max(value) over w - min(value) over w end) as s from events window w as (partition by event_type))
group by event_type, s""",
    "sliding_last_n": "select event_type, event_id, value from events qualify row_number() over (partition by event_type order by event_id desc) <= 200",
    "sliding_count": "select event_id, round(avg(round(value * 100)::bigint) over w, 6) as mean, count(*) over w as held from events window w as (partition by user_id order by event_id rows 9 preceding)",
    "series_shape": "select r_name, 'Field_' || (r_regionkey + 1) as field, 100::bigint as steps, 500::bigint as points from region",
}
ORACLES["monotonic_long"] = ORACLES["monotonic_ms"]

_SHUFFLED = """
with recursive e as (select user_id, list(event_id order by event_id) as ids, count(*) as n from events group by 1),
r as (
  select user_id, 0::bigint as step, 0::bigint as read, []::bigint[] as held, null::bigint as event_id, ids, n from e
  union all
  select user_id, step + 1, filled, list_filter(now, lambda x, i: i <> chosen + 1), now[chosen + 1], ids, n from (
    select *, ('0x' || substr(md5('42:' || user_id || ':' || step), 1, 8))::bigint % len(now) as chosen from (
      select *, held || ids[read + 1:filled] as now from (select *, least(n, step + 16) as filled from r where step < n))))
select user_id, event_id, step - 1 as out_pos from r where step > 0"""
ORACLES["counted_shuffle"] = ORACLES["stream_shuffle"] = _SHUFFLED
