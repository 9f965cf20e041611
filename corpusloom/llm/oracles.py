"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOWER_TEXT = LOWER.format("coalesce(text, '')")

#: CRC-32 by its polynomial: eight steps for each of the 256 bytes, then a fold over the text's bytes.
CRC_TABLE = """
crc_table as (
  select list(v order by b) as steps from (
    select b, list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8],
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from (select cast(unnest(range(256)) as bigint) as b))
)
"""

SHARDS_SQL = f"""
with {CRC_TABLE},
coded as (
  select doc_id, strlen(coalesce(text, '')) + 1 as size,
    [cast('0x' || h as bigint) for h in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] as bytes
  from documents
),
sized as (
  select doc_id, size,
    xor(list_reduce(list_prepend(cast(4294967295 as bigint), bytes),
      lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as text_crc32
  from coded, crc_table
),
placed as (
  select doc_id, size, text_crc32,
    sum(size) over (order by doc_id) as upto, sum(size) over () as total,
    row_number() over (order by doc_id) - 1 as place
  from sized
),
cut as (
  select doc_id, size, text_crc32, place,
    cast(least(15, ((2 * upto - size) * 16) // (2 * total)) as integer) as shard
  from placed
)
select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, shard,
  cast(place - min(place) over (partition by shard) as bigint) as slot, cast(null as integer) as grown_shard
from cut
"""

EXACT_SQL = f"""
with normal as (select doc_id, {LOWER_TEXT} as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from normal
window w as (partition by t)
"""

WARC_SQL = """
with payloads as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
),
firsts as (select *, min(page_id) over (partition by payload_digest) as first_id from payloads)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from firsts
"""

WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(LOWER_TEXT)

DECONTAMINATE_SQL = f"""
with doc_words as (select doc_id, {WORDS} as w from documents),
item_words as (select item_id, {WORDS} as w from benchmark),
windows as (
  select distinct item_id, len(s) as n, s as words
  from (select item_id, unnest([w[i : i + least(13, len(w)) - 1] for i in range(1, greatest(1, len(w) - 12) + 1)]) as s
        from item_words where len(w) > 0)
),
widths as (select distinct n from windows),
places as (
  select doc_id, n, i, w[i : i + n - 1] as words
  from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from doc_words, widths where len(w) >= n)
),
found as (select doc_id, item_id, i, p.n from places p join windows v on p.n = v.n and p.words = v.words),
hits as (
  select doc_id, count(distinct place) as n_hit
  from (select distinct doc_id, unnest(range(i, i + n)) as place from found) group by doc_id
),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found where item_id is not null) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc_words d left join hits h on d.doc_id = h.doc_id left join items i on d.doc_id = i.doc_id
"""



def _cluster_sql(rounds: int = 10, k: int = 8) -> str:
    """k-means with every distance: one pair of tables a round."""
    d2 = "cast(list_sum([(a.v[i] - c.v[i]) * (a.v[i] - c.v[i]) for i in range(1, 65)]) as bigint)"
    floor = "cast((s - ((s % n) + n) % n) // n as bigint)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
assigned{r} as materialized (
  select vec_id, v, best.k as k, best.d as d
  from (select a.vec_id, any_value(a.v) as v, min({{'d': {d2}, 'k': c.k}}) as best
        from kept a, centroids{r} c group by a.vec_id)
)""")
        if r < rounds:
            steps.append(f"""
centroids{r + 1} as materialized (
  select c.k, coalesce(m.v, c.v) as v
  from centroids{r} c left join (
    select k, list({floor} order by i) as v
    from (select k, i, sum(v[i]) as s, count(*) as n from assigned{r}, (select unnest(range(1, 65)) as i) group by k, i)
    group by k) m on c.k = m.k
)""")
    return f"""
with kept as materialized (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
),
centroids0 as materialized (
  select row_number() over (order by sha256('3:' || vec_id)) - 1 as k, v
  from kept qualify row_number() over (order by sha256('3:' || vec_id)) <= {k}
),
{",".join(steps)}
select vec_id, cast(a.k as integer) as cluster, d as distance,
  cast(sum(d) over (partition by a.k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from assigned{rounds} a join centroids{rounds} c on a.k = c.k
"""


#: Every document against every order: the first letter of the order that it fails removes it.
AUDIT_SQL = """
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents
),
failed as (
  select x.doc_id, part,
    case when len(w) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when x.doc_id > min(x.doc_id) over (partition by t) then 'E' else '' end as mask,
    coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from texts x left join (
    select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
    from labels group by doc_id) l on x.doc_id = l.doc_id
),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
steps as (select filter_order, step, filter_order[step] as f, filter_order[1:step - 1] as before from orders, (select unnest(range(1, 6)) as step)),
met as (
  select part, filter_order, step, f, n, c.good, c.toxic, mask, contains(mask, f) as fails,
    len(list_filter(range(1, step), lambda i: contains(mask, filter_order[i]))) > 0 as gone
  from cells c, steps
),
totals as (
  select part, filter_order, step, f,
    sum(case when not gone and not fails then n else 0 end) as kept,
    sum(case when not gone and fails then n else 0 end) as removed,
    sum(case when gone and fails then n else 0 end) as redundant,
    sum(case when mask = f then n else 0 end) as unique_fails,
    sum(case when not gone and fails then good else 0 end) as good_lost,
    sum(case when not gone and fails then toxic else 0 end) as toxic_lost
  from met group by part, filter_order, step, f
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from totals
"""

#: All pairs, and the components of their links by reachability.
NEAR_VECTORS_SQL = """
with recursive usable as materialized (
  select vec_id, [cast(x as double) for x in embedding] as v,
    sqrt(list_sum([cast(x as double) * cast(x as double) for x in embedding])) as norm
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
),
links as materialized (
  select a.vec_id as a, b.vec_id as b
  from usable a join usable b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
),
reached(vec_id, other) as (
  select vec_id, vec_id from embeddings
  union
  select r.vec_id, l.b from reached r join links l on r.other = l.a
),
least as (select vec_id, min(other) as component_id from reached group by vec_id),
degrees as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least m on e.vec_id = m.vec_id left join degrees on e.vec_id = a
"""

ORACLES = {
    "op2_warc_transactions": WARC_SQL,
    "op3_decontaminate": DECONTAMINATE_SQL,
    "op5_byte_shards": SHARDS_SQL,
    "op7_exact_dedup": EXACT_SQL,
    "op11_centroid_clusters": _cluster_sql(),
    "op12_filter_audit": AUDIT_SQL,
    "op13_embedding_near_dedup": NEAR_VECTORS_SQL,
}
