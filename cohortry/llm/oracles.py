"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .queries import SHARD_BYTES, WINDOW

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SHARDING = f"""
with rows as (
    select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint as h
    from documents
), nodes as (
    select len, h >> (48 - len) as prefix, sum(n_bytes) as size
    from rows, range(0, 41) t(len)
    group by all
    having sum(n_bytes) <= {SHARD_BYTES} or min(h) = max(h)
), best as (
    select doc_id, n_bytes, h, min(len) as depth
    from rows join nodes on nodes.prefix = rows.h >> (48 - len)
    group by all
)
select doc_id, left(lpad(bin(h), 48, '0'), depth::int) as shard, depth::int as depth, n_bytes, size::bigint as shard_bytes
from best join nodes on nodes.len = best.depth and nodes.prefix = best.h >> (48 - best.depth)
"""

_FIVE = "('0x' || substr(hexed, 5 * i + 1, 5))::bigint"
WARC = f"""
with hashed as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hexed from pages)
select page_id, strlen(payload)::bigint as payload_bytes,
    array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
        lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_FIVE} >> b) & 31)::int + 1, 1)), '')), '') as payload_digest,
    case when page_id = min(page_id) over (partition by payload) then 'response' else 'revisit' end as record_type,
    nullif(min(page_id) over (partition by payload), page_id) as refers_to
from hashed
"""

MIXING = """
with docs as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as h
    from documents
), sources as (
    select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight,
        row_number() over (order by source nulls last) as place
    from docs group by source
), levels as (
    select *, (sum(source_size) over () - coalesce(sum(source_size) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0) * 3)
        / sum(weight) over (order by source_size / weight, place rows between current row and unbounded following) as level,
        row_number() over (order by source_size / weight, place) as spot
    from sources
), goals as (
    select source, source_size, least(coalesce((select level from levels where level * weight <= source_size * 3 order by spot limit 1) * weight, 0.0), source_size * 3.0::double) as target
    from levels
), counted as (
    select docs.*, source_size, target, sum(size) over (partition by docs.source order by h, doc_id, size rows unbounded preceding) as upto
    from docs join goals on docs.source is not distinct from goals.source
), queued as (
    select *, (epoch * source_size + upto) / target as finish
    from counted, range(0, 3) t(epoch) where size > 0 and target > 0
), taken as (
    select *, sum(size) over (order by finish, source nulls last, epoch, h, doc_id rows unbounded preceding) as within from queued
), copies as (
    select doc_id, sum(size) as words from taken where within <= (select round(sum(target)) from goals) group by doc_id
)
select doc_id, size, source_size, target, coalesce(words, 0)::bigint as taken
from counted left join copies using (doc_id)
"""

NEARDUP = f"""
with recursive words as (
    select doc_id, {_WORDS.format("text")} as w from documents
), grams as (
    select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [array_to_string(w, ' ')] end) as g
    from words where len(w) > 0
), sets as (select distinct doc_id, g from grams), sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (
    select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
    select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c)
), edges as (select a, b from links union all select b, a from links),
reach(doc_id, node) as (
    select doc_id, doc_id from documents
    union
    select reach.doc_id, edges.b from reach join edges on reach.node = edges.a
), found as (select doc_id, min(node) as class_id from reach group by doc_id)
select doc_id, class_id, count(*) over (partition by class_id) as class_size from found
"""

# a shingle that occurs three times counts as three: g#1, g#2, g#3
NEARDUP_WEIGHTED = NEARDUP.replace("sets as (select distinct doc_id, g from grams)", "sets as (select doc_id, g || '#' || row_number() over (partition by doc_id, g) as g from grams)")

LINEDEDUP = """
with lines as (
    select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from documents
), shared as (
    select trim(line, ' ') as line from lines where trim(line, ' ') <> '' group by 1 having count(distinct source) >= 5
), kept as (
    select doc_id, count(*) as n_lines, count(shared.line) as n_removed,
        coalesce(string_agg(lines.line, chr(10) order by place) filter (shared.line is null), '') as text
    from lines left join shared on trim(lines.line, ' ') = shared.line group by doc_id
)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(kept.text) as text_sha256
from documents left join kept using (doc_id)
"""

DECONTAMINATE = f"""
with items as (select item_id::varchar as item, {_WORDS.format("text")} as w from benchmark),
windows as (
    select distinct item, least(len(w), {WINDOW}) as size, unnest(list_transform(range(1, greatest(len(w) - {WINDOW}, 0) + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) as g
    from items where len(w) > 0
), docs as (select doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
spots as (
    select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as g
    from docs, (select distinct size from windows), unnest(range(1, greatest(len(w) - size + 2, 1))) t(i)
), hits as (select doc_id, spots.size, i, item from spots join windows on spots.g = windows.g and spots.size = windows.size),
places as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
found as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as ids from hits group by doc_id)
select docs.doc_id, len(w)::bigint as n_words, coalesce(places.n, 0) as n_hit, coalesce(found.n, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(places.n, 0) > 0 as contaminated
from docs left join places using (doc_id) left join found using (doc_id)
"""

TOPK = """
with vectors as (
    select distinct vec_id, list_transform(embedding, lambda x: floor(x::double * 64)::bigint) as v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
    from vectors q join vectors c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), ranked as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from pairs)
select * from ranked where rank <= 20
"""

_CRC_STEPS = "list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n))"
RESAMPLING = f"""
with steps as (select {_CRC_STEPS} as step),
texts as (
    select 'd' as side, row_number() over () as row, doc_id, coalesce({_WORDS.format("text")}, []) as w from documents
    union all select 't', row_number() over (), null, coalesce({_WORDS.format("text")}, []) from benchmark
), grams as (
    select side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from texts where len(w) > 0
), crcs as (
    select g, xor(4294967295, list_reduce(list_transform(range(0, strlen(g)), lambda i: ('0x' || substr(hex(g), 2 * i + 1, 2))::bigint),
        lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 10000 as bucket
    from (select distinct g from grams), steps
), placed as (select side, row, bucket from grams join crcs using (g)),
counts as (
    select b.bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from range(0, 10000) b(bucket) left join placed using (bucket) group by 1
), gains as (
    select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from counts) + 10000) / ((s + 1)::double * ((select sum(t) from counts) + 10000))))::bigint as gain from counts
), means as (
    select row, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from placed join gains using (bucket) where side = 'd' group by 1
), scored as (
    select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
        coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from texts left join means using (row) where side = 'd'
), ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place from scored)
select doc_id, n_features, weight, score,
    case when n_words >= 20 and place <= (select count(*) from scored where n_words >= 20) * 25 // 100 then place end as rank
from ranked
"""


def _clustering(clusters: int, rounds: int) -> str:
    """One assignment and one set of centroids after the other."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint"
    mean = "(s - ((s % n) + n) % n) // n"
    steps = ["""
with kept as materialized (
    select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""", f"""c0 as materialized (
    select (row_number() over (order by h) - 1)::int as cluster, v as c from (select *, sha256('2:' || vec_id) as h from kept order by h limit {clusters})
)"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
    select row, first(vec_id) as vec_id, first(v) as v, min_by(cluster, square::hugeint * 1000 + cluster) as cluster, min(square) as distance
    from (select row, vec_id, v, {square} as square, cluster from kept, c{i}) group by row
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} as materialized (
    select cluster, coalesce(m, c) as c from c{i} left join (
        select cluster, list({mean} order by place)::bigint[] as m
        from (select cluster, place, sum(x)::hugeint as s, count(*)::hugeint as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as place from a{i}) group by 1, 2)
        group by 1
    ) using (cluster)
)""")
    return ",\n".join(steps) + f"""
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
    sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)
"""


CLUSTERING = _clustering(40, 5)

ORACLES = {
    "op1_sharding": SHARDING,
    "op2_warc": WARC,
    "op3_mixing": MIXING,
    "op4_neardup": NEARDUP,
    "neardup_weighted": NEARDUP_WEIGHTED,
    "op5_linededup": LINEDEDUP,
    "op8_topk": TOPK,
    "op6_decontaminate": DECONTAMINATE,
    "op12_resampling": RESAMPLING,
    "op13_clustering": CLUSTERING,
}
