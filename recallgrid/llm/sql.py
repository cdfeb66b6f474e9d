"""DuckDB SQL of the queries that SQL can say, over the same tables."""

from __future__ import annotations

NGRAM_JACCARD_JOIN = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as shingle from w),
n as (select w.doc_id, count(s.shingle) as n from w left join s on s.doc_id = w.doc_id group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
u as (select a, b from l union select b, a from l),
r as (select doc_id as id, doc_id as root from n union select u.b, r.root from r join u on u.a = r.id where r.root < u.b)
select doc_id, n as n_shingles, min(root) as component_id from n join r on r.id = doc_id group by 1, 2"""


def _suffix_dedup(length: int) -> str:
    """Ranks of strings by doubling: a pair of ranks of h bytes, a step apart, ranks a string of h and the step's bytes."""
    sql = """
with t as (select doc_id, lower(hex(encode(coalesce(text, '')))) as x from documents),
u as (select doc_id, regexp_extract_all(x, '..') as bytes from t),
b as materialized (select doc_id, unnest(bytes) as byte, generate_subscripts(bytes, 1) as i from u),
r1 as materialized (select doc_id, i, ('0x' || byte)::int::bigint as r from b)"""
    h = 1
    while h < length:
        step = min(h, length - h)
        sql += f""",
p{h} as materialized (select doc_id, i, r, lead(r, {step}) over (partition by doc_id order by i) as s from r{h}),
r{h + step} as materialized (select doc_id, i, case when r is not null and s is not null then dense_rank() over (order by r, s) end as r from p{h})"""
        h += step
    return sql + f""",
g as (select r from r{length} where r is not null group by 1 having count(*) > 1),
f as (select k.doc_id, k.i, max(case when g.r is not null then 1 else 0 end) over (partition by k.doc_id order by k.i rows between {length - 1} preceding and current row) as gone from r{length} k left join g on g.r = k.r),
e as (select f.*, byte, gone > coalesce(lag(gone) over (partition by f.doc_id order by f.i), 0) as begins from f join b on b.doc_id = f.doc_id and b.i = f.i),
o as (select doc_id, count(*) as n_bytes, count(*) filter (where gone = 1) as n_removed, count(*) filter (where begins) as n_spans, sha256(unhex(coalesce(string_agg(byte, '' order by i) filter (where gone = 0), ''))) as kept_sha256 from e group by 1)
select doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(kept_sha256, sha256('')) as kept_sha256 from t left join o using (doc_id)"""


SUFFIX_DEDUP = _suffix_dedup(200)
