"""The registered queries over the star schema, each with the same as SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid import tables as T
from recallgrid.functions import scores, text, vectors
from recallgrid.operators import graph, lifecycle, metrics, retrieval, sequences
from recallgrid.plans import router
from recallgrid.shared import shared_folder, written
from recallgrid.sources import store
from recallgrid.streaming import learn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- vectors -------------------------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity({a}::double[], {b}::double[]), 6)"


def _query_vector(spark: SparkSession, d: str, at: int = 0) -> list[float]:
    return T.vectors(spark, d).where(F.col("memory_id") == at).first()["embedding"]


@query(f"""
select memory_id, similarity, round((similarity + 1) / 2, 6) as confidence, row_number() over (order by similarity desc, memory_id) as rank
from (select e.vec_id as memory_id, {_COS.format(a="e.embedding", b="q.embedding")} as similarity from embeddings e, embeddings q where q.vec_id = 0)
order by similarity desc, memory_id limit 10""")
def similarity_topk(spark, d):
    """Nearest vectors to one query vector."""
    return retrieval.similarity_topk(T.vectors(spark, d), _query_vector(spark, d), 10)


@query(f"""
select query_id, memory_id, similarity, round((similarity + 1) / 2, 6) as confidence, rank from (
select *, row_number() over (partition by query_id order by similarity desc, memory_id) as rank from (
select q.vec_id as query_id, e.vec_id as memory_id, {_COS.format(a="e.embedding", b="q.embedding")} as similarity
from embeddings e, embeddings q where q.vec_id % 50 = 0)) where rank <= 5""")
def similarity_batch(spark, d):
    """Nearest vectors to every query vector: ids divisible by 50 against all rows."""
    v = T.vectors(spark, d)
    q = v.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "embedding")
    return retrieval.similarity_batch(v, q, 5)


@query(f"""
select query_id, max(similarity > 0.7) as confident, round(avg(confidence), 6) as avg_confidence from (
select query_id, similarity, round((similarity + 1) / 2, 6) as confidence, row_number() over (partition by query_id order by similarity desc, memory_id) as rank from (
select q.vec_id as query_id, e.vec_id as memory_id, {_COS.format(a="e.embedding", b="q.embedding")} as similarity
from embeddings e, embeddings q where q.vec_id % 50 = 0)) where rank <= 5 group by 1""")
def confident_matches(spark, d):
    """Whether a query has a match above 0.7, and its mean confidence."""
    return retrieval.has_confident_match(similarity_batch(spark, d))


@query("select vec_id as memory_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as l2_norm from embeddings")
def vector_norms(spark, d):
    return T.vectors(spark, d).select("memory_id", F.round(vectors.norm(F.col("embedding")), 6).alias("l2_norm"))


@query("""
select vec_id as memory_id, list_sum(list_transform(embedding, lambda x: floor((x::double - list_min(embedding)::double) * 255.0::double / (list_max(embedding)::double - list_min(embedding)::double))))::bigint as code_sum
from embeddings""")
def quantised_codes(spark, d):
    """8-bit codes over each vector's range, summed."""
    codes = vectors.quantise(F.col("embedding"), 8)
    return T.vectors(spark, d).select("memory_id", F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@query("""
with s as (select vec_id, unnest(generate_series(1, len(embedding))) as i, embedding as e from embeddings),
x as (select vec_id, i, e[i] >= 0 as v, lag(e[i] >= 0) over (partition by vec_id order by i) as b from s)
select vec_id as memory_id, count(*) filter (where b is null or b <> v) as runs from x group by 1""")
def sign_runs(spark, d):
    """Run-length encoding of each vector's signs: the number of runs."""
    signs = F.transform("embedding", lambda x: F.when(x >= 0, 1.0).otherwise(0.0))
    return T.vectors(spark, d).select("memory_id", F.size(vectors.run_lengths(signs)).cast("long").alias("runs"))


@query("""
with p as (select a.vec_id as p_id, b.vec_id as q_id, list_transform(generate_series(1, len(a.embedding)), lambda i: a.embedding[i]::double * b.embedding[i]::double) as v
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select p_id, q_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as first_value, len(v)::bigint as dims from p""")
def pattern_compose(spark, d):
    """Neighbouring patterns composed elementwise and normalised."""
    p = T.vectors(spark, d).select(F.col("memory_id").alias("id"), "embedding")
    pairs = p.select(F.col("id").alias("p_id"), (F.col("id") + 1).alias("q_id"))
    out = retrieval.pattern_compose(p, pairs)
    return out.select("p_id", "q_id", F.round(F.col("embedding")[0], 6).alias("first_value"), F.size("embedding").cast("long").alias("dims"))


@query(f"""
select e.vec_id as id, {_COS.format(a="e.embedding", b="q.embedding")} as similarity from embeddings e, embeddings q
where q.vec_id = 3 and {_COS.format(a="e.embedding", b="q.embedding")} >= 0.1 order by 2 desc, 1 limit 20""")
def pattern_search(spark, d):
    """Patterns by raw cosine of at least 0.1."""
    p = T.vectors(spark, d).select(F.col("memory_id").alias("id"), "embedding")
    return retrieval.pattern_search(p, _query_vector(spark, d, 3), 20, 0.1)


@query("select vec_id as id, label as activation_count from embeddings where label >= 5 order by 2 desc, 1 limit 100")
def pattern_list(spark, d):
    p = T.vectors(spark, d).select(F.col("memory_id").alias("id"), F.col("label").alias("activation_count"))
    return retrieval.pattern_list(p, 5, 100)


@query("select event_id, contains(event_type, 'up') and contains(user_id::varchar, '1') as holds from events")
def constraint_match(spark, d):
    """Constraints that a context must contain."""
    e = T.read(spark, d, "events")
    context = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("expression")) for n, x in (("type", "up"), ("user", "1"))])
    return e.select("event_id", scores.constraints_hold(rules, context).alias("holds"))


# --- exact and text ------------------------------------------------------------------------------------------------


@query("""
with entries as (select p_name as key, min(p_partkey) as value from part group by 1),
probes as (select distinct p_name as key from part union select 'absent ' || n_name from nation)
select key, value, value is not null as found, (value is not null)::int::double as confidence, case when value is null then 2 end as next_layer
from probes left join entries using (key)""")
def exact_lookup(spark, d):
    """Hits and misses of keys."""
    part = T.read(spark, d, "part")
    probes = part.select(F.col("p_name").alias("key")).union(T.read(spark, d, "nation").select(F.concat(F.lit("absent "), "n_name"))).distinct()
    return retrieval.exact_lookup(part.select(F.col("p_name").alias("key"), F.col("p_partkey").alias("value")), probes)


@query("""
with probes as (select distinct p_name as key from part union select 'absent ' || n_name from nation)
select count(*) as probes, count(*) filter (where key in (select p_name from part)) as hits, round(count(*) filter (where key in (select p_name from part)) / count(*)::double, 6) as hit_rate from probes""")
def hit_rate(spark, d):
    return metrics.hit_rate(exact_lookup(spark, d))


@query("""
select id, round((contains(c, 'the')::int + contains(c, 'tion')::int + contains(c, 'zuxyq')::int) / 3.0::double, 6) as score
from (select doc_id + 1 as id, lower(text) as c from documents) where contains(c, 'the') or contains(c, 'tion') or contains(c, 'zuxyq') order by 2 desc, 1 limit 50""")
def text_search(spark, d):
    """Share of the query's words that a text contains."""
    return retrieval.text_search(T.memories(spark, d), "the TION zuxyq", 50)


@query("""
select doc_id + 1 as id from documents where contains(lower(text), 'the and') order by n_chars desc, doc_id limit 100""")
def newest_containing(spark, d):
    """Whole-query containment, latest first; the length stands for the time."""
    m = T.read(spark, d, "documents").select((F.col("doc_id") + 1).alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("created_at"))
    return retrieval.newest_containing(m, "The And", 100).select("id")


@query(r"""
with m as (select doc_id, [lang, source] as tags, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as w from documents where doc_id < 2000),
p as (select a.doc_id as a, b.doc_id as b, len(list_intersect(a.tags, b.tags)) as ct, len(list_distinct(list_concat(a.tags, b.tags))) as ut, len(list_intersect(a.w, b.w)) as cw, len(list_distinct(list_concat(a.w, b.w))) as uw
from m a join m b on b.doc_id = a.doc_id + 1)
select 'assoc_' || a || '_' || b as id, round(case when ut > 0 then ct / ut::double else 0 end, 6) as tag_similarity, round(case when uw > 0 then cw / uw::double else 0 end, 6) as text_similarity,
case when ct / ut::double > 0.5 then 'semantic' when uw > 0 and cw / uw::double > 0.3 then 'conceptual' when 30 < 60 and a % 7 = 0 then 'temporal' else 'domain' end as type from p""".replace("where doc_id < 2000", ""))
def suggested_associations(spark, d):
    """Tag and word overlap of documents with neighbouring ids, and the association type that they suggest."""
    m = T.memories(spark, d).select("id", "tags", text.words(F.col("content")).alias("w"))
    b = m.select((F.col("id") - 1).alias("id"), F.col("tags").alias("tags2"), F.col("w").alias("w2"))
    p = m.join(b, "id").withColumn("t", text.jaccard(F.col("tags"), F.col("tags2"))).withColumn("x", text.jaccard(F.col("w"), F.col("w2")))
    apart = F.when((F.col("id") - 1) % 7 == 0, 30).otherwise(90)
    return p.select(text.association_id(F.col("id") - 1, F.col("id")).alias("id"), F.round("t", 6).alias("tag_similarity"), F.round("x", 6).alias("text_similarity"), text.association_type(F.col("t"), F.col("x"), apart).alias("type"))


@query("""
with m as (select doc_id + 1 as id, list_distinct([lang, source]) as tags from documents)
select 'assoc_' || a.id || '_' || b.id as id, a.id as from_id, b.id as to_id, 'semantic' as type,
round(len(list_intersect(a.tags, b.tags)) / (len(a.tags) + len(b.tags) - len(list_intersect(a.tags, b.tags)))::double, 6) as weight,
'Common tags: ' || len(list_intersect(a.tags, b.tags)) as reason
from m a join m b on a.id <> b.id and len(list_intersect(a.tags, b.tags)) > 0 where a.id % 50 = 0
and round(len(list_intersect(a.tags, b.tags)) / (len(a.tags) + len(b.tags) - len(list_intersect(a.tags, b.tags)))::double, 6) >= 0.5""")
def discovered_associations(spark, d):
    """Associations by shared tags from new memories (ids divisible by 50) to all others."""
    m = T.memories(spark, d).select("id", "tags")
    return retrieval.discover(m.where("id % 50 = 0"), m, 0.5)


@query()
def hashed_terms(spark, d):
    """Hashed term-frequency vectors in long form; the hash is this engine's own."""
    return text.hashed_terms(T.memories(spark, d), "id", "content", 256)


@query()
def text_similarity(spark, d):
    """Texts that are nearest to the text of each turn of the conversations whose id is divisible by 50, by hash embedding.

    Ids hold the conversation above 32 bits and the turn below.
    """
    c = T.read(spark, d, "conversations")
    m = c.select("conv_id", (F.shiftleft(F.col("conv_id").cast("long"), 32) + F.col("turn")).alias("memory_id"), F.col("text").alias("content"))
    q = m.where("conv_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "content")
    return retrieval.text_similarity(m, q, 5)


# --- sequences -----------------------------------------------------------------------------------------------------

_ACC = """a as (select user_id as pool, row_number() over (partition by user_id order by ts, event_id) as seq,
case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 when 'view' then 5 end as memory_id, epoch_us(ts) as ts_us from events where user_id is not null)"""
_TRANS = _ACC + """, s as (select pool, seq, lag(memory_id) over w as from_id, memory_id as to_id, greatest(ts_us - lag(ts_us) over w, 0) as dt from a window w as (partition by pool order by seq)),
t as (select pool, from_id, to_id, count(*) as n from s where from_id is not null group by all),
tr as (select pool, from_id, to_id, n, n / sum(n) over (partition by pool, from_id)::double as probability from t)"""


@query(f"with {_TRANS} select pool, from_id, to_id, n as count, round(probability, 6) as probability from tr")
def transitions(spark, d):
    """Transition counts and row probabilities."""
    return sequences.transitions(T.accesses(spark, d)).select("pool", "from_id", "to_id", "count", F.round("probability", 6).alias("probability"))


@query(f"""with recursive {_TRANS}, r as (select pool, from_id, to_id, dt, row_number() over (partition by pool, from_id, to_id order by seq) as k from s where from_id is not null),
f as (select pool, from_id, to_id, k, dt // 2 as v from r where k = 1 union all select r.pool, r.from_id, r.to_id, r.k, (f.v + r.dt) // 2 from f join r on r.pool = f.pool and r.from_id = f.from_id and r.to_id = f.to_id and r.k = f.k + 1)
select pool, from_id, to_id, max_by(v, k) as average_interval from f group by all""")
def transition_intervals(spark, d):
    """The halving average of each transition's intervals, in order."""
    return sequences.transitions(T.accesses(spark, d)).select("pool", "from_id", "to_id", "average_interval")


_GRAMS = _ACC + """, g as (select pool, seq, 2 as n, [lag(memory_id) over w, memory_id] as ngram from a window w as (partition by pool order by seq)
union all select pool, seq, 3, [lag(memory_id, 2) over w, lag(memory_id) over w, memory_id] from a window w as (partition by pool order by seq)
union all select pool, seq, 4, [lag(memory_id, 3) over w, lag(memory_id, 2) over w, lag(memory_id) over w, memory_id] from a window w as (partition by pool order by seq)
union all select pool, seq, 5, [lag(memory_id, 4) over w, lag(memory_id, 3) over w, lag(memory_id, 2) over w, lag(memory_id) over w, memory_id] from a window w as (partition by pool order by seq)),
gc as (select pool, n, ngram, count(*) as c, min(seq) as first_seq from g where seq >= n group by all),
gr as (select *, c / sum(c) over (partition by pool, n)::double as confidence from gc)"""


@query(f"with {_GRAMS} select pool, n, array_to_string(ngram, '-') as ngram, c as count, first_seq, round(confidence, 6) as confidence from gr")
def ngrams(spark, d):
    """Counts and joint shares of n-grams, n from 2 to 5."""
    return sequences.ngrams(T.accesses(spark, d)).select("pool", "n", F.array_join(F.col("ngram").cast("array<string>"), "-").alias("ngram"), "count", "first_seq", F.round("confidence", 6).alias("confidence"))


@query(f"with {_GRAMS} select pool, n, array_to_string(ngram, '-') as ngram from (select *, row_number() over (partition by pool, n order by first_seq) as r from gr) where r <= 20")
def admitted_ngrams(spark, d):
    """The first 20 n-grams of each order that a pool meets."""
    g = sequences.admitted(sequences.ngrams(T.accesses(spark, d)), 20)
    return g.select("pool", "n", F.array_join(F.col("ngram").cast("array<string>"), "-").alias("ngram"))


@query(f"""with {_ACC}, z as (select pool, list(memory_id order by seq) as ids, list(ts_us order by seq) as ts, count(*) as t from a group by 1),
p as (select pool, ids, ts, t, unnest(generate_series(0, t - 1)) as p from z), l as (select *, unnest([3, 4, 5]) as l from p),
h as (select pool, p, l, ids[p + 1 : p + l] as sequence, greatest(least(p + 49, t - 1) - (p + 2 * l - 1) + 1, 0) as share, (ts[p + l] - ts[p + 1]) // (l - 1) as mean
from l where p + 2 * l <= t and ids[p + 1 : p + l] = ids[p + l + 1 : p + 2 * l])
select pool, array_to_string(sequence, '-') as sequence, l as length, sum(share)::bigint as occurrences, round(sum(share) / (sum(share) + 1)::double, 6) as confidence, min_by(mean, p)::bigint as average_interval_us
from h where share > 0 group by pool, sequence, l""")
def repeats(spark, d):
    """Adjacent repeats and how often a look back over 50 accesses meets them."""
    r = sequences.repeats(T.accesses(spark, d))
    return r.select("pool", F.array_join(F.col("sequence").cast("array<string>"), "-").alias("sequence"), "length", "occurrences", F.round("confidence", 6).alias("confidence"), "average_interval_us")


@query(f"""with {_GRAMS}, last as (select pool, list(memory_id order by seq) as recent from (select *, row_number() over (partition by pool order by seq desc) as k from a) where k <= 10 group by 1)
select gr.pool, ngram[-1] as memory_id, n, round(confidence, 6) as confidence from gr join last on gr.pool = last.pool
where len(recent) >= n - 1 and ngram[1 : n - 1] = recent[len(recent) - n + 2 : len(recent)] and confidence >= 0.05""")
def ngram_predictions(spark, d):
    """What follows the end of each pool's recent accesses in its n-grams."""
    a = T.accesses(spark, d)
    p = sequences.predict_ngram(sequences.ngrams(a), sequences.recent(a), 0.05)
    return p.select("pool", "memory_id", (10 - F.col("turn")).alias("n"), F.round("confidence", 6).alias("confidence"))


@query(f"""with {_TRANS}, last as (select pool, max_by(memory_id, seq) as from_id from a group by 1)
select pool, to_id as memory_id, round(probability, 6) as confidence from tr join last using (pool, from_id) where probability >= 0.1""")
def markov_predictions(spark, d):
    a = T.accesses(spark, d)
    return sequences.predict_markov(sequences.transitions(a), sequences.recent(a)).select("pool", "memory_id", F.round("confidence", 6).alias("confidence"))


@query()
def predictions(spark, d):
    """All four predictors merged: an ordered fold."""
    a = T.accesses(spark, d)
    out = sequences.predict(sequences.fit(a), sequences.recent(a))
    return out.withColumn("contributing_evidence", F.array_join("contributing_evidence", ","))


@query(f"""with {_ACC}, p as (select a.pool, a.memory_id as a, b.memory_id as b from a join a b on a.pool = b.pool and b.seq between a.seq + 1 and a.seq + 10 where a.memory_id <> b.memory_id)
select pool, a, b, count(*) as n from p group by all""")
def co_access(spark, d):
    """How often one memory follows another within ten accesses."""
    return sequences.co_access(T.accesses(spark, d))


@query(f"""with {_ACC}, x as (select pool, min(ts_us) as lo, max(ts_us) as hi, count(*) as n from a group by 1)
select pool, n, (hi - lo) as duration_us, round(count(*) filter (where memory_id = 5) / n::double, 6) as view_share from a join x using (pool) group by pool, n, hi, lo""")
def context_features(spark, d):
    """Duration and the share of views in each pool's log."""
    return sequences.context_features(T.accesses(spark, d), 5)


# --- graph ---------------------------------------------------------------------------------------------------------

_EDGE = """e as (select from_id, to_id, n, n / (n + 1)::double as weight from (select from_id, to_id, count(*) as n from (
select lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as from_id, l_partkey as to_id from lineitem) where from_id is not null and from_id <> to_id group by 1, 2))"""
_STRONG = _EDGE + ", s as (select * from e where weight >= 0.5)"


def _strong(spark, d) -> DataFrame:
    """Written once: a search joins them at every level."""
    return written(graph.usable_edges(T.associations(spark, d), least=0.5))


def _starts(spark, *ids: int) -> DataFrame:
    return spark.createDataFrame([(0, i) for i in ids], "query_id long, start_id long")


@query(f"with {_EDGE} select from_id, to_id, round(weight, 6) as weight from e where from_id in (1, 2, 3)")
def neighbours(spark, d):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    return graph.neighbours(T.associations(spark, d), ids).select("from_id", "to_id", F.round("weight", 6).alias("weight"))


@query(f"with {_EDGE} select id, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select from_id as id, 1 as o, 0 as i from e union all select to_id, 0, 1 from e) group by 1")
def degrees(spark, d):
    return graph.degrees(T.associations(spark, d))


@query(f"""with {_EDGE}, d as (select id, count(*) as k from (select from_id as id from e union all select to_id from e) group by 1), n as (select count(*) as nodes from part)
select nodes, (select count(*) from e) as edges, round(2 * (select count(*) from e) / nodes::double, 6) as avg_degree, (select max(k) from d) as max_degree, round((select count(*) from e) / (nodes * (nodes - 1))::double, 9) as density from n""")
def graph_stats(spark, d):
    return graph.stats(T.read(spark, d, "part").select(F.col("p_partkey").alias("id")), T.associations(spark, d))


@query(f"""with {_STRONG}, x as (select [7::bigint, a.to_id] as p, a.weight as w, 1 as depth from s a where a.from_id = 7 and a.to_id <> 7
union all select [7::bigint, a.to_id, b.to_id], a.weight * b.weight, 2 from s a join s b on a.to_id = b.from_id where a.from_id = 7 and a.to_id <> 7 and b.to_id <> 7 and b.to_id <> a.to_id
union all select [7::bigint, a.to_id, b.to_id, c.to_id], a.weight * b.weight * c.weight, 3 from s a join s b on a.to_id = b.from_id join s c on b.to_id = c.from_id
where a.from_id = 7 and a.to_id <> 7 and b.to_id not in (7, a.to_id) and c.to_id not in (7, a.to_id, b.to_id))
select array_to_string(p, '-') as path, round(w, 6) as weight, depth from x""")
def simple_paths(spark, d):
    """All simple paths of up to three strong edges from one node."""
    out = graph.simple_paths(_strong(spark, d), _starts(spark, 7), 3)
    return out.select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), F.round("weight", 6).alias("weight"), "depth")


@query(f"""with {_STRONG}, l1 as (select to_id as node, weight, row_number() over (order by to_id) as turn from s where from_id = 7 and to_id <> 7),
c2 as (select s.to_id as node, l1.weight * s.weight as weight, l1.turn, row_number() over (partition by s.to_id order by l1.turn) as r from l1 join s on l1.node = s.from_id where s.to_id <> 7 and s.to_id not in (select node from l1)),
l2 as (select node, weight, row_number() over (order by turn, node) as turn from c2 where r = 1),
f as (select node, weight, depth, row_number() over (order by depth, turn) as found from (select node, weight, turn, 1 as depth from l1 union all select node, weight, turn, 2 from l2))
select node, round(weight, 6) as weight, depth, found, row_number() over (order by round(weight, 6) desc, node) as rank from f where found <= 40""")
def breadth_first(spark, d):
    """The first 40 nodes that are found breadth-first, ranked by weight."""
    out = graph.breadth_first(_strong(spark, d), _starts(spark, 7), 2, 40, cut=written)
    return out.select("node", F.round("weight", 6).alias("weight"), "depth", "found", "rank")


def _queue(start: int, depth: int, rounds: int, value: str, begin: int, name: str, order: str) -> str:
    """Labels (value, depth) of a best-first search, derived anew in each round from those before; as many rounds as suffice for the tables."""
    sql = f", l0 as (select {start}::bigint as node, {begin}::double as v, 0 as depth)"
    for k in range(1, rounds + 1):
        sql += f""", c{k} as materialized (select s.to_id as node, round({value}, 12) as v, l.depth + 1 as depth from l{k - 1} l join s on s.from_id = l.node where l.depth < {depth} and s.to_id <> {start}),
l{k} as materialized (select * from l0 union all select node, v, depth from (select *, row_number() over (partition by node order by v {order}, depth) as r from c{k}) where r = 1)"""
    return f"with {_STRONG}{sql} select node, round(v, 6) as {name}, depth, row_number() over (order by round(v, 6) {order}, node) as rank from l{rounds} where node <> {start} order by 2 {order}, 1 limit 30"


@query(_queue(7, 3, 8, "l.v * s.weight", 1, "weight", "desc"))
def best_first(spark, d):
    """The 30 nodes that a queue by weight takes first, within three edges."""
    out = graph.best_first(_strong(spark, d), _starts(spark, 7), 3, 30, cut=written)
    return out.select("node", F.col("value").alias("weight"), "depth", "rank")


def _found(start: int, most: int) -> str:
    """The first nodes that a breadth-first search of two levels finds from a start."""
    return f"""(with l1 as (select to_id as node, weight, row_number() over (order by to_id) as turn from s where from_id = {start} and to_id <> {start}),
c2 as (select s.to_id as node, l1.weight * s.weight as weight, l1.turn, row_number() over (partition by s.to_id order by l1.turn) as r from l1 join s on l1.node = s.from_id where s.to_id <> {start} and s.to_id not in (select node from l1)),
f as (select node, weight, 1 as depth, turn from l1 union all select node, weight, 2, row_number() over (order by turn, node) from c2 where r = 1)
select * from (select {start} as start_id, node, round(weight, 6) as weight, depth, row_number() over (order by depth, turn) as found from f) where found <= {most})"""


@query(f"with {_STRONG}, u as ({' union all '.join(_found(n, 30) for n in (7, 8, 9))}) select * from (select start_id, node, weight, depth, row_number() over (order by weight desc, node, start_id) as rank from u) where rank <= 60")
def multi_start_search(spark, d):
    """Per-source breadth-first search from three starts, merged without joining sources."""
    out = graph.search(_strong(spark, d), _starts(spark, 7, 8, 9), 2, 60, 3, cut=written)
    return out.select("start_id", "node", F.round("weight", 6).alias("weight"), "depth", "rank")


@query("""with recursive e as (select s_suppkey as a, 100000 + s_nationkey as b from supplier union all select 100000 + n_nationkey, 200000 + n_regionkey from nation),
n as (select s_suppkey as id from supplier union select 100000 + n_nationkey from nation union select 200000 + r_regionkey from region),
u as (select a, b from e union select b, a from e), r as (select id, id as c from n union select u.b, r.c from r join u on r.id = u.a)
select id, min(c) as component from r group by 1""")
def graph_components(spark, d):
    """Weakly connected components of a forest of suppliers, nations and regions: one for each region."""
    s, n, r = (T.read(spark, d, t) for t in ("supplier", "nation", "region"))
    nation, region = (F.col("n_nationkey") + 100000).cast("long"), (F.col("n_regionkey") + 200000).cast("long")
    edges = s.select(F.col("s_suppkey").alias("from_id"), (F.col("s_nationkey") + 100000).cast("long").alias("to_id")).union(n.select(nation, region))
    nodes = s.select(F.col("s_suppkey").alias("id")).union(n.select(nation)).union(r.select((F.col("r_regionkey") + 200000).cast("long")))
    return graph.components(nodes, edges, written)


@query(f"""with {_EDGE} select from_id, to_id, round(weight, 6) as weight from (select *, row_number() over (partition by from_id order by weight desc, to_id) as r from e) where r <= 5""")
def capped_out_edges(spark, d):
    """The five heaviest out-edges of each node."""
    return graph.cap_out_edges(T.associations(spark, d), 5, F.col("weight")).select("from_id", "to_id", F.round("weight", 6).alias("weight"))


@query(f"with {_EDGE} select from_id, to_id, round(weight * pow(0.99, 10), 6) as weight from e")
def decayed_edges(spark, d):
    """Weights after ten decay ticks."""
    return graph.decay(T.associations(spark, d), 0.01, 10).select("from_id", "to_id", F.round("weight", 6).alias("weight"))


@query(f"with {_STRONG} select p_partkey as id from part where p_partkey in (select from_id from s union select to_id from s)")
def linked_nodes(spark, d):
    """Parts that a strong edge touches; the rest would be orphans."""
    return graph.linked_nodes(T.read(spark, d, "part").select(F.col("p_partkey").alias("id")), _strong(spark, d))


# --- logs and lifecycle --------------------------------------------------------------------------------------------


@query("""with l as (select event_id as seq, case event_type when 'signup' then 'add' when 'view' then 'update' when 'error' then 'remove' when 'purchase' then 'cleanup' end as k, user_id as id, 'c' || (user_id % 10) as con, 'v' || event_id as v from events where event_type <> 'click'),
s as (select id, max_by(k, seq) as k, max(seq) as seq, max_by(con, seq) as con, max_by(v, seq) as v from l where k in ('add', 'remove') group by 1),
c as (select con, max(seq) as cleaned from l where k = 'cleanup' group by 1),
a as (select s.* from s left join c using (con) where s.k = 'add' and (cleaned is null or cleaned < s.seq)),
u as (select a.id, count(*) as updates, max_by(l.v, l.seq) as v from a join l on l.id = a.id and l.k = 'update' and l.seq > a.seq group by 1)
select a.id as memory_id, a.con as connection_id, coalesce(u.v, a.v) as content, a.seq as added, coalesce(updates, 0) as updates from a left join u on a.id = u.id""")
def log_replay(spark, d):
    """Live rows after a log of adds, updates, removals and connection cleanups."""
    return store.replay(T.log(spark, d))


@query("""select user_id as pool, event_id as key from (select *, row_number() over (partition by user_id order by ts desc, event_id) as r from events) where r <= 10""")
def keep_recent(spark, d):
    """The ten most recently used entries of each pool."""
    e = T.read(spark, d, "events").select(F.col("user_id").alias("pool"), F.col("event_id").alias("key"), F.col("ts").alias("last_access"))
    return lifecycle.keep_recent(e, 10).select("pool", "key")


@query("select event_id from events where ts >= (select max(ts) from events) - interval 3600 second")
def within_ttl(spark, d):
    e = T.read(spark, d, "events")
    e = e.select("event_id", "ts").join(F.broadcast(e.agg(F.max("ts").alias("newest"))), F.lit(True))
    return lifecycle.within_ttl(e, F.col("newest"), 3600, "ts").select("event_id")


@query("""with m as (select user_id as id, max(ts) as t, count(*) as n from events group by 1), x as (select *, (select max(epoch(ts)::bigint) from events) - floor(epoch(t))::bigint as age, max(n) over () as most from m)
select id, round(1 / (1 + greatest(age, 0) / 3600.0::double) * ln(1 + n) / ln(1 + greatest(most, 1)), 6) as retention from x""".replace("max(epoch(ts)::bigint)", "max(floor(epoch(ts))::bigint)"))
def retention_scores(spark, d):
    """Recency times frequency of each user's accesses."""
    m = T.read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("t"), F.count("*").alias("n"))
    top = m.agg(F.max("t").alias("now"), F.max("n").alias("most"))
    x = m.join(F.broadcast(top), F.lit(True))
    age = F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("t").cast("timestamp"))
    return x.select("id", F.round(scores.retention(age, F.col("n"), F.col("most"), F.lit(0.0)), 6).alias("retention"))


@query("select vec_id % 4 as pool, sum(4 * len(embedding) + strlen(coalesce(text, '')))::bigint as bytes, count(*) as entries from embeddings left join documents on doc_id = vec_id group by 1")
def memory_estimate(spark, d):
    """Bytes of vectors and contents."""
    v = T.vectors(spark, d).join(T.read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content")), "memory_id", "left")
    return lifecycle.memory_estimate(v.withColumn("pool", F.col("memory_id") % 4), "pool")


# --- metrics -------------------------------------------------------------------------------------------------------


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(n) as n, min(value) as least, max(value) as most, min(value) filter (where k = floor(n * 0.5)) as p50, min(value) filter (where k = floor(n * 0.95)) as p95, min(value) filter (where k = floor(n * 0.99)) as p99 from r group by 1""")
def latency_percentiles(spark, d):
    """Percentiles as elements of the sorted sample."""
    return metrics.percentiles(T.read(spark, d, "events"), "event_type", "value")


@query("select time_bucket(interval 1 hour, ts) as start, count(*) as n from events group by 1")
def throughput(spark, d):
    return metrics.throughput(T.read(spark, d, "events"), "ts", "1 hour")


@query("""with recursive o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as k from events),
f as (select user_id, k, value as v from o where k = 1 union all select o.user_id, o.k, 0.8::double * f.v + 0.2::double * o.value from f join o on o.user_id = f.user_id and o.k = f.k + 1)
select user_id, round(max_by(v, k), 6) as ema from f group by 1""")
def moving_average(spark, d):
    """Exponential average of each user's values."""
    return metrics.moving_average(T.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query("""with recursive q as (select event_id, user_id, t, row_number() over (partition by user_id order by t, event_id) as k from (select event_id, user_id, floor(epoch(ts))::bigint as t from events)),
f as (select user_id, k, event_id, 0::bigint as in_window, false as limited, [t] as admitted from q where k = 1
union all select user_id, k, event_id, len(w), len(w) >= 3, case when len(w) >= 3 then w else list_append(w, t) end
from (select q.*, list_filter(f.admitted, lambda x: x >= q.t - 3600) as w from f join q on q.user_id is not distinct from f.user_id and q.k = f.k + 1))
select event_id, in_window, limited from f""")
def rate_limited(spark, d):
    """Three admitted requests an hour; refused ones don't count."""
    e = T.read(spark, d, "events").select("event_id", F.col("user_id").alias("client"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return metrics.rate_limited(e, 3, 3600).select("event_id", "in_window", "limited")


@query("""select user_id, case when count(*) filter (where event_type <> 'error') = count(*) then 'healthy' when count(*) filter (where event_type <> 'error') > 0 then 'degraded' else 'unhealthy' end as health from events group by 1""")
def overall_health(spark, d):
    return T.read(spark, d, "events").groupBy("user_id").agg(scores.overall_health(F.col("event_type") != "error").alias("health"))


@query("""with b as (select l_returnflag as name, avg(l_quantity) as v from lineitem where l_linenumber = 1 group by 1), a as (select l_returnflag as name, avg(l_quantity * (1 + l_linenumber * 0.1::double)) as v from lineitem where l_linenumber = 2 group by 1)
select name, round((a.v - b.v) / b.v, 6) as change, case when round((a.v - b.v) / b.v, 6) > 0.1 then 'regressed' when round((a.v - b.v) / b.v, 6) < -0.1 then 'improved' else 'unchanged' end as verdict from a join b using (name)""")
def compared_runs(spark, d):
    """Two runs' averages compared with a tolerance of 10 %."""
    li = T.read(spark, d, "lineitem")
    before = li.where("l_linenumber = 1").groupBy(F.col("l_returnflag").alias("name")).agg(F.avg("l_quantity").alias("value"))
    after = li.where("l_linenumber = 2").groupBy(F.col("l_returnflag").alias("name")).agg(F.avg(F.col("l_quantity") * (1 + F.col("l_linenumber") * 0.1)).alias("value"))
    return metrics.compare_runs(before, after).select("name", "change", "verdict")


def _frames(spark, d) -> DataFrame:
    e = T.read(spark, d, "events").where("value is not null")
    return e.groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("t"), F.col("event_type").alias("unit")).agg(F.sum("value").alias("value"))


_FR = "fr as (select floor(epoch(ts) / 3600)::bigint as t, event_type as unit, sum(value) as value from events where value is not null group by 1, 2)"


@query(f"""with {_FR}, b as (select t, sum(value) as total, row_number() over (order by t) as i from fr group by 1), n as (select count(*) as frames, max(total) as top from b),
x as (select *, coalesce(total > lag(total) over (order by t), true) and coalesce(total > lead(total) over (order by t), true) and total > 0.1 as peak, total > 0.3 * top as high, lag(total > 0.3 * top) over (order by t) as before from b, n),
h as (select b.t, -sum(case when value > 0 then value / total * log2(value / total) else 0 end) as entropy from fr join b using (t) group by 1),
grid as (select u.unit, b.i, coalesce(fr.value, 0) as value from (select distinct unit from fr) u cross join b left join fr on fr.unit = u.unit and fr.t = b.t),
u as (select unit, var_pop(value) as v, max(value) as most, min(i) filter (where value = m) as late from (select *, max(value) over (partition by unit) as m from grid) group by 1)
select frames, (select count(*) from x where peak) as maxima, (select count(*) from x where before and not high) as bursts, (select round(avg(total), 6) from b) as mean_total, (select round(avg(entropy), 6) from h) as entropy,
(select case when count(*) > 1 then round(1000 / ((max(i) - min(i)) / (count(*) - 1)::double * 3600000), 6) else 0 end from x where peak) as oscillation_hz,
(select round(1 / (1 + avg(v)), 6) from u) as stability, (select round(count(*) / ((max(late) - min(late)) * 3600000)::double, 6) from u where most > 0) as propagation_speed from n""")
def signal_features(spark, d):
    """Entropy, stability, maxima, oscillation, bursts and propagation of hourly activity by event type."""
    return metrics.signal_features(_frames(spark, d), 3_600_000.0)


@query(f"""with {_FR}, s as (select unit, sqrt(sum(value * value)) as z from fr group by 1), p as (select a.unit as a, b.unit as b, sum(a.value * b.value) as dp from fr a join fr b on a.t = b.t and a.unit < b.unit group by 1, 2)
select (select count(*) from s) as n, round(sum(dp / (x.z * y.z)) / count(*), 6) as synchrony from p join s x on x.unit = a join s y on y.unit = b""")
def synchrony(spark, d):
    """Mean cosine over pairs of event types' hourly activity."""
    return metrics.synchrony(_frames(spark, d))


# --- routing -------------------------------------------------------------------------------------------------------


def _queries(spark, d) -> DataFrame:
    q = T.read(spark, d, "documents")
    empty = F.array().cast("array<string>")
    return q.select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("content"), (F.col("doc_id") % 5 == 0).alias("has_embedding"),
        F.when(F.col("doc_id") % 7 == 0, F.array(F.col("doc_id") + 1)).otherwise(F.array().cast("array<bigint>")).alias("start_ids"),
        F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("semantic"))).otherwise(empty).alias("assoc_types"), empty.alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, 0.95).otherwise(0.1).alias("min_weight"), F.lit(3).alias("max_depth"),
        F.when(F.col("doc_id") % 13 == 0, F.create_map(F.lit("predict_next"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")).alias("params"),
    )


@query("""with q as (select doc_id, octet_length(encode(coalesce(text, ''))) as z, doc_id % 5 = 0 as e, doc_id % 11 = 0 as a, doc_id % 7 = 0 as s, doc_id % 13 = 0 as t, case when doc_id % 3 = 0 then 0.95 else 0.1 end as w from documents),
r as (select *, (a or s) and not t as assoc from q)
select doc_id as query_id, case when z > 0 and z < 100 and w >= 0.9 and not e and not a then 'exact' when (e or z > 20) and w < 0.9 and not a and not assoc then 'similarity' when assoc then 'association' when t then 'temporal' else 'all' end as route from r""")
def query_routes(spark, d):
    """The route that each query's shape asks for."""
    return router.classify(_queries(spark, d)).select("query_id", "route")


def _layers(spark, d) -> dict[int, router.Layer]:
    v = T.vectors(spark, d)

    def exact(q: DataFrame) -> DataFrame:
        return q.join(v.select(F.col("memory_id").alias("query_id")), "query_id").select("query_id", F.col("query_id").alias("memory_id"), F.lit(1.0).alias("confidence"))

    def similar(q: DataFrame) -> DataFrame:
        own = q.join(v.select(F.col("memory_id").alias("query_id"), "embedding"), "query_id")
        return retrieval.similarity_batch(v, own.select("query_id", "embedding"), 10).select("query_id", "memory_id", "confidence")

    return {1: exact, 2: similar}


def _some(spark, d) -> DataFrame:
    """A stated set of queries: vector ids divisible by 50."""
    return T.vectors(spark, d).where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"))


_ROUTED = f"""x as (select q.vec_id as query_id, e.vec_id as memory_id, round(({_COS.format(a="e.embedding", b="q.embedding")} + 1) / 2, 6) as confidence, {_COS.format(a="e.embedding", b="q.embedding")} as sim from embeddings e, embeddings q where q.vec_id % 50 = 0),
l2 as (select query_id, memory_id, confidence, 2 as layer from (select *, row_number() over (partition by query_id order by sim desc, memory_id) as r from x) where r <= 10),
l1 as (select vec_id as query_id, vec_id as memory_id, 1.0::double as confidence, 1 as layer from embeddings where vec_id % 50 = 0)"""


@query(f"""with {_ROUTED}, u as (select *, row_number() over (partition by query_id, memory_id order by confidence desc, layer) as k from (select * from l1 union all select * from l2))
select query_id, memory_id, confidence, layer, rank from (select *, row_number() over (partition by query_id order by confidence desc, memory_id, layer) as rank from u where k = 1) where rank <= 8""")
def parallel_route(spark, d):
    """Exact and similarity layers together, one row for each memory."""
    return router.parallel(_some(spark, d), _layers(spark, d), 8)


@query("select vec_id as query_id, vec_id as memory_id, 1.0::double as confidence, 1 as layer, 1 as rank from embeddings where vec_id % 50 = 0")
def sequential_route(spark, d):
    """An exact hit ends a query."""
    return router.sequential(_some(spark, d), _layers(spark, d), 8)


@query("""with a as (select doc_id as query_id, doc_id as memory_id, n_chars as created_at, 0 as p from documents where doc_id % 2 = 0), b as (select doc_id, doc_id + 1, n_chars, 1 from documents), u as (select * from a union all select * from b)
select query_id, memory_id, created_at, p as priority, 1 as rank from (select *, min(p) over (partition by query_id) as f from u) where p = f""")
def fallback_route(spark, d):
    """The first part that answers a query."""
    x = T.read(spark, d, "documents")
    a = x.where("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("memory_id"), F.col("n_chars").alias("created_at"))
    b = x.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + 1).alias("memory_id"), F.col("n_chars").alias("created_at"))
    return router.fallback([a, b])


#: Messages, and what the rules say that they ask for: (message, operation, layer), or nothing.
_MESSAGES = [
    ('{"status": "up"}', ("health_check", "health", "all")), ('{"content": "x", "id": 7}', ("memory_add", "add", "layer1")), ('{"content": null, "from_memory_id": 1, "to_memory_id": 2}', ("memory_add", "add", "layer1")),
    ('{"from_memory_id": 1, "to_memory_id": 2}', ("association_add", "add", "layer3")), ('{"from_memory_id": 1}', ("memory_add", "add", "layer3")), ('{"association": {}, "query": "x"}', ("search_associative", "search", "layer3")),
    ('{"operation": "Get_Memory", "content": "x"}', ("memory_get", "get", "layer3")), ('{"operation": "METRICS"}', ("performance", "metrics", "all")), ('{"operation": 5, "search": "x"}', ("search_associative", "search", "layer3")),
    ('{"operation": "explode"}', None), ('{"id": 7}', ("memory_add", "add", "layer3")), ("{}", ("memory_add", "add", "layer3")), ("[1, 2]", None), ("not json", None), ('{"association": 1, "health": 2}', ("association_add", "add", "layer3")),
]
_ANSWERS = ", ".join(f"({i}, {', '.join(repr(x) for x in a) if a else 'null, null, null'})" for i, (_, a) in enumerate(_MESSAGES))


@query(f"select event_id, message, operation, layer from events join (values {_ANSWERS}) v(i, message, operation, layer) on event_id % {len(_MESSAGES)} = i")
def inferred_operations(spark, d):
    """What a JSON message asks for."""
    e = T.read(spark, d, "events")
    m = F.element_at(F.array(*[F.lit(x) for x, _ in _MESSAGES]), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    return e.select("event_id", router.infer_operation(m).alias("a")).select("event_id", "a.message", "a.operation", "a.layer")


# --- streaming -----------------------------------------------------------------------------------------------------


@query(f"with {_TRANS} select pool, from_id, to_id, count(*) as n from s where from_id is not null group by all")
def streamed_transitions(spark, d):
    """Transitions learned from the event table read as a stream, with one state for each pool."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    import uuid

    home = f"{shared_folder(spark)}/recallgrid/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    ids = F.create_map(*[F.lit(x) for kv in T.EVENT_IDS.items() for x in kv])
    a = stream.where("user_id is not null").select(F.col("user_id").alias("pool"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("seq"), ids[F.col("event_type")].cast("long").alias("memory_id"), F.col("ts").cast("timestamp").alias("ts"))
    learn.run_to(learn.steps(a), f"{home}/steps", f"{home}/state")
    return spark.read.schema(learn.STEP).parquet(f"{home}/steps").groupBy("pool", "from_id", "to_id").agg(F.count("*").alias("n"))


# --- maintenance of edges, entries and patterns --------------------------------------------------------------------

_NODES = "(select p_partkey from part where p_partkey % 10 <> 0)"


def _tenths(spark, d) -> DataFrame:
    return T.read(spark, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"))


@query(f"with {_EDGE} select from_id, to_id from e where from_id not in {_NODES} or to_id not in {_NODES}")
def violating_edges(spark, d):
    """Edges with an end that isn't stored: parts whose number is divisible by ten are left out."""
    return graph.violations(T.associations(spark, d), _tenths(spark, d)).select("from_id", "to_id")


@query(f"with {_EDGE} select from_id, to_id, round(weight, 6) as weight from e where from_id in {_NODES} and to_id in {_NODES} and from_id <> 0 and to_id <> 0")
def valid_edges(spark, d):
    return graph.valid_edges(T.associations(spark, d), _tenths(spark, d)).select("from_id", "to_id", F.round("weight", 6).alias("weight"))


@query(f"with {_EDGE} select from_id, to_id from e where from_id % 7 <> 0 and to_id % 7 <> 0")
def edges_after_removal(spark, d):
    """Edges that stay when every seventh part goes."""
    parts = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    ends = T.associations(spark, d).select(F.explode(F.array("from_id", "to_id")).alias("id")).where("id % 7 = 0").distinct()
    return graph.drop_nodes(parts, T.associations(spark, d), ends)[1].select("from_id", "to_id")


@query(_queue(7, 3, 8, "l.v + (1 - s.weight)", 0, "cost", "asc"))
def cheapest_paths(spark, d):
    """The 30 nodes that a queue by cost takes first, within three edges; an edge costs 1 - weight."""
    out = graph.best_first(_strong(spark, d), _starts(spark, 7), 3, 30, cost=True, cut=written)
    return out.select("node", F.col("value").alias("cost"), "depth", "rank")


@query("select c_custkey as memory_id, c_nationkey as connection_id from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def open_connections(spark, d):
    """Customers whose nation's connection isn't closed."""
    closed = T.read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("connection_id"))
    rows = T.read(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_nationkey").alias("connection_id"))
    return store.cleanup_connection(rows, closed).select("memory_id", "connection_id")


@query("""select user_id as key, event_id, value from (select *, row_number() over (partition by user_id order by event_type = 'purchase' desc, event_id desc) as r
from events where event_type in ('view', 'purchase')) where r = 1""")
def upserted_entries(spark, d):
    """Purchases as changes over views: the last writer of each key."""
    e = T.read(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "value", "event_type")
    rows = [e.where(F.col("event_type") == t).drop("event_type") for t in ("view", "purchase")]
    return store.upsert(rows[0], rows[1], "key", "event_id").select("key", "event_id", "value")


@query("""select c_custkey as memory_id, coalesce(n, 0) as access_count, epoch_us(t) as last_us from customer
left join (select user_id, count(*) as n, max(ts) as t from events group by 1) on user_id = c_custkey""")
def touched_entries(spark, d):
    """Access counts and times from the log."""
    m = T.read(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed"))
    log = T.read(spark, d, "events").select(F.col("user_id").alias("memory_id"), F.col("ts").cast("timestamp").alias("ts"))
    return retrieval.touch(m, log).select("memory_id", "access_count", F.unix_micros("last_accessed").alias("last_us"))


@query("""select p_partkey as id, p_size + coalesce(n, 0) as activation_count, greatest(coalesce(s, 0), 0) as last_used_step from part
left join (select l_partkey, count(*) as n, max(l_orderkey) as s from lineitem group by 1) on l_partkey = p_partkey""")
def activated_patterns(spark, d):
    """Parts as patterns, each line of an order an activation."""
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("activation_count"), F.lit(0).cast("long").alias("last_used_step"))
    seen = T.read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.lit(1).alias("delta"), F.col("l_orderkey").alias("step"))
    return retrieval.pattern_touch(p, seen).select("id", "activation_count", "last_used_step")


# --- scores, keys and windows --------------------------------------------------------------------------------------


@query(f"with {_EDGE} select from_id, to_id, round(weight - 0.1::double * n / 24, 6) as score from e")
def edge_retention(spark, d):
    """Retention of edges, with the count of uses as their age in hours."""
    return T.associations(spark, d).select("from_id", "to_id", F.round(scores.edge_retention(F.col("weight"), F.col("n")), 6).alias("score"))


@query("""select user_id, round(case when s > 0.5 then 0.7::double * s + 0.3::double * (1 - least(v / 1000, 1)) else 0 end, 6) as score from (
select user_id, avg(case when event_type <> 'error' then 1.0::double else 0 end) as s, avg(value) as v from events group by 1)""")
def health_scores(spark, d):
    """Each user's share of successes and mean value as milliseconds."""
    u = T.read(spark, d, "events").groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("s"), F.avg("value").alias("v"))
    return u.select("user_id", F.round(scores.health_score(F.col("s"), F.col("v"), F.col("s") > 0.5), 6).alias("score"))


@query("""select event_id, round(least(exp(-0.5::double * pow((value - 50) / 20, 2)) / (20 * sqrt(2 * pi())), 1), 6) as normal, round(least(exp(-value / 50) / 50, 1), 6) as exponential,
round(least(value / 625 * exp(-value / 25), 1), 6) as gamma, round(least(2 * value / 2500 * exp(-pow(value / 50, 2)), 1), 6) as weibull from events where value is not null""")
def interval_probabilities(spark, d):
    """The four interval models with mean 50 and variance 400."""
    e = T.read(spark, d, "events").where("value is not null")
    kinds = ("normal", "exponential", "gamma", "weibull")
    return e.select("event_id", *[F.round(scores.interval_probability(F.col("value"), F.lit(50.0), F.lit(400.0), k), 6).alias(k) for k in kinds])


@query("select doc_id, substr(sha256(doc_id::varchar), 1, 16) as blob_key, sha256(coalesce(text, '')) as content_key from documents")
def content_keys(spark, d):
    """Keys of stored blobs and of contents."""
    docs = T.read(spark, d, "documents")
    return docs.select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("blob_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_key"))


@query("""select conv_id, 'Relevant past memories (newest first):' || chr(10) || string_agg('- ' || text, chr(10) order by turn desc, text) as block
from (select *, row_number() over (partition by conv_id order by turn desc, text) as r from conversations where text is not null) where r <= 10 group by 1""")
def context_blocks(spark, d):
    """A conversation's ten newest turns as one block."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text")
    c = T.read(spark, d, "conversations").where("text is not null").withColumn("r", F.row_number().over(newest)).where("r <= 10")
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("t"))
    return c.select("conv_id", text.context_block(F.col("t.text")).alias("block"))


@query(f"with {_ACC} select epoch_us(time_bucket(interval 5 minute, make_timestamp(ts_us))) as start_us, pool, memory_id, count(*) as n from a group by all")
def windowed_counts(spark, d):
    """The streaming counts by five-minute windows, over the whole log."""
    out = learn.windowed_counts(T.accesses(spark, d))
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "pool", "memory_id", "n")


@query(f"""with {_ACC}, g as (select *, case when ts_us - lag(ts_us) over (partition by pool order by seq) <= 1800000000 then 0 else 1 end as b from a),
x as (select *, sum(b) over (partition by pool order by seq) as k from g)
select pool, min(ts_us) as start_us, max(ts_us) + 1800000000 as end_us, count(*) as n from x group by pool, k""")
def access_sessions(spark, d):
    """Sessions of each pool's accesses, apart by more than 30 minutes."""
    out = learn.sessions(T.accesses(spark, d))
    return out.select("pool", *[F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us") for c in ("start", "end")], "n")
