"""Further registered queries: stored entries, learning, lifecycle, persistence, routes and measures, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid import catalog
from recallgrid import tables as T
from recallgrid.catalog import _ACC, _COS, _EDGE, _FR, _GRAMS, _ROUTED, _STRONG, _TRANS, _found, _frames, _layers, _starts, _strong, query
from recallgrid.functions import scores, text, vectors
from recallgrid.operators import graph, lifecycle, metrics, retrieval, sequences
from recallgrid.plans import flows, router
from recallgrid.shared import shared_folder, written
from recallgrid.sources import store
from recallgrid.streaming import learn


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


# --- entries -------------------------------------------------------------------------------------------------------


@query("""with w as (select user_id as id, count(*) as n from events where event_type = 'purchase' group by 1)
select id, c_custkey is not null as found, case when c_custkey is not null then c_custkey % 3 + n end as access_count from w left join customer on c_custkey = id""")
def fetched_memories(spark, d):
    """Point gets of customers by purchases, each one an access."""
    m = T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed"))
    asked = T.read(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("id"))
    return retrieval.get_memories(m, asked, "2024-02-01")[0].select("id", "found", "access_count")


@query("select 250 as asked, p_partkey as id from (select p_partkey from part order by 1 limit 250) union all select 0, p_partkey from (select p_partkey from part order by 1 limit 100) union all select 5000, p_partkey from (select p_partkey from part order by 1 limit 100)")
def listed_memories(spark, d):
    """Lists with a limit that holds and with two that fall back to 100."""
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    out = [retrieval.list_memories(p, n).select(F.lit(n).alias("asked"), "id") for n in (250, 0, 5000)]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(f"with {_EDGE} select from_id, to_id, round(weight, 6) as weight from e where to_id in (1, 2, 3)")
def incoming_edges(spark, d):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    return graph.neighbours(T.associations(spark, d), ids, "in").select("from_id", "to_id", F.round("weight", 6).alias("weight"))


def _texts(spark, d) -> DataFrame:
    e = T.read(spark, d, "events")
    return e.select((F.col("user_id") % 5).alias("pool"), F.col("event_id").alias("seq"), F.concat(F.lit("c"), (F.col("event_id") % 50).cast("string")).alias("content"), (F.col("event_id") % 500).alias("memory_id"))


_KNOWN = "k as (select user_id % 5 as pool, 'c' || (event_id % 50) as content, max_by(event_id % 500, event_id) as memory_id from events group by 1, 2)"


@query(f"""with {_KNOWN} select user_id as context_id, string_agg(memory_id::varchar, '-' order by event_id) as recent
from events join k on k.pool = user_id % 5 and k.content = 'c' || (event_id % 70) group by 1""")
def resolved_contents(spark, d):
    """Texts of contexts as memory ids; every text that isn't stored is dropped."""
    c = T.read(spark, d, "events").select((F.col("user_id") % 5).alias("pool"), F.col("user_id").alias("context_id"), F.col("event_id").alias("position"), F.concat(F.lit("c"), (F.col("event_id") % 70).cast("string")).alias("content"))
    return sequences.resolve_contents(_texts(spark, d), c).select("context_id", F.array_join(F.col("recent").cast("array<string>"), "-").alias("recent"))


@query(f"""with {_TRANS}, last as (select pool, max_by(memory_id, seq) as from_id from a group by 1), n as (select event_type, memory_id from (values ('click', 1), ('error', 2), ('purchase', 3)) v(event_type, memory_id))
select pool, to_id as memory_id, coalesce(event_type, 'memory_' || to_id) as content from tr join last using (pool, from_id) left join n on n.memory_id = to_id where probability >= 0.1""")
def predicted_contents(spark, d):
    """Predictions with their texts; two of the five kinds have none."""
    a = T.accesses(spark, d)
    p = sequences.predict_markov(sequences.transitions(a), sequences.recent(a)).select("pool", "memory_id")
    named = spark.createDataFrame([("click", 1, 5), ("wrong", 2, 1), ("error", 2, 2), ("purchase", 3, 3)], "content string, memory_id long, seq long")
    return sequences.with_content(p, a.select("pool").distinct().crossJoin(F.broadcast(named))).select("pool", "memory_id", "content")


_REPEATS = catalog.ORACLES["repeats"]


@query(f"select pool, sequence, confidence from ({_REPEATS}) where confidence >= 0.95")
def confident_patterns(spark, d):
    p = sequences.repeats(T.accesses(spark, d)).withColumn("pattern_type", F.lit("exact_sequence"))
    out = sequences.get_patterns(p, "exact_sequence", 0.95).unionByName(sequences.get_patterns(p, "periodic", 0.0))
    return out.select("pool", F.array_join(F.col("sequence").cast("array<string>"), "-").alias("sequence"), F.round("confidence", 6).alias("confidence"))


@query(f"with {_ACC} select pool, count(*) as every, count(*) filter (where memory_id = 5) as own from a group by 1")
def access_histories(spark, d):
    """A memory's accesses, and all of them where none is named."""
    a = T.accesses(spark, d)
    n = lambda m, name: sequences.access_history(a, m).groupBy("pool").agg(F.count("*").alias(name))
    return n(0, "every").join(n(5, "own"), "pool", "left").select("pool", "every", F.coalesce("own", F.lit(0)).alias("own"))


@query(f"with {_STRONG}, u as ({_found(7, 40)}) select 0::bigint as query_id, count(*) as total_found, count(*) + 1 as nodes_explored, count(*) as paths_found from u union all select 1, 0, 1, 0")
def search_summaries(spark, d):
    """A search's summary, and that of one whose start has no edges."""
    starts = _starts(spark, 7).unionAll(spark.createDataFrame([(1, -5)], "query_id long, start_id long"))
    return graph.search_summary(graph.search(_strong(spark, d), starts, 2, 40, 1, "random", cut=written), starts)


@query(f"with {_STRONG}, u as ({' union all '.join(f'select {i}::bigint as query_id, * from {_found(n, 25)}' for i, n in enumerate((7, 8, 9)))}) select query_id, node, weight, depth, found from u")
def batch_search(spark, d):
    """Several searches in one job, each with its own start."""
    starts = spark.createDataFrame([(0, 7), (1, 8), (2, 9)], "query_id long, start_id long")
    out = graph.breadth_first(_strong(spark, d), starts, 2, 25, False, cut=written)
    return out.select("query_id", "node", F.round("weight", 6).alias("weight"), "depth", "found")


@query(f"with {_EDGE} select from_id, to_id, round(weight, 6) as weight from e join part on p_partkey = to_id where weight >= 0.5 and p_brand in ('Brand#1', 'Brand#13')")
def typed_edges(spark, d):
    """Edges of a type whose target has one of two tags."""
    nodes = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("tags"))
    out = graph.usable_edges(T.associations(spark, d), nodes, 0.5, ["temporal", "causal"], ["Brand#1", "Brand#13"])
    return out.select("from_id", "to_id", F.round("weight", 6).alias("weight"))


@query(f"""select query_id, memory_id, similarity, rank from (
select *, row_number() over (partition by query_id order by similarity desc, memory_id) as rank from (
select q.vec_id as query_id, e.vec_id as memory_id, {_COS.format(a="e.embedding", b="q.embedding")} as similarity
from embeddings e, embeddings q where q.vec_id % 50 = 0)) where rank <= 5 and similarity >= 0.2""")
def similar_enough(spark, d):
    """Nearest vectors of at least 0.2."""
    v = T.vectors(spark, d)
    q = v.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "embedding")
    return retrieval.similarity_batch(v, q, 5, 0.2).select("query_id", "memory_id", "similarity", "rank")


_HITS = f"""x as (select q.vec_id % 4 as pool, q.vec_id as query_id, e.vec_id as memory_id, {_COS.format(a="e.embedding", b="q.embedding")} as sim from embeddings e, embeddings q where q.vec_id % 50 = 0),
t as (select * from (select *, row_number() over (partition by query_id order by sim desc, memory_id) as r from x where sim > 0.1) where r <= 5),
h as (select *, row_number() over (partition by pool order by query_id, r) as p from t), f as (select *, min(p) over (partition by pool, query_id) as first from h)"""


@query(f"with {_HITS} select c.pool, b.memory_id as a, c.memory_id as b, count(*) as n from f c join f b on b.pool = c.pool and b.p between c.first - 10 and c.first - 1 where b.memory_id <> c.memory_id group by all")
def co_access_by_query(spark, d):
    """Each query's five best hits with the ten hits before it."""
    v = T.vectors(spark, d)
    q = v.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "embedding")
    r = retrieval.similarity_batch(v, q, 5, 0.1).withColumn("pool", F.col("query_id") % 4)
    return sequences.co_access_by_query(sequences.best_hits(r, 0.1, 5))


@query(f"select e.vec_id as id, {_COS.format(a='e.embedding', b='f.embedding')} as cosine, round(({_COS.format(a='e.embedding', b='f.embedding')} + 1) / 2, 6) as confidence, 1 / 3.0::double as tags, 0.5::double as words from embeddings e join embeddings f on f.vec_id = e.vec_id + 1")
def sql_functions(spark, d):
    """The registered functions, in SQL."""
    text.register(spark)
    T.vectors(spark, d).createOrReplaceTempView("recallgrid_vectors")
    return spark.sql("""select e.memory_id as id, round(cosine(e.embedding, f.embedding) * 1e6, 0) / 1e6 as cosine, round(confidence(round(cosine(e.embedding, f.embedding) * 1e6, 0) / 1e6) * 1e6, 0) / 1e6 as confidence,
        tag_jaccard(array('a', 'b'), array('b', 'c')) as tags, word_jaccard('A  b c', 'c a d') as words from recallgrid_vectors e join recallgrid_vectors f on f.memory_id = e.memory_id + 1""")


# --- learning ------------------------------------------------------------------------------------------------------


@query(f"""select a.pool, coalesce(n, 0) as patterns, round(coalesce(c, 0), 6) as avg_confidence, case when c > 0.3 then 'healthy' when n is null then 'starting' else 'degraded' end as status
from (select distinct user_id as pool from events where user_id is not null) a left join (select pool, count(*) as n, avg(occurrences / (occurrences + 1)::double) as c from ({_REPEATS}) group by 1) p on p.pool = a.pool""")
def predictor_states(spark, d):
    a = T.accesses(spark, d)
    out = sequences.predictor_health(a.select("pool").distinct(), sequences.repeats(a))
    return out.select("pool", "patterns", F.round("avg_confidence", 6).alias("avg_confidence"), "status")


@query(f"""with {_ACC}, n as (select user_id as pool, count(*) as k from events where event_type = 'error' group by 1), l as (select pool, max(seq) as last, count(*) as c from a group by 1)
select l.pool, c + coalesce(k, 0) as accesses, last + coalesce(k, 0) as last_seq, coalesce(k, 0) as learned from l left join n on n.pool = l.pool where l.pool not in (1, 2, 3)""")
def learned_log(spark, d):
    """Errors learned as further accesses, and three pools forgotten."""
    a = T.accesses(spark, d)
    new = T.read(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("pool"), F.lit(9).cast("long").alias("memory_id"), _micros("ts").alias("ts_us"), F.col("event_id").alias("turn"))
    out = sequences.forget(sequences.learn(a, new), [1, 2, 3])
    return out.groupBy("pool").agg(F.count("*").alias("accesses"), F.max("seq").alias("last_seq"), F.count_if(F.col("memory_id") == 9).alias("learned"))


_ACCURACY = _ACC.replace("a as (", "recursive a as (", 1) + """, f as (select pool, seq, (memory_id = 5)::int::double as v from a where seq = 1 union all select a.pool, a.seq, 0.95::double * f.v + 0.05::double * (a.memory_id = 5)::int from f join a on a.pool = f.pool and a.seq = f.seq + 1)"""


@query(f"with {_ACCURACY} select pool, round(max_by(v, seq), 6) as ema from f group by 1")
def running_accuracy(spark, d):
    """Accuracy of always predicting a view, each outcome moving it by a twentieth."""
    return metrics.prediction_accuracy(T.accesses(spark, d).withColumn("hit", (F.col("memory_id") == 5).cast("double")))


@query(f"""with {_ACCURACY}, e as (select pool, round(max_by(v, seq), 6) as ema, count(*) as n from f group by 1)
select e.pool, coalesce(k, 0) as active_patterns, n as context_window_size, ema as prediction_accuracy, 0.1::double as learning_rate from e left join (select pool, count(*) as k from ({_REPEATS}) group by 1) p on p.pool = e.pool""")
def context_states(spark, d):
    a = T.accesses(spark, d)
    return sequences.context_state(a, sequences.repeats(a), running_accuracy(spark, d))


@query(f"""with {_ACC}, g as (select pool, seq, ts_us, [lag(memory_id) over w, memory_id] as g from a window w as (partition by pool order by seq)),
x as (select *, ts_us - lag(ts_us) over (partition by pool, g order by seq) as dt, row_number() over (partition by pool, g order by seq desc) as back from g where seq >= 2)
select pool, array_to_string(g, '-') as ngram, count(*) as count, max_by(dt, seq) as last_interval_us, count(dt) filter (where back <= 3) as kept, coalesce(sum(dt) filter (where back <= 3), 0)::bigint as total, least(count(*), 2) as contexts,
string_agg((seq % 7)::varchar, '-' order by seq) filter (where back <= 2) as last_contexts from x group by pool, g""")
def gram_histories(spark, d):
    """Bigrams' last three intervals and last two contexts."""
    a = T.accesses(spark, d).withColumn("user_context", (F.col("seq") % 7).cast("string"))
    g = sequences.gram_history(a, 2, 3, 2)
    total = F.aggregate("intervals", F.lit(0).cast("long"), lambda s, x: s + x)
    return g.select("pool", F.array_join(F.col("ngram").cast("array<string>"), "-").alias("ngram"), "count", "last_interval_us", F.size("intervals").cast("long").alias("kept"), total.alias("total"), F.size("contexts").cast("long").alias("contexts"), F.array_join("contexts", "-").alias("last_contexts"))


@query(f"select pool, sequence, 1000 + case when length > 2 then average_interval_us else average_interval_us * length end as middle, 1000 + average_interval_us * length as ended from ({_REPEATS})")
def next_occurrences(spark, d):
    """When a pattern's next element is due, behind its second element and behind its last."""
    p = sequences.repeats(T.accesses(spark, d))
    due = lambda at: sequences.next_occurrence(F.lit(1000), F.col("average_interval_us"), at, F.col("length"))
    return p.select("pool", F.array_join(F.col("sequence").cast("array<string>"), "-").alias("sequence"), due(F.lit(2)).alias("middle"), due(F.col("length")).alias("ended"))


@query(f"select pool, round(avg(contains('-' || sequence || '-', '-5-')::int), 6) as strength, round(avg(confidence), 4) as avg_confidence from ({_REPEATS}) group by 1")
def pattern_strengths(spark, d):
    """How many of a pool's patterns hold a memory."""
    s = sequences.pattern_strength(sequences.repeats(T.accesses(spark, d)), 5)
    return s.select("pool", F.round("strength", 6).alias("strength"), F.round("avg_confidence", 4).alias("avg_confidence"))


@query(f"with {_GRAMS} select pool, n, array_to_string(ngram, '-') as ngram, c as count from gr where c >= 3")
def frequent_ngrams(spark, d):
    g = lifecycle.frequent(sequences.ngrams(T.accesses(spark, d)), 3)
    return g.select("pool", "n", F.array_join(F.col("ngram").cast("array<string>"), "-").alias("ngram"), "count")


@query(f"""with {_ACC}, p as (select pool, count(*) as k, avg(ts_us - b) as m, var_pop(ts_us - b) as v from (select *, lag(ts_us) over (partition by pool order by seq) as b from a) group by 1)
select pool, round(m, 3) as mean, round(v / 1e12, 2) as variance, k - 1 as patterns from p where k > 1""")
def interval_models(spark, d):
    """Mean and variance of a pool's intervals, each taken as a pattern's average."""
    a = T.accesses(spark, d)
    dt = (F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy("pool").orderBy("seq"))).alias("average_interval_us")
    m = sequences.interval_model(a.select("pool", dt).where("average_interval_us is not null"))
    return m.select("pool", F.round("mean", 3).alias("mean"), F.round(F.col("variance") / 1e12, 2).alias("variance"), "patterns")


# --- lifecycle -----------------------------------------------------------------------------------------------------


@query(f"with {_ACC} select pool, seq from (select *, row_number() over (partition by pool order by seq desc) as r from a) where r <= 3")
def recent_window(spark, d):
    return lifecycle.last_rows(T.accesses(spark, d).select("pool", "seq"), 3)


@query("select event_id from events where event_id % 3 = 0 and ts < (select max(ts) from events) - interval 10 day")
def unused_memories(spark, d):
    """Entries that were never used and are old, by the newest entry's time."""
    e = T.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("last_accessed"), (F.col("event_id") % 3).alias("access_count"))
    e = e.join(F.broadcast(e.agg(F.max("last_accessed").alias("now"))), F.lit(True))
    return lifecycle.unused(e, F.col("now"), 10).select("event_id")


@query("""with e as (select user_id % 10 as pool, event_id, event_id % 7 as n, floor(epoch(timestamp '2024-02-01') - floor(epoch(ts))) as age from events),
s as (select *, round(1 / (1 + age / 3600.0::double) * ln(1.0::double + n) / ln(1.0::double + greatest(max(n) over (partition by pool), 1)), 9) as score from e)
select pool, event_id from (select *, row_number() over (partition by pool order by score desc, event_id desc) as r from s) where r <= 15""")
def best_kept(spark, d):
    """The 15 entries of each pool with the best retention."""
    e = T.read(spark, d, "events").select((F.col("user_id") % 10).alias("pool"), "event_id", (F.col("event_id") % 7).alias("access_count"), F.col("ts").cast("timestamp").alias("last_accessed"), F.lit(None).cast("double").alias("markov"), F.col("event_id").alias("inserted"))
    return lifecycle.keep_best(e, 15, "2024-02-01").select("pool", "event_id")


def _dated(spark, d) -> DataFrame:
    """Edges by order line, several for one pair of parts, with a time and a connection."""
    li = T.read(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate", "l_quantity")
    pairs = li.select(F.lag("l_partkey").over(w).alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("timestamp").alias("last_used"), F.concat(F.lit("c"), (F.col("l_orderkey") % 5).cast("string")).alias("connection_id"), (F.col("l_quantity") / 50).alias("weight"))
    return pairs.where("from_id is not null and from_id <> to_id")


_DATED = """e as (select * from (select lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_shipdate, l_quantity) as from_id, l_partkey as to_id, l_orderkey as seq, l_linenumber as line, l_shipdate as last_used, 'c' || (l_orderkey % 5) as connection_id, l_quantity / 50 as weight from lineitem) where from_id is not null and from_id <> to_id)"""


@query(f"with {_DATED} select from_id, to_id, max(seq * 10 + line) as place from e group by 1, 2")
def latest_edges(spark, d):
    """The last of the edges between two nodes is the one to go by."""
    e = _dated(spark, d).withColumn("place", F.col("seq") * 10 + F.col("line"))
    return graph.latest_edges(e, "place").select("from_id", "to_id", "place")


@query(f"with {_DATED} select from_id, to_id, seq, line from e where last_used >= timestamp '2000-06-01' - interval 48 hour")
def unexpired_edges(spark, d):
    return graph.expire_edges(_dated(spark, d), "2000-06-01", 48).select("from_id", "to_id", "seq", "line")


def _owned(spark, d) -> DataFrame:
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")).alias("connection_id"), (F.col("p_partkey") % 2).alias("access_count"), F.lit("2024-01-01").cast("timestamp").alias("last_accessed"))


@query(f"""with {_DATED}, l as (select * from e where connection_id <> 'c2' and from_id % 3 = 0), t as (select from_id as id from l union select to_id from l), n as (select p_partkey as id from part where p_partkey % 5 <> 2 or p_partkey in (select id from t))
select 'node' as kind, id, 0::bigint as other, 0::bigint as seq from n union all select 'edge', from_id, to_id, seq * 10 + line from l""")
def closed_connection(spark, d):
    """Nodes and edges without a closed connection's edges and the nodes of it that nothing else links."""
    nodes, edges = graph.close_connection(_owned(spark, d), _dated(spark, d).where("from_id % 3 = 0"), "c2")
    return nodes.select(F.lit("node").alias("kind"), "id", F.lit(0).cast("long").alias("other"), F.lit(0).cast("long").alias("seq")).unionAll(edges.select(F.lit("edge"), "from_id", "to_id", F.col("seq") * 10 + F.col("line")))


@query(f"""with {_DATED} select 'node' as kind, p_partkey as id, 0::bigint as other, 0::bigint as seq from part where p_partkey % 2 <> 0 union all select 'edge', from_id, to_id, seq * 10 + line from e where weight >= 0.4 and from_id % 2 <> 0 and to_id % 2 <> 0""")
def collected_garbage(spark, d):
    """Without memories that were never used, their edges, and weak edges."""
    nodes, edges = graph.garbage(_owned(spark, d), _dated(spark, d), "2024-03-01", 30, 0.4)
    return nodes.select(F.lit("node").alias("kind"), "id", F.lit(0).cast("long").alias("other"), F.lit(0).cast("long").alias("seq")).unionAll(edges.select(F.lit("edge"), "from_id", "to_id", F.col("seq") * 10 + F.col("line")))


# --- persistence and messages --------------------------------------------------------------------------------------


def _persisted(spark, d) -> str:
    """A snapshot of the first half of the log, and the other half as a log with two bad lines."""
    home, log = f"{shared_folder(spark)}/recallgrid/state-{uuid.uuid4().hex}", T.log(spark, d)
    half = log.agg((F.max("seq") / 2).cast("long").alias("half"))
    halves = log.join(F.broadcast(half), F.lit(True))
    store.write_snapshot(store.replay(halves.where("seq <= half").drop("half")), f"{home}/snapshots", "old")
    store.write_snapshot(store.replay(halves.where("seq <= half").drop("half")), f"{home}/snapshots")
    store.append_log(halves.where("seq > half").drop("half"), f"{home}/log")
    spark.createDataFrame([('{"seq": 5, "entry_type": ',), ("no line of a log",)], "value string").coalesce(1).write.mode("append").text(f"{home}/log")
    return home


@query(f"select memory_id, connection_id, content from ({catalog.ORACLES['log_replay']})")
def recovered_state(spark, d):
    """The live rows after the latest snapshot and the log behind it: those of the whole log."""
    home = _persisted(spark, d)
    return store.recover(spark, f"{home}/snapshots", f"{home}/log").select("memory_id", "connection_id", "content")


@query("select 2 as bad_lines, 'yes' as pointed, count(*) as log_rows from events where event_type <> 'click' and event_id > (select max(event_id) // 2 from events where event_type <> 'click')")
def persisted_tables(spark, d):
    """Bad lines of the log, good rows of it, and that the pointer names the latest snapshot with its rows."""
    home = _persisted(spark, d)
    good, bad = store.read_log(spark, f"{home}/log")
    held = store.read_snapshot(spark, f"{home}/snapshots").agg(F.count("*").alias("held"))
    meta = store.snapshot_metadata(spark, f"{home}/snapshots").select("version", "entries")
    pointed = F.when((F.col("held") == F.col("entries")) & (F.col("version") != "old"), "yes").otherwise("no").alias("pointed")
    n = good.agg(F.count("*").alias("log_rows")).join(bad.agg(F.count("*").cast("int").alias("bad_lines")), F.lit(True))
    return n.join(held.join(meta, F.lit(True)).select(pointed), F.lit(True)).select("bad_lines", "pointed", "log_rows")


@query("select key, max_by(v, t) as data from (select user_id::varchar as key, 'old' || event_type as v, event_id as t from events where event_id % 2 = 0 union all select user_id::varchar, 'new' || event_type, event_id + 1000000000 from events where event_id % 2 = 1) group by 1")
def stored_blobs(spark, d):
    """Blobs put over others: the newest data of each key."""
    e = T.read(spark, d, "events")
    half = lambda k, name: e.where(F.col("event_id") % 2 == k).select(F.col("user_id").cast("string").alias("key"), F.concat(F.lit(name), "event_type").cast("binary").alias("data"), F.col("event_id").alias("ts"))
    return store.put_blobs(store.put_blobs(None, half(0, "old")).transform(_newest), half(1, "new")).select("key", F.col("data").cast("string").alias("data"))


def _newest(blobs: DataFrame) -> DataFrame:
    return blobs.groupBy("key").agg(F.max_by("data", "ts").alias("data"), F.max("ts").alias("ts"))


@query("""select p_partkey as id, case when p_size % 6 = 0 then 'Temporal' when p_size % 6 = 1 then 'Spatial' when p_size % 6 = 2 then 'Relational' else 'Transformational' end as category, p_size as activation_count, 1.0::double as confidence, p_partkey + 1 as last_used_step from part""")
def snapshot_patterns(spark, d):
    """Stored patterns read back; a category that isn't known is the default."""
    names = F.array(*[F.lit(x) for x in ("Temporal", "Spatial", "Relational", "Transformational", "temporal", None)])
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.get(names, (F.col("p_size") % 6).cast("int")).alias("category"), F.array().cast("array<float>").alias("embedding"), F.col("p_size").alias("activation_count"), F.col("p_partkey").alias("created_ms"), (F.col("p_partkey") + 1).alias("last_used_ms"))
    return store.patterns_from_snapshot(p).select("id", "category", "activation_count", "confidence", "last_used_step")


@query("select event_id % 10 = 0 as refused, count(*) as n, sum(event_id)::bigint as ids, round(sum(case when event_id % 10 = 0 then 0 else value end), 4) as total from events group by 1")
def wire_round_trip(spark, d):
    """Rows as checked JSON messages and back; a tenth of the checksums are spoilt."""
    m = store.to_wire(T.read(spark, d, "events").select("event_id", "event_type", "value"), "event_id", "event_type", "value")
    spoilt = F.get_json_object("payload", "$.event_id").cast("long") % 10 == 0
    good, bad = store.from_wire(m.withColumn("crc", F.col("crc") + F.when(spoilt, 1).otherwise(0)), "event_id long, event_type string, value double")
    ids = F.get_json_object("payload", "$.event_id").cast("long")
    rows = good.select(F.lit(False).alias("refused"), "event_id", "value").unionAll(bad.select(F.lit(True), ids, F.lit(0.0)))
    return rows.groupBy("refused").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


@query("""select event_id, event_type as a, event_id::varchar as b, case when event_id % 2 = 0 then 'true' else 'false' end as c, '1.5' as e, '["x",' || user_id || ']' as f, 5::bigint as keys from events""")
def metadata_texts(spark, d):
    """Members of a JSON object as texts."""
    e = T.read(spark, d, "events")
    payload = F.format_string('{"a": "%s", "b": %d, "c": %s, "e": 1.5, "f": ["x",%d]}', "event_type", "event_id", F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), "user_id")
    m = e.select("event_id", text.metadata_strings(payload).alias("m"))
    return m.select("event_id", *[F.col("m")[k].alias(k) for k in "abcef"], F.size("m").cast("long").alias("keys"))


@query("""select event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') as query_key from events""")
def query_keys(spark, d):
    return T.read(spark, d, "events").select("event_id", scores.query_key("event_type", "user_id").alias("query_key"))


@query("""select event_id, case when event_id % 3 = 0 then floor(epoch(ts) * 1000)::bigint when event_id % 3 = 1 then event_id else 0 end as ms from events""")
def event_times(spark, d):
    """Times from an ISO text, from a context item, or none."""
    e = T.read(spark, d, "events")
    k = F.col("event_id") % 3
    iso = F.when(k == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    context = F.when(k == 1, F.array(F.lit("user:x"), F.concat(F.lit("timestamp:"), F.col("event_id").cast("string")))).otherwise(F.array(F.lit("mytimestamp:5x")))
    return e.select("event_id", text.event_millis(iso, context).alias("ms"))


@query("""with m as (select doc_id, list_distinct([lang, source]) as tags from documents)
select a.doc_id as id, round(len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))::double, 6) as weight from m a join m b on b.doc_id = a.doc_id + 1 where a.tags is not null""".replace("where a.tags is not null", "where len(a.tags) > 0 and len(b.tags) > 0"))
def tag_overlaps(spark, d):
    """The overlap of neighbours' tags."""
    m = T.memories(spark, d).select((F.col("id") - 1).alias("id"), F.array_distinct(F.filter("tags", lambda t: t.isNotNull())).alias("tags")).where("size(tags) > 0")
    b = m.select((F.col("id") - 1).alias("id"), F.col("tags").alias("tags2"))
    return m.join(b, "id").select("id", F.round(text.tag_overlap(F.col("tags"), F.col("tags2")), 6).alias("weight"))


@query("""with s as (select vec_id, list_min(embedding)::double as lo, list_max(embedding)::double as hi, embedding as e from embeddings)
select vec_id as memory_id, round(list_sum(list_transform(e, lambda x: lo + floor((x::double - lo) * 15.0::double / (hi - lo)) * (hi - lo) / 15.0::double)), 5) as total from s""")
def dequantised_sums(spark, d):
    """4-bit codes turned back into values, summed."""
    v = T.vectors(spark, d)
    back = vectors.dequantise(vectors.quantise(F.col("embedding"), 4), F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double"), 4)
    return v.select("memory_id", F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""select doc_id as id, 256::bigint as dims, case when trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' then 1.0::double else 0.0 end as norm from documents""")
def word_trigram_embeddings(spark, d):
    """Word and trigram embeddings have unit norm; a brute-force test holds their values."""
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    v = text.embed_words_and_trigrams(docs, "id", "text")
    return v.select("id", F.size("embedding").cast("long").alias("dims"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


# --- routes --------------------------------------------------------------------------------------------------------


def _shaped(spark, d) -> DataFrame:
    """Queries of three shapes: sure and short ones, ones with an embedding, and others."""
    v, none = T.vectors(spark, d).where("memory_id % 50 = 0"), F.array().cast("array<string>")
    i = F.col("memory_id")
    return v.select(
        i.alias("query_id"), F.lit("q").alias("content"), (i % 100 == 0).alias("has_embedding"), F.array().cast("array<bigint>").alias("start_ids"), none.alias("assoc_types"), none.alias("tags"),
        F.when(i % 150 == 50, 0.95).otherwise(0.1).alias("min_weight"), F.lit(3).alias("max_depth"), F.create_map().cast("map<string,string>").alias("params"),
    )


_BEST = "u as (select *, row_number() over (partition by query_id, memory_id order by confidence desc, layer) as k from ({rows}))\nselect query_id, memory_id, confidence, layer, rank from (select *, row_number() over (partition by query_id order by confidence desc, memory_id, layer) as rank from u where k = 1) where rank <= 10"
_SURE = "(query_id % 150 = 50 and query_id % 100 <> 0)"


@query(f"with {_ROUTED}, {_BEST.format(rows=f'select * from l1 union all select * from l2 where not {_SURE}')}")
def adaptive_route(spark, d):
    """Sure and short queries go to the exact layer alone, others to both that there are."""
    return router.adaptive(_shaped(spark, d), _layers(spark, d), 10).select("query_id", "memory_id", "confidence", "layer", "rank")


@query(f"with {_ROUTED} select query_id, memory_id, confidence, layer, row_number() over (partition by query_id order by confidence desc, memory_id) as rank from l2")
def custom_route(spark, d):
    """Similar ones first: ten of them leave nothing to ask the exact layer for."""
    return router.custom(_shaped(spark, d), _layers(spark, d), [2, 1], 10).select("query_id", "memory_id", "confidence", "layer", "rank")


@query(f"with {_ROUTED}, {_BEST.format(rows='select * from l1 where query_id % 100 = 0 union all select query_id, memory_id, least(confidence * 1.2::double, 1), 4 from l2 where query_id % 100 <> 0')}")
def boosted_route(spark, d):
    """A sure first layer ends a query; the fourth layer's confidence counts more."""
    layers = _layers(spark, d)
    own = {1: lambda q: layers[1](q.where("query_id % 100 = 0")), 4: layers[2]}
    return router.boosted(_shaped(spark, d), own, 10).select("query_id", "memory_id", "confidence", "layer", "rank")


def _down(rows: DataFrame) -> DataFrame:
    raise ConnectionError("this layer is down")


@query(f"with {_ROUTED} select query_id, memory_id, confidence, layer, 1 as rank, 1 as failed from l1")
def tolerant_route(spark, d):
    """A layer that fails is left out of a parallel route."""
    failures: list = []
    out = router.parallel(_shaped(spark, d), {1: _layers(spark, d)[1], 2: _down}, 10, failures)
    return out.select("query_id", "memory_id", "confidence", "layer", "rank", F.lit(len(failures)).alias("failed"))


@query("select doc_id as query_id, case when strlen(coalesce(text, '')) >= 50 and doc_id % 5 = 0 then 'parallel' else 'sequential' end as strategy from documents")
def query_strategies(spark, d):
    """Sequential for short queries and those without an embedding."""
    q = T.read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("content"), (F.col("doc_id") % 5 == 0).alias("has_embedding"))
    return router.simple_route(q).select("query_id", "strategy")


def _canonical(spark, d) -> DataFrame:
    docs = T.read(spark, d, "documents").join(T.vectors(spark, d).select(F.col("memory_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return docs.select((F.col("doc_id") % 4).alias("pool"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"), "embedding", F.col("n_chars").alias("ts_us"))


@query("""with n as (select count(*) as c, count(*) filter (where doc_id <> 0) as z, count(*) filter (where doc_id in (select vec_id from embeddings)) as v from documents)
select 1 as layer, c as rows, 1 as failed, 2 as linked from n union all select 3, z, 1, 2 from n union all select 4, c, 1, 2 from n union all select 5, v, 1, 2 from n""")
def stored_everywhere(spark, d):
    """Every family's rows of the same memories; the second family fails, the others are written. Associations go to two."""
    done, failed = flows.store_everywhere(_canonical(spark, d), {n: _down if n == 2 else written for n in range(1, 6)})
    linked, _ = flows.associate_everywhere(T.associations(spark, d), {n: lambda e: e for n in range(1, 6)})
    out = None
    for n, rows in done.items():
        one = rows.agg(F.lit(n).alias("layer"), F.count("*").alias("rows"), F.lit(len(failed)).alias("failed"), F.lit(len(linked)).alias("linked"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""select doc_id as id, doc_id % 10 <> 0 and doc_id % 7 <> 0 as success, (doc_id % 10 <> 0)::int + (doc_id % 7 <> 0)::int + 1 as layers,
case when doc_id % 10 <> 0 and doc_id % 7 <> 0 then 'stored' else 'failed' end as decision, case when doc_id % 10 <> 0 and doc_id % 7 <> 0 then 0.9::double else 0 end as confidence from documents""")
def write_outcomes(spark, d):
    """Memories count as stored with the graph and the exact family, whatever the others did."""
    i = F.col("doc_id")
    layers = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), ok.alias("success")) for n, ok in ((3, i % 10 != 0), (1, i % 7 != 0), (2, F.lit(False)), (4, F.lit(True)))]))
    return flows.write_outcomes(T.read(spark, d, "documents").select(i.alias("id"), layers.alias("x")).select("id", "x.layer", "x.success"))


@query(f"with {_ROUTED} select query_id, case when query_id % 100 = 0 then 'exact_match' else 'similarity_search' end as decision, case when query_id % 100 = 0 then 1.0::double else 0.7 end as confidence, case when query_id % 100 = 0 then 0 else count(*) end as l2, 1::bigint as l3 from l2 group by 1")
def query_outcomes(spark, d):
    """Exact matches aren't followed by a similarity search; the other families are asked in any case."""
    q, layers = _shaped(spark, d).select("query_id"), _layers(spark, d)
    return flows.query_outcomes(q, layers[1](q.where("query_id % 100 = 0")), {2: layers[2](q), 3: q.withColumn("memory_id", F.col("query_id"))})


@query("select * from (values (1, 1, 1), (2, 0, 1), (3, 1, 1), (4, 0, 1), (5, 1, 1), (6, 1, 1), (7, 0, 1), (8, 1, 0), (9, 1, 0), (10, 2, 1)) v(id, out_degree, in_degree)")
def demo_degrees(spark, d):
    """Degrees in the demonstration's graph."""
    return graph.degrees(store.demo(spark)[1])


# --- measures and streams ------------------------------------------------------------------------------------------


@query("select 'recallgrid_events{type=\"' || event_type || '\"} ' || count(*) as line from events group by event_type union all select 'recallgrid_rows ' || count(*) from events")
def metric_lines(spark, d):
    """Counts as exposition lines."""
    e = T.read(spark, d, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("value")).select(F.lit("recallgrid_events").alias("name"), F.create_map(F.lit("type"), "event_type").alias("labels"), "value")
    every = e.agg(F.lit("recallgrid_rows").alias("name"), F.create_map().cast("map<string,string>").alias("labels"), F.count("*").alias("value"))
    return metrics.prometheus(n.unionByName(every))


@query("select p_partkey as id, round(pow(p_size / 64.0::double, 3), 6) as error from part")
def filter_errors(spark, d):
    """False positives to be expected of filters of 64 bits by their fill."""
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(metrics.bloom_error(F.col("p_size"), F.lit(64), 3), 6).alias("error"))


@query(f"""with {_FR}, b as (select row_number() over (order by t) as k, x from (select t, sum(value) as x from fr group by 1)), m as (select avg(x) as m, var_pop(x) as v, count(*) as n from b)
select l as lag, round(sum((p.x - m) * (q.x - m)) / max(n) / max(v), 6) as r from b p cross join range(1, 11) g(l) join b q on q.k = p.k + l cross join m group by 1""")
def autocorrelations(spark, d):
    return metrics.autocorrelation(_frames(spark, d))


@query("select user_id, event_id, rank from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events where event_type = 'error') where rank <= 2")
def last_errors(spark, d):
    e = T.read(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return metrics.last_errors(e, "user_id", ["ts", "event_id"], "failed", 2).select("user_id", "event_id", "rank")


@query(f"""with {_ACC}, w as (select epoch_us(time_bucket(interval 5 minute, make_timestamp(ts_us))) as start_us, pool, memory_id, count(*) as n from a group by all)
select * from w where start_us + 300000000 <= (select max(ts_us) from a) - 600000000""")
def streamed_windows(spark, d):
    """The log read as a stream: windows that are final by the watermark."""
    home = f"{shared_folder(spark)}/recallgrid/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    ids = F.create_map(*[F.lit(x) for kv in T.EVENT_IDS.items() for x in kv])
    a = stream.where("user_id is not null").select(F.col("user_id").alias("pool"), ids[F.col("event_type")].cast("long").alias("memory_id"), F.col("ts").cast("timestamp").alias("ts"))
    learn.run_to(learn.windowed_counts(a), f"{home}/windows", f"{home}/state")
    out = spark.read.schema("start timestamp, pool long, memory_id long, n long").parquet(f"{home}/windows")
    return out.select(_micros("start").alias("start_us"), "pool", "memory_id", "n")
