"""Numeric cases and invariants of the engine's own operators."""

import collections
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recallgrid import catalog
from recallgrid.functions import scores, text, vectors
from recallgrid.operators import graph, lifecycle, metrics, retrieval, sequences
from recallgrid.plans import router
from recallgrid.shared import running_total
from recallgrid.sources import store
from recallgrid.streaming import learn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vectors(spark):
    assert one(spark, vectors.cosine(vec(1, 2, 3, 4), vec(1, 2, 3, 4))) == 1.0
    assert one(spark, vectors.cosine(vec(1, 0), vec(0, 1))) == 0.0
    assert math.isclose(one(spark, vectors.cosine(vec(1, 2, 3), vec(-1, -2, -3))), -1.0)
    assert one(spark, vectors.cosine(vec(0, 0), vec(1, 1))) == 0.0
    assert one(spark, vectors.norm(vec(3, 4))) == 5.0
    got = one(spark, vectors.compose(vec(1, 2, 3), vec(4, 5, 6)))
    size = math.sqrt(16 + 100 + 324)
    assert all(math.isclose(a, b / size) for a, b in zip(got, (4, 10, 18)))
    runs = vectors.run_lengths(vec(1, 1, 2, 2, 2, 1))
    assert [(r["n"], r["value"]) for r in one(spark, runs)] == [(2, 1.0), (3, 2.0), (1, 1.0)]
    assert one(spark, vectors.expand_runs(runs)) == [1, 1, 2, 2, 2, 1]
    assert one(spark, vectors.quantise(vec(0, 0.5, 1), 8)) == [0, 127, 255]
    assert one(spark, vectors.quantise(vec(2, 2), 8)) == [0, 0]


def test_similarity(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "memory_id long, embedding array<float>")
    rows = retrieval.similarity_topk(s, [1.0, 0.0], 3).collect()
    assert [(r["memory_id"], r["confidence"], r["rank"]) for r in rows] == [(1, 1.0, 1), (2, 0.5, 2), (3, 0.5, 3)]
    assert retrieval.similarity_topk(s, [0.0, 0.0], 3).count() == 0
    q = s.select(F.col("memory_id").alias("query_id"), "embedding")
    got = retrieval.similarity_batch(s, q, 2).collect()
    assert {r["query_id"] for r in got} == {1, 2} and len(got) == 4
    s = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [1.0, 1.0, 5.0]) for i in range(40)] + [(90, None), (91, [])], "memory_id long, embedding array<float>")
    got = retrieval.similarity_batch(s.coalesce(1), q, 3).where("query_id = 1").orderBy("rank").collect()
    assert [(r["memory_id"], r["similarity"]) for r in got] == [(1, 1.0), (3, 1.0), (5, 1.0)]
    got = retrieval.similarity_batch(s.coalesce(1), q, 42).where("query_id = 2").orderBy("rank").collect()
    assert [r["memory_id"] for r in got] == [*range(0, 40, 2), *range(1, 40, 2), 90, 91] and got[0]["similarity"] == round(1 / 27**0.5, 6)


def test_text(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert math.isclose(one(spark, text.jaccard(a, b)), 1 / 3)
    none = F.array().cast("array<string>")
    assert one(spark, text.jaccard(none, none)) == 0.0
    assert one(spark, text.association_type(F.lit(0.6), F.lit(0.0), F.lit(0))) == "semantic"
    assert one(spark, text.token_share(F.lit("The brain is"), "BRAIN heart")) == 0.5


def test_scores(spark):
    assert one(spark, scores.interval_probability(F.lit(5.0), F.lit(5.0), F.lit(0.0))) == 1.0
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, scores.position_in_pattern(arr(9, 1, 2), arr(1, 2, 3))) == 2
    assert one(spark, scores.position_in_pattern(arr(9), arr(1, 2, 3))) == 0
    assert one(spark, scores.halving_fold(F.array(F.lit(10), F.lit(20)))) == 12
    rules = F.array(F.struct(F.lit("type").alias("name"), F.lit("user_action").alias("expression")))
    assert one(spark, scores.constraints_hold(rules, F.create_map(F.lit("type"), F.lit("user_action_click")))) is True
    assert one(spark, scores.constraints_hold(rules, F.create_map(F.lit("type"), F.lit("system_event")))) is False


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, w) for a, b, w in rows], "from_id long, to_id long, weight double")


def test_graph(spark):
    e = edges(spark, (1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.5), (3, 1, 1.0), (3, 4, 0.5))
    start = spark.createDataFrame([(0, 1)], "query_id long, start_id long")
    paths = {tuple(r["path"]): round(r["weight"], 6) for r in graph.simple_paths(e, start, 3).collect()}
    assert paths == {(1, 2): 0.9, (1, 3): 0.5, (1, 2, 3): 0.72, (1, 3, 4): 0.25, (1, 2, 3, 4): 0.36}
    first = {r["node"]: (r["depth"], round(r["weight"], 6)) for r in graph.breadth_first(e, start, 3).collect()}
    assert first == {2: (1, 0.9), 3: (1, 0.5), 4: (2, 0.25)}
    best = {r["node"]: r["value"] for r in graph.best_first(e, start, 3).collect()}
    assert best == {2: 0.9, 3: 0.72, 4: 0.36}
    assert graph.breadth_first(e, start, 3, 1).count() == 1
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "id long")
    comp = {r["id"]: r["component"] for r in graph.components(nodes, e, lambda df: df).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}
    kept, left = graph.drop_nodes(nodes, e, spark.createDataFrame([(3,)], "id long"))
    assert kept.count() == 4 and left.count() == 1
    assert graph.cap_out_edges(e, 1, F.col("weight")).count() == 3


def accesses(spark, ids):
    return spark.createDataFrame([(1, i + 1, m, 1000 * i, "read") for i, m in enumerate(ids)], "pool long, seq long, memory_id long, ts_us long, access_type string")


def test_sequences(spark):
    a = accesses(spark, [100, 101, 102, 103] * 3 + [100, 101, 102])
    model = sequences.fit(a)
    got = sequences.predict(model, sequences.recent(a, 3)).collect()
    assert min(got, key=lambda r: r["rank"])["memory_id"] == 103
    assert all(math.isclose(r["p"], 1.0) for r in model["transitions"].groupBy("pool", "from_id").agg(F.sum("probability").alias("p")).collect())


def test_repeats_equal_a_rescan(spark):
    import random

    random.seed(3)
    ids = [random.choice([1, 2]) for _ in range(70)]
    count: dict = {}
    for t in range(2, len(ids)):
        lo = max(0, t - 49)
        for n in (3, 4, 5):
            for p in range(lo, t - 2 * n + 2):
                if ids[p : p + n] == ids[p + n : p + 2 * n]:
                    count[tuple(ids[p : p + n])] = count.get(tuple(ids[p : p + n]), 0) + 1
    got = {tuple(r["sequence"]): r["occurrences"] for r in sequences.repeats(accesses(spark, ids)).collect()}
    assert got == count


def test_replay_of_snapshot_and_log_is_replay_of_all(spark):
    rows = [(0, "add", 1, "a", "x"), (1, "add", 2, "b", "y"), (2, "update", 1, "a", "x2"), (3, "remove", 2, "b", None), (4, "add", 3, "c", "z"), (5, "cleanup", 0, "a", None), (6, "update", 3, "c", "z2"), (7, "add", 2, "b", "y2")]
    schema = "seq long, entry_type string, memory_id long, connection_id string, content string"
    log = spark.createDataFrame(rows, schema)
    live = lambda df: {(r["memory_id"], r["content"]) for r in df.collect()}
    assert live(store.replay(log)) == {(3, "z2"), (2, "y2")}
    half = store.replay(log.where("seq < 4")).select("memory_id", "connection_id", "content")
    assert live(store.replay(log.where("seq >= 4"), half)) == live(store.replay(log))


def test_log_and_snapshot_files(spark, tmp_path):
    log = spark.createDataFrame([(0, "add", 1, "a", "x", [1.0], 1.0, 0, None)], store.LOG_SCHEMA)
    store.append_log(log, f"file://{tmp_path}/log")
    (tmp_path / "log" / "bad.json").write_text("{not json\n")
    good, bad = store.read_log(spark, f"file://{tmp_path}/log")
    assert good.count() == 1 and bad.cache().count() == 1
    store.write_snapshot(log, f"file://{tmp_path}/snap")
    assert store.recover(spark, f"file://{tmp_path}/snap", f"file://{tmp_path}/log").count() == 1


def test_router(spark):
    schema = "query_id long, content string, has_embedding boolean, start_ids array<long>, assoc_types array<string>, tags array<string>, min_weight double, max_depth int, params map<string,string>"
    q = spark.createDataFrame([
        (1, "exact text", False, [], [], [], 0.95, 3, {}), (2, "a longer text than twenty", False, [], [], [], 0.1, 3, {}), (3, "x", False, [5], [], [], 0.1, 3, {}),
        (4, "x", False, [], [], [], 0.1, 3, {"predict_next": "1"}), (5, "", False, [], [], [], 0.1, 3, {}), (6, None, None, None, None, None, 0.1, 3, None),
    ], schema)
    got = {r["query_id"]: r["route"] for r in router.classify(q).collect()}
    assert got == {1: "exact", 2: "similarity", 3: "association", 4: "temporal", 5: "all", 6: "all"}
    layers = {1: lambda x: x.where("query_id = 1").select("query_id", F.lit(7).cast("long").alias("memory_id"), F.lit(1.0).alias("confidence")), 2: lambda x: x.select("query_id", F.lit(7).cast("long").alias("memory_id"), F.lit(0.5).alias("confidence"))}
    assert {(r["query_id"], r["layer"]) for r in router.sequential(q, layers).collect()} == {(1, 1), *((k, 2) for k in range(2, 7))}
    assert router.parallel(q, layers).count() == 6


def test_lifecycle_and_metrics(spark):
    s = spark.createDataFrame([("g", float(i)) for i in range(100)], "g string, v double")
    r = metrics.percentiles(s, "g", "v").first()
    assert (r["p50"], r["p95"], r["p99"]) == (50.0, 95.0, 99.0)
    rows = spark.createDataFrame([(1, k, "2024-01-01 00:00:00", 0, 0.0, k) for k in range(10)], "pool long, key long, last_accessed string, access_count long, markov double, inserted long")
    rows = rows.withColumn("last_accessed", F.col("last_accessed").cast("timestamp"))
    assert {r["key"] for r in lifecycle.keep_best(rows, 5, "2024-01-01 01:00:00").collect()} == {5, 6, 7, 8, 9}


def test_streamed_steps_equal_batch(spark, tmp_path):
    from recallgrid.streaming import learn

    ids = [1, 2, 3, 1, 2]
    a = spark.createDataFrame([(p, i, m, i) for p in (1, 2) for i, m in enumerate(ids)], "pool long, seq long, memory_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    a.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(a.schema).parquet(f"file://{tmp_path}/in")
    learn.run_to(learn.steps(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = {(r["pool"], r["from_id"], r["to_id"]): r["n"] for r in spark.read.parquet(f"file://{tmp_path}/out").groupBy("pool", "from_id", "to_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(p, *k): n for p in (1, 2) for k, n in {(1, 2): 2, (2, 3): 1, (3, 1): 1}.items()}


def test_text_similarity_of_all_turns(spark, tmp_path):
    """The registered query against brute force at 384 dimensions, with a conversation of more than 1,000 turns."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"word{rng.randrange(300)}" for _ in range(n))
    rows = [(50, t, "user", say(6)) for t in (0, 1, 7, 999, 1000, 1001)] + [(51, t, "user", say(6)) for t in range(30)] + [(100, 0, "user", None), (100, 1, "user", say(3))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    at = {(c << 32) + t: semantic(x).astype(np.float32).astype(float) for c, t, _, x in rows}
    want = {}
    for c, t, _, x in rows:
        q = at[(c << 32) + t]
        if c % 50 == 0 and x:
            near = [(-round(float(q @ v / max(np.linalg.norm(q) * np.linalg.norm(v), 1e-12)), 6), i) for i, v in at.items()]
            want[(c << 32) + t] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(near)[:5])]
    got = {}
    for r in catalog.QUERIES["text_similarity"](spark, f"file://{tmp_path}").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["memory_id"], r["similarity"]))
    assert got.keys() == want.keys() and len(want) == 7
    for i, found in got.items():
        assert [x[:2] for x in found] == [x[:2] for x in want[i]]
        assert all(math.isclose(a[2], b[2], abs_tol=2e-6) for a, b in zip(found, want[i]))


def hashed(seed, word, size):
    """The engine's hash by the public algorithm: 64-bit xxHash of the seed, then of the word."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", seed) if isinstance(seed, int) else seed.encode(), seed=42)
    x = xxhash.xxh64_intdigest(word.encode(), seed=first)
    return (x - (1 << 64) if x >> 63 else x) % size


def semantic(content, dim=384):
    low = (content or "").lower()
    w, v = low.split(), np.zeros(dim)
    if not w:
        return v
    part = dim // 5
    for x in w:
        group = [(g, words) for g, words in enumerate(text.WORD_GROUPS) if x in words]
        if group:
            (g, words), = group
            for i in range(part):
                v[g * part + i] += 0.5 + 0.3 * math.sin(i / part) + 0.1 * (words.index(x) / len(words) + math.sin((g * part + i) * 0.1))
        else:
            for k, seed in enumerate((42, 137, 314, 628, 1337)):
                v[hashed(seed, x, part) + k * dim // 5] += 0.3
    for n, weight in ((2, 0.1), (3, 0.05)):
        for i in range(len(low) - n + 1):
            v[hashed(n, low[i : i + n], dim)] += weight
    v[hashed("FIRST:", w[0], dim // 4)] += 0.2
    v[hashed("LAST:", w[-1], dim // 4) + dim // 4] += 0.2
    if {"what", "how", "why", "when", "where", "who", "which"} & set(w):
        v[dim // 2 : dim // 2 + 10] += 0.15
    return v / np.linalg.norm(v)


TEXTS = ["the cat sat on a mat", "a kitten and a puppy", "where is the login password", "bug crash exception in record entry", "What\n ist é 日本 😀 x", "", None, "  ", "a", "the cat sat on a mat", "word " * 3000]


def test_semantic_embedding_against_brute_force(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    got = {r["id"]: np.array(r["embedding"]) for r in text.embed_semantic(d, "id", "t").collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert np.allclose(got[i], semantic(t), atol=1e-6), t
    cos = lambda a, b: float(got[a] @ got[b])
    other = {r["id"]: np.array(r["embedding"]) for r in text.embed_semantic(spark.createDataFrame([(0, "cat"), (1, "dog"), (2, "car"), (3, "user login"), (4, "account signin"), (5, "truck transport")], "id long, t string"), "id", "t").collect()}
    assert cos(0, 9) > 0.999 and other[0] @ other[1] > other[0] @ other[2] and other[3] @ other[4] > other[3] @ other[5]


def test_word_trigram_embedding_and_hashed_terms_against_brute_force(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    got = {r["id"]: np.array(r["embedding"]) for r in text.embed_words_and_trigrams(d, "id", "t").collect()}
    terms = collections.defaultdict(dict)
    for r in text.hashed_terms(d, "id", "t", 64).collect():
        terms[r["id"]][r["dim"]] = r["value"]
    for i, t in enumerate(TEXTS):
        low, v, n = (t or "").lower(), np.zeros(256), collections.Counter()
        for x in low.split():
            v[hashed(21, x, 256)] += 1
        for k in range(len(low) - 2):
            v[hashed(22, low[k : k + 3], 256)] += 0.5
        assert np.allclose(got[i], v / (np.linalg.norm(v) or 1), atol=1e-6), t
        for x in (t or "").split():
            y = xxhash.xxh64_intdigest(x.encode(), seed=42)
            n[(y - (1 << 64) if y >> 63 else y) % 64] += 1
        size = math.sqrt(sum(c * c for c in n.values()))
        assert terms[i] == {k: c / size for k, c in n.items()} or all(math.isclose(terms[i][k], c / size) for k, c in n.items()) and len(terms[i]) == len(n)


def test_text_similarity_against_brute_force(spark):
    rng = random.Random(3)
    words = [w for g in text.WORD_GROUPS for w in g] + ["alpha", "beta", "gamma", "what", "delta"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(60)] + ["", "same text here", "same text here"]
    s = spark.createDataFrame(list(enumerate(texts)), "memory_id long, content string")
    q = s.where("memory_id % 7 = 0 or memory_id >= 60").select(F.col("memory_id").alias("query_id"), "content")
    got = collections.defaultdict(list)
    for r in retrieval.text_similarity(s, q, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["memory_id"], r["similarity"]))
    v = np.array([semantic(t).astype(np.float32) for t in texts], float)
    asked = [i for i in range(len(texts)) if (i % 7 == 0 or i >= 60) and texts[i]]
    assert sorted(got) == asked
    for i in asked:
        sims = np.round(np.array([v[i] @ x / ((np.linalg.norm(v[i]) * np.linalg.norm(x)) or 1) for x in v]), 6)
        assert [round(s, 4) for _, s in got[i]] == [round(x, 4) for x in sorted(sims, reverse=True)[:5]]
        assert all(math.isclose(sims[m], s, abs_tol=2e-6) for m, s in got[i])


def test_predictions_against_brute_force(spark):
    """All four predictors and their merge, by loops over two pools' logs."""
    rng = random.Random(4)
    logs = {p: [rng.choice([1, 2, 3]) if k % 5 else 4 for k in range(60)] for p in (1, 2)}
    logs[1] += [1, 2, 3, 1, 2, 3, 1, 2]
    rows = [(p, k + 1, m, 1000 * (k + 1) + 37 * (k % 3), "read") for p, log in logs.items() for k, m in enumerate(log)]
    a = spark.createDataFrame(rows, "pool long, seq long, memory_id long, ts_us long, access_type string")
    got = {(r["pool"], r["memory_id"]): (r["confidence"], r["prediction_type"], r["contributing_evidence"]) for r in sequences.predict(sequences.fit(a), sequences.recent(a, 2)).collect()}
    patterns = sequences.repeats(a).collect()
    want = {}
    for p, log in logs.items():
        out, recent = [], log[-2:]
        for n in (3, 2):
            grams = collections.Counter(tuple(log[k : k + n]) for k in range(len(log) - n + 1))
            for g, c in sorted(grams.items()):
                if list(g[:-1]) == recent[len(recent) - n + 1 :] and c / grams.total() >= 0.1:
                    out.append((10 - n, c / grams.total(), g[-1], "ngram", f"ngram-{n}"))
        moves = collections.Counter((x, y) for x, y in zip(log, log[1:]) if x == recent[-1])
        for (_, y), c in moves.items():
            if c / moves.total() >= 0.1:
                out += [(20, c / moves.total(), y, "markov", "transition"), (41, 0.9 * c / moves.total(), y, "statistical", "transition")]
        own = [r for r in patterns if r["pool"] == p]
        mean = np.mean([r["average_interval_us"] for r in own]) if own else 0
        var = np.var([r["average_interval_us"] for r in own]) if own else 0
        for r in own:
            if r["sequence"][:2] == recent and r["confidence"] * 0.8 >= 0.1:
                out.append((30, r["confidence"] * 0.8, r["sequence"][2], "completion", "pattern"))
            at = max([k for k in (1, 2) if recent[-k:] == r["sequence"][:k]], default=0)
            if 0 < at < r["length"]:
                prob = 1.0 if var <= 0 else min(1.0, math.exp(-0.5 * ((r["average_interval_us"] - mean) ** 2 / var)) / math.sqrt(2 * math.pi * var))
                if prob > 0.1:
                    out.append((40, 0.6 * prob + 0.4 * r["confidence"], r["sequence"][at], "statistical", "timing"))
        for m in {x[2] for x in out}:
            mine = sorted((t, round(c, 12), kind, e) for t, c, mm, kind, e in out if mm == m)
            acc = mine[0][1]
            for x in mine:
                acc = (acc + x[1]) / 2
            if round(acc, 6) >= 0.1:
                want[p, m] = (round(acc, 6), mine[0][2], [mine[0][3], *[x[3] for x in mine]])
    assert set(got) == set(want) and len(want) >= 3
    for k in want:
        assert math.isclose(got[k][0], want[k][0], abs_tol=2e-6) and got[k][1:] == want[k][1:], k


def test_halving_average_of_long_histories(spark):
    """Whole-number halving behind hundreds of intervals equals the fold, constant ones included."""
    rng = random.Random(5)
    histories = {1: [7] * 300, 2: [rng.randrange(1 << 40) for _ in range(500)], 3: [(1 << 49) + k for k in range(129)], 4: [1, 0], 5: [rng.choice([0, 1]) for _ in range(1000)]}
    rows = []
    for p, dts in histories.items():
        t = 0
        for k, dt in enumerate([0, *dts]):
            t += dt
            rows.append((p, k, 1, t))
    got = {r["pool"]: (r["count"], r["average_interval"]) for r in sequences.transitions(spark.createDataFrame(rows, "pool long, seq long, memory_id long, ts_us long")).collect()}
    for p, dts in histories.items():
        acc = 0
        for dt in dts:
            acc = (acc + dt) // 2
        assert got[p] == (len(dts), acc), p


def test_long_moving_average_and_limits(spark):
    rng = random.Random(6)
    rows = [(1, k, rng.random()) for k in range(3000)] + [(2, 0, 5.0)]
    d = spark.createDataFrame(rows, "g long, k long, v double")
    got = {r["g"]: r["ema"] for r in metrics.moving_average(d, "g", ["k"], "v", 0.999).collect()}
    acc = rows[0][2]
    for _, _, v in rows[1:3000]:
        acc = 0.999 * acc + 0.001 * v
    assert math.isclose(got[1], acc, abs_tol=1e-6) and got[2] == 5.0
    # one request a second and three in four seconds: refused ones don't count, so the fifth second is admitted again
    r = spark.createDataFrame([(t, "a", t) for t in range(9)] + [(100 + t, None, 0) for t in range(5)], "event_id long, client string, t long")
    limited = {x["event_id"]: x["limited"] for x in metrics.rate_limited(r, 3, 4).collect()}
    assert [t for t in range(9) if limited[t]] == [3, 4, 8] and sum(limited[100 + t] for t in range(5)) == 2


def test_best_first_where_depth_binds(spark):
    """A node that is taken by a long good path doesn't go on, though a short bad one would have."""
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.5), (3, 4, 0.9), (4, 5, 0.9), (1, 5, 0.01)], "from_id long, to_id long, weight double")
    starts = spark.createDataFrame([(0, 1)], "query_id long, start_id long")
    got = {r["node"]: (r["value"], r["depth"]) for r in graph.best_first(e, starts, 2, 10).collect()}
    assert got == {2: (0.9, 1), 3: (0.81, 2), 5: (0.01, 1)}
    got = {r["node"]: (r["value"], r["depth"]) for r in graph.best_first(e, starts, 3, 10).collect()}
    assert got == {2: (0.9, 1), 3: (0.81, 2), 4: (0.729, 3), 5: (0.01, 1)}
    with pytest.raises(ValueError):
        graph.breadth_first(e, starts, 11)


def test_running_totals_of_large_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2]), rng.randrange(10**6), k) for k in range(3000)]
    d = spark.createDataFrame(rows, "g long, v long, k long")
    got = {r["k"]: r["upto"] for r in running_total(d.repartition(7), ["g"], ["v", "k"], F.lit(1), "upto").collect()}
    for g in (None, 1, 2):
        own = sorted((v, k) for x, v, k in rows if x == g)
        assert [got[k] for _, k in own] == list(range(1, len(own) + 1))


def test_checksum_and_pointer(spark, tmp_path):
    assert one(spark, scores.checksum(F.lit("payload"))) == zlib.crc32(b"payload")
    root = f"file://{tmp_path}/s"
    store.write_snapshot(spark.range(3).toDF("memory_id"), root, "a")
    store.write_snapshot(spark.range(5).toDF("memory_id"), root, "b")
    (tmp_path / "s" / "_pointers" / "part-torn.json").write_text('{"version": "c", "entr')
    assert store.snapshot_metadata(spark, root).first()["version"] == "b" and store.read_snapshot(spark, root).count() == 5
    assert store.prune_snapshots(spark, root, 1) == ["a"] and store.read_snapshot(spark, root).count() == 5
    assert not (tmp_path / "s" / "a").exists()


def test_stream_with_an_interval(spark, tmp_path):
    """A running query writes what arrives while it runs."""
    import time

    source = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, 1, 5, 10)], "pool long, seq long, memory_id long, us long").write.parquet(source)
    a = spark.readStream.schema("pool long, seq long, memory_id long, us long").parquet(source).select("pool", "seq", "memory_id", F.timestamp_micros("us").alias("ts"))
    run = learn.run_to(learn.steps(a), f"file://{tmp_path}/out", f"file://{tmp_path}/state", every="1 second")
    spark.createDataFrame([(1, 2, 6, 25)], "pool long, seq long, memory_id long, us long").write.mode("append").parquet(source)
    until = time.time() + 60
    while time.time() < until:
        run.processAllAvailable()
        got = [tuple(r) for r in spark.read.schema(learn.STEP).parquet(f"file://{tmp_path}/out").collect()]
        if got:
            break
    run.stop()
    assert got == [(1, 2, 5, 6, 15)]
