"""Index, search, budgets, cache, governance, messages, sources and answers."""

import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import identity as idn
from lorekeep.operators import budget as bg
from lorekeep.operators import cache as ca
from lorekeep.operators import context as cx
from lorekeep.operators import embedding as em
from lorekeep.operators import governance as gv
from lorekeep.operators import index as ix
from lorekeep.operators import ivf
from lorekeep.operators import messages as ms
from lorekeep.operators import postings as ps
from lorekeep.operators import running as rn
from lorekeep.operators import search as sr
from lorekeep.session import scratch_path, scratch_scope, shared_folder
from lorekeep import sinks
from lorekeep.sinks import overwrite_namespaces, write_index
from lorekeep.sources import exports as ex
from lorekeep.sources import files
from lorekeep.sources.files import read_files

NOW = F.lit("2024-01-10 00:00:00").cast("timestamp")


def vectors_and_queries(spark, n=300, q=25, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    vectors = np.round(rng.standard_normal((n, dim)), 1)
    vectors[: n // 3] = vectors[0]  # a third of all vectors are one and the same
    vectors[n - 1] = 0
    queries = np.round(rng.standard_normal((q, dim)), 1)
    names = ["slack/", "notion/", "drive/", "default"]
    v = spark.createDataFrame(
        [(names[i % 4], f"v{i}", [float(x) for x in row], i % 5) for i, row in enumerate(vectors)],
        "namespace string, id string, values array<double>, label int",
    ).repartition(5)
    a = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in row]) for i, row in enumerate(queries)], "query_id string, values array<double>"
    )
    return v, a, vectors, queries, names


def brute(vectors, queries, names, k, metric, per_namespace, allowed=None):
    want = set()
    for j, query in enumerate(queries):
        rows = []
        for i, vector in enumerate(vectors):
            if allowed is not None and not allowed(i):
                continue
            if metric == "cosine":
                norm = np.linalg.norm(vector) * np.linalg.norm(query)
                score = None if norm == 0 else round(float(vector @ query / norm), 6)
            elif metric == "dotproduct":
                score = round(float(vector @ query), 6)
            else:
                score = -round(float(np.linalg.norm(vector - query)), 6)
            rows.append((-score if score is not None else np.inf, f"v{i}", names[i % 4]))
        groups = {name: [r for r in rows if r[2] == name] for name in names[:3]} if per_namespace else {"": rows}
        for group in groups.values():
            for rank, (worse, vid, name) in enumerate(sorted(group)[:k], 1):
                want.add((f"q{j}", name, vid, rank))
    return want


@pytest.mark.parametrize("metric", sr.METRICS)
@pytest.mark.parametrize("resident", [100, 4])
def test_top_k_equals_brute_force(spark, monkeypatch, metric, resident):
    monkeypatch.setattr(sr, "SLAB_ROWS", 10)  # many blocks, slabs and passes once the queries do not fit
    monkeypatch.setattr(sr, "PASS_BYTES", 8 * 12 * 9)
    v, a, vectors, queries, names = vectors_and_queries(spark)
    got = sr.top_k(a, v, 7, metric, resident=resident).collect()
    assert {(r.query_id, r.namespace, r.id, r["rank"]) for r in got} == brute(vectors, queries, names, 7, metric, False)
    every = sr.top_k_all(a, v, 3, metric=metric, resident=resident).collect()
    assert {(r.query_id, r.namespace, r.id, r["rank"]) for r in every} == brute(vectors, queries, names, 3, metric, True)


def test_top_k_blocks_do_not_change_results(spark, monkeypatch):
    v, a, vectors, queries, names = vectors_and_queries(spark)
    batch = v.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    matrix = np.array(queries)
    results = []
    for scores in (10, 1_000_000):
        monkeypatch.setattr(sr, "BLOCK_SCORES", scores)
        best = sr._Best(len(matrix), 4)
        sr._score_batch(best, batch, matrix, "cosine")
        results.append(sorted(best.rows([str(i) for i in range(len(matrix))], "cosine"), key=str))
    assert results[0] == results[1]


def test_top_k_filter_namespace_zero_and_empty(spark):
    v, a, vectors, queries, names = vectors_and_queries(spark)
    got = sr.top_k(a, v, 5, where=sr.metadata_where({"label": {"$in": [1, 2], "$gte": 2}})).collect()
    assert {(r.query_id, r.namespace, r.id, r["rank"]) for r in got} == brute(
        vectors, queries, names, 5, "cosine", False, lambda i: i % 5 == 2
    )
    assert {r.namespace for r in sr.top_k(a, v, 5, namespace="slack").collect()} == {"slack/"}
    last = sr.top_k(a, v, 300).where("id = 'v299'").collect()
    assert {(r.score, r["rank"]) for r in last} == {(None, 300)}
    assert sr.top_k(a, v.where("false"), 5).count() == 0
    assert sr.top_k(a.where("false"), v, 5).count() == 0
    carried = sr.top_k(a, v, 5, carry=["label"]).collect()
    assert len(carried) == 25 * 5 and all(int(r.id[1:]) % 5 == r.label for r in carried)
    for bad in (dict(metric="manhattan"), dict(k=0)):
        with pytest.raises(ValueError):
            sr.top_k(a, v, **bad)
    with pytest.raises(ValueError):
        sr.metadata_where({"label": {"$near": 1}})


def test_many_queries_never_shuffle_the_index(spark):
    v, a, *_ = vectors_and_queries(spark)
    ids = lambda df: sorted(map(tuple, df.collect()))
    plan = sr.top_k(a, v, 3, resident=8)._jdf.queryExecution().executedPlan().toString()
    assert ids(sr.top_k(a, v, 3, resident=8)) == ids(sr.top_k(a, v, 3))
    # What is exchanged is hits, above the pass over the index; nothing below the pass is.
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning" not in plan[plan.index("MapInArrow") :]


def clusters(spark, n=6000, dim=16, groups=40, seed=5):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((groups, dim))
    held = centres[draw.integers(0, groups, n)] + 0.25 * draw.standard_normal((n, dim))
    rows = [("ab"[i % 2], str(i), own.tolist(), i) for i, own in enumerate(held)]
    return spark.createDataFrame(rows, "namespace string, id string, values array<double>, place int")


def test_inverted_file_reads_a_share_and_finds_the_neighbours(spark):
    v = clusters(spark)
    path = ivf.build(v, scratch_path(spark, "t-ivf"))
    asked = v.where("place % 100 = 0").select(F.col("id").alias("query_id"), "values")
    exact = {(r.query_id, r.id): r.score for r in sr.top_k(asked, v, 5).collect()}
    hits = ivf.top_k(spark, path, asked, carry=["place"]).collect()
    found = {(r.query_id, r.id): r.score for r in hits}
    assert len(found) == 300 and all(int(r.id) == r.place for r in hits)
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(score - exact[key]) < 1e-9 for key, score in found.items() if key in exact)
    # A few queries open the directories of their cells only.
    few = asked.limit(2)
    cells = spark.read.parquet(f"{path}/vectors").select("cell").distinct().count()
    matrix = np.array([r["values"] for r in few.collect()])
    index = ivf.Index(spark, path)
    probes = index.probes
    read = ivf.probed_cells(index.centroids, matrix, probes)
    assert len(index.vectors(sorted(read)).inputFiles()) == len(read)
    assert cells == 77 and len(read) <= 2 * probes < cells / 2


def test_inverted_file_with_all_cells_is_exact(spark):
    v, a, *_ = vectors_and_queries(spark)
    rows = [("slack/", "null", None, 1), ("slack/", "zero", [0.0] * 6, 1), (None, "lost", [0.0] * 6, 1), ("drive/", "nan", [float("nan")] * 6, 1)]
    dims = len(v.first()["values"])
    odd = spark.createDataFrame([(n, i, None if x is None else x[:1] * dims, k) for n, i, x, k in rows], "namespace string, id string, values array<double>, label int")
    both = v.select("namespace", "id", "values", F.lit(1).alias("label")).unionByName(odd)
    path = ivf.build(both, scratch_path(spark, "t-ivf"), cells=7)
    ids = lambda df: sorted(map(tuple, df.select("query_id", "namespace", "id", "score", "rank").collect()), key=str)
    assert ids(ivf.top_k(spark, path, a, 4, probes=7)) == ids(sr.top_k(a, both, 4))
    assert ids(ivf.top_k(spark, path, a, 4, probes=2)) == ids(ivf.top_k(spark, path, a, 4, probes=2, resident=6))
    assert ids(ivf.top_k(spark, path, a, 400, probes=2)) == ids(sr.top_k(a, both, 400))
    lost = spark.createDataFrame([("q", [0.0] * dims), ("r", None)], "query_id string, values array<double>")
    assert ivf.top_k(spark, path, lost, 3).count() == sr.top_k(lost, both, 3).count() == 3
    assert ivf.top_k(spark, path, a.where("false"), 3).count() == 0
    assert spark.read.parquet(f"{path}/vectors").count() == both.count()
    empty = ivf.build(both.where("false"), scratch_path(spark, "t-ivf"))
    assert ivf.top_k(spark, empty, a, 3).count() == 0


def test_postings_search_skips_frequent_terms(spark, monkeypatch):
    draw = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    texts = ["the of and " * 6 + " ".join(draw.choice(words, 12)) + (f" rare{i % 300}" * 2) for i in range(1500)] + ["", None, " \n"] + [f"the cat {'of and ' * 9}"] * 2
    chunks = spark.createDataFrame([("ab"[i % 2], f"{i:04}", t) for i, t in enumerate(texts)], "namespace string, id string, content string")
    asked = [("q1", "the rare7 rare8"), ("q2", "the of and"), ("q3", "nowhere"), ("q4", ""), ("q5", None), ("q6", "w1 w2 rare9 of"), ("q7", "the")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    path = ps.build(chunks, scratch_path(spark, "t-postings"))
    vector = lambda df, col: {r[0]: {t.term: t.weight for t in r[1]} for r in df.select(df.columns[-2], ps.sparse_vector(F.col(col))).collect()}
    held = {k: v for k, v in vector(chunks.select("id", "content"), "content").items() if v}
    want = set()
    for q, own in vector(queries.select("query_id", "text"), "text").items():
        scores = [(-round(sum(x * own.get(t, 0.0) for t, x in terms.items()), 6), i) for i, terms in held.items()]
        want |= {(q, i, rank) for rank, (score, i) in enumerate(sorted(s for s in scores if s[0] < 0)[:5], 1)}
    read = []
    met = ps._met
    monkeypatch.setattr(ps, "_met", lambda s, p, a: read.append({(r.query_id, r.df) for r in a.collect()}) or met(s, p, a))
    got = {(r.query_id, r.id, r["rank"]) for r in ps.search(spark, path, queries, 5).collect()}
    assert got == want and len(got) >= 20
    # The list of "the", which is in every chunk, is not read for a query that rarer terms decide.
    assert not [(q, df, number) for number, step in enumerate(read) for q, df in step if df > 1000 and q in ("q1", "q6")]
    empty = ps.build(chunks.where("false"), scratch_path(spark, "t-postings"))
    assert ps.search(spark, empty, queries).count() == 0 and ps.search(spark, path, queries.where("false")).count() == 0


def test_queries_with_long_lists_pass_over_the_documents(spark, monkeypatch):
    """With the lists forbidden, cut short, or in several passes: the same hits, best k with ties by id, none without a positive score."""
    draw = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choice(words, 30)) for _ in range(900)] + ["", "alone", *["w1 w2 w3"] * 9]
    chunks = spark.createDataFrame([("ab"[i % 2], f"{i // 2:04}", t) for i, t in enumerate(texts)], "namespace string, id string, content string")
    asked = [(f"q{i}", " ".join(draw.choice(words, 9))) for i in range(20)] + [("same", "w1 w2 w3"), ("none", "nowhere"), ("one", "alone"), ("null", None)]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    odd = spark.createDataFrame([(None, "n", "w1 w2 w3"), ("a", None, "w4 w5"), ("a", "twice", "w6 w7"), ("a", "twice", "w7 w8 w9")], chunks.schema)
    queries = queries.unionByName(queries.where("query_id IN ('q3', 'one')"))
    path = ps.build(chunks.unionByName(odd), scratch_path(spark, "t-postings"))
    found = lambda: sorted(map(tuple, ps.search(spark, path, queries, 5).select("query_id", "namespace", "id", "score", "rank").collect()))
    monkeypatch.setattr(ps, "WORTH", 1e9)
    want, passes = found(), []
    one = ps._pass
    monkeypatch.setattr(ps, "_pass", lambda *given: passes.append(given[2].num_rows) or one(*given))
    for worth, resident, block in ((8, 1 << 20, 2_000_000), (8, 60, 50)):
        monkeypatch.setattr(ps, "WORTH", worth)
        monkeypatch.setattr(ps, "RESIDENT_TERMS", resident)
        monkeypatch.setattr(ps, "BLOCK_SCORES", block)
        passes.clear()
        assert found() == want and len(want) == 106 and (len(passes) > 1) == (resident == 60) and sum(passes) > 150
    monkeypatch.setattr(ps, "WORTH", 0)
    monkeypatch.setattr(ps, "LONG", 0)
    assert found() == want


def test_hash_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([("one two two",), ("One TWO two",), ("",), (None,), ("éa éa",)], "content string")
    rows = em.embed_hash(df).collect()
    assert len(rows) == 3
    assert all(abs(sum(x * x for x in r["values"]) - 1) < 1e-9 for r in rows)
    assert rows[0]["values"] == rows[1]["values"]
    endpoint = em.embed_endpoint(df).collect()
    assert [(r["values"] is None, r.token_count) for r in endpoint] == [(False, 3), (False, 3), (True, 0), (True, 0), (False, 2)]


def test_endpoint_tells_what_the_call_has_cost(spark):
    df = spark.createDataFrame([(i, "word " * 125_000) for i in range(4)] + [(4, None), (5, "")], "i int, content string")
    for budget, share in ((0.04, 25.0), (0.0, 0.0)):
        rows = em.embed_endpoint(df.repartition(3), budget=budget).collect()
        told = {(r.model, r.total_tokens, r.total_cost_usd, r.monthly_budget_usd, r.budget_used_percent) for r in rows}
        assert len(rows) == 6 and told == {("text-embedding-3-small", 500_000, 0.01, budget, share)}
    assert em.embed_endpoint(df.where("false")).count() == 0


def test_model_failure_costs_only_its_batch(spark):
    def load():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError
            return [[1.0]] * len(texts)

        return model

    df = spark.createDataFrame([("a",), ("bad",), ("b",), ("c",), (" ",)], "content string").coalesce(1)
    got = [(r.content, r["values"]) for r in em.embed_model(df, load, batch=2).collect()]
    assert got == [("a", None), ("bad", None), ("b", [1.0]), ("c", [1.0])]


@pytest.mark.parametrize("slices", [1, 5])
def test_running_total_with_one_hot_group(spark, slices):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), i % 7, i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t int, i int, x int").repartition(6)
    got = {r.i: r.running for r in rn.running_total(df, F.col("x"), ["t", "i"], ["g"], slices=slices).collect()}
    want, sums = {}, {}
    for g, t, i, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        sums[g] = sums.get(g, 0) + x
        want[i] = sums[g]
    assert got == want
    batches = rn.with_batch(df, ["t", "i"], ["g"], size=100).groupBy("g", "batch").count().collect()
    assert all(r["count"] <= 100 for r in batches) and sum(r["count"] for r in batches) == 400


def test_budget_gate_limits(spark):
    df = spark.createDataFrame([("m", i, c) for i, c in enumerate([50.0, 25.0, 25.0, 0.5])], "month string, i int, cost_usd double")
    got = bg.budget_gate(df, ["i"]).orderBy("i").collect()
    assert [(r.accepted, r.state) for r in got] == [(True, "ok"), (True, "alert"), (True, "alert"), (False, "halted")]
    assert [r.accepted for r in bg.batch_gate(df).collect()] == [False] * 4
    assert [r.accepted for r in bg.batch_gate(df, cap=100.5).collect()] == [True] * 4
    zero = bg.budget_gate(df, ["i"], cap=0.0).collect()
    assert {r.state for r in zero} == {"halted"}
    costed = bg.with_cost(spark.createDataFrame([(1_000_000, "other")], "tokens int, model string"), F.col("model")).first()
    assert costed.cost_usd == pytest.approx(0.02)


def test_even_allocation(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([10, 11, 12, 7])], "i int, tokens int")
    rows = bg.even_allocation(df, ["i"], size=3).orderBy("i").collect()
    assert [r.allocated_tokens for r in rows] == [11, 11, 11, 7]
    assert rows[0].allocated_cost_usd == pytest.approx(33 * 0.02 / 1e6 / 3)


def test_upsert_replace_delete(spark):
    schema = "namespace string, id string, doc_id string, x int"
    index = spark.createDataFrame([("s/", f"d-{i}", "d", i) for i in range(3)] + [("n/", "e-0", "e", 9)], schema)
    new = spark.createDataFrame([("s/", "d-0", "d", 7), ("s/", "d-0", "d", 8), ("s/", "f-0", "f", 1)], schema)
    stamped = index.withColumn("indexed_at", NOW)
    once = ix.upsert(stamped, new, NOW, newest=["x"])
    state = lambda df: sorted((r.namespace, r.id, r.x) for r in df.collect())
    assert state(once) == [("n/", "e-0", 9), ("s/", "d-0", 8), ("s/", "d-1", 1), ("s/", "d-2", 2), ("s/", "f-0", 1)]
    assert state(ix.upsert(once, new, NOW, newest=["x"])) == state(once)
    shorter = spark.createDataFrame([("s/", "d-0", "d", 5)], schema)
    assert state(ix.replace_docs(index, shorter)) == [("n/", "e-0", 9), ("s/", "d-0", 5)]
    gone = spark.createDataFrame([("s/", "d")], "namespace string, doc_id string")
    assert state(ix.replace_docs(index, shorter.where("false"), gone)) == [("n/", "e-0", 9)]
    ids = spark.createDataFrame([("s/", "e-0"), ("s/", "d-1")], "namespace string, id string")
    assert len(state(ix.delete(index, ids))) == 3
    stats = {r.namespace: r.vector_count for r in ix.index_stats(index.withColumn("values", F.array(F.lit(1.0)))).collect()}
    assert stats == {"s/": 3, "n/": 1, None: 4}


def test_dedup_keeps_every_content(spark):
    get = lambda rows: sorted(map(tuple, ix.dedup(spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")).collect()), key=str)
    rows = [(1, "a", None), (2, "a", None), (2, "b", None), (3, "c", None)]
    assert get(rows) == [(1, "a", None), (2, "b", None), (3, "c", None)]
    assert get([(None, "a", None), (2, "a", None), (None, "b", None), (None, "b", None)]) == [(2, "a", None), (None, "b", None)]
    assert get([(4, None, None), (5, None, None), (None, None, None), (5, "", None)]) == [(4, None, None), (5, "", None)]
    same = [(7, "x", {"k": 1})] * 5 + [(7, "x", {"k": 2})] * 3 + [(7, "y", {"k": 1})] * 2
    got = get(same)
    assert len(got) == 2 and got[0][:2] == (7, "x") and got[0][2] in ({"k": 1}, {"k": 2}) and got[1] == (7, "y", {"k": 1})
    assert get([]) == []


def test_dedup_changes_and_sync(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "doc_id int, text string")
    assert sorted(r.doc_id for r in ix.dedup(df).collect()) == sorted({0, 1} | {i for i in range(0, 30, 3)})
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, None)], "doc_id int, text string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (5, None)], "doc_id int, text string")
    assert {r.doc_id: r.status for r in ix.change_detect(old, new).collect()} == {
        1: "unchanged", 2: "changed", 3: "deleted", 4: "new", 5: "unchanged"
    }
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1)], "source string, modified int")
    marks = spark.createDataFrame([("a", 3)], "source string, last_seen int")
    fresh = ix.since(rows, marks)
    assert sorted(map(tuple, fresh.collect())) == [("a", 5), ("b", 1)]
    assert ix.since(rows, ix.next_marks(fresh, marks)).count() == 0


def test_cache(spark):
    rows = spark.createDataFrame(
        [("a", "1", "2024-01-09 00:00:00", None), ("a", "2", "2024-01-09 12:00:00", 43200), ("b", "3", "2024-01-09 12:00:00", 0)],
        "key string, value string, at string, ttl_seconds int",
    ).withColumn("created_at", F.col("at").cast("timestamp"))
    cache = ca.cache_put(ca.cache_entries(rows.where("false")), rows)
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r.key: (r.state, r.value) for r in ca.cache_get(cache, asked, NOW).collect()}
    assert got == {"a": ("hit", "2"), "b": ("expired", None), "c": ("miss", None)}  # expiry itself is still valid
    assert ca.cache_purge(cache, NOW).count() == 1 and ca.purge_count(cache, NOW).first().purged == 1
    stats = ca.cache_stats(cache.withColumn("expires_at", F.when(F.col("key") == "a", F.col("expires_at"))), NOW).first()
    assert (stats.total_entries, stats.valid_entries, stats.expired_entries, stats.total_size_bytes) == (2, 1, 1, 2)
    assert ca.cache_delete(cache, asked).count() == 0


def test_governance(spark):
    items = spark.createDataFrame([("s", 0, 24), ("s", 0, 25), ("s", 0, None)], "source string, a int, b int").select(
        "source",
        (NOW + F.make_dt_interval(F.lit(0), F.col("a"))).alias("deleted_at"),
        (NOW + F.make_dt_interval(F.lit(0), F.col("b"))).alias("purged_at"),
    )
    row = gv.deletion_sla(items).first()
    assert (row.deletions, row.within_sla, row.late, row.open, row.max_hours) == (3, 1, 1, 1, 25.0)
    calls = spark.createDataFrame([(i < 2,) for i in range(10)], "failed boolean").withColumn("ts", NOW)
    assert gv.failure_rate(calls).first().mode == "batch"
    assert gv.failure_rate(calls, threshold=0.2).first().mode == "streaming"


def message_frame(spark, rows):
    return spark.createDataFrame(rows, "channel_id string, message_id string, minute int, thread string, text string").select(
        "channel_id",
        "message_id",
        (NOW + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))).alias("ts"),
        F.when(F.col("thread").isNotNull(), NOW).alias("thread_ts"),
        "text",
    )


def test_messages(spark):
    rows = [("c1", f"m{i}", i, "t", "x") for i in range(20)] + [("c2", "n0", 0, None, "y")]
    df = message_frame(spark, rows)
    order = {r.message_id: (r.reply_index, r.thread_size) for r in ms.threads(df).collect()}
    assert order == {f"m{i}": (i, 20) for i in range(20)}
    late = NOW + F.make_dt_interval(F.lit(30), F.lit(0), F.lit(10))
    assert {r.message_id for r in ms.recent_messages(df, late, 30, 3).collect()} == {"m19", "m18", "m17"}
    channels = spark.createDataFrame(
        [("c1", False, "public_channel"), ("c2", False, "private_channel"), ("c3", True, "public_channel"), ("c4", False, "im")],
        "channel_id string, is_archived boolean, type string",
    )
    assert [r.channel_id for r in ms.filter_channels(channels).collect()] == ["c1", "c2"]
    assert ms.filter_channels(channels, limit=1).count() == 1
    assert [r.channel_id for r in ms.public_only(channels).collect()] == ["c1", "c3"]
    sample = ms.quota_sample(df, channels, n=8).collect()
    assert sorted(r.message_id for r in sample) == ["m18", "m19", "n0"]
    assert ms.quota_sample(df, channels, n=2).count() == 2


def test_page_titles_and_blocks(spark):
    pages = [
        '{"page_id":"1","properties":{"name":{"type":"title","title":[{"plain_text":"low"}]},"Name":{"type":"title","title":[{"plain_text":"top"}]}},'
        '"blocks":[{"type":"paragraph","paragraph":{"rich_text":[{"plain_text":"a"},{"plain_text":"b"}]}},{"type":"code","code":{"text":"c"}},{"x":1},'
        '{"type":"divider","divider":{}},{"type":"p","p":{"rich_text":[],"text":"no"}},{"type":"gone"}]}',
        '{"page_id":"2","properties":{"Name":{"type":"select"},"Title":{"type":"title","title":[]},"title":{"type":"title","title":[{}]}},"blocks":[]}',
        '{"page_id":"3","properties":{}}',
    ]
    path = scratch_path(spark, "pages-test")
    spark.createDataFrame([(p,) for p in pages], "value string").write.text(path)
    rows = {r.page_id: r for r in ex.read_pages(spark, path).collect()}
    assert (rows["1"].title, rows["1"].text_content, rows["1"].block_count) == ("top", "a\nb\nc", 6)
    assert (rows["2"].title, rows["2"].text_content, rows["2"].block_count) == ("Untitled", "", 0)
    assert (rows["3"].title, rows["3"].text_content, rows["3"].block_count) == ("Untitled", "", 0)
    union = ex.read_corpus(spark, {"notion": path, "drive": path + "-missing"})
    assert union.count() == 3
    with pytest.raises(FileNotFoundError):
        ex.read_corpus(spark, {"drive": path + "-missing"})


def test_messages_json_array_and_defaults(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"channel_id":"c","timestamp":"1704067200.000100","text":null},{"timestamp":"x"}]')
    rows = ex.read_messages(spark, str(tmp_path / "m.json"), multi_line=True).orderBy("ts").collect()
    assert rows[0].ts is None and rows[1].ts.microsecond == 100
    assert (rows[1].channel_name, rows[1].user_id, rows[1].text) == ("unknown", "unknown", "")


def test_files_by_mime(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("né".encode())
    (tmp_path / "b.pdf").write_bytes(b"ok\xff\xfe!")
    (tmp_path / "c.gsheet").write_text("x,y")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert (rows["a.txt"].content, rows["a.txt"].format) == ("né", "text/plain")
    assert (rows["b.pdf"].content, rows["b.pdf"].format) == ("ok!", "application/pdf")
    assert (rows["c.gsheet"].content, rows["c.gsheet"].format) == ("x,y", "text/csv")


def test_files_are_listed_by_the_tasks(spark, tmp_path, monkeypatch):
    """The driver sees folders, never files, and what is found is what Spark's own reader finds."""
    for name in ("a.txt", "b.pdf", "_c.txt", ".d.txt", "x/e é %20.txt", "x/y/f.txt", "_z/g.txt", "k=1/_h=1.txt", "k=1/i.TXT", "x/empty.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else f"{name}\n".encode() + b"\xff")
    (tmp_path / "nothing").mkdir()
    rows = lambda df: sorted(map(tuple, df.selectExpr("path", "modificationTime", "length", "hex(content)").collect()))
    for pattern in (None, "*.txt", "[a-f]*.{txt,pdf}"):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        want = rows((reader.option("pathGlobFilter", pattern) if pattern else reader).load(str(tmp_path)))
        for most in (10_000, 1, 0):
            monkeypatch.setattr(files, "FOLDERS", most)
            for place in (str(tmp_path), f"file://{tmp_path}"):
                assert rows(files._binary_files(spark, place, pattern)) == want and len(want) >= 4
        monkeypatch.setattr(files, "FOLDERS", 10_000)
    assert read_files(spark, str(tmp_path)).inputFiles() == []
    single = read_files(spark, str(tmp_path / "a.txt")).first()
    assert (single.size, single.content) == (7, "a.txt\n")
    assert read_files(spark, str(tmp_path / "nothing")).count() == 0


def test_identity(spark):
    row = spark.range(1).select(
        idn.namespace_of(F.lit("slack")).alias("a"),
        idn.namespace_of(F.lit("mail")).alias("b"),
        idn.vector_id(F.lit("s"), F.lit(None).cast("string"), F.lit(1)).alias("c"),
        idn.vector_id(F.lit("s"), F.lit("7"), F.lit(1)).alias("d"),
        cx.citation(F.lit(1), F.lit("slack"), F.lit(None).cast("string"), F.lit("")).alias("e"),
    ).first()
    assert tuple(row) == ("slack/", "default", None, "s-7-1", "1. Slack")


def hits_frame(spark):
    rows = [
        ("q", "slack/", "a", 0.5, "low slack words. Other.", "u", "2024-01-09 00:00:00"),
        ("q", "drive/", "b", 0.9, "best drive words", None, "2024-01-09 00:00:00"),
        ("q", "notion/", "c", 0.7, "", "u", "2024-01-09 00:00:00"),
        ("q", "notion/", "d", 0.6, "old", "u", "2023-01-09 00:00:00"),
    ]
    return spark.createDataFrame(
        rows, "query_id string, namespace string, id string, score double, content string, url string, at string"
    ).withColumn("ts", F.col("at").cast("timestamp"))


def test_context_ranking_and_summaries(spark):
    hits = hits_frame(spark)
    first = lambda ranking: cx.answer_context(hits, 1, ranking=ranking).first().context
    assert first("score") == "Source: drive\nContent: best drive words"
    assert first("source_order") == "Source: slack\nContent: low slack words. Other."
    queries = spark.createDataFrame([("q", "drive words"), ("p", "nothing")], "query_id string, text string")
    got = {r.query_id: r.summary for r in cx.extractive_summary(queries, cx.answer_context(hits), 1).collect()}
    assert got == {"q": "Content: best drive words.", "p": cx.NO_INFORMATION}
    lines = [r.line for r in cx.citations(hits.withColumn("timestamp", F.col("at"))).orderBy("rank").collect()]
    assert lines[0] == "1. Drive (2024-01-09)" and lines[1].startswith("2. Notion - <u|Link> (2023")


def test_digest_window_and_render(spark):
    items = cx.digest(hits_frame(spark), NOW, 7)
    assert [(r.position, r.id) for r in items.orderBy("position").collect()] == [(1, "b"), (2, "c"), (3, "a")]
    order = cx.digest(hits_frame(spark), NOW, 7, ranking="source_order").orderBy("position").collect()
    assert [r.id for r in order] == ["a", "c", "b"]
    body = spark.createDataFrame([("text",)], "digest string")
    stats = spark.createDataFrame([(1234567,)], "total_vector_count bigint")
    message = cx.render_digest(body, stats, NOW).first().message
    assert message.startswith("📊 *Weekly Knowledge Digest* | Jan 03 - Jan 10, 2024\n\ntext") and "1,234,567" in message
    assert "Documents: N/A" in cx.render_digest(body, stats.where("false"), NOW).first().message


def test_model_summary_texts(spark):
    def load():
        def model(text, context):
            if context == "bad":
                raise RuntimeError
            return text + context

        return model

    df = spark.createDataFrame([("q", "c"), ("q", "bad"), ("q", None)], "text string, context string")
    assert [r.summary for r in cx.model_summary(df, load).collect()] == ["qc", cx.FAILED_SUMMARY, cx.NO_INFORMATION]


def test_index_sink_replaces_only_touched_namespaces(spark):
    v, *_ = vectors_and_queries(spark, n=20)
    path = write_index(v, scratch_path(spark, "sink-test"))
    overwrite_namespaces(v.where("namespace = 'slack/'").limit(1), path)
    counts = {r.namespace: r["count"] for r in spark.read.parquet(path).groupBy("namespace").count().collect()}
    assert counts == {"slack/": 1, "notion/": 5, "drive/": 5, "default": 5}


def test_replacing_one_document_rewrites_one_bucket(spark):
    rows = [("a/b" if i % 2 else "c d=", f"d{i // 2}", str(i), "first") for i in range(200)]
    frame = spark.createDataFrame(rows, "namespace string, doc_id string, id string, version string")
    path = sinks.write_buckets(frame, scratch_path(spark, "t-buckets"), 8)
    files = lambda: set(spark.read.parquet(path).inputFiles())
    before = files()
    new = spark.createDataFrame([("a/b", "d3", "7a", "second"), ("a/b", "d3", "7b", "second"), ("a/b", "d99", "0", "not asked")], frame.schema)
    docs = new.where("doc_id = 'd3'").select("namespace", "doc_id")
    assert len(sinks.replace_documents(new, docs, path, 8)) == 1
    assert len(before - files()) == 1 and len(files() - before) == 1
    want = {(n, d, i, v) for n, d, i, v in rows if (n, d) != ("a/b", "d3")} | {("a/b", "d3", "7a", "second"), ("a/b", "d3", "7b", "second")}
    got = lambda: {tuple(r) for r in spark.read.parquet(path).select("namespace", "doc_id", "id", "version").collect()}
    assert got() == want
    # nothing is left of them
    sinks.replace_documents(new.where("false"), frame.where("namespace = 'a/b'").select("namespace", "doc_id"), path, 8)
    assert got() == {row for row in want if row[0] == "c d="}


def test_vectors_of_different_lengths_are_refused(spark):
    ragged = spark.createDataFrame(
        [("n", str(i), [1.0] * n) for i, n in enumerate((3, 3, 2, 4))], "namespace string, id string, values array<double>"
    ).coalesce(1)
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, values array<double>")
    for vectors in (ragged, ragged.where("size(values) = 2")):
        with pytest.raises(Exception, match="dimension"):
            sr.top_k(asked, vectors, 2).collect()


def test_dimension_comes_from_all_rows(spark):
    rows = [("n", None), ("n", [1.0, 2.0]), ("m", [1.0, 2.0, 3.0])]
    stats = ix.index_stats(spark.createDataFrame(rows, "namespace string, values array<double>")).collect()
    got = {r.namespace: (r.vector_count, r.dimension, r.least_dimension) for r in stats}
    assert got == {"n": (2, 2, 2), "m": (1, 3, 3), None: (3, 3, 2)}


def test_upsert_takes_rows_with_maps(spark):
    schema = "namespace string, id string, extra map<string,string>"
    new = spark.createDataFrame([("n", "1", {"a": "1"}), ("n", "1", {"a": "2"}), ("n", "2", None)], schema)
    index = spark.createDataFrame([("n", "1", {"a": "0"})], schema).withColumn("indexed_at", NOW)
    got = {r.id: r.extra for r in ix.upsert(index, new, NOW).collect()}
    assert got == {"1": {"a": "2"}, "2": None}


def test_no_caps_unless_asked(spark):
    channels = spark.range(150).selectExpr("CAST(id AS STRING) channel_id", "'public_channel' type", "false is_archived")
    assert ms.filter_channels(channels).count() == 150
    messages = spark.range(700).selectExpr("'c' channel_id", "CAST(id AS STRING) message_id").withColumn("ts", NOW)
    assert ms.recent_messages(messages, NOW, 1).count() == 700
    files = spark.range(150).selectExpr("CAST(id AS STRING) file_id", "array('f') parents", "'t' mime_type", "'n' name", "'x' content")
    assert ex.list_files(files, "f").count() == ex.search_files(files, "x").count() == 150


def test_scratch_goes_with_its_scope(spark):
    import os

    v, a, *_ = vectors_and_queries(spark)
    folder = shared_folder(spark).removeprefix("file://") + "/lorekeep"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    with scratch_scope(spark) as scope:
        path = ivf.build(v, scratch_path(spark, "t-ivf"), cells=4)
        assert path.startswith(scope) and ivf.top_k(spark, path, a, 3, resident=8).count() == 75
        with pytest.raises(ZeroDivisionError), scratch_scope(spark):
            v.write.parquet(scratch_path(spark, "t-inner"))
            1 / 0
        assert len(os.listdir(scope.removeprefix("file://"))) > 1
    assert set(os.listdir(folder)) == before
    assert not scratch_path(spark, "t-after").startswith(scope)


def test_files_are_written_whole_and_without_checksums(spark):
    """Hadoop's writer leaves a checksum beside each local file and starts processes for both."""
    rows = spark.createDataFrame([("txt", b"a\nb"), ("txt", b""), ("pdf", b"\xffc"), ("pdf", None), (None, b"d")] * 20, "kind string, body binary")
    folder = sinks.write_files(rows.repartition(3), scratch_path(spark, "t-files"))
    back = read_files(spark, folder, pattern="*.txt", kind=F.regexp_extract("path", "kind=([^/]+)/", 1))
    found = back.groupBy("mime_type", "size", "content").count().collect()
    assert sorted(map(tuple, found)) == [
        ("application/octet-stream", 2, "d\n", 20), ("application/pdf", 1, "\n", 20), ("application/pdf", 3, "c\n", 20),
        ("text/plain", 1, "\n", 20), ("text/plain", 4, "a\nb\n", 20),
    ]
    names = [name for _, _, names in os.walk(folder.removeprefix("file:")) for name in names]
    assert len(names) == 100 and all(name.endswith(".txt") for name in names)


def test_vectors_are_made_in_bounded_parts():
    tokens = pa.array([["a"] * 300_000, None, [], ["b"] * 300_000, ["c"], ["d"] * 700_000, ["e"]])
    met = []
    made = em.in_parts(tokens, lambda part: met.append(sum(len(row or ()) for row in part.to_pylist())) or pc.list_value_length(part))
    assert made.equals(pc.list_value_length(tokens)) and met == [300_000, 300_001, 700_000, 1]
    assert len(em.in_parts(tokens.slice(0, 0), pc.list_value_length)) == 0


@pytest.mark.parametrize("k", [1, 5, 400])
def test_contenders_hold_the_best_of_every_query(k):
    rng = np.random.default_rng(3)
    scores = np.round(rng.standard_normal((7, 1000)), 2)
    scores[1, 10:400], scores[2, 5], scores[3], scores[4, 990:] = 1.0, np.nan, np.nan, 9.0
    scores[5, :3] = -np.inf
    asked, rows, good = sr._contenders(scores, np.full(7, -np.inf), k)
    clean = np.where(np.isnan(scores), -np.inf, scores)
    for j in range(7):
        mine = asked == j
        met = sorted(zip(-good[mine], rows[mine]))[:k]
        assert met == sorted(zip(-clean[j], range(1000)))[:k]
    assert k > 1 or len(rows[asked == 0]) < 100
