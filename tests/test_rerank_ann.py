"""MMR against a plain greedy loop; IVF recall with every list probed; discovery shapes."""

import numpy as np

from canopy.operators import ann, discovery as dv, vectors as vo
from canopy.operators.rerank import mmr_rerank


def _pool(spark, n=12, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    q = m[0]
    rows = [(1, str(i), float(m[i] @ q), [float(x) for x in m[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, id string, score double, vector array<float>"), m, q


def test_mmr_matches_greedy_loop(spark):
    df, m, q = _pool(spark)
    got = [r["id"] for r in mmr_rerank(df, k=4, lam=0.5).orderBy("mmr_rank").collect()]
    mm = np.array([np.asarray(r["vector"], dtype=np.float64) for r in df.orderBy("id").collect()])
    ids = [r["id"] for r in df.orderBy("id").collect()]
    rel = {r["id"]: r["score"] for r in df.collect()}
    order = sorted(ids, key=lambda i: (-rel[i], i))
    chosen = []
    while len(chosen) < 4:
        best, bval = None, -np.inf
        for i in order:
            if i in chosen:
                continue
            red = max((float(mm[ids.index(i)] @ mm[ids.index(c)]) for c in chosen), default=0.0)
            v = 0.5 * rel[i] - 0.5 * red
            if v > bval:
                best, bval = i, v
        chosen.append(best)
    assert got == chosen and got[0] == "0"


def test_ivf_recall_all_lists(spark):
    df, m, q = _pool(spark, n=40)
    corpus = df.select("id", "vector")
    piv = ann.kmeans_pivots(corpus, n_lists=4)
    idx = ann.assign_lists(corpus, piv)
    qs = df.where("id in ('1', '2')").select(df["id"].cast("long").alias("query_id"), "vector")
    approx = ann.ivf_topk(idx, qs, piv, 5, nprobe=4)
    exact = vo.topk_similar_batch(corpus, qs, 5)
    assert all(r["recall"] == 1.0 for r in ann.recall_at_k(approx, exact).collect())


def test_recall_at_the_probes_of_the_query(spark):
    from canopy.plans import q_retrieval as q
    assert q.RECALL_NPROBE < q.RECALL_LISTS
    got = [r["recall"] for r in q.q_ann_recall(spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == 30 and np.mean(got) >= 0.9


def test_discovery_shapes(spark):
    df, m, q = _pool(spark, n=30)
    files = df.select("id", "vector").withColumnRenamed("id", "file_id")
    doms = dv.discover_domains(files, k=3).collect()
    assert len(doms) == 3 and all(abs(sum(x * x for x in d["vector"]) - 1) < 1e-5 for d in doms)


def test_stored_index_reads_probed_lists_only(spark, tmp_path):
    from canopy.sources.store import TableStore
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # a long folder name would be shortened in the plan
    tmp_path = tmp_path / ("n" * 150)
    df, m, q = _pool(spark, n=60)
    bad = spark.createDataFrame([("null", None), ("nan", [float("nan")] * 6), ("short", [1.0])], "id string, vector array<float>")
    corpus = df.select("id", "vector").unionByName(bad)
    piv = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(6)], "list_id int, vector array<double>")
    store = TableStore(spark, f"file://{tmp_path}")
    ann.write_index(store, "ix", corpus, piv)
    assert store.read("ix").count() == 60
    qs = df.where("id in ('1', '2')").select(df["id"].cast("long").alias("query_id"), "vector")
    got = ann.search_index(store, "ix", qs, 5, nprobe=1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    probed = sorted({r["list_id"] for r in ann.probes(qs, piv, 1).collect()})
    assert probed == [1, 2]
    scan = next(line for line in plan.splitlines() if "/ix/" in line)
    assert "list_id" in scan.split("PartitionFilters: [")[1].split("]")[0]
    exact = {(r["query_id"], r["rank"], r["id"]) for r in vo.topk_similar_batch(df.select("id", "vector"), qs, 5).collect()}
    for budget in (0, 1 << 20):  # joined by a shuffle, then by a broadcast
        full = ann.ivf_topk(store.read("ix"), qs, piv, 5, nprobe=6, max_broadcast_bytes=budget)
        assert {(r["query_id"], r["rank"], r["id"]) for r in full.collect()} == exact
    assert ann.search_index(store, "ix", qs.limit(0), 5).count() == 0


def _two_bundles(spark, n=40):
    """Domain 0: two bundles of directions; domain 1: one file; domain 2: copies of one vector; a zero and a null vector."""
    rng = np.random.default_rng(3)
    rows = [(0, f"a{i}", [float(x) for x in np.eye(4)[i % 2] + rng.normal(scale=0.05, size=4)]) for i in range(n)]
    rows += [(1, "b", [0.0, 0.0, 1.0, 0.0])] + [(2, f"c{i}", [0.0, 0.0, 0.0, 2.0]) for i in range(9)]
    rows += [(0, "zero", [0.0] * 4), (0, "null", None)]
    return spark.createDataFrame(rows, "domain_id int, file_id string, vector array<float>")


def test_subtopics_over_all_files(spark):
    subs, members = dv.discover_subtopics(_two_bundles(spark).repartition(5), max_sub=2)
    got = {(r["domain_id"], r["pos"]): r["vector"] for r in subs.collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (2, 0)}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in got.values())
    of = {r["file_id"]: r["pos"] for r in members.collect()}
    assert len(of) == 50 and len({of[f"a{i}"] for i in range(0, 40, 2)}) == 1 and of["a0"] != of["a1"]
    empty, none = dv.discover_subtopics(_two_bundles(spark).limit(0))
    assert empty.count() == none.count() == 0


def test_first_files_are_limited_before_the_exchange(spark):
    unit = _two_bundles(spark).selectExpr("domain_id", "file_id", "vector as u").repartition(5)
    first = dv._first_files(unit, 2, "file_id")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted((r["domain_id"], r["pos"]) for r in first.collect()) == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)]


def test_titles_from_content(spark):
    members = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "d")], "domain_id int, file_id string")
    texts = spark.createDataFrame([("a", "Login token, the login"), ("b", "login the page"), ("c", "the of chart axis"), ("d", None)],
                                  "file_id string, text string")
    t = {r["domain_id"]: r["title"] for r in dv.cluster_titles(members, texts, ["domain_id"], n_terms=2).collect()}
    assert t == {0: "login, the", 1: "axis, chart"}
    topics = spark.createDataFrame([(0, 0, "domain-1"), (1, 1, "domain-2"), (2, 2, "domain-3")], "domain_id int, pos int, title string")
    same = spark.createDataFrame([(0, "x"), (1, "x")], "domain_id int, title string")
    named = {r["pos"]: r["title"] for r in dv.with_titles(topics, same, ["domain_id"], []).collect()}
    assert named == {0: "x", 1: "x (2)", 2: "domain-3"}
