"""Vector operators: normalisation, cosine forms, top-k, IVF, quality identity, upsert."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from canopy.functions import vector as vx
from canopy.operators import ann, ontology as on, vectors as vo


def corpus(spark, n=60, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return spark.createDataFrame([(str(i), [float(x) for x in m[i]]) for i in range(n)], "id string, vector array<float>"), m


def test_normalize_zero_and_mismatch(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0, 0.0], [1.0, 0.0])],
                               "a array<float>, b array<float>")
    r = df.select(vx.normalize("a").alias("n"), vx.cosine("a", "b").alias("c")).collect()
    assert [round(x, 6) for x in r[0]["n"]] == [0.6, 0.8]
    assert r[1]["n"] == [0.0, 0.0] and r[1]["c"] == 0.0  # zero vector kept, cosine 0
    assert r[2]["c"] == 0.0  # lenient: length mismatch -> 0


def test_topk_matches_numpy(spark):
    df, m = corpus(spark)
    q = m[5]
    got = [r["id"] for r in vo.topk_similar(df, q.tolist(), 7).orderBy("rank").collect()]
    exp = [str(i) for i in np.argsort(-(m @ q), kind="stable")[:7]]
    assert got == exp and got[0] == "5"  # the node itself is included (by-id semantics)
    assert vo.topk_similar(df, q.tolist(), 0).count() == 0
    assert vo.topk_similar(df, q.tolist(), 1000).count() == 60  # k larger than the corpus


def test_batch_equals_single(spark):
    df, m = corpus(spark)
    qs = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in (1, 2, 3)], "query_id long, vector array<float>")
    b = vo.topk_similar_batch(df, qs, 5)
    for i in (1, 2, 3):
        single = [r["id"] for r in vo.topk_similar(df, m[i].tolist(), 5).orderBy("rank").collect()]
        batch = [r["id"] for r in b.where(F.col("query_id") == i).orderBy("rank").collect()]
        assert single == batch


def test_ivf_all_lists_equals_exact(spark):
    df, m = corpus(spark)
    piv = spark.createDataFrame([(i, [float(x) for x in m[i * 7]]) for i in range(6)], "list_id int, vector array<float>")
    qs = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in (0, 11, 22)], "query_id long, vector array<float>")
    idx = ann.assign_lists(df, piv)
    approx = ann.ivf_topk(idx, qs, piv, 5, nprobe=6)
    exact = vo.topk_similar_batch(df, qs, 5)
    a = sorted((r["query_id"], r["id"], r["rank"]) for r in approx.collect())
    e = sorted((r["query_id"], r["id"], r["rank"]) for r in exact.collect())
    assert a == e


def test_quality_identity_equals_pair_loop(spark):
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(30, 5))
    vecs[4] = 0.0  # zero vector: cosine 0 in the pair loop
    dom = [i % 3 for i in range(30)]
    df = spark.createDataFrame([(str(i), dom[i], [float(x) for x in vecs[i]]) for i in range(30)],
                               "file_id string, domain_id int, vector array<float>")
    q = on.cluster_quality(df).first()
    tot, n = 0.0, 0
    for d in range(3):
        members = [i for i in range(30) if dom[i] == d]
        for i, j in itertools.combinations(members, 2):
            a, b = vecs[i].astype(np.float32).astype(np.float64), vecs[j].astype(np.float32).astype(np.float64)
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            tot += 0.0 if na == 0 or nb == 0 else float(a @ b / (na * nb))
            n += 1
    assert q["n_pairs"] == n and math.isclose(q["avg_similarity"], tot / n, abs_tol=1e-9)


def test_upsert_latest_wins(spark):
    old = spark.createDataFrame([("a", "m", 2, [1.0, 0.0], 1), ("b", "m", 2, [0.0, 1.0], 1)],
                                "id string, model string, dim int, vector array<float>, batch long")
    new = spark.createDataFrame([("a", "m", 2, [3.0, 4.0], 2)], "id string, model string, dim int, vector array<float>, batch long")
    r = {x["id"]: x for x in vo.upsert_embeddings(old, new).collect()}
    assert r["a"]["batch"] == 2 and [round(v, 6) for v in r["a"]["vector"]] == [0.6, 0.8] and r["b"]["batch"] == 1


def test_pair_similarity_null_when_missing(spark):
    df, m = corpus(spark, n=3)
    pairs = spark.createDataFrame([("0", "1"), ("0", "nope")], "a_id string, b_id string")
    r = {(x["a_id"], x["b_id"]): x["score"] for x in vo.pair_similarity(df, pairs).collect()}
    assert r[("0", "nope")] is None and math.isclose(r[("0", "1")], float(m[0] @ m[1]), abs_tol=1e-6)


def test_embedder_unit_and_deterministic(spark):
    df = spark.createDataFrame([(1, "The cat sat"), (2, "the CAT sat"), (3, "")], "k int, text string")
    e = {r["k"]: r["vector"] for r in vo.embed_texts(df).collect()}
    assert e[1] == e[2] and math.isclose(sum(x * x for x in e[1]), 1.0, abs_tol=1e-5)
    assert all(x == 0.0 for x in e[3])
