"""Product-quantised lists: codes and candidates against plain loops, recall and bytes at the production setting."""

import numpy as np
import pytest

from canopy.operators import ann, pq, vectors as vo
from canopy.sources.store import TableStore


def _frame(spark, m):
    rows = [(str(i), [float(x) for x in r]) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "id string, vector array<float>").repartition(3)


def _unit(n, dim, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_codes_and_scores_match_plain_loops(spark, tmp_path):
    m = _unit(90, 8)
    corpus = _frame(spark, m)
    bad = spark.createDataFrame([("null", None), ("nan", [float("nan")] * 8), ("short", [1.0])], "id string, vector array<float>")
    q = pq.train(corpus, n_lists=5, parts=4)
    store = TableStore(spark, f"file://{tmp_path}")
    pq.write_index(store, "ix", corpus.unionByName(bad), q)
    m32 = {r["id"]: np.array(r["vector"], np.float64) for r in corpus.collect()}
    rows = store.read("ix_codes").collect()
    assert len(rows) == 2 * len(m) == 2 * store.read("ix_vectors").count()
    said = {}
    for r in rows:
        x = m32[r["id"]]
        order = np.argsort(-(q.pivots @ x), kind="stable")
        assert q.ids[order[0]] == r["home"] and r["list_id"] in q.ids[order[:2]]
        at = int(np.flatnonzero(q.ids == r["list_id"])[0])
        residual = (x - q.pivots[at]).reshape(4, 2)
        want = [int(((book - piece) ** 2).sum(1).argmin()) for book, piece in zip(q.books, residual)]
        assert list(r["code"]) == want
        near = q.pivots[at] + np.concatenate([q.books[p][c] for p, c in enumerate(want)])
        said.setdefault(r["id"], []).append((r["list_id"], near))
    queries = corpus.where("id in ('3', '7')").selectExpr("cast(id as long) as query_id", "vector")
    got = {}
    for r in pq._candidates(store, "ix", pq.read_quantiser(store, "ix"), queries, 3, 10, "vector", 1).collect():  # a query a block
        got.setdefault(r["query_id"], set()).add(r["id"])
    for i in (3, 7):
        x = m32[str(i)]
        probed = set(q.ids[np.argsort(-(q.pivots @ x), kind="stable")[:3]].tolist())
        scores = {d: max((float(near @ x) for li, near in own if li in probed), default=None) for d, own in said.items()}
        able = sorted((s for s in scores.values() if s is not None), reverse=True)
        assert len(got[i]) == 10 and min(scores[d] for d in got[i]) >= able[9] - 1e-9


def test_all_lists_and_candidates_are_exact(spark, tmp_path):
    corpus = _frame(spark, _unit(60, 8, 3))
    store = TableStore(spark, f"file://{tmp_path}")
    pq.write_index(store, "ix", corpus, pq.train(corpus, n_lists=4, parts=2))
    queries = corpus.where("id in ('1', '2')").selectExpr("cast(id as long) as query_id", "vector")
    exact = [tuple(r) for r in vo.topk_similar_batch(corpus, queries, 5).select("query_id", "rank", "id").collect()]
    full = pq.search(store, "ix", queries, 5, nprobe=4, rerank=60)
    assert sorted(tuple(r) for r in full.select("query_id", "rank", "id").collect()) == sorted(exact)
    assert pq.search(store, "ix", queries.limit(0), 5).count() == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_and_bytes_at_the_setting_of_the_query(spark, sf):
    from canopy.plans import q_retrieval as q
    got = q.q_ann_pq_recall(spark, f"/root/testdata/sf{sf}").collect()
    assert len(got) == {"0.01": 5, "0.1": 20}[sf]
    assert np.mean([r["recall"] for r in got]) >= 0.9 and max(r["share"] for r in got) <= 1 / 3


def test_lloyd_fills_empty_clusters():
    x = np.r_[np.zeros((20, 2)), np.ones((1, 2)), np.full((1, 2), 5.0)]
    assert len(np.unique(pq.lloyd(x, 3), axis=0)) == 3


def test_a_scan_gives_a_task_s_best_rows_and_not_a_batch_s(spark):
    """Whatever the batches, a task gives each query its best rows, ties by id: no more than that leaves it."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    q = pq.Quantiser(np.arange(2), np.zeros((2, 4)), rng.normal(size=(2, 3, 2)))
    codes = rng.integers(0, 3, (500, 2)).astype(np.uint8)   # nine different rows, so most scores are tied
    ids = [f"v{i:03d}" for i in rng.permutation(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * 500, pa.int32()), pa.array([i % 2 for i in range(500)], pa.int32()),
                                        pa.array([bytes(c) for c in codes])], names=["id", "home", "list_id", "code"])
    queries = rng.normal(size=(3, 4))
    probes = np.array([[True, True], [True, False], [False, False]])
    near = np.array([[sum(t[p, c] for p, c in enumerate(code)) for code in codes] for t in q.tables(queries)])
    want = {}
    for i, qid in enumerate((7, 8, 9)):
        able = [(-near[i, r], ids[r]) for r in range(500) if probes[i, r % 2]]
        want[qid] = {d for _, d in sorted((round(s, 9), d) for s, d in able)[:6]}
    for size in (500, 40, 1):
        run = pq._scan(q, np.array([7, 8, 9]), queries, probes, 6)
        got = {7: [], 8: [], 9: []}
        for rb in run(batch.slice(at, size) for at in range(0, 500, size)):
            for r in rb.to_pylist():
                got[r["query_id"]].append(r["id"])
        assert {k: set(v) for k, v in got.items()} == want and all(len(v) <= 6 for v in got.values())


def test_lloyd_holds_some_distances_at_a_time(monkeypatch):
    import tracemalloc
    x = np.random.default_rng(2).normal(size=(20_000, 4))
    tracemalloc.start()
    whole = pq.lloyd(x, 256, rounds=2)
    assert tracemalloc.get_traced_memory()[1] < 40e6   # all distances are 41 MB
    tracemalloc.stop()
    monkeypatch.setattr(pq, "SCORES_AT_ONCE", 1000)
    assert np.allclose(pq.lloyd(x, 256, rounds=2), whole)
