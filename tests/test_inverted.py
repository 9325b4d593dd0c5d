"""The stored inverted index against BM25 by a full scan; what it reads and skips."""

import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from canopy.operators import inverted, keyword as kw
from canopy.sources.store import TableStore


def _docs(spark, n, seed=1):
    rnd = random.Random(seed)
    common = ["the", "of", "Table", "tree"]
    rows = [(seed * 10_000 + i, " ".join([*(rnd.choice(common) for _ in range(rnd.randint(0, 6))),
                                          *(f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(rnd.randint(0, 12)))])) for i in range(n)]
    return spark.createDataFrame([*rows, (seed * 10_000 + n, None), (seed * 10_000 + n + 1, ""), (seed * 10_000 + n + 2, rows[0][1])],
                                 "doc_id long, text string").repartition(3)


def _queries(spark):
    rows = [(1, "tree w1 w2"), (2, "THE the of"), (3, "w250 w7"), (4, "nowhere"), (5, None), (6, "w1"), (7, "table w3 w4 w5 w6")]
    return spark.createDataFrame(rows, "query_id long, text string")


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())


@pytest.fixture(scope="module")
def both(spark):
    return _docs(spark, 300), _docs(spark, 120, 2)


def test_search_equals_a_scan_after_every_change(spark, both, tmp_path):
    a, b = both
    store = TableStore(spark, f"file://{tmp_path}")
    inverted.write_index(store, "ix", a, buckets=8, block_docs=16)
    assert _rows(inverted.search(store, "ix", _queries(spark), 5)) == _rows(kw.bm25_topk(a, _queries(spark), 5))
    inverted.append(store, "ix", b)
    want = _rows(kw.bm25_topk(a.unionByName(b), _queries(spark), 5))
    assert _rows(inverted.search(store, "ix", _queries(spark), 5)) == want
    folders = store.version("ix")
    before = store.read("ix").where("term is null").count()
    inverted.merge_segments(store, "ix")
    assert store.version("ix") != folders and "," in folders and "," not in store.version("ix")
    sizes = store.read("ix").where("term is null")
    assert sizes.count() <= before and sizes.agg(F.max("n")).first()[0] <= 24 and sizes.agg(F.sum("n")).first()[0] == 426
    assert _rows(inverted.search(store, "ix", _queries(spark), 5)) == want
    assert inverted.search(store, "ix", _queries(spark).limit(0)).count() == 0


def test_only_the_terms_buckets_are_needed(spark, both, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    inverted.write_index(store, "ix", both[0], buckets=8, block_docs=16)
    queries = spark.createDataFrame([(1, "w1 tree")], "query_id long, text string")
    want = _rows(inverted.search(store, "ix", queries, 5))
    folder = tmp_path / "ix" / store.version("ix")
    terms = spark.createDataFrame([("w1",), ("tree",)], "term string")
    own = {f"bucket={r[0]}" for r in terms.select(inverted._bucket("term", 8)).collect()} | {f"bucket={inverted.SIZES}"}
    read = inverted.postings(store, "ix", terms).select(F.input_file_name()).distinct().collect()
    assert {part for r in read for part in r[0].split("/") if part.startswith("bucket=")} <= own
    for other in [p for p in folder.iterdir() if p.name.startswith("bucket=") and p.name not in own]:
        shutil.rmtree(other)
    assert _rows(inverted.search(store, "ix", queries, 5)) == want and len(want) == 5


def test_blocks_below_the_threshold_are_skipped(spark, tmp_path):
    rows = [(i, "needle " * (9 if i < 8 else 1) + "hay " * (2 if i < 8 else 40)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    store = TableStore(spark, f"file://{tmp_path}")
    inverted.write_index(store, "ix", docs, buckets=4, block_docs=8)
    report = {}
    queries = spark.createDataFrame([(1, "needle")], "query_id long, text string")
    got = _rows(inverted.search(store, "ix", queries, 4, report=report))
    assert got == _rows(kw.bm25_topk(docs, queries, 4))
    assert report["blocks"] == 100 and report["scored"] <= 8


def _exchanged(plan):
    """Records that each exchange of a plan that has run wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _exchanged(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _exchanged(plan.plan())
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else []
    below = plan.children()
    return own + [n for i in range(below.size()) for n in _exchanged(below.apply(i))]


def test_a_block_passes_on_the_best_documents_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same words in all") for i in range(800)], "doc_id long, text string").coalesce(1)
    store = TableStore(spark, f"file://{tmp_path}")
    inverted.write_index(store, "ix", docs, buckets=4, block_docs=80)
    queries = spark.createDataFrame([(1, "same words in all")], "query_id long, text string")
    found = inverted.search(store, "ix", queries, 4)
    assert [r["doc_id"] for r in sorted(found.collect(), key=lambda r: r["rank"])] == [0, 1, 2, 3]
    numbers = _exchanged(found._jdf.queryExecution().executedPlan())
    assert numbers and max(numbers) <= 60, numbers   # 4 documents or terms of a block at most


def test_keys_that_repeat_in_several_blocks_are_summed(spark, tmp_path):
    rows = [(i if i else None, "needle " * (1 + i % 5) + "hay " * (10 + i % 7)) for i in range(60)]
    far = [(key, "needle " + "hay " * 40) for key in [None, 7, 7, 33] for _ in range(6)]  # weak places of their own
    store = TableStore(spark, f"file://{tmp_path}")
    inverted.write_index(store, "ix", spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), buckets=4, block_docs=8)
    inverted.append(store, "ix", spark.createDataFrame(far, "doc_id long, text string").coalesce(1))
    queries = spark.createDataFrame([(1, "needle")], "query_id long, text string")
    each = [(key, text.split().count("needle"), len(text.split())) for key, text in rows + far]
    n, average = len(each), sum(x[2] for x in each) / len(each)
    idf, want = math.log(0.5 / (n + 0.5) + 1), {}
    for key, tf, dl in each:
        want[key] = want.get(key, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))
    best = sorted(want, key=lambda key: (-round(want[key], 6), key is not None, key))[:3]
    for _ in range(2):
        got = sorted(inverted.search(store, "ix", queries, 3).collect(), key=lambda r: r["rank"])
        assert [r["doc_id"] for r in got] == best and [r["score"] for r in got] == pytest.approx([want[key] for key in best], abs=2e-6)
        inverted.merge_segments(store, "ix")
