"""Keyword search against brute force; context search caps; cost estimate record."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from canopy.operators import cost as co
from canopy.operators import keyword as kw
from canopy.operators.vectors import TOKEN_SPLIT

DOCS = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "cats and dogs"), (4, "a mat a mat a mat"),
        (5, "")]
QUERIES = [(10, "cat mat"), (11, "dog"), (12, "unknownword")]


def brute_bm25(k1=1.2, b=0.75):
    toks = {d: [t for t in re.split(TOKEN_SPLIT, x.lower()) if t] for d, x in DOCS}
    n = len(DOCS)
    avgdl = sum(len(t) for t in toks.values()) / n
    out = {}
    for q, text in QUERIES:
        terms = {t for t in re.split(TOKEN_SPLIT, text.lower()) if t}
        for d, t in toks.items():
            tf = Counter(t)
            s = 0.0
            for term in terms:
                if tf[term]:
                    df = sum(1 for x in toks.values() if term in x)
                    idf = math.log((n - df + 0.5) / (df + 0.5) + 1.0)
                    s += idf * tf[term] * (k1 + 1) / (tf[term] + k1 * (1 - b + b * len(t) / avgdl))
            if s:
                out[(q, d)] = s
    return out


def test_bm25_equals_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    qs = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in kw.bm25_scores(docs, qs).collect()}
    exp = brute_bm25()
    assert set(got) == set(exp)
    for k, v in exp.items():
        assert math.isclose(got[k], v, rel_tol=1e-12)


def test_bm25_topk_and_query_blocks(spark):
    docs = spark.createDataFrame([*DOCS, (99, None), (98, "")], "doc_id long, text string").repartition(3)
    qs = spark.createDataFrame([*QUERIES, (13, None), (14, ""), (10, "mat")], "query_id long, text string")
    whole = {(r["query_id"], r["doc_id"]): r["score"] for r in kw.bm25_scores(docs, qs).collect()}
    blocks = {(r["query_id"], r["doc_id"]): r["score"] for r in kw.bm25_scores(docs, qs, max_pairs=1).collect()}
    assert whole == blocks and whole
    for k in (1, 2):
        best = {}
        for (q, d), s in sorted(whole.items(), key=lambda x: (-round(x[1], 6), x[0][1])):
            best.setdefault(q, []).append(d)
        got = {}
        for r in kw.bm25_topk(docs, qs, k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == {q: d[:k] for q, d in best.items()}
    assert kw.bm25_topk(docs.limit(0), qs, 2).collect() == []
    assert kw.bm25_topk(docs, qs.limit(0), 2).collect() == []


def test_rrf(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id long, doc_id long, rank int")
    r = [(x["doc_id"], x["rank"]) for x in kw.hybrid_topk(a, b, 3).orderBy("rank").collect()]
    assert r[0] == (8, 1)


def test_cost_record(spark):
    stages = spark.createDataFrame([("summarization", "m1", 1, 100, 50), ("directory_summaries", "m1", 1, 50, 25)],
                                   "stage string, model string, items long, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m1", 100.0, 100.0)], "model string, input_price double, output_price double")
    r = {x["stage"]: x for x in co.price(stages, prices).collect()}
    assert math.isclose(r["summarization"]["cost"], 0.015) and math.isclose(r["directory_summaries"]["cost"], 0.0075)
    assert r["total"]["approved"]
    dflt = co.price(stages.limit(1), prices.limit(0)).where(F.col("stage") == "total").first()
    assert math.isclose(dflt["cost"], 100 / 1e6 * 1.0 + 50 / 1e6 * 3.0)
