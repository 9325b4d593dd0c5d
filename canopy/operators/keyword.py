"""Sparse keyword scoring (X1): BM25 top-k and hybrid fusion with dense ranks.

Index pass: one read of the documents in Arrow batches -- tokenise, keep
only tokens of the batch's query terms, count (doc, term), and write one row
per document: its length and two parallel arrays of term numbers and counts,
as a parquet table in the shared checkpoint folder.  Corpus size and average
length are one aggregate over it, document frequencies one count per term.

Scoring pass: every Arrow batch of index rows is scored against the query
terms, and only the batch's k best documents of each query leave the task
(ties at the k-th score cut by id), so the last exchange carries at most
k x queries x batches rows however many documents share a term.  A term
that occurs in a third of all documents only lengthens the rows.

Query batches of more than ``max_pairs`` (query, term) pairs are answered in
blocks of queries, one pass each, with the same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.batches import byte_slices
from canopy.operators.vectors import TOKEN_SPLIT, tokens
from canopy.session import materialize

K1 = 1.2
B = 0.75
RRF_K = 60
MAX_PAIRS = 1_000_000   # (query, term) pairs that travel to the tasks at once


def _index_batches(key: str, text: str, terms: list[str]):
    """Arrow batches -> (key, dl, terms, tfs): token counts of the query terms of every document."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        known = pa.array(terms, pa.string())
        for rb in (part for batch in batches for part in byte_slices(batch, batch.schema.get_field_index(text))):
            n = rb.num_rows
            txt = pc.fill_null(rb.column(rb.schema.get_field_index(text)), "")
            toks = pc.split_pattern_regex(pc.utf8_lower(txt), pattern=TOKEN_SPLIT)
            rows = np.repeat(np.arange(n, dtype=np.int64), np.asarray(pc.list_value_length(toks), np.int64))
            flat = pc.list_flatten(toks)
            dl = np.bincount(rows[np.asarray(pc.not_equal(flat, ""), bool)], minlength=n).astype(np.int64)
            number = np.asarray(pc.fill_null(pc.index_in(flat, value_set=known), -1), np.int64)
            hit = number >= 0
            pairs, tf = np.unique(rows[hit] * max(len(terms), 1) + number[hit], return_counts=True)
            doc, term = np.divmod(pairs, max(len(terms), 1))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rb.column(rb.schema.get_field_index(key)), pa.array(dl),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))],
                names=[key, "dl", "terms", "tfs"])
    return run


def _score_batches(key: str, idf, by_term: dict, avgdl: float, k: int | None, k1: float, b: float):
    """Arrow batches of index rows -> (query_id, key, score): each query's k best of the batch, all if k is None."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for rb in batches:
            ids, dl, terms, tfs = (rb.column(i) for i in range(4))
            sizes = np.diff(np.asarray(terms.offsets, np.int64))
            doc = np.repeat(np.arange(rb.num_rows), sizes)
            term = np.asarray(terms.flatten(), np.int64)
            tf = np.asarray(tfs.flatten(), np.float64)
            norm = k1 * (1 - b + b * np.asarray(dl, np.float64) / avgdl)
            weight = idf[term] * tf * (k1 + 1) / (tf + norm[doc])
            order = np.argsort(term, kind="stable")
            present, starts = np.unique(term[order], return_index=True)
            postings = dict(zip(present.tolist(), np.split(order, starts[1:])))
            queries: dict[int, list] = {}
            for t, rows in postings.items():
                for q in by_term.get(t, ()):
                    queries.setdefault(q, []).append(rows)
            out_q, out_row, out_s = [], [], []
            for q, lists in queries.items():
                rows = np.concatenate(lists)
                scores = np.bincount(doc[rows], weights=weight[rows], minlength=rb.num_rows)
                docs = np.unique(doc[rows])
                s = np.round(scores[docs], 6)
                if k is not None and len(docs) > k:
                    docs = docs[s >= np.partition(s, len(s) - k)[len(s) - k]]
                    if len(docs) > k:  # ties at the bound: the least ids stay
                        names = ids.take(pa.array(docs)).to_numpy(zero_copy_only=False)
                        docs = docs[np.lexsort((names, -np.round(scores[docs], 6)))[:k]]
                out_q.append(np.full(len(docs), q, np.int64))
                out_row.append(docs)
                out_s.append(scores[docs])
            if out_q:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q)), ids.take(pa.array(np.concatenate(out_row))),
                     pa.array(np.concatenate(out_s))], names=["query_id", key, "score"])
    return run


def _query_blocks(q: DataFrame, max_pairs: int):
    """Yield lists of (query_id, terms) with at most ``max_pairs`` terms in all (or one query)."""
    block, pairs = [], 0
    for r in q.orderBy("query_id").toLocalIterator():
        if block and pairs + len(r["terms"]) > max_pairs:
            yield block
            block, pairs = [], 0
        block.append((r["query_id"], r["terms"]))
        pairs += len(r["terms"])
    if block:
        yield block


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text",
                k1: float = K1, b: float = B, k: int | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(query_id, doc, score) of documents that share a term with a query.

    With ``k`` only the k best of each query and Arrow batch come out, which
    hold the k best of all (ranked on the 6-place score, then the id).  Query
    ids are integers; queries without a term, and null texts, match nothing.
    """
    import numpy as np
    spark = docs.sparkSession
    ktype = docs.schema[key].dataType.simpleString()
    q = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term")) \
        .groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    out = None
    for block in _query_blocks(q, max_pairs):
        terms = sorted({t for _, own in block for t in own})
        number = {t: i for i, t in enumerate(terms)}
        by_term: dict[int, list[int]] = {}
        for query, own in block:
            for t in own:
                by_term.setdefault(number[t], []).append(query)
        index = materialize(docs.select(key, text).mapInArrow(
            _index_batches(key, text, terms), f"{key} {ktype}, dl long, terms array<int>, tfs array<int>"), "postings")
        n, total = index.agg(F.count(F.lit(1)), F.sum("dl")).first()
        df = np.zeros(len(terms))
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r["t"]] = r["count"]
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
        avgdl = float(total or 0) / n if total else 1.0
        part = index.select(key, "dl", "terms", "tfs").where(F.size("terms") > 0).mapInArrow(
            _score_batches(key, idf, by_term, avgdl, k, k1, b), f"query_id long, {key} {ktype}, score double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"query_id long, {key} {ktype}, score double")


def _topk(scores: DataFrame, k: int, key: str) -> DataFrame:
    r = scores.withColumn("score", F.round("score", 6))
    win = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return r.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Top-k documents per query by BM25 (ranked on the 6-place score, then id)."""
    return _topk(bm25_scores(docs, queries, key, text, k=k), k, key)


def rrf(rankings: list[DataFrame], k: int = 10, key: str = "doc_id", c: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of several (query_id, key, rank) tables."""
    u = None
    for r in rankings:
        part = r.select("query_id", key, (F.lit(1.0) / (c + F.col("rank"))).alias("rr"))
        u = part if u is None else u.unionByName(part)
    s = u.groupBy("query_id", key).agg(F.sum("rr").alias("score"))
    return _topk(s, k, key)


def hybrid_topk(sparse: DataFrame, dense: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """Hybrid keyword + vector ranking by reciprocal rank (constant 60)."""
    return rrf([sparse, dense], k, key)
