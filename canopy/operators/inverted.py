"""Stored inverted index for keyword search (X1): written once, searched by term.

Layout.  Documents are cut into even blocks of at most ``block_docs`` as they
are read; a row holds one term's postings in one block (places in the block,
counts) with the largest count and the least length among them, which bound
the term's BM25 weight in the block whatever the corpus' averages become.
Rows are partitioned into buckets of terms, so a search opens its terms'
buckets alone; a term in a third of all documents is many rows, none longer
than a block.  A row without a term, in a bucket of its own, holds the block's
size and length and, once for all its terms, its documents' keys and lengths.
Each batch of documents is a segment: a folder that an append adds and
:func:`merge_segments` writes together, small blocks joined.

Search.  From the rows' bounds alone (no postings read) every query gets an
upper bound for each block.  Its ``k`` best blocks are scored; the k-th score
found there is a threshold, and only blocks whose bound reaches it are scored
besides.  The postings of a block meet in one task, which adds them up and
passes on each query's ``k`` best documents, so what is exchanged does not
grow with the postings of a query.  Documents whose key the index holds more
than once pass on whatever they score, and their blocks are always scored, so
that their scores are summed.  Answers equal those of a full scan.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.keyword import K1, MAX_PAIRS, B
from canopy.operators.vectors import TOKEN_SPLIT, tokens
from canopy.session import materialize
from canopy.sources.store import TableStore

BUCKETS = 64            # folders of terms; a parameter of an index, kept in its rows' folders
SIZES = -1              # bucket of the rows that hold a block's size
ROUNDING = 2e-6         # scores are ranked to six places


def _block_rows(ids, texts, block: int) -> pa.RecordBatch:
    """The rows of one block of documents; the last, without a term, is the block's own."""
    n = len(texts)
    toks = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=TOKEN_SPLIT)
    rows = np.repeat(np.arange(n, dtype=np.int64), np.asarray(pc.list_value_length(toks), np.int64))
    flat = pc.list_flatten(toks)
    real = np.asarray(pc.not_equal(flat, ""), bool)
    rows, terms = rows[real], flat.filter(pa.array(real)).dictionary_encode()
    lengths = np.bincount(rows, minlength=n).astype(np.int32)
    pairs, tf = np.unique(np.asarray(terms.indices, np.int64) * max(n, 1) + rows, return_counts=True)
    term, doc = np.divmod(pairs, max(n, 1))
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    ends = np.r_[starts, len(term)]
    size = np.diff(ends)
    least = np.minimum.reduceat(lengths[doc], starts) if len(starts) else np.zeros(0, np.int32)
    most = np.maximum.reduceat(tf, starts) if len(starts) else np.zeros(0, np.int64)
    row = np.arange(len(starts) + 2)
    lists = pa.array(np.r_[ends, len(term)].astype(np.int32), mask=row == len(starts))  # null in the block's own row
    whole = pa.array(np.where(row > len(starts), n, 0).astype(np.int32), mask=row < len(starts))  # null in all others

    def column(values, last, kind):
        return pa.concat_arrays([pa.array(values, kind), pa.array([last], kind)])

    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([terms.dictionary.take(pa.array(term[starts])), pa.array([None], pa.string())]),
        pa.array(np.full(len(starts) + 1, block)), column(size.astype(np.int32), n, pa.int32()),
        column(np.zeros(len(starts), np.int64), int(lengths.sum()), pa.int64()),
        column(most.astype(np.int32), 0, pa.int32()), column(least.astype(np.int32), 0, pa.int32()),
        pa.ListArray.from_arrays(lists, pa.array(doc.astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int32))),
        pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, pa.array(lengths))],
        names=["term", "block", "n", "total", "max_tf", "min_dl", "at", "tfs", "docs", "dls"])


def _bucket(term, buckets: int):
    return F.when(F.col(term).isNull(), F.lit(SIZES)).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets))).cast("int")


def _new_numbers(index: DataFrame | None = None) -> int:
    """The first of 2 ** 40 numbers for blocks, none of which ``index`` has."""
    used = {r[0] for r in index.where(F.col("bucket") == SIZES).select(F.shiftright("block", 40)).distinct().collect()} if index is not None else set()
    while True:  # one turn but for a chance of segments in 2 ** 23
        segment = uuid.uuid4().int >> 105
        if segment not in used:
            return segment << 40


def _segment(docs: DataFrame, key: str, text: str, buckets: int, block_docs: int, segment: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        task, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            parts = -(-batch.num_rows // block_docs)
            cuts = [i * batch.num_rows // parts for i in range(parts + 1)] if parts else []
            for at, end in zip(cuts, cuts[1:]):
                part = batch.slice(at, end - at)
                yield _block_rows(part.column(0), part.column(1), segment + (task << 20) + no)
                no += 1

    rows = docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"term string, block long, n int, total long, max_tf int, min_dl int, at array<int>, tfs array<int>, docs array<{kind}>, dls array<int>")
    return _dealt(rows, buckets)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by bucket, sorted by term; a bucket that is too large for one task is split."""
    return rows.withColumn("bucket", _bucket("term", buckets)).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term")


def write_index(store: TableStore, name: str, docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
                block_docs: int = 4096) -> None:
    """A new index of ``docs``.  Null texts have no terms but count as documents; keys should be unique."""
    store.replace_many({name: _segment(docs, key, text, buckets, block_docs, _new_numbers()),
                        f"{name}_shape": store.spark.createDataFrame([(buckets, block_docs)], "buckets int, block_docs int")},
                       partition_by={name: ["bucket"]})


def append(store: TableStore, name: str, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
    """Add documents whose keys the index does not have yet, as a segment."""
    shape = store.read(f"{name}_shape").first()
    segment = _new_numbers(store.read(name))
    store.append(name, _segment(docs, key, text, shape["buckets"], shape["block_docs"], segment), ["bucket"])


def merge_segments(store: TableStore, name: str) -> None:
    """Write all segments as one.  Blocks of less than half of ``block_docs``
    documents are joined to blocks of that size; the others' rows stay as they are."""
    shape = store.read(f"{name}_shape").first()
    rows = store.read(name)
    spread = F.pmod(F.xxhash64("block"), F.lit(shape["buckets"]))  # blocks of one spread join, so no window holds all of them
    sizes = rows.where((F.col("bucket") == SIZES) & (F.col("n") < shape["block_docs"] / 2)).select("block", "n", spread.cast("long").alias("spread"))
    run = Window.partitionBy("spread").orderBy("n", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.floor((F.sum("n").over(run) - 1) / shape["block_docs"])
    into = F.lit(_new_numbers(rows)) + number * shape["buckets"] + F.col("spread")
    before = Window.partitionBy("into").orderBy("n", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int")  # places of a block's documents start there
    names = materialize(sizes.withColumn("into", into).select("block", "into", base.alias("base")), "blocks")
    part = F.struct("base", F.transform("at", lambda x: x + F.col("base")).alias("at"), "tfs", "docs", "dls")
    joined = (rows.join(names, "block").withColumn("part", part).groupBy("term", F.col("into").alias("block"))
              .agg(F.sum("n").cast("int").alias("n"), F.sum("total").alias("total"), F.max("max_tf").alias("max_tf"),
                   F.min("min_dl").alias("min_dl"), F.sort_array(F.collect_list("part")).alias("parts"))  # two blocks' documents at most
              .withColumns({c: F.flatten(f"parts.{c}") for c in ("at", "tfs", "docs", "dls")}).drop("parts"))
    stay = rows.join(names, "block", "left_anti").select(*joined.columns)
    store.replace(name, _dealt(stay.unionByName(joined), shape["buckets"]), ["bucket"])


def postings(store: TableStore, name: str, terms: DataFrame) -> DataFrame:
    """The index rows of ``terms`` (distinct, column ``term``); only their buckets' folders are opened."""
    buckets = store.read(f"{name}_shape").first()["buckets"]
    own = [r[0] for r in terms.select(_bucket("term", buckets)).distinct().collect()]  # at most the number of buckets
    return store.read(name).where(F.col("bucket").isin(own)).join(terms, "term")


def search(store: TableStore, name: str, queries: DataFrame, k: int = 10, key: str = "doc_id", k1: float = K1, b: float = B,
           report: dict | None = None) -> DataFrame:
    """``query_id, key, score, rank``: BM25, ranked on the 6-place score, then the key.

    Queries without a term that occurs have no row.  Nothing is collected, so
    any number of queries is one batch.  ``report`` receives the number of
    (query, block) pairs that have a term in common and of those scored.
    """
    sizes = store.read(name).where(F.col("bucket") == SIZES)
    size = sizes.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, average = size["n"] or 0, (size["total"] or 0) / max(1, size["n"] or 0) or 1.0
    asked = materialize(queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
                        .where("query_id is not null").distinct(), "query-terms")
    rows = postings(store, name, asked.select("term").distinct())
    df = rows.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    terms = materialize(asked.join(df, "term").select("query_id", "term", idf.alias("idf")), "query-idf")

    def weight(tf, dl):
        return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(average)))

    bound = weight(F.col("max_tf"), F.col("min_dl"))
    blocks = materialize(rows.select("term", "block", "max_tf", "min_dl").join(terms, "term")
                         .groupBy("query_id", "block").agg(F.sum(bound).alias("bound")), "block-bounds")
    first = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), F.col("block"))
    seeds = materialize(blocks.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("query_id", "block"), "seed-blocks")

    twice = materialize(_repeats(sizes), "repeats")
    share = F.pmod(F.xxhash64("query_id"), F.lit(-(-asked.count() // MAX_PAIRS) or 1))  # a task holds one share of the queries
    by_term = terms.groupBy("term", share.alias("share")).agg(F.first("idf").alias("idf"), F.collect_list("query_id").alias("queries"))
    kinds = {f.name: f.dataType.simpleString() for f in [*sizes.schema, *asked.schema]}

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = pairs.groupBy("block", share.alias("share")).agg(F.collect_list("query_id").alias("queries"))
        own = sizes.select("block", "docs", "dls").join(wanted, "block").join(twice, "block", "left")
        hit = (rows.select("term", "block", "at", "tfs").join(by_term, "term").drop("term")
               .join(wanted.select("block", "share"), ["block", "share"], "left_semi"))
        return (hit.unionByName(own, allowMissingColumns=True).groupBy("block", "share")
                .applyInArrow(_block_scores(k, k1, b, average, key), f"query_id {kinds['query_id']}, `{key}` {kinds['docs'][6:-1]}, score double"))

    def summed(parts: DataFrame) -> DataFrame:
        return _best(parts.groupBy("query_id", key).agg(F.round(F.sum("score"), 6).alias("score")), k, key)

    first_scores = materialize(scored(seeds), "seed-scores")
    least = summed(first_scores).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    reach = F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROUNDING) | F.col("twice")
    rest = materialize(blocks.join(least, "query_id", "left").join(twice.select("block", F.lit(True).alias("twice")), "block", "left")
                       .where(reach).join(seeds, ["query_id", "block"], "left_anti").select("query_id", "block"), "rest-blocks")
    if report is not None:
        report.update(blocks=blocks.count(), scored=seeds.count() + rest.count())
    return summed(first_scores.unionByName(scored(rest)))


def _repeats(sizes: DataFrame) -> DataFrame:
    """``block, repeats``: the places of documents whose key the index holds more than once."""
    each = sizes.select("block", F.posexplode("docs").alias("place", "key"))
    keys = materialize(each.groupBy("key").count().where("count > 1").select(F.col("key").alias("again")), "repeated-keys")
    return (each.join(keys, F.col("key").eqNullSafe(F.col("again")), "left_semi")
            .groupBy("block").agg(F.collect_list("place").alias("repeats")))


def _block_scores(k: int, k1: float, b: float, average: float, key: str):
    """The rows of one block -> (query_id, key, score): each query's k best
    documents, and all those whose key repeats with their unrounded scores."""
    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table["docs"])).combine_chunks()
        hit = table.filter(pc.is_valid(table["at"])).combine_chunks()

        def flat(rows, name):
            return pc.list_flatten(rows[name]).combine_chunks()

        ids, dl = flat(own, "docs"), np.asarray(flat(own, "dls"), np.float64)
        at, tf = np.asarray(flat(hit, "at"), np.int64), np.asarray(flat(hit, "tfs"), np.float64)
        sizes = np.asarray(pc.list_value_length(hit["at"]), np.int64)
        idf = np.repeat(np.asarray(hit["idf"], np.float64), sizes)
        weight = idf * tf * (k1 + 1) / (tf + (k1 * (1 - b + b * dl / average))[at])
        ends = np.cumsum(sizes)
        again = np.zeros(len(ids), bool)
        again[np.asarray(flat(own, "repeats"), np.int64)] = True
        asks, row = flat(hit, "queries"), np.repeat(np.arange(len(sizes)), np.asarray(pc.list_value_length(hit["queries"]), np.int64))
        kept = pc.is_in(asks, value_set=flat(own, "queries"))
        asks, row = asks.filter(kept).dictionary_encode(), row[np.asarray(kept, bool)]
        number = np.asarray(asks.indices, np.int64)
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(len(asks.dictionary) + 1))
        out_q, out_doc, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for q in range(len(asks.dictionary)):
            lists = [slice(ends[r] - sizes[r], ends[r]) for r in row[order[bounds[q]:bounds[q + 1]]]]
            scores = np.bincount(np.concatenate([at[x] for x in lists]), np.concatenate([weight[x] for x in lists]), len(ids))
            docs = np.flatnonzero(scores)
            all_of = docs[again[docs]]
            docs = docs[~again[docs]]
            s = np.round(scores[docs], 6)
            if len(docs) > k:
                stay = s >= np.partition(s, len(s) - k)[len(s) - k]
                docs, s = docs[stay], s[stay]
                if len(docs) > k:  # ties at the bound: the least keys stay
                    ties = pa.table({"score": s, "key": ids.take(pa.array(docs))})
                    best = np.asarray(pc.sort_indices(ties, [("score", "descending"), ("key", "ascending")], null_placement="at_start"))[:k]
                    docs, s = docs[best], s[best]
            out_doc += [docs, all_of]
            out_s += [s, scores[all_of]]
            out_q.append(np.full(len(docs) + len(all_of), q))
        return pa.table({"query_id": asks.dictionary.take(pa.array(np.concatenate(out_q))),
                         key: ids.take(pa.array(np.concatenate(out_doc))), "score": np.concatenate(out_s)})
    return run


def _best(scores: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
