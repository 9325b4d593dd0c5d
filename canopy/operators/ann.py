"""Approximate top-k with an inverted-list index (V10), Spark-native.

Build: each vector gets the list of its nearest pivot (given pivots or
``pyspark.ml`` KMeans centres) by a matrix product per Arrow batch, without a
shuffle; ``write_index`` stores the rows partitioned by ``list_id`` and the
pivots beside them in one commit.  Search: each query picks its ``nprobe``
nearest pivots; the stored table is read with a filter on the lists probed, so
other lists' files are not opened, and joined to the probes by ``list_id``.
``nprobe = n_lists`` equals exact search.  A list holding a third of the corpus
is written and read by many tasks (AQE rebalancing and file splits), and the
partial top-k keeps each task's output at k rows per query.

Pivots live on the driver, where KMeans puts them: some hundred bytes each, and
an index has far fewer lists than rows.  Null and ragged vectors and such with
NaN have no nearest pivot and are in no list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions.vector import dot
from canopy.operators.vectors import MAX_BROADCAST_BYTES
from canopy.session import materialize
from canopy.sources.store import TableStore

SCORES_AT_ONCE = 1 << 20   # scores of a block of rows in the matrix product


def collect_pivots(pivots: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """List ids in ascending order and their vectors."""
    rows = pivots.select("list_id", "vector").orderBy("list_id").collect()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)


def _nearest(ids: np.ndarray, m: np.ndarray, n: int, vec: str):
    """Arrow batches with a row per row and each of its ``n`` nearest pivots (lowest list id on ties)."""
    step = max(1, SCORES_AT_ONCE // max(1, len(ids)))

    def run(batches):
        for rb in batches:
            col = rb.column(rb.schema.get_field_index(vec))
            right = pc.fill_null(pc.equal(pc.list_value_length(col), m.shape[1] if len(ids) else -1), False)
            rb = rb.filter(right)
            for i in range(0, rb.num_rows, step):
                part = rb.slice(i, step)
                x = np.asarray(part.column(part.schema.get_field_index(vec)).flatten(), dtype=np.float64)
                s = x.reshape(-1, m.shape[1]) @ m.T
                known = np.nonzero(~np.isnan(s).any(axis=1))[0]
                best = np.argsort(-s[known], axis=1, kind="stable")[:, :n] if n > 1 \
                    else np.argmax(s[known], axis=1)[:, None]
                rows = part.take(pa.array(np.repeat(known, best.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids[best.ravel()].astype(np.int32))],
                                                 names=[*rows.schema.names, "list_id"])
    return run


def _with_list(df: DataFrame, pivots: DataFrame, n: int, vec: str) -> DataFrame:
    ids, m = collect_pivots(pivots)
    df = df.drop("list_id")
    schema = T.StructType([*df.schema.fields, T.StructField("list_id", T.IntegerType())])
    return df.mapInArrow(_nearest(ids, m, n, vec), schema)


def assign_lists(corpus: DataFrame, pivots: DataFrame, vec: str = "vector") -> DataFrame:
    """Nearest pivot by dot product (lowest list id on ties)."""
    return _with_list(corpus, pivots, 1, vec)


def write_index(store: TableStore, name: str, corpus: DataFrame, pivots: DataFrame, vec: str = "vector") -> None:
    """Store the corpus partitioned by ``list_id`` and its pivots, in one commit.

    The rebalance hint deals rows by list and splits lists that are too large for one task.
    """
    rows = assign_lists(corpus, pivots, vec).hint("rebalance", F.col("list_id"))
    store.replace_many({name: rows, f"{name}_pivots": pivots.select("list_id", "vector")},
                       partition_by={name: ["list_id"]})


def kmeans_pivots(corpus: DataFrame, n_lists: int = 100, seed: int = 7, vec: str = "vector") -> DataFrame:
    """Pivots from ``pyspark.ml`` KMeans (distributed Lloyd iterations)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = corpus.select(array_to_vector(vec).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=20, featuresCol="features").fit(data)
    centers = model.clusterCenters()
    spark = corpus.sparkSession
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)],
                                 "list_id int, vector array<double>")


def probes(queries: DataFrame, pivots: DataFrame, nprobe: int, vec: str = "vector") -> DataFrame:
    """(query_id, list_id, _qv) of each query's ``nprobe`` nearest pivots."""
    return _with_list(queries.select("query_id", vec), pivots, nprobe, vec) \
        .select("query_id", "list_id", F.col(vec).alias("_qv"))


def ivf_topk(indexed: DataFrame, queries: DataFrame, pivots: DataFrame, k: int = 10, nprobe: int = 2,
             id_col: str = "id", vec: str = "vector", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Approximate top-k per query over the probed lists of ``indexed``.

    The probe table is broadcast while its vectors have at most
    ``max_broadcast_bytes``; a larger one is joined by a shuffle on ``list_id``.
    """
    p = materialize(probes(queries, pivots, nprobe, vec), "probes")
    lists = [r[0] for r in p.select("list_id").distinct().collect()]   # at most one per pivot
    size = p.agg(F.sum(F.size("_qv") * 8 + 16)).first()[0] or 0
    probed = indexed.where(F.col("list_id").isin(lists)).select(F.col(id_col).alias("id"), "list_id", vec)
    j = probed.join(F.broadcast(p) if size <= max_broadcast_bytes else p.hint("merge"), "list_id")
    s = j.select("query_id", "id", dot(vec, "_qv").alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_index(store: TableStore, name: str, queries: DataFrame, k: int = 10, nprobe: int = 2,
                 id_col: str = "id", vec: str = "vector") -> DataFrame:
    """:func:`ivf_topk` over a stored index: only the probed lists' folders are read."""
    return ivf_topk(store.read(name), queries, store.read(f"{name}_pivots"), k, nprobe, id_col, vec)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per-query recall of the approximate answer against the exact one."""
    hit = approx.select("query_id", "id").join(exact.select("query_id", "id"), ["query_id", "id"])
    h = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    n = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(h, "query_id", "left").select(
        "query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))
