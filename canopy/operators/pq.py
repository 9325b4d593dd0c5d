"""Approximate top-k with product-quantised inverted lists.

Build.  A vector stands in its ``copies`` nearest lists (so a query near a
border still meets it), in each as the residual to the list's pivot, cut into
``parts`` pieces of which the nearest code of a small codebook is kept: one byte
a piece instead of four a component.  Pivots come from k-means, codebooks
from k-means of each piece over the residuals of a sample of at most
``sample_rows`` rows, a task a piece; every row is indexed.  Codes and vectors
are tables partitioned by list, the vectors by their nearest one.

Search.  Codes of the probed lists are read; the score of a query with a code
is looked up, one table of parts x codes numbers a query, and each task
keeps its best rows a query.  The ``rerank`` best of all tasks are scored
exactly from the vectors, of which only their lists are read.

Memory of a task: the lookup tables of a block of queries
(``max_broadcast_bytes`` at most), ``SCORES_AT_ONCE`` scores and the rows held.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.vector import dot
from canopy.operators import ann
from canopy.operators.vectors import MAX_BROADCAST_BYTES
from canopy.session import materialize
from canopy.sources.store import TableStore

SCORES_AT_ONCE = 1 << 20
CODES = 256             # a code is one byte
CODE_ROWS = "id string, home int, list_id int, code binary"


class Quantiser(NamedTuple):
    ids: np.ndarray      # lists, ascending
    pivots: np.ndarray   # lists x components
    books: np.ndarray    # parts x codes x components of a part

    def residuals(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rows, parts, components of a part) of rows in the lists at positions ``at``."""
        parts, _, width = self.books.shape
        return (x - self.pivots[at]).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = self.residuals(x, at)
        out = np.empty(r.shape[:2], np.uint8)
        for p, book in enumerate(self.books):
            out[:, p] = ((book * book).sum(1)[None, :] - 2 * r[:, p] @ book.T).argmin(1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): what each code adds to a query's score."""
        parts, _, width = self.books.shape
        return np.einsum("qpw,pcw->qpc", q.reshape(len(q), parts, width), self.books)


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of k-means; an empty cluster takes the row that fits worst.  ``SCORES_AT_ONCE`` distances are held."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    step = max(1, SCORES_AT_ONCE // len(centres)) if len(centres) else 1
    own, near = np.zeros(len(x), np.int64), np.zeros(len(x))
    for _ in range(rounds):
        for at in range(0, len(x), step):
            d = (centres * centres).sum(1)[None, :] - 2 * x[at:at + step] @ centres.T
            own[at:at + step] = d.argmin(1)
            near[at:at + step] = d.min(1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        full = size > 0
        centres[full] = total[full] / size[full, None]
        if not full.all():
            worst = np.argsort(-(near + (x * x).sum(1)), kind="stable")
            centres[~full] = x[worst[:int((~full).sum())]]
    return centres


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def train(corpus: DataFrame, n_lists: int = 16, parts: int = 16, sample_rows: int = 65_536, seed: int = 7,
          vec: str = "vector") -> Quantiser:
    """Pivots and codebooks; rows of one length, which ``parts`` divides, without nulls or NaN.

    The sample is the rows with the least hashes, so it is the same at every run.
    """
    spread = F.xxhash64(F.lit(seed), F.col(vec))
    sample = materialize(corpus.select(vec).withColumn("h", spread).orderBy("h").limit(sample_rows).select(vec), "pq-sample")
    ids, pivots = ann.collect_pivots(ann.kmeans_pivots(sample, n_lists, seed, vec))
    dim = pivots.shape[1]
    if dim % parts:
        raise ValueError(f"{parts} parts do not divide {dim} components")

    def pieces(batches):
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            r = (x - pivots[(x @ pivots.T).argmax(1)]).reshape(len(x), parts, -1)
            for p in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(list(r[:, p]), pa.list_(pa.float64()))],
                                                 names=["part", "x"])

    def book(rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("x").combine_chunks(), dim // parts)
        c = lloyd(x, min(CODES, len(x)), seed=seed)
        part = rows.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * len(c), pa.int32()), "code": pa.array(range(len(c)), pa.int32()),
                         "centre": pa.array(list(c), pa.list_(pa.float64()))})

    made = (sample.mapInArrow(pieces, "part int, x array<double>").groupBy("part")
            .applyInArrow(book, "part int, code int, centre array<double>").collect())  # parts x 256 short rows
    books = np.zeros((parts, max(r["code"] for r in made) + 1, dim // parts))
    for r in made:
        books[r["part"], r["code"]] = r["centre"]
    return Quantiser(ids, pivots, books)


def encode(corpus: DataFrame, quantiser: Quantiser, copies: int = 2, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """``id, home, list_id, code``: a row for each of the ``copies`` nearest lists of a vector; ``home`` is the nearest.

    Null and ragged vectors and such with NaN have no list and no row.
    """
    q, n = quantiser, min(copies, len(quantiser.ids))
    near = ann._nearest(q.ids, q.pivots, n, vec)
    place = {int(i): at for at, i in enumerate(q.ids)}

    def run(batches):
        for rows in near(batches):  # n rows in a row for each vector, nearest list first
            lists = rows.column(2).to_numpy()
            at = np.fromiter((place[int(i)] for i in lists), np.int64, len(lists))
            codes = q.encode(_matrix(rows.column(1), q.pivots.shape[1]), at)
            width = codes.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(0, width * len(codes) + 1, width, np.int32)),
                                                                     pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.repeat(lists[::n], n).astype(np.int32)), rows.column(2), packed],
                                             names=["id", "home", "list_id", "code"])

    return corpus.select(F.col(id_col).cast("string").alias("id"), vec).mapInArrow(run, CODE_ROWS)


def write_index(store: TableStore, name: str, corpus: DataFrame, quantiser: Quantiser, copies: int = 2, id_col: str = "id",
                vec: str = "vector") -> None:
    """Codes and vectors by list, pivots and codebooks, in one commit."""
    spark, q = corpus.sparkSession, quantiser
    vectors = corpus.select(F.col(id_col).cast("string").alias("id"), F.col(vec).alias("vector"))
    codes = encode(vectors, q, copies).hint("rebalance", F.col("list_id"))
    homes = ann.assign_lists(vectors, _pivot_rows(spark, q)).hint("rebalance", F.col("list_id"))
    books = spark.createDataFrame([(p, c, [float(v) for v in row]) for p, book in enumerate(q.books) for c, row in enumerate(book)],
                                  "part int, code int, centre array<double>")
    store.replace_many({f"{name}_codes": codes, f"{name}_vectors": homes, f"{name}_pivots": _pivot_rows(spark, q), f"{name}_books": books},
                       partition_by={f"{name}_codes": ["list_id"], f"{name}_vectors": ["list_id"]})


def _pivot_rows(spark, q: Quantiser) -> DataFrame:
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(q.ids, q.pivots)], "list_id int, vector array<double>")


def read_quantiser(store: TableStore, name: str) -> Quantiser:
    """Pivots and codebooks of a stored index (lists, and parts x 256 short rows)."""
    ids, pivots = ann.collect_pivots(store.read(f"{name}_pivots"))
    rows = store.read(f"{name}_books").collect()
    books = np.zeros((max(r["part"] for r in rows) + 1, max(r["code"] for r in rows) + 1, len(rows[0]["centre"])))
    for r in rows:
        books[r["part"], r["code"]] = r["centre"]
    return Quantiser(ids, pivots, books)


def _scan(q: Quantiser, qids: np.ndarray, matrix: np.ndarray, probes: np.ndarray, keep: int):
    """Arrow batches of codes to each query's ``keep`` best rows of the task, ties by id.

    ``probes``: (queries x lists), does the query probe the list?  Rows are held
    until they are four times ``keep`` a query, then cut; from then on only rows that
    reach a query's worst one are taken.
    """
    base, tables = matrix @ q.pivots.T, q.tables(matrix)
    parts = q.books.shape[0]
    step = max(1, SCORES_AT_ONCE // max(1, len(qids)))

    names = ["query_id", "id", "home", "near"]

    def cut(held: list) -> tuple[pa.Table, np.ndarray]:
        """The best rows and what a row must reach to be among them."""
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows, [("query_id", "ascending"), ("near", "descending"), ("id", "ascending")]))
        at = rows["query_id"].to_numpy()
        nth = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        least = np.full(len(qids), -np.inf)
        last = nth == keep - 1
        least[at[last]] = rows["near"].to_numpy()[last]
        return rows.filter(pa.array(nth < keep)).combine_chunks(), least

    def run(batches):
        held, n_held, least = [], 0, np.full(len(qids), -np.inf)   # query_id is its place in qids until the end
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = np.searchsorted(q.ids, part.column(2).to_numpy())
                codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, parts)
                scores = base[:, lists]
                for p in range(parts):
                    scores += tables[:, p, :][:, codes[:, p]]
                scores[~probes[:, lists]] = -np.inf
                which, row = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                rows = pa.array(row)
                held.append(pa.RecordBatch.from_arrays([pa.array(which), part.column(0).take(rows), part.column(1).take(rows),
                                                        pa.array(scores[which, row])], names=names))
                n_held += len(row)
                if n_held > 4 * keep * len(qids):
                    best, least = cut(held)
                    held, n_held = best.to_batches(), best.num_rows
        if n_held:
            best, _ = cut(held)
            for rows in best.to_batches(max_chunksize=65_536):
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows.column(0).to_numpy()]), *rows.columns[1:]], names=names)

    return run


def _query_blocks(queries: DataFrame, bytes_a_query: int, budget: int, vec: str):
    """(ids, matrix) of blocks of queries by a hash of their ids; a block's tables fit the budget."""
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), vec).where(F.col(vec).isNotNull())
    n = rows.count()
    blocks = max(1, min(n, -(-n * bytes_a_query // budget)))
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if got:
            yield np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64)


def search(store: TableStore, name: str, queries: DataFrame, k: int = 10, nprobe: int = 12, rerank: int = 100,
           vec: str = "vector", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``query_id, id, score, rank`` of each query; scores are exact, the choice of candidates is not.

    Queries that no vector can answer (none in the lists probed) have no row.
    """
    q = read_quantiser(store, name)
    found = _candidates(store, name, q, queries, nprobe, rerank, vec, max_broadcast_bytes)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id string, score double, rank int")
    homes = [r[0] for r in found.select("home").distinct().collect()]  # at most one per pivot
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vec).alias("_qv"))
    vectors = store.read(f"{name}_vectors").where(F.col("list_id").isin(homes)).select("id", F.col("list_id").alias("home"), "vector")
    scored = (found.join(vectors, ["home", "id"]).join(asked, "query_id")
              .select("query_id", "id", dot("vector", "_qv").alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _candidates(store, name, q: Quantiser, queries, nprobe, rerank, vec, budget) -> DataFrame | None:
    """``query_id, id, home`` of the rows to score exactly."""
    parts, codes, _ = q.books.shape
    out = None
    for qids, matrix in _query_blocks(queries, parts * codes * 8, budget, vec):
        order = np.argsort(-(matrix @ q.pivots.T), axis=1, kind="stable")[:, :nprobe]
        probes = np.zeros((len(qids), len(q.ids)), bool)
        np.put_along_axis(probes, order, True, axis=1)
        lists = [int(i) for i in q.ids[probes.any(0)]]
        rows = store.read(f"{name}_codes").where(F.col("list_id").isin(lists)).select("id", "home", "list_id", "code")
        # a vector may come up once for each of its lists, so as many times the rows are kept of a task
        part = rows.mapInArrow(_scan(q, qids, matrix, probes, 2 * rerank), "query_id long, id string, home int, near double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return None
    w = Window.partitionBy("query_id").orderBy(F.col("near").desc(), F.col("id"))
    best = out.groupBy("query_id", "id", "home").agg(F.max("near").alias("near"))
    return materialize(best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= rerank).select("query_id", "id", "home"), "pq-candidates")


def bytes_read(store: TableStore, name: str, queries: DataFrame, nprobe: int, rerank: int, vec: str = "vector") -> DataFrame:
    """``query_id, share``: bytes of codes and of exactly scored vectors that a query
    needs, by the bytes of all vectors (four a component)."""
    q = read_quantiser(store, name)
    sizes = {r["list_id"]: r["n"] for r in store.read(f"{name}_codes").groupBy("list_id").agg(F.count("*").alias("n")).collect()}
    total = store.read(f"{name}_vectors").count()
    width, parts = 4 * q.pivots.shape[1], q.books.shape[0]
    rows = []
    for qids, matrix in _query_blocks(queries, 8 * q.pivots.shape[1], MAX_BROADCAST_BYTES, vec):
        order = np.argsort(-(matrix @ q.pivots.T), axis=1, kind="stable")[:, :nprobe]
        for i, near in zip(qids.tolist(), q.ids[order].tolist()):
            read = sum(sizes.get(n, 0) for n in near)
            rows.append((i, (read * parts + min(rerank, read) * width) / max(1, total * width)))
    return queries.sparkSession.createDataFrame(rows, "query_id long, share double")
