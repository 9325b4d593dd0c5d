"""Embedding table operators.

Scoring runs in two forms:

* a small, driver-checked set of target vectors (one query, <= 64 domains)
  becomes literal arrays in a projection -> pure JVM expression, no join;
* a query *batch* is broadcast as one float64 matrix (its size is checked
  against ``max_broadcast_bytes``; larger batches are processed in blocks)
  and scored per Arrow batch with one matrix product, emitting only each
  partition's top-k per query (partial top-k).  A final ``row_number``
  window over <= partitions x k rows per query finishes the exact top-k.

Corpus-by-corpus similarity is never formed; that goes through the
inverted-list index in :mod:`canopy.operators.ann`.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions.batches import byte_slices, cut_words
from canopy.functions.text import chunk_id, embed_text, node_kind
from canopy.functions.vector import dot, normalize, vec_lit

MAX_LITERAL_TARGETS = 64
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SCORES_AT_ONCE = 1 << 20   # scores of a batch that a task holds: some of its queries at a time


# ------------------------------------------------------------ node texts

def chunk_rows(summaries: DataFrame, key: str = "hash") -> DataFrame:
    """One row per named function / class item of each summary.

    ``idx`` is the position in the unfiltered array; items without a name or
    a summary are skipped.
    """
    f = summaries.select(key, F.lit("func").alias("kind"),
                         F.posexplode("summary.functions").alias("idx", "it"))
    c = summaries.select(key, F.lit("class").alias("kind"),
                         F.posexplode("summary.classes").alias("idx", "it"))
    u = f.unionByName(c).where((F.coalesce(F.col("it.name"), F.lit("")) != "")
                               & (F.coalesce(F.col("it.summary"), F.lit("")) != ""))
    return u.select(chunk_id(key, "kind", "idx", "it.name").alias("chunk_id"), F.col(key).alias("hash"),
                    "kind", "idx", F.col("it.name").alias("name"),
                    embed_text("it.name", "it.summary").alias("text"))


def embedding_texts(summaries: DataFrame) -> DataFrame:
    """File nodes (text = summary) plus chunk nodes (text = ``name: summary``)."""
    files = summaries.select(F.col("hash").alias("id"), F.lit("file").alias("kind"),
                             F.col("summary.summary").alias("text"))
    chunks = chunk_rows(summaries).select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), "text")
    return files.unionByName(chunks)


def embedding_worklist(summaries: DataFrame, existing: DataFrame) -> DataFrame:
    """Node texts whose id has no stored embedding yet (anti join)."""
    return embedding_texts(summaries).join(existing.select("id").distinct(), "id", "left_anti")


def embedding_counts(nodes: DataFrame) -> DataFrame:
    """File and chunk embedding counts."""
    k = node_kind("id")
    return nodes.agg(F.count(F.when(k == "file", 1)).alias("files"),
                     F.count(F.when(k == "chunk", 1)).alias("chunks"))


# ------------------------------------------------------------ embedder

TOKEN_SPLIT = r"[^a-z0-9àâçèéêëîïôùûüäößñáíóú]+"


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda x: x != "")


def token_buckets(text, dim: int) -> Column:
    """Hash bucket of every token: first 32 bits of md5(token) mod dim."""
    return F.transform(tokens(text), lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


def _hashed_tf_batches(keys: list[str], text: str, dim: int):
    """Arrow-batch embedder: text -> unit hashed term-frequency vector.

    Per slice of a batch (``TEXT_BYTES``), vectorised: lower-case, cut at non-word runs, map tokens to
    the slice's distinct tokens, md5 once per distinct token (bucket = first 32 bits mod
    dim, exactly as :func:`token_buckets` computes it in SQL), one
    ``bincount`` over (row, bucket), row-wise L2 normalisation, zero-copy
    list output.  Counts are integers, so the float64 norm is exact and the
    vector equals ``cast(x / sqrt(sum x^2) as float)`` bit for bit.
    """
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            yield from map(embed, byte_slices(batch, batch.schema.get_field_index(text)))

    def embed(rb):
        n = rb.num_rows
        txt = rb.column(rb.schema.get_field_index(text))
        words, rows = cut_words(pc.utf8_lower(txt))
        toks = words.dictionary_encode()
        first = b"".join([hashlib.md5(t).digest()[:4] for t in toks.dictionary.cast(pa.binary()).to_pylist()])
        b = (np.frombuffer(first, ">u4") % dim).astype(np.int64)[np.asarray(toks.indices)]
        c = np.bincount(rows * dim + b, minlength=n * dim).astype(np.float64).reshape(n, dim)
        nrm = np.sqrt(np.einsum("ij,ij->i", c, c))
        v = np.where(nrm[:, None] > 0, c / np.where(nrm > 0, nrm, 1.0)[:, None], c).astype(np.float32)
        offs = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
        vec = pa.ListArray.from_arrays(offs, pa.array(v.reshape(-1)),
                                       mask=txt.is_null() if txt.null_count else None)
        arrays = [rb.column(rb.schema.get_field_index(k)) for k in keys] + [vec]
        return pa.RecordBatch.from_arrays(arrays, names=keys + ["vector"])
    return run


def hashed_tf_vectors(df: DataFrame, keys: list[str], text: str = "text", dim: int = 64) -> DataFrame:
    """(keys..., vector): unit-length hashed term-frequency vector of each
    whole text, computed per Arrow batch (the text is not returned)."""
    src = df.select(*keys, text)
    fields = [f for f in src.schema.fields if f.name in keys]
    schema = T.StructType(fields + [T.StructField("vector", T.ArrayType(T.FloatType()))])
    return src.mapInArrow(_hashed_tf_batches(list(keys), text, dim), schema)


def embed_texts(df: DataFrame, text: str = "text", dim: int = 64, method: str = "sql",
                model: str | None = None, dedupe: bool = False) -> DataFrame:
    """V12/V13 default offline embedder.

    ``method='sql'``: md5-bucketed hashed TF (reproducible in any SQL engine).
    ``method='ml'``: ``pyspark.ml`` HashingTF + Normalizer (murmur3 buckets).
    Returns the input columns except ``text``, plus ``vector``, ``model``, ``dim``.
    ``dedupe=True`` embeds each distinct text once (SHA-256 key, Q9) and
    joins the vectors back -- worth its two shuffles only for a costly,
    model-backed provider; the offline embedders are cheaper than the shuffle
    and give equal vectors for equal texts anyway.
    """
    if dedupe:
        keyed = df.withColumn("_tkey", F.sha2(F.col(text), 256))
        uniq = keyed.select("_tkey", text).dropDuplicates(["_tkey"])
        vec = _embed(uniq, ["_tkey"], text, dim, method)
        out = keyed.join(vec, "_tkey", "left").drop("_tkey")
    else:  # the text itself is not passed through (never shipped to Python)
        out = _embed(df, [c for c in df.columns if c != text], text, dim, method)
    model = model or f"hashed-tf-{method}-{dim}"
    return out.withColumn("model", F.lit(model)).withColumn("dim", F.lit(dim))


def _embed(df: DataFrame, keys: list[str], text: str, dim: int, method: str) -> DataFrame:
    if method == "ml":
        from pyspark.ml.feature import HashingTF, Normalizer
        from pyspark.ml.functions import vector_to_array
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(df.withColumn("_tok", tokens(text)))
        nv = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0).transform(tf)
        return nv.select(*keys, vector_to_array("_nv", "float32").alias("vector"))
    return hashed_tf_vectors(df, keys, text, dim)


# ------------------------------------------------------------ table ops

def normalize_vectors(df: DataFrame, vec: str = "vector") -> DataFrame:
    """P10 at write time: stored vectors are unit length (zero kept)."""
    return df.withColumn(vec, normalize(vec))


def upsert_embeddings(old: DataFrame, new: DataFrame, keys=("id", "model"), order: str = "batch") -> DataFrame:
    """Latest-wins merge on (id, model); new vectors are normalised first.

    Plan: union -> one shuffle on the key -> row_number = 1.  Writing the
    result to a *new* location and swapping a pointer is done by the store.
    """
    new = normalize_vectors(new)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    u = old.unionByName(new, allowMissingColumns=True)
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lookup(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """S12 batch point lookup (semi join)."""
    return corpus.join(ids.select("id").distinct(), "id", "left_semi")


def exists(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """S12 existence flag for each asked id."""
    have = corpus.select("id").distinct().withColumn("exists", F.lit(True))
    return ids.select("id").distinct().join(have, "id", "left").select(
        "id", F.coalesce("exists", F.lit(False)).alias("exists"))


def delete(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """S12 delete (anti join)."""
    return corpus.join(ids.select("id").distinct(), "id", "left_anti")


def load_model(corpus: DataFrame, model: str) -> DataFrame:
    """One model's vectors (partition pruning when stored by model)."""
    return corpus.where(F.col("model") == model).select("id", "vector")


def embedding_stats(corpus: DataFrame) -> DataFrame:
    """Count per model plus a total row (model null) in one rollup."""
    return corpus.rollup("model").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ scoring

def _collect_small(df: DataFrame, cols, limit: int, what: str) -> list:
    rows = df.select(*cols).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; use the batch path")
    return rows


def score_literal(corpus: DataFrame, query_vec, vec: str = "vector") -> Column:
    """Score column against one driver-side vector (JVM expression)."""
    return dot(vec, vec_lit(query_vec))


def topk_similar(corpus: DataFrame, query_vec, k: int = 10, id_col: str = "id",
                 vec: str = "vector") -> DataFrame:
    """Exact top-k for one query: projection + TakeOrderedAndProject."""
    if k <= 0:
        return corpus.sparkSession.createDataFrame([], "id string, score double, rank int")
    scored = corpus.select(F.col(id_col).alias("id"), score_literal(corpus, query_vec, vec).alias("score"))
    top = scored.where(~F.isnan("score")).orderBy(F.col("score").desc(), F.col("id")).limit(k)
    w = Window.orderBy(F.col("score").desc(), F.col("id"))  # over <= k rows
    return top.withColumn("rank", F.row_number().over(w))


def vector_of(corpus: DataFrame, node_id: str, id_col: str = "id", vec: str = "vector") -> list:
    rows = corpus.where(F.col(id_col) == node_id).select(vec).limit(2).collect()
    if not rows:
        raise KeyError(f"Node {node_id} not found")
    return list(rows[0][0])


def topk_by_id(corpus: DataFrame, node_id: str, k: int = 10, include_self: bool = True) -> DataFrame:
    """V6: top-k neighbours of a stored node (the node itself included, Q8)."""
    q = vector_of(corpus, node_id)
    c = corpus if include_self else corpus.where(F.col("id") != node_id)
    return topk_similar(c, q, k)


def pair_similarity(corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dot of two stored ids; null when either is missing (left joins)."""
    a = corpus.select(F.col("id").alias("a_id"), F.col("vector").alias("va"))
    b = corpus.select(F.col("id").alias("b_id"), F.col("vector").alias("vb"))
    j = pairs.join(a, "a_id", "left").join(b, "b_id", "left")
    return j.select("a_id", "b_id", dot("va", "vb").alias("score"))


_BATCH_OUT = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def _partial_topk_fn(qids: np.ndarray, qmat: np.ndarray, k: int, id_col: str, vec: str,
                     min_score: float | None):
    """Arrow-batch scorer: one (rows x queries) matrix product per batch and
    the batch's top-k per query (ties at the k-th score kept, then cut by id)."""
    import pyarrow as pa
    dim = qmat.shape[1]

    def run(batches):
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            ids = rb.column(rb.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False)
            col = rb.column(rb.schema.get_field_index(vec))
            lens = np.diff(np.asarray(col.offsets, dtype=np.int64))
            flat = np.asarray(col.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            ok = (lens == dim) & ~np.asarray(col.is_null().to_numpy(zero_copy_only=False), dtype=bool)
            if ok.all():
                m = flat.reshape(n, dim)
            else:  # ragged or null vectors: score only the well-formed rows
                m = np.zeros((n, dim))
                starts = np.asarray(col.offsets, dtype=np.int64)[:-1]
                for r in np.nonzero(ok)[0]:
                    m[r] = flat[starts[r] - starts[0]:starts[r] - starts[0] + dim]
            for at in range(0, len(qids), max(1, SCORES_AT_ONCE // n)):
                yield best(ids, ok, m, slice(at, at + max(1, SCORES_AT_ONCE // n)))

    def best(ids, ok, m, some):
        s = m @ qmat[some].T
        out_q, out_i, out_s = [], [], []
        for j, qid in enumerate(qids[some]):
            scored = ok & ~np.isnan(s[:, j])
            colj = np.where(scored, s[:, j], -np.inf)
            valid = np.nonzero(scored)[0]
            if min_score is not None:
                cand = valid[colj[valid] >= min_score]
            elif len(valid) > k:
                kth = np.partition(colj[valid], len(valid) - k)[len(valid) - k]
                cand = valid[colj[valid] >= kth]
            else:
                cand = valid
            if min_score is None and len(cand) > k:
                cand = cand[np.lexsort((ids[cand], -colj[cand]))[:k]]
            out_q.append(np.full(len(cand), qid, dtype=np.int64))
            out_i.append(ids[cand])
            out_s.append(colj[cand])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_i).astype(object), pa.string()),
             pa.array(np.concatenate(out_s))], names=["query_id", "id", "score"])
    return run


def score_batch(corpus: DataFrame, queries: DataFrame, k: int | None, id_col: str = "id",
                vec: str = "vector", min_score: float | None = None,
                max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Partial scores of a query batch: per Arrow batch top-k (or all >= min_score).

    The query matrix travels inside the task closure (Spark broadcasts large
    closures); its size is checked and big batches are split into blocks.
    """
    qsorted = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector")
    stats = qsorted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    cnt, dim = int(stats["n"]), int(stats["d"] or 0)
    block = max(1, max_broadcast_bytes // (max(dim, 1) * 8))
    nblk = max(1, (cnt + block - 1) // block)
    # Blocks by hash of the query id: no global sort of the query set.
    qsorted = qsorted.withColumn("_blk", F.pmod(F.xxhash64("query_id"), F.lit(nblk)))
    parts = []
    src = corpus.select(F.col(id_col).cast("string").alias(id_col), vec)
    for b in range(nblk):
        sel = qsorted if nblk == 1 else qsorted.where(F.col("_blk") == b)
        rows = sel.select("query_id", "vector").collect()
        if not rows:
            continue
        qids = np.array([r[0] for r in rows], dtype=np.int64)
        qmat = np.stack([np.asarray(r[1], dtype=np.float64) for r in rows])
        fn = _partial_topk_fn(qids, qmat, k if k is not None else 0, id_col, vec, min_score)
        parts.append(src.mapInArrow(fn, _BATCH_OUT))
    if not parts:
        return corpus.sparkSession.createDataFrame([], _BATCH_OUT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def topk_similar_batch(corpus: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id",
                       vec: str = "vector") -> DataFrame:
    """V5 for many queries: partial top-k per batch, then exact final rank."""
    if k <= 0:
        return corpus.sparkSession.createDataFrame([], "query_id long, id string, score double, rank int")
    partial = score_batch(corpus, queries, k, id_col, vec)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_model_filter(corpus: DataFrame, query_vec, model: str, k: int = 10) -> DataFrame:
    """V9: top-k inside one model (partition pruning on ``model``)."""
    return topk_similar(corpus.where(F.col("model") == model), query_vec, k)
