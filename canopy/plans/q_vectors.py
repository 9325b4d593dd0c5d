"""Catalogue: vector math, top-k search and the embedding table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from canopy.functions import vector as vx
from canopy.operators import vectors as vo
from canopy.plans import oracle_sql as o
from canopy.plans.catalog import r6, register
from canopy.sources import standins as st
from canopy.sources.store import TableStore

K = 10
QUERY_LABEL = 0      # the single-query searches use the domain vector of label 0
FILTER_MODEL = "model_b"

o.add_cte("q0", f"SELECT vector AS q FROM domains WHERE domain_id = {QUERY_LABEL}", ["domains"])


def _query_vec(spark, d):
    row = st.domains(spark, d).where(F.col("domain_id") == QUERY_LABEL).select("vector").first()
    return list(row[0])


def _with_domain(df, spark, d):
    dom = st.domains(spark, d).select(F.col("domain_id").alias("label"), F.col("vector").alias("dv"))
    return df.join(dom, "label")  # <= one row per label


@register("normalize_vectors", o.with_ctes(f"""
    SELECT id, (round(sqrt({o.norm_sq('vector')}), 6) + 0.0) AS norm_before,
           (round(sqrt({o.norm_sq(o.normalize('vector'))}), 6) + 0.0) AS norm_after,
           (round(CAST({o.normalize('vector')}[1] AS DOUBLE), 6) + 0.0) AS x0
    FROM raw_vectors""", "raw_vectors"))
def q_normalize_vectors(spark, d):
    r = st.raw_vectors(spark, d)
    n = vx.normalize("vector")
    return r.select("id", r6(F.sqrt(vx.norm_sq("vector"))).alias("norm_before"),
                    r6(F.sqrt(vx.norm_sq(n))).alias("norm_after"),
                    r6(F.get(n, 0).cast("double")).alias("x0"))


@register("dot_product", o.with_ctes(f"""
    SELECT e.id, (round({o.dot('e.vector', 'd.vector')}, 6) + 0.0) AS score
    FROM node_embeddings e JOIN domains d ON e.label = d.domain_id""", "node_embeddings", "domains"))
def q_dot_product(spark, d):
    e = _with_domain(st.node_embeddings(spark, d), spark, d)
    return e.select("id", r6(vx.dot("vector", "dv", strict=True)).alias("score"))


_MISMATCH = "CASE WHEN r.vec_id % 89 = 0 THEN r.vector[1:63] ELSE r.vector END"


@register("cosine_lenient", o.with_ctes(f"""
    SELECT r.id, (round({o.cosine(_MISMATCH, 'd.vector')}, 6) + 0.0) AS score
    FROM raw_vectors r JOIN domains d ON r.label = d.domain_id""", "raw_vectors", "domains"))
def q_cosine_lenient(spark, d):
    r = _with_domain(st.raw_vectors(spark, d), spark, d)
    a = F.when(F.col("vec_id") % 89 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector"))
    return r.select("id", r6(vx.cosine(a, "dv")).alias("score"))


@register("cosine_strict", o.with_ctes(f"""
    SELECT r.id, (round({o.cosine('r.vector', 'd.vector')}, 6) + 0.0) AS score
    FROM raw_vectors r JOIN domains d ON r.label = d.domain_id""", "raw_vectors", "domains"))
def q_cosine_strict(spark, d):
    r = _with_domain(st.raw_vectors(spark, d), spark, d)
    return r.select("id", r6(vx.cosine("vector", "dv", strict=True)).alias("score"))


@register("cosine_distance", o.with_ctes(f"""
    SELECT e.id, (round(1.0 - {o.dot('e.vector', 'd.vector')}, 6) + 0.0) AS distance
    FROM node_embeddings e JOIN domains d ON e.label = d.domain_id""", "node_embeddings", "domains"))
def q_cosine_distance(spark, d):
    e = _with_domain(st.node_embeddings(spark, d), spark, d)
    return e.select("id", r6(vx.cosine_distance("vector", "dv")).alias("distance"))


def _topk_sql(where: str = "TRUE", qsrc: str = "SELECT q FROM q0", k: int = K) -> str:
    return f"""SELECT id, {o.r6('score')} AS score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
        SELECT id, {o.dot('vector', 'qq.q')} AS score FROM node_embeddings, ({qsrc}) qq WHERE {where}))
    WHERE rank <= {k}"""


@register("topk_similar", o.with_ctes(_topk_sql(), "node_embeddings", "q0"))
def q_topk_similar(spark, d):
    t = vo.topk_similar(st.node_embeddings(spark, d), _query_vec(spark, d), K)
    return t.select("id", r6("score").alias("score"), "rank")


@register("topk_by_id", o.with_ctes(
    _topk_sql(qsrc="SELECT vector AS q FROM node_embeddings WHERE id = '0'"), "node_embeddings"))
def q_topk_by_id(spark, d):
    t = vo.topk_by_id(st.node_embeddings(spark, d), "0", K)
    return t.select("id", r6("score").alias("score"), "rank")


@register("topk_model_filter", o.with_ctes(_topk_sql(where=f"model = '{FILTER_MODEL}'"), "node_embeddings", "q0"))
def q_topk_model_filter(spark, d):
    t = vo.topk_model_filter(st.node_embeddings(spark, d), _query_vec(spark, d), FILTER_MODEL, K)
    return t.select("id", r6("score").alias("score"), "rank")


@register("topk_similar_batch", o.with_ctes(f"""
    SELECT query_id, id, (round(score, 6) + 0.0) AS score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM (SELECT CAST(q.domain_id AS BIGINT) AS query_id, e.id, {o.dot('e.vector', 'q.vector')} AS score
            FROM node_embeddings e, domains q))
    WHERE rank <= {K}""", "node_embeddings", "domains"))
def q_topk_similar_batch(spark, d):
    q = st.domains(spark, d).select(F.col("domain_id").cast("long").alias("query_id"), "vector")
    t = vo.topk_similar_batch(st.node_embeddings(spark, d), q, K)
    return t.select("query_id", "id", r6("score").alias("score"), "rank")


@register("pair_similarity", o.with_ctes(f"""
    SELECT p.a_id, p.b_id, (round({o.dot('a.vector', 'b.vector')}, 6) + 0.0) AS score
    FROM (SELECT id AS a_id, CAST(vec_id + 1 AS VARCHAR) AS b_id FROM node_embeddings) p
    LEFT JOIN node_embeddings a ON a.id = p.a_id LEFT JOIN node_embeddings b ON b.id = p.b_id""",
    "node_embeddings"))
def q_pair_similarity(spark, d):
    e = st.node_embeddings(spark, d)
    pairs = e.select(F.col("id").alias("a_id"), (F.col("vec_id") + 1).cast("string").alias("b_id"))
    p = vo.pair_similarity(e, pairs)
    return p.select("a_id", "b_id", r6("score").alias("score"))


@register("embedding_stats", o.with_ctes(
    "SELECT model, count(*) AS n FROM node_embeddings GROUP BY ROLLUP (model)", "node_embeddings"))
def q_embedding_stats(spark, d):
    return vo.embedding_stats(st.node_embeddings(spark, d))


o.add_cte("upsert_src", f"""
    SELECT id, model, dim, 1::BIGINT AS batch FROM node_embeddings
    UNION ALL
    SELECT id, 'model_a', CAST(len(vector) AS INTEGER), 2::BIGINT FROM raw_vectors WHERE vec_id % 4 = 0""",
          ["node_embeddings", "raw_vectors"])


@register("embedding_upsert", o.with_ctes("""
    SELECT id, model, dim, batch FROM (
      SELECT *, row_number() OVER (PARTITION BY id, model ORDER BY batch DESC) AS rn FROM upsert_src)
    WHERE rn = 1""", "upsert_src"))
def q_embedding_upsert(spark, d):
    old = st.node_embeddings(spark, d).select("id", "model", "dim", "vector", F.lit(1).cast("long").alias("batch"))
    r = st.raw_vectors(spark, d).where(F.col("vec_id") % 4 == 0)
    new = r.select("id", F.lit("model_a").alias("model"), F.size("vector").alias("dim"), "vector",
                   F.lit(2).cast("long").alias("batch"))
    store = TableStore(spark, f"{TableStore.for_session(spark).root}/upsert-{uuid.uuid4().hex[:8]}")
    store.merge("embeddings", old, ("id",), vo.upsert_embeddings)
    store.merge("embeddings", new, ("id",), vo.upsert_embeddings)
    return store.read("embeddings").select("id", "model", "dim", "batch")


o.add_cte("domain_ids", "SELECT CAST(min(vec_id) AS VARCHAR) AS id FROM embeddings GROUP BY label", [])


def _domain_ids(spark, d):
    from canopy.sources.tables import table
    return table(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").cast("string").alias("id")).select("id")


@register("embedding_lookup", o.with_ctes(
    "SELECT id, model, dim FROM node_embeddings WHERE id IN (SELECT id FROM domain_ids)",
    "node_embeddings", "domain_ids"))
def q_embedding_lookup(spark, d):
    return vo.lookup(st.node_embeddings(spark, d), _domain_ids(spark, d)).select("id", "model", "dim")


@register("embedding_exists", o.with_ctes(
    "SELECT DISTINCT CAST(vec_id + 1 AS VARCHAR) AS id, "
    "CAST(vec_id + 1 AS VARCHAR) IN (SELECT id FROM node_embeddings) AS exists FROM node_embeddings",
    "node_embeddings"))
def q_embedding_exists(spark, d):
    e = st.node_embeddings(spark, d)
    return vo.exists(e, e.select((F.col("vec_id") + 1).cast("string").alias("id")))


@register("embedding_delete", o.with_ctes(
    "SELECT id, model FROM node_embeddings WHERE id NOT IN (SELECT id FROM domain_ids)",
    "node_embeddings", "domain_ids"))
def q_embedding_delete(spark, d):
    return vo.delete(st.node_embeddings(spark, d), _domain_ids(spark, d)).select("id", "model")


@register("embedding_load_model", o.with_ctes(
    f"SELECT id, CAST(len(vector) AS INTEGER) AS dim FROM node_embeddings WHERE model = '{FILTER_MODEL}'",
    "node_embeddings"))
def q_embedding_load_model(spark, d):
    return vo.load_model(st.node_embeddings(spark, d), FILTER_MODEL).select("id", F.size("vector").alias("dim"))


o.add_cte("node_texts", """
    SELECT hash AS id, 'file' AS kind, summary AS text FROM summaries
    UNION ALL
    SELECT hash || ':' || kind || ':' || CAST(idx AS VARCHAR) || ':' || it.name, 'chunk', it.name || ': ' || it.summary
    FROM (SELECT hash, 'func' AS kind, i - 1 AS idx, functions[i] AS it
          FROM (SELECT hash, functions, unnest(range(1, len(functions) + 1)) AS i FROM summaries)
          UNION ALL SELECT hash, 'class', 0, classes[1] FROM summaries)
    WHERE coalesce(it.name, '') <> '' AND coalesce(it.summary, '') <> ''""", ["summaries"])


@register("embedding_worklist", o.with_ctes(
    "SELECT id, kind FROM node_texts WHERE split_part(id, ':', 1) NOT IN (SELECT hash FROM cache)",
    "node_texts", "cache"))
def q_embedding_worklist(spark, d):
    """Nodes of contents not embedded by the earlier run (cache = embedded)."""
    s = st.summaries(spark, d)
    existing = vo.embedding_texts(s.join(st.cache(spark, d), "hash", "left_semi")).select("id")
    return vo.embedding_worklist(s, existing).select("id", "kind")


@register("embedding_counts", o.with_ctes(
    "SELECT count(*) FILTER (WHERE kind = 'file') AS files, count(*) FILTER (WHERE kind = 'chunk') AS chunks "
    "FROM node_texts", "node_texts"))
def q_embedding_counts(spark, d):
    return vo.embedding_counts(vo.embedding_texts(st.summaries(spark, d)))
