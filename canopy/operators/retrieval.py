"""Categorised context search (O9, O10, W3, T2, U6, J12, A15) for query batches.

One plan answers many queries:

* topics: every query scored against the (small) topic table with the
  partial top-k scorer; best 3 per query; depth 1 -> 'domain' (dropped when
  its title equals the root's), depth 2 -> 'topic'; the root is always
  returned with score 1.0;
* nodes: a 2k pool per query (partial top-k per Arrow batch + final
  window), hydrated by joining the *broadcast pool* to the summary table
  on the content hash (one streaming scan, no shuffle of the summaries),
  then capped at 4 files and 4 chunks per query in score order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.text import default_text, parse_chunk_id, node_kind
from canopy.operators.vectors import score_batch
from canopy.schemas import CONTEXT

ROOT_SCORE = 1.0
TOP_TOPICS = 3
PER_CATEGORY = 4
POOL_FACTOR = 2


def _with_metadata(df: DataFrame, **known: Column) -> DataFrame:
    """The columns of ``schemas.CONTEXT`` without the rank; those that the category does not have are null."""
    def column(f):
        c = known[f.name] if f.name in known else F.col(f.name) if f.name in df.columns else F.lit(None)
        return c.cast(f.dataType).alias(f.name)
    return df.select(*[column(f) for f in CONTEXT if f.name != "rank"])


def _rank(df: DataFrame, part: list[str], k: int | None) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col("id"))
    r = df.withColumn("rank", F.row_number().over(w))
    return r.where(F.col("rank") <= k) if k is not None else r


def context_topics(queries: DataFrame, topics: DataFrame, topic_vectors: DataFrame,
                   top: int = TOP_TOPICS) -> DataFrame:
    """T2 + U6: root row + best ``top`` topics per query, categorised."""
    roots = topics.where(F.col("is_root")).select("id", "title", "description").limit(2).collect()
    non_root = topic_vectors.join(topics.where(~F.col("is_root")).select("id"), "id", "left_semi")
    best = _rank(score_batch(non_root, queries, top), ["query_id"], top)
    t = topics.select("id", "title", "description", "depth", F.col("parent_id").alias("parent"))
    best = best.join(t, "id").withColumn(
        "category", F.when(F.col("depth") == 1, F.lit("domain")).otherwise(F.lit("topic")))
    out = _with_metadata(best)
    if roots:
        rid, rtitle, rdesc = roots[0]
        out = out.where(~((F.col("category") == "domain") & (F.col("title") == F.lit(rtitle))))
        root_df = _with_metadata(
            queries.select("query_id").distinct(), category=F.lit("domain"), id=F.lit(rid), score=F.lit(ROOT_SCORE),
            title=F.lit(rtitle), description=F.lit(rdesc), depth=F.lit(0))
        out = root_df.unionByName(out)
    w = Window.partitionBy("query_id", "category").orderBy(F.col("score").desc(), F.col("id"))
    return out.withColumn("rank", F.row_number().over(w))


def context_hits(queries: DataFrame, nodes: DataFrame, summaries: DataFrame, k: int = 20,
                 per_category: int = PER_CATEGORY, pool_factor: int = POOL_FACTOR) -> DataFrame:
    """W3 + J12: 2k pool per query, hydrated from the summaries, capped per kind."""
    pool_k = k * pool_factor
    partial = score_batch(nodes, queries, pool_k)
    pool = _rank(partial, ["query_id"], pool_k).drop("rank")
    p = parse_chunk_id("id")
    pool = pool.select("query_id", "id", "score", node_kind("id").alias("kind"),
                       F.when(node_kind("id") == "chunk", p["file"]).otherwise(F.col("id")).alias("hash"),
                       p["kind"].alias("ckind"), p["idx"].alias("idx"), p["name"].alias("cname"))
    s = summaries.select("hash", "path", "summary")
    j = s.join(pool, "hash").withColumn("_item", F.when(F.col("ckind") == "func", F.get(F.col("summary.functions"), F.col("idx")))
                                        .otherwise(F.get(F.col("summary.classes"), F.col("idx"))))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    file_rows = _with_metadata(
        j.where(F.col("kind") == "file"), category=F.lit("file"), title=default_text("summary.title", "Unknown file"),
        description=default_text("summary.summary", "No summary available"), loc=F.col("summary.loc"),
        n_functions=count("summary.functions"), n_classes=count("summary.classes"))
    chunk_rows = _with_metadata(
        j.where((F.col("kind") == "chunk") & F.col("_item").isNotNull()), category=F.lit("chunk"),
        title=F.concat(F.col("cname"), F.lit("()")),
        description=default_text(F.col("_item.summary"), "No description available"), loc=F.col("_item.loc"),
        parent=F.col("summary.title"), chunk_kind=F.col("ckind"))
    return _rank(file_rows.unionByName(chunk_rows), ["query_id", "category"], per_category)


def context_search(queries: DataFrame, topics: DataFrame, topic_vectors: DataFrame, nodes: DataFrame,
                   summaries: DataFrame, k: int = 20) -> DataFrame:
    """All four categories for every query in one DataFrame."""
    if nodes.limit(1).count() == 0:  # O10 guard: no embeddings -> empty answer
        return context_empty(queries.sparkSession)
    a = context_topics(queries, topics, topic_vectors)
    b = context_hits(queries, nodes, summaries, k)
    return a.select(*CONTEXT.names).unionByName(b.select(*CONTEXT.names))


def context_empty(spark) -> DataFrame:
    return spark.createDataFrame([], CONTEXT)


def context_counts(ctx: DataFrame) -> DataFrame:
    """Result count per query and category."""
    return ctx.groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n"))
