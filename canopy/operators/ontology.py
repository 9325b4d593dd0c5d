"""Topic ontology: domain assignment, quality, topics, links, checks.

Scale notes
-----------
* Domains are few by construction (2-10 from discovery).  Up to
  ``LITERAL_DOMAINS`` their vectors become literals in one projection; more
  are scored by a matrix product per Arrow batch.  Either way scoring every
  file against every domain, choosing threshold-or-best and exploding the
  assignments is a *narrow* per-row transformation: no join, no shuffle, and
  a domain that attracts a third of the files costs nothing extra.
* Intra-cluster mean cosine uses the identity
  ``sum_{i<j} u_i.u_j = (|sum u|^2 - sum |u|^2) / 2`` on unit vectors, so it
  is two map-side-combined aggregations instead of an n^2 pair join.
* Links resolve paths and (domain, title) pairs with equi-joins; whether a
  subtopic or topic table is broadcast is left to its measured size (AQE).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from canopy.functions.batches import list_rows, products, squares
from canopy.functions.vector import cosine_array, let, norm_sq, seq_norm_sq

LITERAL_DOMAINS = 64
ROWS_AT_ONCE = 4096        # vectors that a task scores against their domains' subtopics at once
SCORES_AT_ONCE = 1 << 20   # scores of a block of rows in the matrix product
THRESHOLD = 0.3
TOP_FILES = 30
ROOT_ID = "root"


# ------------------------------------------------------------ scoring

def collect_domains(domains: DataFrame) -> list:
    """(domain_id, vector) of every domain, ordered by id."""
    rows = domains.select("domain_id", "vector").orderBy("domain_id").collect()
    return [(r[0], list(r[1])) for r in rows]


def _score_array(doms: list, vec: str = "vector", na: str = "_na") -> Column:
    """Full cosine (V3 semantics) of the row's vector to each domain, in id order.

    NaN, which Spark orders above every number, becomes minus infinity: such a
    vector reaches no threshold and falls back to the lowest domain id.
    """
    return F.transform(cosine_array(vec, na, [v for _, v in doms]),
                       lambda x: F.when(F.col(vec).isNotNull(), F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x)))


def _known(score: Column) -> Column:
    """A score, or null where the vector has none."""
    return F.when(score > float("-inf"), score)


def _matrix_scores(doms: list, vec: str, ordered: bool = False):
    """Arrow batches with a column ``_s`` of each row's cosines to all domains:
    null for a null vector, 0 where either has a zero norm, minus infinity for NaN.

    ``ordered``: sums component by component, which gives the numbers of :func:`_score_array`; of a vector with a null
    inside only the score with a zero vector is known, as there."""
    m = np.array([v for _, v in doms], dtype=np.float64)
    norms = np.sqrt(squares(m) if ordered else (m * m).sum(axis=1))
    n, dim = m.shape
    step = max(1, SCORES_AT_ONCE // n)

    def score(rows: pa.RecordBatch) -> pa.RecordBatch:
        col = rows.column(rows.schema.get_field_index(vec))
        known = np.asarray(col.is_valid())
        if not pc.all(pc.equal(pc.list_value_length(col.drop_null()), dim)).as_py() and known.any():
            raise ValueError("Vectors must have the same length")
        held = col.drop_null().flatten()
        x = np.asarray(held, dtype=np.float64).reshape(-1, dim)
        own = np.sqrt(squares(x) if ordered else (x * x).sum(axis=1))
        zero = (own == 0)[:, None] | (norms == 0)[None, :]
        cos = np.where(zero, 0.0, (products(m, x).T if ordered else x @ m.T) / np.where(zero, 1.0, own[:, None] * norms[None, :]))
        values, unknown = np.full((len(known), n), np.nan), np.repeat(~known[:, None], n, axis=1)
        values[known] = np.where(np.isnan(cos), -np.inf, cos)
        if ordered and held.null_count:
            unknown[known] = np.asarray(held.is_null()).reshape(-1, dim).any(1)[:, None] & ~zero
        flat = pa.array(values.ravel(), mask=unknown.ravel())
        arrays = [*rows.columns, pa.ListArray.from_arrays(np.arange(len(known) + 1, dtype=np.int32) * n, flat)]
        return pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, "_s"])

    def run(batches):
        for rb in batches:
            for i in range(0, rb.num_rows, step):
                yield score(rb.slice(i, step))
    return run


def _scored(files: DataFrame, cols: list[str], doms: list, vec: str, batched: bool = False) -> DataFrame:
    """``cols`` and ``_s``, the row's scores to all domains in id order; ``batched``: in products a batch, with the same numbers."""
    cols = list(dict.fromkeys(cols))
    rows = files.select(*dict.fromkeys([*cols, vec]))
    few = len(doms) <= LITERAL_DOMAINS
    if few and not batched:
        return rows.withColumn("_na", norm_sq(vec)).select(*cols, _score_array(doms, vec).alias("_s"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_s", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_matrix_scores(doms, vec, ordered=few), schema).select(*cols, "_s")


def _ids(doms: list) -> Column:
    return F.array(*[F.lit(d) for d, _ in doms])


def domain_scores(files: DataFrame, domains: DataFrame, key: str = "file_id", vec: str = "vector") -> DataFrame:
    """Score of each file for each domain (files x domains rows)."""
    doms = collect_domains(domains)
    s = _scored(files, [key], doms, vec).select(key, F.posexplode("_s").alias("_i", "score"))
    return s.select(key, F.get(_ids(doms), F.col("_i")).alias("domain_id"), _known(F.col("score")).alias("score"))


def assign_domains(files: DataFrame, domains: DataFrame, threshold: float = THRESHOLD,
                   key: str = "file_id", vec: str = "vector", keep: list[str] | None = None, batched: bool = False) -> DataFrame:
    """O3 + W1 + U3 in one narrow pass: every domain with score >= threshold,
    else the single best domain (lowest id on ties), flagged ``via_fallback``.
    ``batched``: few domains are scored in products a batch too, which costs Python workers and pays for many files."""
    doms = collect_domains(domains)
    keep = keep or []
    if not doms:  # nothing to assign to; sequence(0, -1) would run backwards
        return files.select(key, F.lit(None).cast("int").alias("domain_id"), F.lit(None).cast("double").alias("score"),
                            F.lit(None).cast("boolean").alias("via_fallback"), *keep).limit(0)
    ids, n = _ids(doms), len(doms)
    t = _scored(files, [key, *keep], doms, vec, batched)
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    above = F.filter(idx, lambda i: F.get(F.col("_s"), i) >= threshold)
    best = F.array_position(F.col("_s"), F.array_max("_s")).cast("int") - 1
    chosen = F.when(F.size(above) > 0, above).otherwise(F.array(best))
    t = t.select(key, *keep, "_s", (F.size(above) == 0).alias("via_fallback"), F.explode(chosen).alias("_i"))
    return t.select(key, F.get(ids, F.col("_i")).alias("domain_id"), _known(F.get(F.col("_s"), F.col("_i"))).alias("score"),
                    "via_fallback", *keep)


def best_domain(files: DataFrame, domains: DataFrame, key: str = "file_id", vec: str = "vector") -> DataFrame:
    """Arg-max domain per file (strict '>' scan: lowest id wins ties)."""
    doms = collect_domains(domains)
    if not doms:
        return files.select(key, F.lit(None).cast("int").alias("domain_id"),
                            F.lit(None).cast("double").alias("score")).limit(0)
    t = _scored(files, [key], doms, vec)
    i = F.array_position(F.col("_s"), F.array_max("_s")).cast("int") - 1
    return t.select(key, F.get(_ids(doms), i).alias("domain_id"), _known(F.array_max("_s")).alias("score"))


def unassigned_files(files: DataFrame, domains: DataFrame, threshold: float = THRESHOLD,
                     key: str = "file_id", vec: str = "vector") -> DataFrame:
    """Files with no domain at or above the threshold."""
    doms = collect_domains(domains)
    if not doms:
        return files.select(key)
    t = _scored(files, [key], doms, vec).select(key, F.array_max("_s").alias("max_score"))
    return t.where(~(F.col("max_score") >= threshold)).select(key)


def domain_candidates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(domain, file, score) above the threshold in score order.

    Ordered with a range-partitioned global sort (balanced even when one
    domain dominates) instead of a per-domain window.
    """
    return scores.where((F.col("score") >= threshold) & ~F.isnan("score")).orderBy("domain_id", F.col("score").desc(), "file_id")


def domain_top_files(assign: DataFrame, n: int = TOP_FILES, key: str = "file_id") -> DataFrame:
    """Top-n files per domain by score (+ count of the rest).

    ``row_number <= n`` plans as partial + final WindowGroupLimit, so each
    map task forwards at most n rows per domain; the per-domain totals are a
    map-side-combined count joined back (one row per domain, broadcast).
    """
    w = Window.partitionBy("domain_id").orderBy(F.col("score").desc(), F.col(key))
    top = assign.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    tot = assign.groupBy("domain_id").agg(F.count(F.lit(1)).alias("_total"))
    return top.join(tot, "domain_id").select(
        "domain_id", "rank", key, "score", F.greatest(F.col("_total") - n, F.lit(0)).alias("n_more"))


def cluster_sizes(assign: DataFrame, domains: DataFrame) -> DataFrame:
    """A5: files per domain, zero kept for empty domains."""
    c = assign.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"))
    return domains.select("domain_id").join(c, "domain_id", "left").select(
        "domain_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _cluster_sums(assign: DataFrame, vec: str = "vector") -> DataFrame:
    """Per cluster: pairs n(n-1)/2 and the pair-cosine sum (|S|^2 - Q) / 2, with
    S = sum u, Q = sum |u|^2 over unit vectors u (zero vectors stay zero).

    One grouped aggregation: ``Summarizer.sum`` adds the unit vectors as ML
    vectors (a JVM aggregate with map-side partial sums), so a cluster of any
    size costs one buffer of ``dim`` doubles per partition.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    u = let(F.sqrt(norm_sq(vec)), lambda nrm: F.when(nrm == 0, F.transform(vec, lambda x: F.lit(0.0)))
            .otherwise(F.transform(vec, lambda x: x.cast("double") / nrm)))
    a = assign.select("domain_id", u.alias("u")).select("domain_id", "u", norm_sq("u").alias("_q"))
    g = a.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"), F.sum("_q").alias("q"),
                                   Summarizer.sum(array_to_vector("u")).alias("_s"))
    s2 = norm_sq(vector_to_array("_s"))
    pairs = F.when(F.col("n") >= 2, F.col("n") * (F.col("n") - 1) / 2).otherwise(0).cast("long")
    psum = F.when(F.col("n") >= 2, (s2 - F.col("q")) / 2).otherwise(F.lit(0.0))
    return g.select("domain_id", pairs.alias("n_pairs"), psum.alias("pair_sum"))


def intra_cluster_pairs(assign: DataFrame, vec: str = "vector") -> DataFrame:
    """J8 re-aimed: per cluster the number of pairs i<j and their mean cosine,
    from the sum-vector identity -- the pairs themselves are never formed."""
    c = _cluster_sums(assign, vec)
    return c.select("domain_id", "n_pairs", F.when(F.col("n_pairs") > 0, F.col("pair_sum") / F.col("n_pairs"))
                    .otherwise(F.lit(0.0)).alias("avg_similarity"))


def cluster_quality(assign: DataFrame, vec: str = "vector") -> DataFrame:
    """A4: pair-weighted mean cosine inside clusters, without forming pairs.

    Unit vectors u (zero stays zero, as cosine 0):  per cluster S = sum u,
    Q = sum |u|^2, n = size; pair sum = (|S|^2 - Q) / 2, pairs = n(n-1)/2.
    """
    t = _cluster_sums(assign, vec).agg(F.sum("n_pairs").cast("long").alias("n_pairs"), F.sum("pair_sum").alias("_ps"))
    return t.select(F.coalesce("n_pairs", F.lit(0).cast("long")).alias("n_pairs"),
                    F.when(F.col("n_pairs") > 0, F.col("_ps") / F.col("n_pairs")).otherwise(F.lit(0.0))
                    .alias("avg_similarity"))


# ------------------------------------------------------------ topics / links

def domain_topic_id(pos) -> Column:
    return F.concat(F.lit("domain-"), (pos + 1).cast("string"))


def subtopic_topic_id(dpos, spos) -> Column:
    return F.concat(domain_topic_id(dpos), F.lit("-sub-"), (spos + 1).cast("string"))


def ontology_topics(root: tuple[str, str], domains: DataFrame, subtopics: DataFrame) -> DataFrame:
    """Root (depth 0) -> domains (1) -> subtopics (2) with positional ids.

    ``domains`` carries its 0-based ``pos``; ``subtopics`` carries
    ``domain_id`` and its own 0-based ``pos`` inside the domain.
    """
    spark = domains.sparkSession
    r = spark.createDataFrame([(ROOT_ID, root[0], root[1])], "id string, title string, description string") \
        .select("id", "title", "description", F.lit(None).cast("string").alias("parent_id"),
                F.lit(0).alias("depth"), F.lit(True).alias("is_root"))
    d = domains.select(domain_topic_id(F.col("pos")).alias("id"), "title", "description",
                       F.lit(ROOT_ID).alias("parent_id"), F.lit(1).alias("depth"), F.lit(False).alias("is_root"))
    dp = domains.select("domain_id", F.col("pos").alias("dpos"))
    s = subtopics.join(dp, "domain_id").select(
        subtopic_topic_id(F.col("dpos"), F.col("pos")).alias("id"), "title", "description",
        domain_topic_id(F.col("dpos")).alias("parent_id"), F.lit(2).alias("depth"), F.lit(False).alias("is_root"))
    return r.unionByName(d).unionByName(s)


def subtopic_ids(domains: DataFrame, subtopics: DataFrame) -> DataFrame:
    """(domain_id, title) -> topic id; keyed per domain, so equal titles in
    two domains stay distinct (Q7).  First position wins inside a domain."""
    dp = domains.select("domain_id", F.col("pos").alias("dpos"))
    s = subtopics.join(dp, "domain_id")
    g = s.groupBy("domain_id", "title").agg(F.min_by(subtopic_topic_id(F.col("dpos"), F.col("pos")), F.col("pos"))
                                            .alias("topic_id"))
    return g


def _exploded(assignments: DataFrame) -> DataFrame:
    return assignments.select("domain_id", "path", F.explode("subtopics").alias("title"))


def _path_ids(files: DataFrame) -> DataFrame:
    """Path -> file id (one id per path, deterministic)."""
    return files.groupBy("path").agg(F.max("file_id").alias("node_id"))


def ontology_links(assignments: DataFrame, files: DataFrame, domains: DataFrame, subtopics: DataFrame) -> DataFrame:
    """H6: assignments -> (topic, file) links, confidence 100, distinct.

    A topic is its domain's position and its own, so links are made distinct as lists of positions of a
    (file, domain) and not one by one; ids are written last.
    """
    dp = domains.select("domain_id", F.col("pos").alias("dpos"))
    first = subtopics.join(dp, "domain_id").where(F.col("title").isNotNull()).groupBy("domain_id", "title") \
        .agg(F.min_by(F.struct("dpos", F.when(F.col("dpos").isNotNull(), F.col("pos")).alias("pos")), F.col("pos")).alias("s"))
    places = first.groupBy("domain_id", "s.dpos").agg(
        F.map_from_entries(F.collect_list(F.struct("title", F.struct("s.pos")))).alias("_pos"))   # the subtopics of a domain
    known = F.filter(F.transform("subtopics", lambda t: F.try_element_at("_pos", t)), lambda x: x.isNotNull())
    j = assignments.join(_path_ids(files), "path").join(places, "domain_id") \
        .select("node_id", "dpos", F.array_distinct(F.transform(known, lambda x: x["pos"])).alias("at"))
    held = j.groupBy("node_id", "dpos").agg(F.collect_set("at").alias("at"))   # few different lists, however many paths
    links = held.select(F.col("node_id").cast("string").alias("node_id"), "dpos",
                        F.explode(F.array_distinct(F.flatten("at"))).alias("pos")) \
        .select(subtopic_topic_id(F.col("dpos"), F.col("pos")).alias("topic_id"), "node_id")
    return links.select(F.concat(F.lit("link-"), F.col("topic_id"), F.lit("-"), F.col("node_id")).alias("id"),
                        "topic_id", "node_id", F.lit("file").alias("node_type"), F.lit(100).alias("confidence"))


def link_resolution(assignments: DataFrame, files: DataFrame, domains: DataFrame, subtopics: DataFrame) -> DataFrame:
    """J3/J4 rejects: unknown paths and unknown (domain, title) pairs."""
    ex = _exploded(assignments)
    paths = _path_ids(files).select("path")
    bad_path = ex.join(paths, "path", "left_anti").select(F.lit("unknown_path").alias("reason"), "path", "title")
    ok = ex.join(paths, "path", "left_semi")
    ids = subtopic_ids(domains, subtopics).select("domain_id", "title")
    bad_title = ok.join(ids, ["domain_id", "title"], "left_anti") \
        .select(F.lit("unknown_subtopic").alias("reason"), "path", "title")
    return bad_path.unionByName(bad_title)


def assignment_violations(assignments: DataFrame, candidates: DataFrame, subtopics: DataFrame) -> DataFrame:
    """The four validation checks as one violations table.

    ``candidates``: (domain_id, path) of each domain cluster.
    """
    a = assignments.select("domain_id", "path", "subtopics")
    c = candidates.select("domain_id", "path")
    not_assigned = c.join(a.select("domain_id", "path"), ["domain_id", "path"], "left_anti") \
        .select("domain_id", F.lit("not_assigned").alias("reason"), "path", F.lit(None).cast("string").alias("title"))
    unknown_path = a.join(c, ["domain_id", "path"], "left_anti") \
        .select("domain_id", F.lit("unknown_path").alias("reason"), "path", F.lit(None).cast("string").alias("title"))
    titles = subtopics.select("domain_id", "title").distinct()
    unknown_sub = _exploded(a).join(titles, ["domain_id", "title"], "left_anti") \
        .select("domain_id", F.lit("unknown_subtopic").alias("reason"), "path", "title")
    empty = a.where(F.size("subtopics") == 0) \
        .select("domain_id", F.lit("empty").alias("reason"), "path", F.lit(None).cast("string").alias("title"))
    return reduce(DataFrame.unionByName, [not_assigned, unknown_path, unknown_sub, empty])


def assignment_stats(assignments: DataFrame) -> DataFrame:
    """Per domain and overall (domain null) in one rollup."""
    n = F.size("subtopics")
    return assignments.rollup("domain_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum(n).cast("long").alias("assignments"),
        F.count(F.when(n > 1, 1)).alias("multi_topic"))


def coverage(links: DataFrame, n_files: DataFrame) -> DataFrame:
    """A6 (+Q6): compat coverage from the link count, and true distinct coverage.

    ``n_files`` is a one-row DataFrame with column ``n``.
    """
    u = links.select(F.lit(1).alias("_l"), F.col("node_id"), F.lit(0).cast("long").alias("_n")) \
        .unionByName(n_files.select(F.lit(0).alias("_l"), F.lit(None).cast("string").alias("node_id"),
                                    F.col("n").cast("long").alias("_n")))
    t = u.agg(F.sum("_l").cast("long").alias("links"), F.countDistinct("node_id").alias("covered"),
              F.sum("_n").cast("long").alias("files"))
    pct = lambda x: F.when(F.col("files") == 0, F.lit(100)).otherwise(
        F.least(F.lit(100), F.round(x * 100.0 / F.col("files")).cast("int")))
    return t.select("links", "covered", "files", pct(F.col("links")).alias("coverage_compat"),
                    pct(F.col("covered")).alias("coverage_distinct"))


def ontology_stats(topics: DataFrame, links: DataFrame) -> DataFrame:
    """Topic and link counts and maximum depth (null when empty, Q21)."""
    u = topics.select(F.lit(1).alias("_t"), F.col("depth"), F.lit(0).alias("_l")) \
        .unionByName(links.select(F.lit(0).alias("_t"), F.lit(None).cast("int").alias("depth"), F.lit(1).alias("_l")))
    return u.agg(F.coalesce(F.sum("_t"), F.lit(0)).cast("long").alias("total_topics"),
                 F.coalesce(F.sum("_l"), F.lit(0)).cast("long").alias("total_links"),
                 F.max("depth").alias("max_depth"))


def topics_for_files(links: DataFrame, topics: DataFrame) -> DataFrame:
    """J1 (batch form): every file's topics; topics are small and broadcast."""
    t = topics.select(F.col("id").alias("topic_id"), "title", "depth")
    return links.join(t, "topic_id").select("node_id", "topic_id", "title", "depth")


def files_for_topic(links: DataFrame, topic_id: str) -> DataFrame:
    """Files linked to one topic."""
    return links.where((F.col("topic_id") == topic_id) & (F.col("node_type") == "file")).select("node_id")


def topic_subtree(topics: DataFrame) -> DataFrame:
    """Closure (ancestor, descendant, distance) of the depth-2 tree."""
    t = topics.select("id", "parent_id")
    self_ = t.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("distance"))
    one = t.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(1).alias("distance"))
    p = t.select(F.col("id").alias("mid"), F.col("parent_id").alias("gp"))
    two = one.join(p, one["ancestor_id"] == p["mid"]).where(F.col("gp").isNotNull()) \
        .select(F.col("gp").alias("ancestor_id"), "descendant_id", F.lit(2).alias("distance"))
    return self_.unionByName(one).unionByName(two)


def topic_neighbours(links: DataFrame) -> DataFrame:
    """Number of topics two files share — only for pairs inside one topic,
    computed as a count per (topic, file) degree instead of listing pairs:
    returns per file how many other files share at least its topics
    (sum over its topics of topic size - 1)."""
    size = links.groupBy("topic_id").agg(F.count(F.lit(1)).alias("_n"))
    j = links.join(size, "topic_id")
    return j.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_topics"),
                                    F.sum(F.col("_n") - 1).cast("long").alias("n_neighbour_links"))


def ontology_overlap(links: DataFrame, files: DataFrame) -> DataFrame:
    """Files with no topic or with more than one."""
    c = links.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_topics"))
    f = files.select(F.col("file_id").cast("string").alias("node_id"))
    j = f.join(c, "node_id", "left").select("node_id", F.coalesce("n_topics", F.lit(0).cast("long")).alias("n_topics"))
    return j.where(F.col("n_topics") != 1).withColumn(
        "problem", F.when(F.col("n_topics") == 0, "uncovered").otherwise("overlap"))


# ------------------------------------------------------------ checks

# Fixed values that must equal the reference: acceptance limits and message texts.
MAX_TOTAL_MS = 30 * 60 * 1000
MAX_CALLS = 100
MIN_SIMILARITY = 0.1


def validation(metrics: DataFrame) -> DataFrame:
    """Acceptance checks on a metrics row (coverage, total_ms, calls, similarity)."""
    issues = F.array_compact(F.array(
        F.when(F.col("coverage") < 100, F.concat(F.lit("Coverage below 100%: "), F.col("coverage").cast("string"), F.lit("%"))),
        F.when(F.col("total_ms") > MAX_TOTAL_MS, F.concat(F.lit("Total time exceeds 30 minutes: "),
                                                         F.round(F.col("total_ms") / 1000).cast("long").cast("string"), F.lit("s"))),
        F.when(F.col("calls") > MAX_CALLS, F.concat(F.lit("LLM calls exceed 100: "), F.col("calls").cast("string"))),
        F.when(F.col("similarity") < MIN_SIMILARITY, F.concat(F.lit("Low cluster similarity: "),
                                                              F.format_number(F.col("similarity"), 3))),
    ))
    return metrics.select("*", (F.size(issues) == 0).alias("passed"), issues.alias("issues"))


def call_count(n_domains) -> Column:
    """Enrichment calls of a build: 1 discovery + 2 per domain."""
    return F.lit(1) + 2 * n_domains


def _subtopic_choices(subs: list, kind, threshold: float, names: list[str]):
    """Arrow batches whose first columns are (domain_id, vector) -> the other columns, domain_id, via_fallback, chosen (at, score).

    ``subs``: (domain_id, vectors) of each domain; ``at`` is the place of a chosen one.  Rows of other domains go, and
    those without a score: of a null vector, or one with a null inside, only the score with a zero vector is known, 0.
    """
    domains = pa.array([d for d, _ in subs], kind)
    whole = [[v is not None and None not in v for v in vectors] for _, vectors in subs]
    lengths = [np.sqrt([seq_norm_sq(v) if w else np.nan for v, w in zip(vectors, own)]) for (_, vectors), own in zip(subs, whole)]

    def run(batches):
        for rb in batches:
            for start in range(0, rb.num_rows, ROWS_AT_ONCE):
                yield from choose(rb.slice(start, ROWS_AT_ONCE))

    def choose(part):
        col = part.column(1)
        starts, sizes, flat = list_rows(col)
        known = np.asarray(col.is_valid())
        sizes = np.where(known, sizes, -1)
        if col.values.null_count:
            gone = np.concatenate([[0], np.cumsum(np.asarray(col.values.is_null()))])
            known = known & (gone[starts + sizes.clip(0)] == gone[starts])
        number = np.asarray(pc.index_in(part.column(0), value_set=domains).fill_null(-1), np.int64)
        for d, (_, vectors) in enumerate(subs):
            mine = np.flatnonzero(number == d)
            for width in np.unique(sizes[mine]).tolist():
                if width >= 0 and any(v is not None and len(v) != width for v in vectors):
                    raise ValueError("Vectors must have the same length")
                rows = mine[sizes[mine] == width]
                score, scored = scores(d, vectors, flat[starts[rows][:, None] + np.arange(max(width, 0))], known[rows])
                yield taken(part, rows, score, scored)

    def scores(d, vectors, x, known):
        """(subtopics x rows) cosines, NaN as minus infinity, and which of them there are."""
        score, own = np.zeros((len(vectors), len(x))), np.sqrt(squares(x))
        if x.shape[1] and any(whole[d]):
            score[whole[d]] = products([v for v, w in zip(vectors, whole[d]) if w], x)
        zero = (known & (own == 0)) | (lengths[d] == 0)[:, None]
        with np.errstate(all="ignore"):
            score = np.where(zero, 0.0, score / (own * lengths[d][:, None]))
        return np.where(np.isnan(score), -np.inf, score), zero | (known & np.array(whole[d])[:, None])

    def taken(part, rows, score, scored):
        score = np.where(scored, score, -np.inf)
        most = score.max(0)
        best = ((score == most) & scored).argmax(0)
        fallback = most < threshold
        chosen = (np.where(fallback, np.arange(len(score))[:, None] == best, score >= threshold) & scored).T
        some = chosen.any(1)
        row, at = np.nonzero(chosen)
        value = score.T[row, at]
        ends = np.concatenate([[0], np.cumsum(chosen[some].sum(1))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(value, mask=np.isneginf(value))], ["at", "score"])
        stay = pa.array(rows[some])
        return pa.RecordBatch.from_arrays([*(part.column(i).take(stay) for i in range(2, part.num_columns)), part.column(0).take(stay),
                                           pa.array(fallback[some]), pa.ListArray.from_arrays(ends, pairs)], names=names)

    return run


def assign_subtopics(assign: DataFrame, subtopic_vectors: DataFrame, threshold: float = THRESHOLD,
                     key: str = "file_id", vec: str = "vector", keep: list[str] | None = None,
                     listed: bool = False) -> DataFrame:
    """O5 default provider: inside its domain, each file takes every subtopic
    with cosine >= threshold, else the best one (lowest position on ties).

    The subtopics of all domains (2-10 of each) go to the tasks, which score each row's vector against its domain's
    in products a batch, summed in the order of :func:`canopy.functions.vector.cosine`; the titles are
    broadcast and joined by ``domain_id``, as a join by a few keys, or one that broadcasts the files, would
    have all files of a domain in one task.  A NaN vector falls back to the first subtopic, with a null score.
    ``listed``: one row a row of ``assign``, with all its ``titles``, instead of one a title.
    """
    keep = keep or []
    by_domain = subtopic_vectors.where(F.col("domain_id").isNotNull()).groupBy("domain_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "title", F.col("vector").alias("v")))).alias("of"))
    subs = [tuple(r) for r in by_domain.collect()]
    domain = subtopic_vectors.schema["domain_id"]
    titles = assign.sparkSession.createDataFrame([(d, [s["title"] for s in of]) for d, of in subs],
                                                 T.StructType([domain, T.StructField("_titles", T.ArrayType(T.StringType()))]))
    rows = assign.select("domain_id", vec, key, *keep)
    choice = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("score", T.DoubleType())])
    fields = [*rows.schema.fields[2:], rows.schema["domain_id"], T.StructField("via_fallback", T.BooleanType()), T.StructField("_t", T.ArrayType(choice))]
    choices = _subtopic_choices([(d, [s["v"] for s in of]) for d, of in subs], to_arrow_type(rows.schema["domain_id"].dataType),
                                threshold, [f.name for f in fields])
    t = rows.mapInArrow(choices, T.StructType(fields)).join(F.broadcast(titles), "domain_id")
    if listed:
        return t.select(key, "domain_id", F.transform("_t", lambda x: F.get(F.col("_titles"), x["at"])).alias("titles"), "via_fallback", *keep)
    t = t.select(key, "domain_id", *keep, "via_fallback", "_titles", F.explode("_t").alias("_t"))
    return t.select(key, "domain_id", F.get(F.col("_titles"), F.col("_t.at")).alias("title"), F.col("_t.score").alias("score"),
                    "via_fallback", *keep)
