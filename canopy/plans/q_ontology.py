"""Catalogue: ontology build."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import ontology as on
from canopy.plans import oracle_sql as o
from canopy.plans.catalog import r6, register
from canopy.sources import standins as st

THR = 0.3
THR_MULTI = 0.2

o.add_cte("ont_files", "SELECT id AS file_id, 'vec/' || id AS path, vector, vec_id, label FROM node_embeddings",
          ["node_embeddings"])
o.add_cte("dscores", f"""SELECT f.file_id, f.path, f.vec_id, f.vector, d.domain_id,
      {o.cosine('f.vector', 'd.vector')} AS score FROM ont_files f, domains d""", ["ont_files", "domains"])


def _assign_cte(name: str, thr: float) -> None:
    o.add_cte(name, f"""SELECT file_id, path, vec_id, vector, domain_id, score, max_s < {thr} AS via_fallback FROM (
      SELECT *, max(score) OVER (PARTITION BY file_id) AS max_s,
             row_number() OVER (PARTITION BY file_id ORDER BY score DESC, domain_id) AS rn FROM dscores)
    WHERE score >= {thr} OR (max_s < {thr} AND rn = 1)""", ["dscores"])


_assign_cte("dassign", THR)
_assign_cte("dassign_multi", THR_MULTI)
o.add_cte("sub_assign", """SELECT domain_id, CASE WHEN vec_id % 50 = 7 THEN 'vecx/' || file_id ELSE path END AS path,
      CASE WHEN vec_id % 60 = 11 THEN []::VARCHAR[] ELSE list_concat(list_concat(
        ['sub-' || CAST(vec_id % 3 AS VARCHAR)],
        CASE WHEN vec_id % 4 = 0 THEN ['sub-0'] ELSE []::VARCHAR[] END),
        CASE WHEN vec_id % 45 = 2 THEN ['sub-9'] ELSE []::VARCHAR[] END) END AS subtopics
    FROM dassign""", ["dassign"])
o.add_cte("topics", f"""
    SELECT 'root' AS id, {o.sql_str(st.ROOT_TOPIC[0])} AS title, {o.sql_str(st.ROOT_TOPIC[1])} AS description,
           NULL::VARCHAR AS parent_id, 0 AS depth, TRUE AS is_root
    UNION ALL
    SELECT 'domain-' || CAST(domain_id + 1 AS VARCHAR), title, description, 'root', 1, FALSE FROM domains
    UNION ALL
    SELECT 'domain-' || CAST(domain_id + 1 AS VARCHAR) || '-sub-' || CAST(pos + 1 AS VARCHAR), title, description,
           'domain-' || CAST(domain_id + 1 AS VARCHAR), 2, FALSE FROM subtopics""", ["domains", "subtopics"])
o.add_cte("sub_ids", """SELECT domain_id, title, arg_min('domain-' || CAST(domain_id + 1 AS VARCHAR) || '-sub-'
      || CAST(pos + 1 AS VARCHAR), pos) AS topic_id FROM subtopics GROUP BY domain_id, title""", ["subtopics"])
o.add_cte("sub_exploded", "SELECT domain_id, path, unnest(subtopics) AS title FROM sub_assign", ["sub_assign"])
o.add_cte("links", """SELECT DISTINCT 'link-' || s.topic_id || '-' || f.file_id AS id, s.topic_id, f.file_id AS node_id,
      'file' AS node_type, 100 AS confidence
    FROM sub_exploded e JOIN (SELECT path, max(file_id) AS file_id FROM ont_files GROUP BY path) f ON e.path = f.path
    JOIN sub_ids s ON s.domain_id = e.domain_id AND s.title = e.title""", ["sub_exploded", "ont_files", "sub_ids"])
o.add_cte("quality", f"""SELECT count(*) AS n_pairs,
      CASE WHEN count(*) > 0 THEN avg({o.cosine('a.vector', 'b.vector')}) ELSE 0.0 END AS avg_similarity
    FROM dassign a JOIN dassign b ON a.domain_id = b.domain_id AND a.file_id < b.file_id""", ["dassign"])
o.add_cte("cov", """SELECT (SELECT count(*) FROM links) AS links, (SELECT count(DISTINCT node_id) FROM links) AS covered,
      (SELECT count(*) FROM ont_files) AS files""", ["links", "ont_files"])
o.add_cte("cov_pct", """SELECT links, covered, files,
      CASE WHEN files = 0 THEN 100 ELSE CAST(least(100, round(links * 100.0 / files)) AS INTEGER) END AS coverage_compat,
      CASE WHEN files = 0 THEN 100 ELSE CAST(least(100, round(covered * 100.0 / files)) AS INTEGER) END AS coverage_distinct
    FROM cov""", ["cov"])


def _assign(spark, d, thr=THR):
    return st.domain_assignment(spark, d, thr)


@register("domain_scores", o.with_ctes(f"SELECT file_id, domain_id, {o.r6('score')} AS score FROM dscores", "dscores"))
def q_domain_scores(spark, d):
    s = on.domain_scores(st.ont_files(spark, d), st.domains(spark, d))
    return s.select("file_id", "domain_id", r6("score").alias("score"))


@register("best_domain", o.with_ctes(f"""SELECT file_id, domain_id, {o.r6('score')} AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, domain_id) AS rn FROM dscores) WHERE rn = 1""",
    "dscores"))
def q_best_domain(spark, d):
    b = on.best_domain(st.ont_files(spark, d), st.domains(spark, d))
    return b.select("file_id", "domain_id", r6("score").alias("score"))


@register("unassigned_files", o.with_ctes(
    f"SELECT file_id FROM dscores GROUP BY file_id HAVING NOT max(score) >= {THR}", "dscores"))
def q_unassigned_files(spark, d):
    return on.unassigned_files(st.ont_files(spark, d), st.domains(spark, d), THR)


@register("domain_candidates", o.with_ctes(
    f"SELECT domain_id, file_id, {o.r6('score')} AS score FROM dscores WHERE score >= {THR}", "dscores"))
def q_domain_candidates(spark, d):
    s = on.domain_scores(st.ont_files(spark, d), st.domains(spark, d))
    return on.domain_candidates(s, THR).select("domain_id", "file_id", r6("score").alias("score"))


@register("domain_assignment", o.with_ctes(
    f"SELECT file_id, domain_id, {o.r6('score')} AS score, via_fallback FROM dassign", "dassign"))
def q_domain_assignment(spark, d):
    return _assign(spark, d).select("file_id", "domain_id", r6("score").alias("score"), "via_fallback")


@register("domain_assignment_multi", o.with_ctes(
    f"SELECT file_id, domain_id, {o.r6('score')} AS score, via_fallback FROM dassign_multi", "dassign_multi"))
def q_domain_assignment_multi(spark, d):
    return _assign(spark, d, THR_MULTI).select("file_id", "domain_id", r6("score").alias("score"), "via_fallback")


@register("distinct_assigned", o.with_ctes(
    "SELECT DISTINCT file_id FROM dassign_multi WHERE NOT via_fallback", "dassign_multi"))
def q_distinct_assigned(spark, d):
    return _assign(spark, d, THR_MULTI).where(~F.col("via_fallback")).select("file_id").distinct()


@register("domain_top_files", o.with_ctes("""SELECT domain_id, CAST(rank AS INTEGER) AS rank, file_id,
      greatest(total - 30, 0) AS n_more FROM (
      SELECT domain_id, file_id, row_number() OVER (PARTITION BY domain_id ORDER BY score DESC, file_id) AS rank,
             count(*) OVER (PARTITION BY domain_id) AS total FROM dassign) WHERE rank <= 30""", "dassign"))
def q_domain_top_files(spark, d):
    return on.domain_top_files(_assign(spark, d)).select("domain_id", "rank", "file_id", "n_more")


@register("cluster_sizes", o.with_ctes("""SELECT d.domain_id, count(a.file_id) AS n FROM domains d
    LEFT JOIN dassign a ON a.domain_id = d.domain_id GROUP BY d.domain_id""", "domains", "dassign"))
def q_cluster_sizes(spark, d):
    return on.cluster_sizes(_assign(spark, d), st.domains(spark, d))


@register("cluster_quality", o.with_ctes(
    f"SELECT n_pairs, {o.r6('avg_similarity')} AS avg_similarity FROM quality", "quality"))
def q_cluster_quality(spark, d):
    q = on.cluster_quality(_assign(spark, d))
    return q.select("n_pairs", r6("avg_similarity").alias("avg_similarity"))


def _topics(spark, d):
    return on.ontology_topics(st.ROOT_TOPIC, st.ont_domains(spark, d), st.subtopics(spark, d))


def _links(spark, d):
    return on.ontology_links(st.subtopic_assignment(spark, d), st.ont_files(spark, d),
                             st.ont_domains(spark, d), st.subtopics(spark, d))


@register("intra_cluster_pairs", o.with_ctes(f"""SELECT a.domain_id, count(*) AS n_pairs,
      {o.r6('avg(' + o.cosine('a.vector', 'b.vector') + ')')} AS avg_similarity
    FROM dassign a JOIN dassign b ON a.domain_id = b.domain_id AND a.file_id < b.file_id
    GROUP BY a.domain_id HAVING count(*) > 0""", "dassign"))
def q_intra_cluster_pairs(spark, d):
    """Per-domain pair count and mean cosine (identity; the oracle joins pairs)."""
    p = on.intra_cluster_pairs(_assign(spark, d)).where(F.col("n_pairs") > 0)
    return p.select("domain_id", "n_pairs", r6("avg_similarity").alias("avg_similarity"))


@register("ontology_topics", o.with_ctes("SELECT * FROM topics", "topics"))
def q_ontology_topics(spark, d):
    return _topics(spark, d)


@register("topic_kind", o.with_ctes(
    "SELECT id, CASE WHEN depth = 1 THEN 'domain' ELSE 'topic' END AS kind FROM topics", "topics"))
def q_topic_kind(spark, d):
    from canopy.functions.text import topic_kind
    return _topics(spark, d).select("id", topic_kind("depth").alias("kind"))


@register("ontology_links", o.with_ctes("SELECT * FROM links", "links"))
def q_ontology_links(spark, d):
    return _links(spark, d)


@register("link_resolution", o.with_ctes("""
    SELECT 'unknown_path' AS reason, path, title FROM sub_exploded
    WHERE path NOT IN (SELECT path FROM ont_files)
    UNION ALL
    SELECT 'unknown_subtopic', e.path, e.title FROM sub_exploded e
    WHERE e.path IN (SELECT path FROM ont_files)
      AND NOT EXISTS (SELECT 1 FROM sub_ids s WHERE s.domain_id = e.domain_id AND s.title = e.title)""",
    "sub_exploded", "ont_files", "sub_ids"))
def q_link_resolution(spark, d):
    return on.link_resolution(st.subtopic_assignment(spark, d), st.ont_files(spark, d),
                              st.ont_domains(spark, d), st.subtopics(spark, d))


@register("assignment_violations", o.with_ctes("""
    SELECT c.domain_id, 'not_assigned' AS reason, c.path, NULL::VARCHAR AS title FROM dassign c
    WHERE NOT EXISTS (SELECT 1 FROM sub_assign a WHERE a.domain_id = c.domain_id AND a.path = c.path)
    UNION ALL
    SELECT a.domain_id, 'unknown_path', a.path, NULL FROM sub_assign a
    WHERE NOT EXISTS (SELECT 1 FROM dassign c WHERE a.domain_id = c.domain_id AND a.path = c.path)
    UNION ALL
    SELECT e.domain_id, 'unknown_subtopic', e.path, e.title FROM sub_exploded e
    WHERE NOT EXISTS (SELECT 1 FROM subtopics s WHERE s.domain_id = e.domain_id AND s.title = e.title)
    UNION ALL
    SELECT domain_id, 'empty', path, NULL FROM sub_assign WHERE len(subtopics) = 0""",
    "dassign", "sub_assign", "sub_exploded", "subtopics"))
def q_assignment_violations(spark, d):
    cand = _assign(spark, d).select("domain_id", "path")
    return on.assignment_violations(st.subtopic_assignment(spark, d), cand, st.subtopics(spark, d))


@register("assignment_stats", o.with_ctes("""SELECT domain_id, count(*) AS files,
      CAST(sum(len(subtopics)) AS BIGINT) AS assignments, count(*) FILTER (WHERE len(subtopics) > 1) AS multi_topic
    FROM sub_assign GROUP BY ROLLUP (domain_id)""", "sub_assign"))
def q_assignment_stats(spark, d):
    return on.assignment_stats(st.subtopic_assignment(spark, d))


def _coverage(spark, d):
    n = st.ont_files(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return on.coverage(_links(spark, d), n)


@register("coverage_compat", o.with_ctes("SELECT links, files, coverage_compat FROM cov_pct", "cov_pct"))
def q_coverage_compat(spark, d):
    return _coverage(spark, d).select("links", "files", "coverage_compat")


@register("coverage_distinct", o.with_ctes("SELECT covered, files, coverage_distinct FROM cov_pct", "cov_pct"))
def q_coverage_distinct(spark, d):
    return _coverage(spark, d).select("covered", "files", "coverage_distinct")


@register("ontology_stats", o.with_ctes("""SELECT (SELECT count(*) FROM topics) AS total_topics,
      (SELECT count(*) FROM links) AS total_links, (SELECT max(depth) FROM topics) AS max_depth""", "topics", "links"))
def q_ontology_stats(spark, d):
    return on.ontology_stats(_topics(spark, d), _links(spark, d))


@register("topics_for_file", o.with_ctes(
    "SELECT l.node_id, l.topic_id, t.title, t.depth FROM links l JOIN topics t ON t.id = l.topic_id",
    "links", "topics"))
def q_topics_for_file(spark, d):
    return on.topics_for_files(_links(spark, d), _topics(spark, d))


@register("files_for_topic", o.with_ctes(
    "SELECT node_id FROM links WHERE topic_id = 'domain-1-sub-1' AND node_type = 'file'", "links"))
def q_files_for_topic(spark, d):
    return on.files_for_topic(_links(spark, d), "domain-1-sub-1")


@register("domain_subtopics", o.with_ctes("""SELECT d.domain_id, d.title AS domain_title, s.pos, s.title AS subtopic_title
    FROM domains d JOIN subtopics s ON s.domain_id = d.domain_id""", "domains", "subtopics"))
def q_domain_subtopics(spark, d):
    dm = st.domains(spark, d).select("domain_id", F.col("title").alias("domain_title"))
    s = st.subtopics(spark, d).select("domain_id", "pos", F.col("title").alias("subtopic_title"))
    return dm.join(s, "domain_id").select("domain_id", "domain_title", "pos", "subtopic_title")


@register("topic_subtree", o.with_ctes("""
    SELECT id AS ancestor_id, id AS descendant_id, 0 AS distance FROM topics
    UNION ALL SELECT parent_id, id, 1 FROM topics WHERE parent_id IS NOT NULL
    UNION ALL SELECT p.parent_id, c.id, 2 FROM topics c JOIN topics p ON c.parent_id = p.id
      WHERE p.parent_id IS NOT NULL""", "topics"))
def q_topic_subtree(spark, d):
    return on.topic_subtree(_topics(spark, d))


@register("topic_neighbours", o.with_ctes("""SELECT node_id, count(*) AS n_topics,
      CAST(sum(n - 1) AS BIGINT) AS n_neighbour_links
    FROM links l JOIN (SELECT topic_id, count(*) AS n FROM links GROUP BY topic_id) s ON s.topic_id = l.topic_id
    GROUP BY node_id""", "links"))
def q_topic_neighbours(spark, d):
    return on.topic_neighbours(_links(spark, d))


@register("ontology_overlap", o.with_ctes("""SELECT node_id, n_topics,
      CASE WHEN n_topics = 0 THEN 'uncovered' ELSE 'overlap' END AS problem FROM (
      SELECT f.file_id AS node_id, count(l.node_id) AS n_topics FROM ont_files f
      LEFT JOIN links l ON l.node_id = f.file_id GROUP BY f.file_id) WHERE n_topics <> 1""", "ont_files", "links"))
def q_ontology_overlap(spark, d):
    return on.ontology_overlap(_links(spark, d), st.ont_files(spark, d))


_VALIDATION_SQL = """SELECT len(issues) = 0 AS passed, array_to_string(issues, '; ') AS issues,
      CAST(len(issues) AS INTEGER) AS n_issues FROM (
      SELECT list_filter([
        CASE WHEN coverage < 100 THEN 'Coverage below 100%: ' || CAST(coverage AS VARCHAR) || '%' END,
        CASE WHEN total_ms > 1800000 THEN 'Total time exceeds 30 minutes: ' || CAST(round(total_ms / 1000) AS BIGINT) || 's' END,
        CASE WHEN calls > 100 THEN 'LLM calls exceed 100: ' || CAST(calls AS VARCHAR) END,
        CASE WHEN similarity < 0.1 THEN 'Low cluster similarity: ' || printf('%.3f', similarity) END],
        lambda x: x IS NOT NULL) AS issues
      FROM (SELECT (SELECT coverage_distinct FROM cov_pct) AS coverage, 0 AS total_ms,
                   1 + 2 * (SELECT count(*) FROM domains) AS calls,
                   (SELECT avg_similarity FROM quality) AS similarity))"""


def _one_row(*frames):
    """Combine one-row frames with disjoint columns (union + max, no join)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


def _metrics(spark, d):
    cov = _coverage(spark, d).select(F.col("coverage_distinct").alias("coverage"))
    q = on.cluster_quality(_assign(spark, d)).select(F.col("avg_similarity").alias("similarity"))
    nd = st.domains(spark, d).agg(on.call_count(F.count(F.lit(1))).alias("calls"))
    return _one_row(cov, q, nd).withColumn("total_ms", F.lit(0).cast("long"))


@register("ontology_validation", o.with_ctes(_VALIDATION_SQL, "cov_pct", "quality", "domains"))
def q_ontology_validation(spark, d):
    v = on.validation(_metrics(spark, d))
    return v.select("passed", F.array_join("issues", "; ").alias("issues"), F.size("issues").alias("n_issues"))


@register("ontology_export", o.with_ctes(
    "SELECT s.total_topics, s.total_links, s.max_depth, v.passed, v.issues FROM ("
    + """SELECT (SELECT count(*) FROM topics) AS total_topics,
      (SELECT count(*) FROM links) AS total_links, (SELECT max(depth) FROM topics) AS max_depth""" + ") s, ("
    + _VALIDATION_SQL + ") v", "topics", "links", "cov_pct", "quality", "domains"))
def q_ontology_export(spark, d):
    """O8 with the real metrics (Q12), not constants."""
    s = on.ontology_stats(_topics(spark, d), _links(spark, d))
    v = on.validation(_metrics(spark, d)).select("passed", F.array_join("issues", "; ").alias("issues"))
    return _one_row(s, v).select("total_topics", "total_links", "max_depth", "passed", "issues")


o.add_cte("sub_scores", f"""SELECT a.file_id, a.domain_id, s.title, s.pos, {o.cosine('a.vector', 's.vector')} AS score
    FROM dassign a JOIN subvecs s ON s.domain_id = a.domain_id""", ["dassign", "subvecs"])
o.add_cte("subvecs", """SELECT CAST(label AS INTEGER) AS domain_id, CAST(rn - 2 AS INTEGER) AS pos,
      'sub-' || CAST(rn - 2 AS VARCHAR) AS title, embedding AS vector FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn BETWEEN 2 AND 4""", [])


@register("subtopic_assignment", o.with_ctes(f"""SELECT file_id, domain_id, title, {o.r6('score')} AS score,
      max_s < {THR} AS via_fallback FROM (
      SELECT *, max(score) OVER (PARTITION BY file_id, domain_id) AS max_s,
             row_number() OVER (PARTITION BY file_id, domain_id ORDER BY score DESC, pos) AS rn FROM sub_scores)
    WHERE score >= {THR} OR (max_s < {THR} AND rn = 1)""", "sub_scores"))
def q_subtopic_assignment(spark, d):
    a = _assign(spark, d).select("file_id", "domain_id", "vector")
    s = on.assign_subtopics(a, st.subtopic_vectors(spark, d), THR)
    return s.select("file_id", "domain_id", "title", r6("score").alias("score"), "via_fallback")
