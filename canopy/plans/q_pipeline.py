"""Catalogue: discovery, full builds, cost estimate, incremental stream (O1-O2, O4, O6, O11, A11-A14, ST1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from canopy.operators import cost as co
from canopy.operators import discovery as dv
from canopy.operators import ontology as on
from canopy.operators import tree
from canopy.operators.summarise import incremental_new_content
from canopy.plans import oracle_sql as o
from canopy.plans.catalog import register
from canopy.sources import standins as st
from canopy.sources.store import TableStore

o.add_cte("doc_children", f"""
    SELECT {o.dirname('path')} AS parent, 0 AS kind, {o.basename('path')} || '/' AS label FROM doc_dirs
    UNION ALL SELECT {o.dirname('path')}, 1, CAST(file_id AS VARCHAR) FROM files""", ["doc_dirs", "files"])
o.add_cte("dir_summaries", f"""
    SELECT d.path, CASE WHEN coalesce(c.n, 0) = 0 THEN '[empty directory]'
        WHEN c.n <= 3 THEN 'Contains ' || c.listing
        ELSE 'Directory ''' || {o.basename('d.path')} || ''' with ' || CAST(c.n AS VARCHAR) || ' items ('
             || CAST(c.n_dirs AS VARCHAR) || ' sub-directories, ' || CAST(c.n - c.n_dirs AS VARCHAR) || ' files)' END AS summary
    FROM doc_dirs d LEFT JOIN (
      SELECT parent, count(*) AS n, count(*) FILTER (WHERE kind = 0) AS n_dirs,
             array_to_string(list(label ORDER BY kind, label), ', ') AS listing
      FROM doc_children GROUP BY parent) c ON c.parent = d.path""", ["doc_dirs", "doc_children"])


@register("top_directories", o.with_ctes(
    f"SELECT path, file_count, loc FROM rollup_docs WHERE len({o.segs('path')}) <= 2", "rollup_docs"))
def q_top_directories(spark, d):
    return dv.top_directories(tree.directory_rollup(st.files(spark, d))).select("path", "file_count", "loc")


o.add_cte("summaries_by_path", "SELECT k.path, s.* EXCLUDE (path) FROM keyed k JOIN summaries s USING (hash)",
          ["keyed", "summaries"])


@register("key_files", o.with_ctes(
    "SELECT path, title, CAST(coalesce(length(summary), 0) AS INTEGER) AS summary_len FROM summaries_by_path", "summaries_by_path"))
def q_key_files(spark, d):
    return dv.key_files(dv.per_path(st.files(spark, d), st.summaries(spark, d)))


@register("discovery_context", o.with_ctes(f"""
    SELECT 0 AS section, 0 AS weight, '' AS path,
           'Repository contains ' || CAST((SELECT count(*) FROM summaries_by_path) AS VARCHAR) || ' files across '
           || CAST((SELECT count(*) FROM rollup_docs) AS VARCHAR) || ' directories.' AS line
    UNION ALL
    SELECT 1, r.loc, r.path, '• ' || r.path || ' (' || CAST(r.file_count AS VARCHAR) || ' files, '
           || CAST(r.loc AS VARCHAR) || ' LOC): ' || coalesce(s.summary, '')
    FROM rollup_docs r LEFT JOIN dir_summaries s ON s.path = r.path WHERE len({o.segs('r.path')}) <= 2
    UNION ALL
    SELECT 2, coalesce(length(summary), 0), path, '• ' || path || ': ' || coalesce(title, '') || ' - ' || coalesce(summary, '')
    FROM summaries_by_path""", "summaries_by_path", "rollup_docs", "dir_summaries"))
def q_discovery_context(spark, d):
    f = st.files(spark, d)
    return dv.discovery_lines(dv.per_path(f, st.summaries(spark, d)), tree.build_directories(f))


@register("discover_domains")
def q_discover_domains(spark, d):
    """O2 default provider: KMeans domains over the file vectors."""
    return dv.discover_domains(st.ont_files(spark, d)).select("domain_id", "title", "description")


@register("discover_subtopics")
def q_discover_subtopics(spark, d):
    """O4 default provider: per-domain subtopics over all files of each domain."""
    subs, _ = dv.discover_subtopics(st.domain_assignment(spark, d))
    return subs.select("domain_id", "pos", "title", "description")


def _build(spark, d):
    from canopy.plans.build import build_ontology
    store = TableStore.for_session(spark)
    store = TableStore(spark, f"{store.root}/build-{uuid.uuid4().hex[:8]}")
    return build_ontology(st.ont_files(spark, d).select("file_id", "path", "vector"), store)


@register("build_ontology")
def q_build_ontology(spark, d):
    """The persisted topic table of a full default-provider build."""
    return _build(spark, d)["topics"]


@register("run_metrics")
def q_run_metrics(spark, d):
    """A14 + O7: timings, counts, coverage, quality, calls and checks of a build."""
    m = _build(spark, d)["metrics"]
    return m.withColumn("issues", F.array_join("issues", "; "))


@register("cost_estimate", o.with_ctes(f"""
    SELECT stage, model, items, input_tokens, output_tokens, {o.r6('cost')} AS cost, approved FROM (
      SELECT s.*, s.input_tokens / 1000000 * coalesce(p.input_price, 1.0)
                  + s.output_tokens / 1000000 * coalesce(p.output_price, 3.0) AS cost, NULL::BOOLEAN AS approved
      FROM (SELECT stage, model, items, items * {co.FILE_INPUT_TOKENS} AS input_tokens,
                   items * {co.FILE_OUTPUT_TOKENS} AS output_tokens FROM (
              SELECT 'summarization' AS stage, 'model_a' AS model, count(*) AS items FROM (
                SELECT hash FROM keyed WHERE hash NOT IN (SELECT hash FROM cache) GROUP BY hash))
            UNION ALL
            SELECT stage, model, items, items * {co.DIR_INPUT_TOKENS}, items * {co.DIR_OUTPUT_TOKENS} FROM (
              SELECT 'directory_summaries' AS stage, 'model_x' AS model, count(*) AS items FROM (
                SELECT parent FROM doc_children WHERE parent <> '' GROUP BY parent HAVING count(*) > 3))) s
      LEFT JOIN prices p ON p.model = s.model)
    UNION ALL
    SELECT 'total', NULL, CAST(sum(items) AS BIGINT), CAST(sum(input_tokens) AS BIGINT),
           CAST(sum(output_tokens) AS BIGINT), {o.r6('sum(cost)')}, sum(cost) <= 1.0 FROM (
      SELECT s.*, s.input_tokens / 1000000 * coalesce(p.input_price, 1.0)
                  + s.output_tokens / 1000000 * coalesce(p.output_price, 3.0) AS cost
      FROM (SELECT 'model_a' AS model, count(*) AS items, count(*) * {co.FILE_INPUT_TOKENS} AS input_tokens,
                   count(*) * {co.FILE_OUTPUT_TOKENS} AS output_tokens FROM (
              SELECT hash FROM keyed WHERE hash NOT IN (SELECT hash FROM cache) GROUP BY hash)
            UNION ALL
            SELECT 'model_x', count(*), count(*) * {co.DIR_INPUT_TOKENS}, count(*) * {co.DIR_OUTPUT_TOKENS} FROM (
              SELECT parent FROM doc_children WHERE parent <> '' GROUP BY parent HAVING count(*) > 3)) s
      LEFT JOIN prices p ON p.model = s.model)""", "keyed", "cache", "doc_children", "prices"))
def q_cost_estimate(spark, d):
    f = st.files(spark, d)
    work = incremental_new_content(f, st.cache(spark, d))
    dirs = tree.directory_summary(f).where(F.col("needs_provider"))
    stages = co.stage_items(work, "summarization", "model_a", co.FILE_INPUT_TOKENS, co.FILE_OUTPUT_TOKENS) \
        .unionByName(co.stage_items(dirs, "directory_summaries", "model_x", co.DIR_INPUT_TOKENS, co.DIR_OUTPUT_TOKENS))
    p = co.price(stages, st.prices(spark))
    return p.select("stage", "model", "items", "input_tokens", "output_tokens",
                    F.round("cost", 6).alias("cost"), "approved")


@register("stream_incremental", o.with_ctes("SELECT DISTINCT hash FROM keyed", "keyed"))
def q_stream_incremental(spark, d):
    """ST1: documents streamed file by file; run twice, the second adds nothing."""
    from canopy.streaming.incremental import document_stream, start_incremental
    base = TableStore.for_session(spark)
    run = uuid.uuid4().hex[:8]
    store = TableStore(spark, f"{base.root}/stream-{run}")
    for attempt in range(2):
        q = start_incremental(spark, document_stream(spark, d), store, run)
        q.awaitTermination()
    return store.read("summaries").select("hash")


@register("pipeline_run")
def q_pipeline_run(spark, d):
    """End-to-end run over the files stand-in; returns the stage status table."""
    from canopy.plans.build import run_pipeline
    base = TableStore.for_session(spark)
    store = TableStore(spark, f"{base.root}/run-{uuid.uuid4().hex[:8]}")
    files = st.files(spark, d).select("file_id", "path", "text", "size")
    return run_pipeline(spark, files, store)
