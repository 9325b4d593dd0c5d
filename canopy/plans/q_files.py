"""Catalogue: scans, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import text as tx
from canopy.plans import oracle_sql as o
from canopy.plans.catalog import register
from canopy.operators import summarise as sm
from canopy.sources import scan, standins as st

RULES = scan.parse_ignore_rules(st.IGNORE_FILE_LINES)
RULES_COMPAT = scan.parse_ignore_rules(st.IGNORE_FILE_LINES_COMPAT)
SIZE_LIMIT = 8192  # stand-in scan size limit (both sides of the limit occur)


# What RULES ignore, said by path segments, without patterns.
_SEG = o.segs("path")
_IGNORED = (f"({_SEG}[1] = 'src3' OR (starts_with({_SEG}[1], 'src1') AND {_SEG}[2] = 'de' AND NOT starts_with({_SEG}[3], 'doc41')) OR list_contains({_SEG}, 'doc7.ts') "
            f"OR ({_SEG}[1] = 'src5' AND {_SEG}[2] <> 'en') OR (starts_with({_SEG}[3], 'doc4') AND NOT starts_with({_SEG}[3], 'doc41')))")


_EXTS = o.sql_list(scan.SUPPORTED_EXTENSIONS)
_DIRSEG = f"{o.segs('path')}[1:len({o.segs('path')}) - 1]"
_IGN_DIRS = " OR ".join(f"contains(s, {o.sql_str(n)})" for n in scan.IGNORED_DIR_NAMES)


def _scan_chain(df):
    df = scan.filter_ignore_rules(df, RULES)
    df = scan.filter_ignored_dirs(df)
    return scan.filter_extension(df)


_SCAN_WHERE = (f"NOT {_IGNORED} AND NOT len(list_filter({_DIRSEG}, lambda s: {_IGN_DIRS})) > 0 "
               f"AND list_contains({_EXTS}, {o.extension('path')})")


@register("scan_files", o.with_ctes(f"SELECT file_id, path, size FROM files WHERE {_SCAN_WHERE}", "files"))
def q_scan_files(spark, d):
    return _scan_chain(st.files(spark, d)).select("file_id", "path", "size")


@register("filter_extension", o.with_ctes(
    f"SELECT file_id, path FROM files WHERE list_contains({_EXTS}, {o.extension('path')})", "files"))
def q_filter_extension(spark, d):
    return scan.filter_extension(st.files(spark, d)).select("file_id", "path")


@register("filter_ignored_dirs", o.with_ctes(
    f"SELECT file_id, path FROM files_deep WHERE NOT len(list_filter({_DIRSEG}, lambda s: {_IGN_DIRS})) > 0",
    "files_deep"))
def q_filter_ignored_dirs(spark, d):
    return scan.filter_ignored_dirs(st.files_deep(spark, d)).select("file_id", "path")


@register("filter_max_size", o.with_ctes(
    f"SELECT file_id, path, size FROM files WHERE size <= {SIZE_LIMIT}", "files"))
def q_filter_max_size(spark, d):
    return scan.filter_max_size(st.files(spark, d), SIZE_LIMIT).select("file_id", "path", "size")


@register("limit_files", o.with_ctes(
    f"SELECT file_id, path FROM files ORDER BY path LIMIT {scan.MAX_FILES}", "files"))
def q_limit_files(spark, d):
    return scan.limit_files(st.files(spark, d), scan.MAX_FILES).select("file_id", "path")


@register("filter_ignore_rules", o.with_ctes(
    f"SELECT file_id, path FROM files WHERE NOT {_IGNORED}", "files"))
def q_filter_ignore_rules(spark, d):
    return scan.filter_ignore_rules(st.files(spark, d), RULES).select("file_id", "path")


@register("filter_ignore_rules_compat", o.with_ctes(
    f"SELECT file_id, path FROM files WHERE {_SEG}[1] = 'src5' AND NOT ({_SEG}[2] LIKE 'd_%') AND NOT list_contains({_SEG}, 'doc7.ts')",
    "files"))
def q_filter_ignore_rules_compat(spark, d):
    return scan.filter_ignore_rules(st.files(spark, d), RULES_COMPAT, compat=True).select("file_id", "path")


@register("file_records", o.with_ctes(
    f"SELECT file_id, path, {o.basename('path')} AS name, {o.loc('text')} AS loc, size "
    f"FROM files WHERE {_SCAN_WHERE}", "files"))
def q_file_records(spark, d):
    return scan.file_records(_scan_chain(st.files(spark, d)))


@register("content_hash", o.with_ctes(f"SELECT file_id, {o.content_hash('text')} AS hash FROM files", "files"))
def q_content_hash(spark, d):
    return st.files(spark, d).select("file_id", tx.content_hash("text").alias("hash"))


@register("detect_language", o.with_ctes(f"SELECT file_id, {o.language('path')} AS language FROM files", "files"))
def q_detect_language(spark, d):
    return st.files(spark, d).select("file_id", tx.detect_language("path").alias("language"))


@register("loc", o.with_ctes(f"SELECT file_id, {o.loc('text')} AS loc FROM files", "files"))
def q_loc(spark, d):
    return st.files(spark, d).select("file_id", tx.line_count("text").alias("loc"))


@register("path_parts", o.with_ctes(
    f"SELECT file_id, {o.dirname('path')} AS dirname, {o.basename('path')} AS basename, "
    f"CAST(len({o.segs('path')}) AS INTEGER) AS n_segments FROM files_deep", "files_deep"))
def q_path_parts(spark, d):
    return st.files_deep(spark, d).select(
        "file_id", tx.dirname("path").alias("dirname"), tx.basename("path").alias("basename"),
        F.size(tx.segments("path")).alias("n_segments"))


@register("directory_id", o.with_ctes(
    f"SELECT DISTINCT {o.dirname('path')} AS path, {o.dir_id(o.dirname('path'))} AS id FROM files_deep",
    "files_deep"))
def q_directory_id(spark, d):
    return st.files_deep(spark, d).select(tx.dirname("path").alias("path")).distinct() \
        .select("path", tx.dir_id("path").alias("id"))


@register("embed_text", o.with_ctes("SELECT hash, title || ': ' || summary AS text FROM summaries", "summaries"))
def q_embed_text(spark, d):
    s = st.summaries(spark, d)
    return s.select("hash", tx.embed_text("summary.title", "summary.summary").alias("text"))


_CHUNK_ROWS_SQL = """SELECT hash || ':' || kind || ':' || CAST(idx AS VARCHAR) || ':' || it.name AS chunk_id,
       hash, kind, idx, it.name AS name, it.name || ': ' || it.summary AS text
FROM (SELECT hash, 'func' AS kind, CAST(i - 1 AS INTEGER) AS idx, functions[i] AS it
      FROM (SELECT hash, functions, unnest(range(1, len(functions) + 1)) AS i FROM summaries)
      UNION ALL
      SELECT hash, 'class', 0, classes[1] FROM summaries)
WHERE coalesce(it.name, '') <> '' AND coalesce(it.summary, '') <> ''"""


@register("chunk_rows", o.with_ctes(_CHUNK_ROWS_SQL, "summaries"))
def q_chunk_rows(spark, d):
    from canopy.operators.vectors import chunk_rows
    return chunk_rows(st.summaries(spark, d))


@register("parse_chunk_id", o.with_ctes(
    "SELECT chunk_id, split_part(chunk_id, ':', 1) AS file, split_part(chunk_id, ':', 2) AS kind, "
    "CAST(split_part(chunk_id, ':', 3) AS INTEGER) AS idx, "
    "array_to_string(string_split(chunk_id, ':')[4:], ':') AS name FROM (" + _CHUNK_ROWS_SQL + ")", "summaries"))
def q_parse_chunk_id(spark, d):
    from canopy.operators.vectors import chunk_rows
    c = chunk_rows(st.summaries(spark, d))
    p = tx.parse_chunk_id("chunk_id")
    return c.select("chunk_id", p["file"].alias("file"), p["kind"].alias("kind"),
                    p["idx"].alias("idx"), p["name"].alias("name"))


@register("node_kind", o.with_ctes(
    "SELECT id, CASE WHEN contains(id, ':func:') OR contains(id, ':class:') THEN 'chunk' ELSE 'file' END AS kind "
    "FROM (SELECT chunk_id AS id FROM (" + _CHUNK_ROWS_SQL + ") UNION ALL SELECT hash FROM summaries)",
    "summaries"))
def q_node_kind(spark, d):
    from canopy.operators.vectors import chunk_rows
    s = st.summaries(spark, d)
    ids = chunk_rows(s).select(F.col("chunk_id").alias("id")).unionByName(s.select(F.col("hash").alias("id")))
    return ids.select("id", tx.node_kind("id").alias("kind"))


@register("summary_json_roundtrip", o.with_ctes(
    "SELECT hash, title, summary, loc, CAST(len(functions) AS INTEGER) AS n_functions, "
    "functions[1].name AS first_function FROM summaries", "summaries"))
def q_summary_json_roundtrip(spark, d):
    from canopy.schemas import SUMMARY
    s = st.summaries(spark, d).select("hash", F.to_json("summary").alias("json"))
    back = s.select("hash", F.from_json("json", SUMMARY).alias("s"))
    return back.select("hash", "s.title", "s.summary", "s.loc",
                       F.size("s.functions").alias("n_functions"),
                       F.get("s.functions", 0).getField("name").alias("first_function"))


@register("summary_to_json")
def q_summary_to_json(spark, d):
    """One JSON document per file summary (the ``--output`` sink form)."""
    s = st.summaries(spark, d)
    return s.select("hash", "path", F.to_json(F.struct("hash", "language", "summary", "path")).alias("json"))


@register("default_fields", o.with_ctes(
    "SELECT hash, coalesce(nullif(title, ''), 'Unknown file') AS title, "
    "coalesce(nullif(summary, ''), 'No summary available') AS summary, "
    "CAST(coalesce(len(functions), 0) AS INTEGER) AS n_functions FROM summaries", "summaries"))
def q_default_fields(spark, d):
    s = st.summaries(spark, d)
    return s.select("hash", tx.default_text("summary.title", "Unknown file").alias("title"),
                    tx.default_text("summary.summary", "No summary available").alias("summary"),
                    F.coalesce(F.size("summary.functions"), F.lit(0)).alias("n_functions"))


@register("dedupe_texts", o.with_ctes(
    "SELECT sha256(text) AS text_key, count(*) AS n FROM "
    "(SELECT summary AS text FROM summaries UNION ALL "
    "SELECT text FROM (" + _CHUNK_ROWS_SQL + ")) WHERE text IS NOT NULL GROUP BY 1", "summaries"))
def q_dedupe_texts(spark, d):
    from canopy.operators.vectors import embedding_texts
    t = embedding_texts(st.summaries(spark, d))
    return t.where(F.col("text").isNotNull()).groupBy(tx.text_key("text").alias("text_key")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("split_model_name", o.with_ctes(
    "SELECT file_id, split_part(path, '/', 1) AS provider, regexp_replace(path, '^[^/]*/', '') AS model "
    "FROM files", "files"))
def q_split_model_name(spark, d):
    return st.files(spark, d).select("file_id", tx.provider_of("path").alias("provider"),
                                     tx.model_of("path").alias("model"))


@register("cache_hit_miss", o.with_ctes(
    "SELECT s.hash, CASE WHEN c.hash IS NULL THEN 'miss' ELSE 'hit' END AS status "
    "FROM summaries s LEFT JOIN cache c ON s.hash = c.hash", "summaries", "cache"))
def q_cache_hit_miss(spark, d):
    return sm.cache_status(st.summaries(spark, d).select("hash"), st.cache(spark, d))


@register("incremental_new_content", o.with_ctes(
    "SELECT hash, min(file_id) AS file_id FROM keyed WHERE hash NOT IN (SELECT hash FROM cache) GROUP BY hash",
    "keyed", "cache"))
def q_incremental_new_content(spark, d):
    return sm.incremental_new_content(st.files(spark, d), st.cache(spark, d))
