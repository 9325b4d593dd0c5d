"""Catalogue: directory hierarchy and roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from canopy.operators import tree
from canopy.plans import oracle_sql as o
from canopy.plans.catalog import register
from canopy.sources import standins as st
from canopy.sources.store import TableStore

o.add_cte("deep_dirs", f"""SELECT DISTINCT unnest({o.ancestors('path')}) AS path FROM files_deep""", ["files_deep"])
o.add_cte("doc_dirs", f"""SELECT DISTINCT unnest({o.ancestors('path')}) AS path FROM files""", ["files"])
o.add_cte("deep_children", f"""
    SELECT {o.dirname('path')} AS parent, 0 AS kind, {o.basename('path')} || '/' AS label FROM deep_dirs
    UNION ALL
    SELECT {o.dirname('path')}, 1, CAST(file_id AS VARCHAR) FROM files_deep""", ["deep_dirs"])
o.add_cte("rollup_docs", f"""
    SELECT path, sum(loc)::BIGINT AS loc, count(*) AS file_count FROM (
      SELECT unnest({o.ancestors('path')}) AS path, CAST({o.loc('text')} AS BIGINT) AS loc
      FROM files WHERE len({o.segs('path')}) > 1) GROUP BY path""", ["files"])

_DIR_COLS = f"{o.dir_id('path')} AS id, {o.basename('path')} AS name, path, {o.parent_id('path')} AS parent_id"


@register("directory_tree", o.with_ctes(f"SELECT {_DIR_COLS} FROM deep_dirs", "deep_dirs"))
def q_directory_tree(spark, d):
    return tree.directory_tree(st.files_deep(spark, d))


@register("directory_rollup", o.with_ctes(
    f"SELECT path, {o.dir_id('path')} AS id, {o.parent_id('path')} AS parent_id, loc, file_count FROM rollup_docs",
    "rollup_docs"))
def q_directory_rollup(spark, d):
    return tree.directory_rollup(st.files(spark, d)).select("path", "id", "parent_id", "loc", "file_count")


o.add_cte("later_files", """SELECT path, CASE WHEN file_id % 17 = 0 THEN text || chr(10) || '// edited' ELSE text END AS text
    FROM files WHERE file_id % 13 <> 0""", ["files"])


@register("directory_rollup_incremental", o.with_ctes(f"""
    SELECT path, {o.dir_id('path')} AS id, {o.parent_id('path')} AS parent_id, sum(loc)::BIGINT AS loc, count(*) AS file_count FROM (
      SELECT unnest({o.ancestors('path')}) AS path, CAST({o.loc('text')} AS BIGINT) AS loc
      FROM later_files WHERE len({o.segs('path')}) > 1) GROUP BY path""", "later_files"))
def q_directory_rollup_incremental(spark, d):
    """A1 + X4: the roll-up of an earlier run, brought up to a later one by its changes alone."""
    f = st.files(spark, d).select("path", "text", "file_id")
    store = TableStore(spark, f"{TableStore.for_session(spark).root}/rollup-{uuid.uuid4().hex[:8]}")
    tree.update_rollup(store, "directories", f.where("file_id % 11 <> 0"))
    edited = F.when(F.col("file_id") % 17 == 0, F.concat("text", F.lit("\n// edited"))).otherwise(F.col("text"))
    tree.update_rollup(store, "directories", f.where("file_id % 13 <> 0").select("path", edited.alias("text")))
    return store.read("directories").select("path", "id", "parent_id", "loc", "file_count")


@register("repo_totals", o.with_ctes(
    f"SELECT coalesce(sum(CAST({o.loc('text')} AS BIGINT)), 0)::BIGINT AS loc, count(*) AS file_count FROM files",
    "files"))
def q_repo_totals(spark, d):
    return tree.repo_totals(st.files(spark, d))


@register("directory_child_counts", o.with_ctes(
    "SELECT parent AS path, count(*) AS child_count, count(*) FILTER (WHERE kind = 0) AS n_dirs, "
    "count(*) FILTER (WHERE kind = 1) AS n_files FROM deep_children GROUP BY parent", "deep_children"))
def q_directory_child_counts(spark, d):
    return tree.directory_child_counts(st.files_deep(spark, d))


@register("directory_summary", o.with_ctes("""
    SELECT d.path, coalesce(c.n, 0) AS child_count,
      CASE WHEN coalesce(c.n, 0) = 0 THEN '[empty directory]'
           WHEN c.n <= 3 THEN 'Contains ' || c.listing ELSE NULL END AS summary,
      coalesce(c.n, 0) > 3 AS needs_provider
    FROM deep_dirs d LEFT JOIN (
      SELECT parent, count(*) AS n,
             array_to_string(list(label ORDER BY kind, label), ', ') AS listing
      FROM deep_children GROUP BY parent) c ON c.parent = d.path""", "deep_dirs", "deep_children"))
def q_directory_summary(spark, d):
    return tree.directory_summary(st.files_deep(spark, d))


@register("root_directories", o.with_ctes(
    f"SELECT {_DIR_COLS} FROM deep_dirs WHERE instr(path, '/') = 0", "deep_dirs"))
def q_root_directories(spark, d):
    return tree.root_directories(tree.directory_tree(st.files_deep(spark, d)))


@register("directory_children", o.with_ctes(
    f"SELECT {_DIR_COLS} FROM doc_dirs WHERE {o.parent_id('path')} = {o.dir_id(chr(39) + 'src0' + chr(39))}",
    "doc_dirs"))
def q_directory_children(spark, d):
    return tree.directory_children(tree.directory_tree(st.files(spark, d)), "src0")


@register("files_in_directory", o.with_ctes(
    f"SELECT file_id, {o.dirname('path')} AS dir_path, CASE WHEN {o.dirname('path')} = '' THEN 'root' "
    f"ELSE {o.dir_id(o.dirname('path'))} END AS dir_id FROM files_deep", "files_deep"))
def q_files_in_directory(spark, d):
    return tree.files_in_directory(st.files_deep(spark, d))


@register("tree_integrity", o.with_ctes(
    "SELECT count(*) AS expected, "
    "(SELECT coalesce(sum(file_count), 0) FROM rollup_docs WHERE instr(path, '/') = 0)::BIGINT "
    f"+ count(*) FILTER (WHERE len({o.segs('path')}) = 1) AS found, "
    "count(*) = (SELECT coalesce(sum(file_count), 0) FROM rollup_docs WHERE instr(path, '/') = 0)::BIGINT "
    f"+ count(*) FILTER (WHERE len({o.segs('path')}) = 1) AS passed FROM files", "files", "rollup_docs"))
def q_tree_integrity(spark, d):
    return tree.tree_integrity(st.files(spark, d))


@register("large_directories", o.with_ctes(
    "SELECT path, loc, loc >= 1000 AS is_large FROM rollup_docs", "rollup_docs"))
def q_large_directories(spark, d):
    return tree.large_directories(st.files(spark, d))


@register("directory_scan", o.with_ctes(
    f"SELECT {o.dir_id('path')} AS id, path, loc, file_count FROM rollup_docs", "rollup_docs"))
def q_directory_scan(spark, d):
    """S9 + S10: write the directory table through the store, read it back."""
    from canopy.sources.store import TableStore
    store = TableStore.for_session(spark)
    store.replace("directories", tree.build_directories(st.files(spark, d)))
    return store.read("directories").select("id", "path", "loc", "file_count")
