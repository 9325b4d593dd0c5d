"""Catalogue: chunking, summaries and change detection."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from canopy.functions.text import content_hash, line_count
from canopy.operators import chunking as ch
from canopy.operators.declarations import declarations
from canopy.operators import summarise as sm
from canopy.operators.changes import manifest_diff
from canopy.plans import oracle_sql as o
from canopy.plans.catalog import register
from canopy.sources import standins as st

PATTERN = "^[A-ZÉÀÈ]"      # stand-in boundary: a line starting with a capital
WINDOW = 30                 # stand-in window (300 by default)

o.add_cte("bounds", f"""SELECT file_id, text, ls,
      list_filter(range(0, len(ls)), lambda i: regexp_matches(ls[i + 1], '{PATTERN}')) AS b
    FROM (SELECT file_id, text, {o.lines('text')} AS ls FROM files)""", ["files"])
o.add_cte("decl", """SELECT file_id, CAST(p - 1 AS INTEGER) AS pos, CAST(b[p] AS INTEGER) AS start_line,
      CAST(coalesce(b[p + 1] - 1, len(ls) - 1) AS INTEGER) AS end_line, ls
    FROM (SELECT file_id, ls, b, unnest(range(1, len(b) + 1)) AS p FROM bounds)""", ["bounds"])
o.add_cte("windows", f"""SELECT file_id, pos, CAST(win AS INTEGER) AS win,
      CAST(start_line + win * {WINDOW} AS INTEGER) AS start_line,
      CAST(least(start_line + win * {WINDOW} + {WINDOW - 1}, end_line) AS INTEGER) AS end_line, ls
    FROM (SELECT *, unnest(range(0, (end_line - start_line) // {WINDOW} + 1)) AS win FROM decl)""", ["decl"])
o.add_cte("whole_windows", f"""SELECT file_id, 0 AS pos, CAST(win AS INTEGER) AS win,
      CAST(win * {WINDOW} AS INTEGER) AS start_line,
      CAST(least(win * {WINDOW} + {WINDOW - 1}, len(ls) - 1) AS INTEGER) AS end_line
    FROM (SELECT *, unnest(range(0, (len(ls) - 1) // {WINDOW} + 1)) AS win FROM bounds)""", ["bounds"])
o.add_cte("fallback", """SELECT file_id, 0 AS pos, 0 AS win, 0 AS start_line, CAST(len(ls) - 1 AS INTEGER) AS end_line, ls
    FROM bounds WHERE len(b) = 0""", ["bounds"])
o.add_cte("all_chunks", """SELECT file_id, pos, win, start_line, end_line,
      array_to_string(ls[start_line + 1:end_line + 1], chr(10)) AS text
    FROM (SELECT * FROM windows UNION ALL SELECT * FROM fallback)""", ["windows", "fallback"])
o.add_cte("chunk_summ", f"""SELECT file_id, pos, win, {o.summary_parts('text')} FROM all_chunks""", ["all_chunks"])


def _chunks(spark, d):
    return ch.chunk_files(st.files(spark, d), PATTERN, WINDOW)


def _chunk_summaries(spark, d):
    c = _chunks(spark, d)
    return c.select("file_id", "pos", "win", sm.extractive_summary("text").alias("summary"))


@register("declaration_chunks", o.with_ctes(
    "SELECT file_id, pos, start_line, end_line, array_to_string(ls[start_line + 1:end_line + 1], chr(10)) AS text "
    "FROM decl", "decl"))
def q_declaration_chunks(spark, d):
    return ch.declaration_chunks(st.files(spark, d), PATTERN)


def _source_sql() -> str:
    """Expected declarations of the stand-in sources, by their places alone: lines a snippet has are known."""
    def text(lines: list[str]) -> str:
        out = []
        for piece in re.split(r"(\{n\}|\{line\})", "\n".join(lines)):
            out.append({"{n}": "CAST(n AS VARCHAR)", "{line}": "line"}.get(piece, o.sql_str(piece)))
        return " || ".join(out)

    kinds = []
    for language, (function, cls) in st.SOURCE_LINES.items():
        a, b = len(function), len(cls)
        first, last = next(i for i, x in enumerate(cls) if "@" in x or "async" in x), {"typescript": 4, "python": 5}[language]
        sign = "=" if language == "typescript" else "IS DISTINCT FROM"
        of = f"FROM source_rows WHERE lang {sign} 'en' AND n % 3"
        at = f"n // 3 * {2 * a + b} + n % 3 * {a}"
        row = "file_id, '{}' AS kind, '{}' || n AS name, {} AS owner, {} AS start_line, {} AS end_line, string_split({}, chr(10))[{}:{}] AS ls"
        kinds.append(f"SELECT {row.format('function', 'f', 'NULL', at, f'{at} + {a - 2}', text(function), 1, a - 1)}, n * 2 AS o {of} <> 2")
        kinds.append(f"SELECT {row.format('class', 'C', 'NULL', at, f'{at} + {b - 2}', text(cls), 1, b - 1)}, n * 2 AS o {of} = 2")
        owner = "'C' || n"
        kinds.append(f"SELECT {row.format('method', 'm', owner, f'{at} + {first}', f'{at} + {last}', text(cls), first + 1, last + 1)}, "
                     f"n * 2 + 1 AS o {of} = 2")
    return f"""SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY o) - 1 AS INTEGER) AS pos, kind, name, owner,
      CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, array_to_string(ls, chr(10)) AS text
    FROM ({' UNION ALL '.join(kinds)})"""


o.add_cte("source_rows", f"""SELECT file_id, lang, n, ls[n + 1] AS line
    FROM (SELECT file_id, lang, ls, unnest(range(0, len(ls))) AS n FROM (SELECT file_id, lang, {o.lines('text')} AS ls FROM files))""",
          ["files"])


@register("declarations", o.with_ctes(_source_sql(), "source_rows"))
def q_declarations(spark, d):
    """C1 by a scanner with lexical state: functions, classes and methods of sources."""
    return declarations(st.source_files(spark, d))


@register("loc_window_chunks", o.with_ctes(
    "SELECT file_id, pos, win, start_line, end_line FROM whole_windows", "whole_windows"))
def q_loc_window_chunks(spark, d):
    """C2 on whole-file segments: every file longer than the window is split."""
    return ch.loc_windows(ch.chunk_fallback(st.files(spark, d), None), WINDOW) \
        .select("file_id", "pos", "win", "start_line", "end_line")


@register("chunk_fallback", o.with_ctes("SELECT file_id, start_line, end_line FROM fallback", "fallback"))
def q_chunk_fallback(spark, d):
    return ch.chunk_fallback(st.files(spark, d), PATTERN).select("file_id", "start_line", "end_line")


@register("summarise_extractive", o.with_ctes(
    "SELECT file_id, pos, win, title, summary, loc FROM chunk_summ", "chunk_summ"))
def q_summarise_extractive(spark, d):
    s = _chunk_summaries(spark, d)
    return s.select("file_id", "pos", "win", "summary.title", "summary.summary", "summary.loc")


@register("merge_chunk_summaries", o.with_ctes(f"""
    SELECT c.file_id, arg_min(title, pos * 100000 + win) AS title,
           string_agg(summary, chr(10) || chr(10) ORDER BY pos, win) AS summary,
           CAST(sum(len(list_filter(functions, lambda x: x.name IS NOT NULL))) AS INTEGER) AS n_functions,
           CAST(sum(len(list_filter(classes, lambda x: x.name IS NOT NULL))) AS INTEGER) AS n_classes,
           any_value(f.loc) AS loc
    FROM chunk_summ c JOIN (SELECT file_id, {o.loc('text')} AS loc FROM files) f ON c.file_id = f.file_id
    GROUP BY c.file_id""", "chunk_summ", "files"))
def q_merge_chunk_summaries(spark, d):
    s = _chunk_summaries(spark, d).withColumn("chunk_no", F.col("pos") * 100000 + F.col("win"))
    loc = st.files(spark, d).select("file_id", line_count("text").alias("loc"))
    m = sm.merge_chunk_summaries(s, key="file_id", pos="chunk_no", loc=loc)
    named = lambda c: F.size(F.filter(c, lambda x: x["name"].isNotNull()))
    return m.select("file_id", "title", "summary", named("functions").alias("n_functions"),
                    named("classes").alias("n_classes"), "loc")


def _flaky(text: str) -> dict:
    """Stand-in model: fails on very short texts, otherwise extractive."""
    if len(text) < 120:
        raise ValueError("input too short for the model")
    ls = text.split("\n")
    return {"title": ls[0], "summary": text, "functions": [], "classes": [], "loc": len(ls)}


@register("summarise_with_errors")
def q_summarise_with_errors(spark, d):
    """Retries, then an error row; the job never fails on one row."""
    f = st.files(spark, d).select(content_hash("text").alias("hash"), "text").dropDuplicates(["hash"])
    out = sm.summarise_with_provider(f, sm.FunctionProvider(_flaky, retries=2, backoff_s=0.0))
    return out.select("hash", "status", "error", F.col("summary.title").alias("title"),
                      F.col("summary.loc").alias("loc"))


@register("manifest_diff", o.with_ctes(f"""
    SELECT coalesce(n.path, o.path) AS path,
           CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
                WHEN o.hash <> n.hash THEN 'changed' ELSE 'same' END AS change
    FROM (SELECT path, {o.content_hash('text')} AS hash FROM files WHERE file_id % 11 <> 0) o
    FULL OUTER JOIN (SELECT path, {o.content_hash("CASE WHEN file_id % 17 = 0 THEN text || chr(10) || '// edited' ELSE text END")} AS hash
                     FROM files WHERE file_id % 13 <> 0) n ON o.path = n.path""", "files"))
def q_manifest_diff(spark, d):
    old, new = st.manifests(spark, d)
    return manifest_diff(old, new)
