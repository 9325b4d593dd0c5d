"""Scalar string / path / id functions used across the library.

All functions take and return ``Column``s built from ``pyspark.sql.functions``
so they stay inside Catalyst / whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "MODEL_VERSION", "content_hash", "extension", "detect_language", "line_count",
    "segments", "dirname", "basename", "ancestors", "prefixes", "dir_id",
    "embed_text", "chunk_id", "parse_chunk_id", "node_kind", "topic_kind",
    "default_text", "provider_of", "model_of", "relevance_pct", "text_key",
    "lines",
]

# Fixed values that must equal the reference for equal cache keys.
MODEL_VERSION = "2025-07-11-02"
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript",
    ".py": "python",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(text, version: str = MODEL_VERSION) -> Column:
    """SHA-256 hex of the content followed by the model-version string."""
    return F.sha2(F.concat(_c(text), F.lit(version)), 256)


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path) -> Column:
    """Lower-cased extension of the last path segment (``''`` when none).

    A leading dot alone (``.gitignore``) is not an extension.
    """
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def detect_language(path) -> Column:
    """ts/tsx/js/jsx -> typescript, py -> python, else plain."""
    ext = extension(path)
    expr = None
    for lang in dict.fromkeys(LANGUAGE_BY_EXTENSION.values()):
        exts = [e for e, l in LANGUAGE_BY_EXTENSION.items() if l == lang]
        cond = ext.isin(*exts)
        expr = F.when(cond, F.lit(lang)) if expr is None else expr.when(cond, F.lit(lang))
    return expr.otherwise(F.lit("plain"))


def lines(text) -> Column:
    """Lines of a text; a trailing newline yields a trailing empty line."""
    return F.split(_c(text), "\n", -1)


def line_count(text) -> Column:
    """Number of newline-separated pieces (empty text -> 1)."""
    return F.size(lines(text))


def segments(path) -> Column:
    return F.split(_c(path), "/")


def dirname(path) -> Column:
    """Parent path, '' for a top-level entry."""
    segs = segments(path)
    return F.when(F.size(segs) <= 1, F.lit("")).otherwise(
        F.array_join(F.slice(segs, 1, F.size(segs) - 1), "/"))


def ancestors(path) -> Column:
    """All ancestor directory paths of a file path, shallowest first.

    Empty array for a top-level file (guarded: ``sequence(1, 0)`` would run
    backwards in Spark).
    """
    segs = segments(path)
    n = F.size(segs) - 1
    return F.when(n >= 1, F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(segs, 1, i), "/")
    )).otherwise(F.array().cast("array<string>"))


def prefixes(path) -> Column:
    """Ancestors plus the path itself (what a directory walk tests in turn)."""
    segs = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(segs)),
                       lambda i: F.array_join(F.slice(segs, 1, i), "/"))


def dir_id(path) -> Column:
    """P5: first 16 hex characters of SHA-256(path)."""
    return F.substring(F.sha2(_c(path), 256), 1, 16)


def embed_text(a, b) -> Column:
    """``a: b`` (``concat`` keeps a null visible as null)."""
    return F.concat(_c(a), F.lit(": "), _c(b))


def chunk_id(file_key, kind, idx, name) -> Column:
    """``<file>:<func|class>:<index>:<name>``."""
    return F.concat_ws(":", _c(file_key), _c(kind), _c(idx).cast("string"), _c(name))


def parse_chunk_id(cid) -> Column:
    """struct(file, kind, idx, name); the name keeps any further ':'."""
    parts = F.split(_c(cid), ":", 4)
    return F.struct(
        F.get(parts, 0).alias("file"),
        F.get(parts, 1).alias("kind"),
        F.get(parts, 2).cast("int").alias("idx"),
        F.get(parts, 3).alias("name"),
    )


def node_kind(cid) -> Column:
    """P9: 'chunk' when the id contains ':func:' or ':class:', else 'file'."""
    c = _c(cid)
    return F.when(c.contains(":func:") | c.contains(":class:"), F.lit("chunk")).otherwise(F.lit("file"))


def topic_kind(depth) -> Column:
    """Depth 1 -> domain, else topic."""
    return F.when(_c(depth).cast("int") == 1, F.lit("domain")).otherwise(F.lit("topic"))


def default_text(x, default: str) -> Column:
    """P14 ``x || default``: empty string and null both fall back."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))


def provider_of(model) -> Column:
    """Provider part of ``provider/model``."""
    return F.split_part(_c(model), F.lit("/"), F.lit(1))


def model_of(model) -> Column:
    """Model part of ``provider/model`` (whole string when no '/')."""
    return F.regexp_replace(_c(model), r"^[^/]*/", "")


def relevance_pct(score) -> Column:
    """Relevance as a percentage with one decimal."""
    return F.round(_c(score) * 100, 1)


def text_key(text) -> Column:
    """P16 re-aimed: collision-safe dedupe key of an embedding text."""
    return F.sha2(_c(text), 256)
