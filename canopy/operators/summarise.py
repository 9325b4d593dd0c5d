"""Chunk / file summaries (C4-C8) and the provider seam.

The default provider is extractive and written in Spark SQL (no Python
worker): title = first line, summary = the first sentence of every line,
functions = all lines after the title, classes = the last line (each item:
first word, loc 1, the line).  A model-backed provider plugs in through :class:`Provider`, wrapped
by ``mapInPandas`` over *distinct* content hashes only.
"""

from __future__ import annotations

import time
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions.text import content_hash, detect_language, line_count, lines
from canopy.schemas import SUMMARY

ERROR_TITLE = "[summary failed]"
TEXT_CHARS = 1 << 20   # of texts that a provider gets at once, or one text: its answers are as long and held with them


SENTENCE = "^[^.!?]*[.!?]?"


def _item(line: Column) -> Column:
    return F.struct(
        F.nullif(F.regexp_extract(line, r"^([^ ]+)", 1), F.lit("")).alias("name"),
        F.lit(1).alias("loc"),
        F.nullif(line, F.lit("")).alias("summary"),
    )


def extractive_summary(text) -> Column:
    """C4 default provider as one struct expression (JVM-side)."""
    t = F.col(text) if isinstance(text, str) else text
    ls = lines(t)
    return F.struct(
        F.get(ls, 0).alias("title"),
        F.array_join(F.transform(ls, lambda x: F.regexp_extract(x, SENTENCE, 0)), " ").alias("summary"),
        F.transform(F.slice(ls, 2, F.size(ls)), _item).alias("functions"),
        F.array(_item(F.element_at(ls, -1))).alias("classes"),
        line_count(t).alias("loc"),
    )


class Provider:
    """Enrichment seam: ``apply(pdf) -> pdf`` over an Arrow batch.

    Input columns: ``key`` and ``text``; output: ``key``, ``summary`` (a dict
    matching ``schemas.SUMMARY``), ``status`` and ``error``.
    """

    retries = 3
    backoff_s = 0.5

    def summarise(self, text: str) -> dict:  # pragma: no cover - interface
        raise NotImplementedError

    def apply(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out_s, out_status, out_err = [], [], []
        for text in pdf["text"]:
            err = None
            for attempt in range(self.retries):
                try:
                    out_s.append(self.summarise(text))
                    out_status.append("ok")
                    out_err.append(None)
                    break
                except Exception as e:  # C5: per-row isolation
                    err = str(e)
                    if attempt + 1 < self.retries and self.backoff_s:
                        time.sleep(self.backoff_s * (2 ** attempt))
            else:
                loc = (text or "").count("\n") + 1
                out_s.append({"title": ERROR_TITLE, "summary": f"Error: {err}",
                              "functions": [], "classes": [], "loc": loc})
                out_status.append("error")
                out_err.append(err)
        return pd.DataFrame({"key": pdf["key"].values, "summary": out_s,
                             "status": out_status, "error": out_err})


class FunctionProvider(Provider):
    """Provider from a plain ``text -> summary dict`` function."""

    def __init__(self, fn: Callable[[str], dict], retries: int = 3, backoff_s: float = 0.0):
        self.fn, self.retries, self.backoff_s = fn, retries, backoff_s

    def summarise(self, text: str) -> dict:
        return self.fn(text)


PROVIDER_OUT = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("summary", SUMMARY),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])


def summarise_with_provider(df: DataFrame, provider: Provider, key: str = "hash",
                            text: str = "text") -> DataFrame:
    """C4/C5 through a provider: Arrow batches, one row never fails the job."""
    src = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = pdf["text"].str.len().fillna(0).cumsum()
            for _, part in pdf.groupby((ends // TEXT_CHARS).astype("int64").to_numpy()):  # ascending, so rows keep their order
                yield provider.apply(part)

    return src.mapInPandas(run, PROVIDER_OUT).withColumnRenamed("key", key)


def split_errors(summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and a quarantine table."""
    return (summaries.where(F.col("status") == "ok"), summaries.where(F.col("status") != "ok"))


def summarise_files(files: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Whole-file summaries keyed by content hash, one per distinct content.

    Equal content at several paths is summarised once (C7); the row keeps the
    path and language of the lowest ``file_id`` (Q15).  Which file stands for
    a content is decided on ids and hashes alone; no text is aggregated.
    """
    keyed = files.select("file_id", "path", "text", content_hash("text").alias("hash"))
    lowest = keyed.groupBy("hash").agg(F.min("file_id").alias("file_id"))
    first = keyed.join(lowest, ["hash", "file_id"], "left_semi").select("hash", "path", "text")
    if provider is None:
        out = first.select("hash", detect_language("path").alias("language"), "path",
                           extractive_summary("text").alias("summary"),
                           F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
        return out
    enriched = summarise_with_provider(first, provider)
    return (first.join(enriched, "hash")
            .select("hash", detect_language("path").alias("language"), "path",
                    "summary", "status", "error"))


def merge_chunk_summaries(chunk_summaries: DataFrame, key: str = "hash", pos: str = "pos",
                          loc: DataFrame | None = None) -> DataFrame:
    """Chunk summaries -> one file summary.

    title of the lowest position, summaries joined by a blank line in position
    order, functions / classes concatenated in order.  A file's chunk list is
    bounded by the scan size cap (1 MiB), so collecting one file's chunks into
    one row is safe; nothing larger is ever collected.
    """
    g = chunk_summaries.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("summary").alias("s")))).alias("parts"))
    merged = g.select(
        key,
        F.get(F.col("parts"), 0).getField("s").getField("title").alias("title"),
        F.array_join(F.transform("parts", lambda x: x["s"]["summary"]), "\n\n").alias("summary"),
        F.flatten(F.transform("parts", lambda x: x["s"]["functions"])).alias("functions"),
        F.flatten(F.transform("parts", lambda x: x["s"]["classes"])).alias("classes"),
    )
    if loc is not None:
        merged = merged.join(loc, key, "left")
    return merged


def cache_status(summaries_or_files: DataFrame, cache: DataFrame, key: str = "hash") -> DataFrame:
    """Hit / miss per key against the cache (left join on a distinct key)."""
    c = cache.select(key).distinct().withColumn("_hit", F.lit(True))
    return (summaries_or_files.join(c, key, "left")
            .withColumn("status", F.when(F.col("_hit"), F.lit("hit")).otherwise(F.lit("miss")))
            .drop("_hit"))


def incremental_new_content(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct content not yet in the cache, with its lowest file id.

    ``groupBy(hash)`` aggregates map-side first, so a content repeated in a
    third of all files costs one partial row per partition, not a hot task.
    """
    keyed = files.select("file_id", content_hash("text").alias("hash"))
    distinct = keyed.groupBy("hash").agg(F.min("file_id").alias("file_id"))
    return distinct.join(cache.select("hash").distinct(), "hash", "left_anti")
