"""Corpus pipeline: quality rules, language, near-duplicates, secrets, packing.

Every stage takes the documents that its predecessor left (columns ``doc_id,
text, lang, source, n_chars``), and its decisions take effect:

* ``quality``: failing lines go, documents that the rules reject go;
* ``language``: ``lang`` becomes the predicted one; documents without a letter go.
  Where nothing was learned (no labelled text outside the held-out fold) the
  others stay with their ``lang`` unchanged;
* ``near_duplicates``: of each component of near-duplicates one row stays, of
  the least id (without id if the component has only such rows);
* ``secrets``: every span found is replaced by a mark;
* ``packing``: pieces of token sequences.

``n_chars`` follows the text.  Null texts are rejected by the first stage;
rows that share a doc_id, or have none, are documents of their own unless their
texts are near-duplicates.  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import langid, packing, quality, secrets, simhash
from canopy.llm.queries import vocabulary
from canopy.llm.shared import cut
from canopy.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # language prediction and token ids are beyond SQL


def _documents(docs: DataFrame, **changed) -> DataFrame:
    """The documents' columns with some replaced; ``n_chars`` counts the new text."""
    text = changed.get("text", F.col("text"))
    columns = {"n_chars": F.length(text).cast("long"), **changed}
    return docs.select(*(columns.get(c, F.col(c)).alias(c) for c in COLUMNS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.clean_lines(docs, keep=["lang", "source"])
    return _documents(judged.where("kept"), text=F.col("clean_text"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = langid.identify(docs, keep=["lang", "source", "n_chars"], unlearned=None)
    return _documents(named.where("lang_pred is null or lang_pred <> 'und'"), lang=F.coalesce("lang_pred", "lang"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(docs, keep=["text", "lang", "source"])
    clean = secrets.redacted(F.col("text"), F.concat("base", "entropy"))
    changed = found.select("doc_id", F.inline(F.array(F.struct(clean.alias("text")))), "lang", "source")
    return _documents(changed)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage),
          ("secrets", secret_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
