"""ST1: cache-first incremental summaries as a Structured Streaming job.

New files (or new rows of a document table) arrive on a file stream; each
micro-batch hashes the content, drops hashes summarised well
(anti join against the summaries table), summarises the rest and stores
them; a stored error row is no hit and is replaced.  The content hash is the idempotency key, so a replayed batch after
an executor or driver loss adds nothing twice; the stream checkpoint lives
in the shared checkpoint folder.  No watermark is needed: there is no
event-time aggregation, only a keyed anti join against a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.text import content_hash
from canopy.operators.summarise import summarise_files
from canopy.session import checkpoint_dir
from canopy.sources.store import TableStore


def process_batch(store: TableStore, name: str = "summaries"):
    def fn(batch: DataFrame, epoch_id: int) -> None:
        keyed = batch.select("file_id", "path", "text", content_hash("text").alias("hash"))
        if store.exists(name):
            good = store.read(name).where("status = 'ok'").select("hash")
            keyed = keyed.join(good, "hash", "left_anti")
        store.put_summaries(name, summarise_files(keyed.drop("hash")))
    return fn


def start_incremental(spark: SparkSession, source: DataFrame, store: TableStore, run_id: str,
                      available_now: bool = True):
    """Start the stream over ``source`` (a streaming DataFrame of files)."""
    ckpt = checkpoint_dir(spark).rstrip("/") + f"/streams/{run_id}"
    w = source.writeStream.foreachBatch(process_batch(store)).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a file stream, mapped to the files stand-in.

    The table is a file or a folder of files; a stream over the path itself must
    be a folder, so it is named by a pattern that only this table matches.
    """
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = re.sub(r"([\\*?{}\[\]])", r"\\\1", sf_dir.rstrip("/"))
    d = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
         .parquet(f"{folder}/documents.parque[t]"))
    ext = (F.when(F.col("lang") == "en", F.lit(".ts")).when(F.col("lang") == "fr", F.lit(".py"))
           .when(F.col("lang") == "de", F.lit(".md")).otherwise(F.lit(".bin")))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ext)
    return d.select(F.col("doc_id").alias("file_id"),
                    F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), name).alias("path"), "text")
