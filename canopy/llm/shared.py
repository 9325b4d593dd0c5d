"""Shared-folder files and session helpers of the training-data operators.

Files that tasks write go below the folder that the session names in
``spark.checkpoint.dir`` and are opened through ``pyarrow.fs`` (local, HDFS,
S3, GCS, by URI), so the driver and every executor see the same files.  An
output appears under its final name only when it is complete: a task that is
retried or run twice writes the same content again under the same name.
"""

from __future__ import annotations

import os
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.batches import byte_slices  # noqa: F401
from canopy.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name (not yet created) in the cluster's shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, a folder for each
    value of the columns ``folders``, and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` and more, range-partitioned and sorted by id, null ids first.

    Rows of one id, however many, spread over partitions: they are ordered by
    their first 64 characters, a hash of the text and their row number.
    """
    keys = ["doc_id", "head", "hash", "row_no"]
    text = F.col("text")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .withColumns({"head": F.left(text, F.lit(64)), "hash": F.xxhash64(text), "row_no": F.monotonically_increasing_id()})
            .repartitionByRange(*keys).sortWithinPartitions(*keys))


def filesystem(uri: str):
    """(file system, path) of a folder or file named by URI or absolute path."""
    from pyarrow import fs
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


@contextmanager
def complete_file(files, path: str):
    """Output stream whose file gets its name when the block ends well."""
    from pyarrow import fs
    part = f"{path}.part-{uuid.uuid4().hex}"
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(part) as out:
        yield out
    if files.get_file_info(path).type == fs.FileType.File:  # another attempt was first, with equal content
        files.delete_file(part)
    else:
        files.move(part, path)


def quiet_threads() -> None:
    """One thread per Python worker: Spark already runs a task on each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def slices(batch, size: int):
    """Row slices of an Arrow batch, so that few texts are held as Python objects."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, terms: int | None = None) -> DataFrame:
    """``vec_id, w, wide``: floor(scale * x) of the vectors whose components are all
    finite (and ``terms`` in number, where that is given).

    ``w`` holds them as longs; a vector with a component of 2**62 or more has
    them in ``wide`` instead, as decimal text (Python computes it exactly).
    """
    x = F.col("vector")
    sound = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    if terms is not None:
        sound = (F.size(x) == terms) & sound
    big = F.exists(x, lambda c: F.abs(c) >= float(2 ** 62 / scale))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
            .where(x.isNotNull()).where(sound)
            .select("vec_id", F.when(~big, F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))).alias("w"),
                    F.when(big, x).alias("wide")))

    def exact(batches):
        import math
        from fractions import Fraction

        import pyarrow as pa
        for batch in batches:
            texts = [None if v is None else [str(math.floor(Fraction(c) * scale)) for c in v] for v in batch.column("wide").to_pylist()] \
                if batch.column("wide").null_count < batch.num_rows else [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("w"), pa.array(texts, pa.list_(pa.string()))],
                                             names=["vec_id", "w", "wide"])

    return rows.mapInArrow(exact, "vec_id long, w array<long>, wide array<string>")
