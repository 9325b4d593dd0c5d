"""SparkSession helpers: local builder for tests/bench, checkpoint dir lookup."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "canopy",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes.

    On a cluster the launcher's settings win: ``getOrCreate`` returns the
    existing session and only the SQL options below are (re)applied.
    """
    master = master or os.environ.get("CANOPY_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CANOPY_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Where the setting is absent, a local master (tests) gets a fresh scratch
    folder; on a cluster executors would not share one, so that is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="canopy-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str = "tmp") -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table in the shared folder.

    Columnar and much faster than an RDD checkpoint for large intermediates;
    readers get a plain parquet scan (column pruning, filter pushdown), and a
    lost executor never triggers recomputation of the upstream plan.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/materialized/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def small_table(df: DataFrame, max_rows: int) -> DataFrame:
    """Freeze a DataFrame that several actions reuse.

    Up to ``max_rows`` rows (a query batch, the topic table) it becomes a local
    relation by one bounded collect; a larger one is written and read back.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return materialize(df, "reused")
    return df.sparkSession.createDataFrame(rows, df.schema)
