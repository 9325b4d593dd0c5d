"""A PostgreSQL vector table as source and sink over JDBC.

The vector column travels as text (``'[x,y,...]'``) and is parsed on the
Spark side.  Upserts write to a staging table first; the final merge runs
in the database (``INSERT .. ON CONFLICT``) through the ``postActions``-style
statement the caller executes.  No database is started by this library or
its tests; the functions only build Spark readers and writers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vectors(spark: SparkSession, url: str, table: str = "embeddings", model: str | None = None,
                 properties: dict | None = None, num_partitions: int = 64) -> DataFrame:
    where = f" WHERE model = '{model}'" if model else ""
    query = f"(SELECT id, node_id, model, dim, vector::text AS vector_text FROM {table}{where}) AS t"
    r = spark.read.format("jdbc").option("url", url).option("dbtable", query)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    df = r.load()
    vec = F.transform(F.split(F.regexp_replace("vector_text", r"[\[\]\s]", ""), ","), lambda x: x.cast("float"))
    return df.select("id", "node_id", "model", "dim", vec.alias("vector")).repartition(num_partitions, "id")


def write_vectors_staging(df: DataFrame, url: str, staging_table: str, properties: dict | None = None) -> str:
    """Write to a staging table; returns the merge statement to run in the database."""
    out = df.select("id", "node_id", "model", "dim",
                    F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: x.cast("string")), ","),
                             F.lit("]")).alias("vector"))
    w = out.write.format("jdbc").option("url", url).option("dbtable", staging_table).mode("overwrite")
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()
    return (f"INSERT INTO embeddings (id, node_id, model, dim, vector) "
            f"SELECT id, node_id, model, dim, vector::vector FROM {staging_table} "
            f"ON CONFLICT (id) DO UPDATE SET model = EXCLUDED.model, dim = EXCLUDED.dim, vector = EXCLUDED.vector")
