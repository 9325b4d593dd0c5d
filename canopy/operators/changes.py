"""Change detection between two runs (X4: re-analyse changed files only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "path", hash_col: str = "hash") -> DataFrame:
    """Full outer join of two (path, hash) manifests -> added/changed/removed/same."""
    o = old.select(F.col(key).alias("_ok"), F.col(hash_col).alias("_oh"))
    n = new.select(F.col(key).alias("_nk"), F.col(hash_col).alias("_nh"))
    j = o.join(n, o["_ok"] == n["_nk"], "full_outer")
    change = (F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNull(), "removed")
              .when(F.col("_oh") != F.col("_nh"), "changed").otherwise("same"))
    return j.select(F.coalesce("_nk", "_ok").alias(key), change.alias("change"))


def changed_files(files: DataFrame, diff: DataFrame, key: str = "path") -> DataFrame:
    """Files whose content must be re-analysed (added or changed)."""
    return files.join(diff.where(F.col("change").isin("added", "changed")).select(key), key, "left_semi")
