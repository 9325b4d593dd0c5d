"""Query catalogue: one Spark plan per operator key plus its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is ANSI SQL
over the driver tables.  Scores are rounded to 6 places in the output only
(filters and ranks use unrounded values); ties break on id ascending.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Importing the query modules fills the two dictionaries.
from canopy.plans import q_files, q_tree, q_chunks, q_vectors, q_ontology, q_retrieval, q_pipeline, q_graph  # noqa: E402,F401
