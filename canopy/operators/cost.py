"""Cost estimate of the enrichment stages (A11, A12), priced per work-list row.

Token counts per item follow the reference's planning constants; prices
come from a (small, broadcast) price table per 1M tokens with a default
for unknown models.  Unlike a pre-scan with its own file cap, the estimate
prices exactly the rows that will be sent (Q19).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference: tokens per item and the
# default price per 1M tokens, and the auto-approval threshold in dollars.
FILE_INPUT_TOKENS = 800
FILE_OUTPUT_TOKENS = 150
DIR_INPUT_TOKENS = 200
DIR_OUTPUT_TOKENS = 50
DEFAULT_INPUT_PRICE = 1.0
DEFAULT_OUTPUT_PRICE = 3.0
APPROVAL_THRESHOLD = 1.0


def stage_items(df: DataFrame, stage: str, model: str, in_tokens: int, out_tokens: int) -> DataFrame:
    """One row per stage: item count and token totals of a work list."""
    return df.agg(F.count(F.lit(1)).alias("items")).select(
        F.lit(stage).alias("stage"), F.lit(model).alias("model"), "items",
        (F.col("items") * in_tokens).cast("long").alias("input_tokens"),
        (F.col("items") * out_tokens).cast("long").alias("output_tokens"))


def price(stages: DataFrame, prices: DataFrame, threshold: float = APPROVAL_THRESHOLD) -> DataFrame:
    """Cost per stage plus a ``total`` row carrying the approval flag."""
    p = prices.select("model", "input_price", "output_price")
    j = stages.join(p, "model", "left")
    cost = (F.col("input_tokens") / 1_000_000 * F.coalesce("input_price", F.lit(DEFAULT_INPUT_PRICE))
            + F.col("output_tokens") / 1_000_000 * F.coalesce("output_price", F.lit(DEFAULT_OUTPUT_PRICE)))
    per = j.select("stage", "model", "items", "input_tokens", "output_tokens", cost.alias("cost"),
                   F.lit(None).cast("boolean").alias("approved"))
    tot = per.agg(F.sum("items").alias("items"), F.sum("input_tokens").alias("input_tokens"),
                  F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost")).select(
        F.lit("total").alias("stage"), F.lit(None).cast("string").alias("model"), "items", "input_tokens",
        "output_tokens", "cost", (F.col("cost") <= threshold).alias("approved"))
    return per.unionByName(tot)
