"""Diversity re-ranking (X2, MMR) over a bounded candidate pool per query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MMR_OUT = "query_id long, id string, score double, mmr_rank int"


def mmr_rerank(pool: DataFrame, k: int = 5, lam: float = 0.5) -> DataFrame:
    """Greedy MMR per query: argmax lam*sim(q,d) - (1-lam)*max sim(d, chosen).

    ``pool`` (query_id, id, score, vector) is the top-n candidate pool of
    each query (bounded by the caller's pool size), so a group holds at
    most n rows no matter how skewed the corpus is.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]])
        rel = pdf["score"].to_numpy()
        chosen: list[int] = []
        best_sim = np.full(len(pdf), -np.inf)
        for _ in range(min(k, len(pdf))):
            red = np.where(np.isfinite(best_sim), best_sim, 0.0)
            val = lam * rel - (1 - lam) * red
            val[chosen] = -np.inf
            j = int(np.argmax(val))
            chosen.append(j)
            best_sim = np.maximum(best_sim, m @ m[j])
        out = pdf.iloc[chosen][["query_id", "id", "score"]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    return pool.select("query_id", "id", "score", "vector").groupBy("query_id").applyInPandas(run, MMR_OUT)
