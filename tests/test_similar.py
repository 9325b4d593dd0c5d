"""Similar pairs against all pairs: recall, exactness, split buckets, classes."""

import numpy as np
import pytest

from canopy.operators import similar


def _vectors(spark, n=300, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dim))
    x = (base[rng.integers(0, len(base), n)] + 0.28 * rng.standard_normal((n, dim))).astype(np.float32)
    x[-10:] = x[:10]
    rows = [(f"v{i:03d}", [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [("null", None), ("nan", [float("nan")] * dim), ("hole", [None] + [1.0] * (dim - 1)), ("short", [1.0]),
           ("zero", [0.0] * dim), ("inf", [float("inf")] + [0.0] * (dim - 1)), (None, [1.0] * dim), rows[3]]
    df = spark.createDataFrame([(a, b, "x", 0) for a, b in rows + odd], "id string, vector array<float>, band string, parts int")
    x = x[:-10].astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return df, x @ x.T


@pytest.mark.parametrize("part", [2048, 7])
def test_pairs_match_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(similar, "PART", part)
    df, scores = _vectors(spark)
    i, j = np.nonzero(np.triu(scores >= 0.9, 1))
    want = {(f"v{a:03d}", f"v{b:03d}") for a, b in zip(i, j)}
    assert len(want) > 100
    pairs, members = similar.similar_pairs(df, 16, 0.9, bits=6)
    rows = pairs.collect()
    got = {(r["a"], r["b"]) for r in rows}
    assert len(rows) == len(got) and got <= want  # none twice, none below the threshold
    assert len(got) >= 0.95 * len(want)
    assert all(abs(r["score"] - scores[int(r["a"][1:]), int(r["b"][1:])]) < 1e-6 for r in rows)
    classes = sorted((r["id"], r["class_id"]) for r in members.collect())
    assert classes == [(f"v{k:03d}", f"v{k if k < 290 else k - 290:03d}") for k in range(300)]


def test_hot_class_and_empty(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOT_CLASS", 10)
    df = spark.createDataFrame([(f"{k:03d}", [1.0, 2.0] if k % 3 else [float(k + 1), -1.0]) for k in range(120)], "id string, vector array<float>")
    c = {r["id"]: r["class_id"] for r in similar.classes(df, 2).collect()}
    assert len(c) == 120 and all(c[f"{k:03d}"] == ("001" if k % 3 else f"{k:03d}") for k in range(120))
    pairs, members = similar.similar_pairs(df.limit(0), 2)
    assert pairs.collect() == [] and members.collect() == []


def test_bands_follow_threshold():
    assert similar.bands_for(1.0, 0.95, 16) == 1
    assert similar.bands_for(0.9, 0.95, 16) < similar.bands_for(0.8, 0.95, 16) < similar.bands_for(0.8, 0.99, 16)
