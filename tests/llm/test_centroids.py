"""Centroid clustering against plain integer k-means; the geometry of its bounds."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from canopy.llm import centroids

D = 64


def plain(rows, k=16, rounds=3):
    kept = [(i, [math.floor(Fraction(c) * 64) for c in v]) for i, v in rows
            if v is not None and len(v) == D and all(c is not None and math.isfinite(c) for c in v)]
    key = {i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept}
    centers = [w for _, w in sorted(kept, key=lambda r: (key[r[0]], r[1]))[:k]]

    def assign():
        out = []
        for _, w in kept:
            d = [sum((a - b) ** 2 for a, b in zip(w, c)) for c in centers]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for j in range(len(centers)):
            mine = [w for (_, w), (c, _) in zip(kept, own) if c == j]
            if mine:
                centers[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    fit = lambda v: v if v < 2 ** 63 else None
    per = {j: sum(d for c, d in own if c == j) for j in range(len(centers))}
    return sorted(((i, c, fit(d), fit(per[c]), fit(sum(per.values())),
                    hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, own)), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "w") for i, v in rows], "vec_id long, embedding array<double>, cluster int, w string")
    return sorted((tuple(r) for r in centroids.cluster(df.repartition(4), **more).collect()), key=repr)


def blobs(n, seed=1, spread=0.3):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(0, 1, (12, D))
    return [(i, (middle[rnd.integers(12)] + rnd.normal(0, spread, D)).tolist()) for i in range(n)]


def test_matches_plain_and_skips_scans(spark):
    rows = blobs(900) + [(5, None), (6, [1.0]), (7, [float("nan")] * D), (8, [float("inf")] + [0.0] * (D - 1)), (9, [None] * D)]
    rows += [rows[0]] * 300 + [(None, rows[1][1]), (None, rows[2][1])]  # a hot vector, repeated and missing ids
    report = []
    assert run(spark, rows, report=report) == plain(rows)
    assert report[0][1] == report[0][0] and report[-1][1] < report[-1][0] / 2


def test_ties_go_to_the_smaller_number(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([0.0, 1 / 64]) if t < 3 else 0.0 for t in range(D)]) for i in range(120)]
    assert run(spark, rows) == plain(rows)


def test_few_empty_and_none(spark):
    rows = blobs(3)
    assert run(spark, rows) == plain(rows)
    same = [(i, [0.5] * D) for i in range(40)]
    assert run(spark, same) == plain(same)
    assert run(spark, [(1, None), (2, [0.5])]) == []


def test_components_of_any_size(spark):
    rows = blobs(60)
    rows += [(100 + i, [s * 10.0 ** e] + [0.25] * (D - 1)) for i, (s, e) in enumerate([(1, 6), (-1, 7), (1, 9), (1, 15), (-1, 18), (1, 30), (1, 300)])]
    rows += [(200, [1.7e308] + [0.0] * (D - 1)), (201, [1e18] * D), (202, [1e18] * D)]
    assert run(spark, rows) == plain(rows)


def test_shrinkage_bounds_every_point_of_the_sphere():
    rnd = np.random.default_rng(2)
    less = 0
    for _ in range(300):
        d = int(rnd.integers(2, 6))
        o, c, new = rnd.normal(0, 3, (3, d))
        r = float(rnd.uniform(0, 4))
        x = rnd.normal(0, 1, (500, d))
        x = o + x / np.linalg.norm(x, axis=1, keepdims=True) * r * rnd.uniform(0, 1, (500, 1)) ** 0.2
        fell = np.linalg.norm(x - c, axis=1) - np.linalg.norm(x - new, axis=1)
        bound, p = centroids.shrinkage(o, r, c, new), float(np.linalg.norm(new - c))
        assert fell.max() <= bound + 1e-9
        assert 0 <= bound <= p * (1 + 1e-12)
        less += bound < 0.9 * p
    assert less > 100
    assert centroids.shrinkage(o, 1.0, c, c) == 0.0


def test_bounds_decide_as_scans_do():
    rnd = np.random.default_rng(6)
    rows = rnd.integers(-40, 40, (2000, 8))
    now = [r.tolist() for r in rows[:6]]
    cluster, upper, lower, _ = centroids.assign(rows, None, now, None, np.float64)
    for _ in range(6):
        radii = [float(upper[cluster == j].max(initial=0)) for j in range(6)]
        nxt = [(rows[cluster == j].sum(0) // max(1, (cluster == j).sum())).tolist() for j in range(6)]
        bounds = tuple(np.array(b) for b in centroids.drifts(centroids.Centroids(nxt, now, radii)))
        assert (bounds[1] <= max(bounds[0]) + 1e-9).all()
        cluster, upper, lower, scanned = centroids.assign(rows, (cluster, upper, lower), nxt, bounds, np.float64)
        want, own, second = centroids.nearest(rows, nxt, np.int64)
        assert (cluster == want).all() and (upper >= np.sqrt(own) - 1e-9).all() and (lower <= np.sqrt(second) + 1e-9).all()
        now = nxt
    assert scanned.sum() < 2000
