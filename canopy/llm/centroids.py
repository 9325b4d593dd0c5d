"""k-means with drift bounds tightened by geometry, on integer vectors, exact.

Every vector carries its cluster, an upper bound of the distance to that
cluster's centroid and a lower bound of the distance to any other.  While the
upper bound stays below the lower one the vector can't change its cluster and
no distance is computed.  When centroids move, the upper bound grows by the
own centroid's drift, and the lower bound shrinks, usually by the largest drift.

Here it shrinks by less.  The vectors of a cluster lie in a sphere about its
old centroid o, of radius r (their largest upper bound).  For a centroid that
moves from c to c', a distance p, look at the plane through o, c and c'.  With m the
middle of c and c' and t the angle at m between a vector x and the direction
of the move, |x-c|^2 - |x-c'|^2 = 2 p |x-m| cos t and |x-c| + |x-c'| >= 2 |x-m|,
so the distance shrinks by p cos t at most.  Seen from m the sphere covers
angles from a - b on, a being the angle of o and sin b = r / |o-m|.  So the
lower bound of the cluster's vectors loses max over the other centroids of
p cos(a - b): p if m lies in the sphere or the sphere in the direction of the
move, nothing if the whole sphere lies behind.

Vectors whose bounds overlap are ambiguous: all distances are computed, in
integers, and ties go to the smaller number.

A round is one pass in Arrow batches over the stored vectors; a task adds its
sums per cluster to its output as rows of their own, and the next centroids
come from those.  Only centroids and radii (k rows) pass through the driver.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.shared import cut, integer_vectors

LIMB = 2 ** 40          # sums go through Spark in digits of this base, so that no size of component overflows
LONGEST = 2 ** 63 - 1
MARGIN = 1e-9           # relative; covers the rounding of float64 bounds
STATE = ("vec_id long, w array<long>, wide array<string>, cluster int, upper double, lower double, distance long, "
         "digits array<struct<cluster:int,term:int,place:int,value:long>>, "
         "totals array<struct<cluster:int,size:long,radius:double,inertia:string,scanned:long>>")
_DIGIT = pa.struct([("cluster", pa.int32()), ("term", pa.int32()), ("place", pa.int32()), ("value", pa.int64())])
_TOTAL = pa.struct([("cluster", pa.int32()), ("size", pa.int64()), ("radius", pa.float64()), ("inertia", pa.string()), ("scanned", pa.int64())])
SCHEMA = pa.schema([("vec_id", pa.int64()), ("w", pa.list_(pa.int64())), ("wide", pa.list_(pa.string())), ("cluster", pa.int32()),
                    ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("digits", pa.list_(_DIGIT)),
                    ("totals", pa.list_(_TOTAL))])


class Centroids(NamedTuple):
    now: list[list[int]]
    before: list[list[int]] | None   # None: first round, nothing is bounded yet
    radii: list[float] | None        # of the spheres about ``before``


# -- geometry --------------------------------------------------------------------

def distance(a: list[int], b: list[int]) -> float:
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


def shrinkage(o: np.ndarray, r: float, c: np.ndarray, moved: np.ndarray) -> float:
    """At most how much nearer ``moved`` is than ``c`` to any point within ``r`` of ``o``."""
    move = moved - c
    p = float(np.sqrt(move @ move))
    if p == 0:
        return 0.0
    to = o - (c + moved) / 2
    far = float(np.sqrt(to @ to))
    if far <= r * (1 + MARGIN):
        return p
    along = float(to @ move) / (far * p)
    angle = math.acos(max(-1.0, min(1.0, along))) - math.asin(min(1.0, r / far))
    return p * max(0.0, math.cos(max(0.0, angle)))


def drifts(state: Centroids) -> tuple[list[float], list[float]]:
    """(growth of the upper bound, loss of the lower bound) of each cluster's vectors."""
    old, new = np.array(state.before, np.float64), np.array(state.now, np.float64)
    grown = [distance(a, b) for a, b in zip(state.before, state.now)]
    lost = [max([shrinkage(old[i], state.radii[i], old[j], new[j]) for j in range(len(old)) if j != i and grown[j]], default=0.0)
            for i in range(len(old))]
    return [g * (1 + MARGIN) for g in grown], [x * (1 + MARGIN) for x in lost]


# -- one batch -------------------------------------------------------------------

def _kind(largest: int, terms: int):
    """The fastest type in which squared distances of components within ``largest`` are exact."""
    most = (2 * largest) ** 2 * terms
    return np.float64 if most < 2 ** 53 else np.int64 if most < 2 ** 63 else object


def nearest(rows: np.ndarray, centroids: list[list[int]], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(cluster, its squared distance, that of the second nearest) of each row, ties to
    the smaller number; no second one where Python integers are needed."""
    if kind == np.float64:
        x, c = rows.astype(kind), np.array(centroids, kind)
        d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    else:
        d = np.empty((len(rows), len(centroids)), kind)
        x = rows.astype(kind)
        for j, c in enumerate(centroids):
            d[:, j] = ((x - np.array(c, kind)) ** 2).sum(1)
    best = d.argmin(1)  # the first of equals
    at = np.arange(len(d))
    own = d[at, best]
    if kind == object:
        return best, own, None
    rest = d.astype(np.float64)
    rest[at, best] = np.inf
    return best, own.astype(np.int64), rest.min(1)


def own_distance(rows: np.ndarray, cluster: np.ndarray, centroids: list[list[int]], kind) -> np.ndarray:
    d = rows.astype(kind) - np.array(centroids, kind)[cluster]
    own = (d * d).sum(1)
    return own if kind == object else own.astype(np.int64)


def _above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + MARGIN)


def _below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares) * (1 - MARGIN)


def assign(rows: np.ndarray, held: tuple | None, centroids: list[list[int]], bounds: tuple | None, kind):
    """(cluster, upper, lower, was it scanned) of a batch.

    ``held``: cluster, upper and lower from the last round, ``bounds``: what
    they gain and lose; without bounds, or where only Python integers are
    exact, every row is scanned (the latter leaves no bounds either).
    """
    n = len(rows)
    if bounds is None or kind == object:
        cluster, own, second = nearest(rows, centroids, kind)
        if second is None:
            return cluster, np.full(n, np.inf), np.zeros(n), np.ones(n, bool)
        return cluster, _above(own), _below(second), np.ones(n, bool)
    grown, lost = bounds
    cluster, upper, lower = (c.copy() for c in held)
    upper += grown[cluster]
    lower -= lost[cluster]
    near = np.flatnonzero(~(upper < lower))
    if len(near):  # the exact distance to the own centroid may still tell
        upper[near] = _above(own_distance(rows[near], cluster[near], centroids, kind))
    scan = np.flatnonzero(~(upper < lower))
    if len(scan):
        best, own, second = nearest(rows[scan], centroids, kind)
        cluster[scan], upper[scan], lower[scan] = best, _above(own), _below(second)
    scanned = np.zeros(n, bool)
    scanned[scan] = True
    return cluster, upper, lower, scanned


def _exact_sum(values: np.ndarray) -> np.ndarray:
    """Sum over the first axis that can't overflow."""
    if values.dtype != object and len(values) and int(np.abs(values).max()) * len(values) >= 2 ** 63:
        values = values.astype(object)
    return values.sum(0)


class _Totals:
    """A task's sums per cluster; components of any size."""

    def __init__(self, k: int, terms: int):
        self.sums = [[0] * terms for _ in range(k)]
        self.size, self.radius, self.inertia, self.scanned = [0] * k, [0.0] * k, [0] * k, [0] * k

    def add(self, rows: np.ndarray, cluster, upper, own, scanned) -> None:
        for j in np.unique(cluster).tolist():
            on = cluster == j
            self.sums[j] = [a + int(b) for a, b in zip(self.sums[j], _exact_sum(rows[on]))]
            self.size[j] += int(on.sum())
            self.radius[j] = max(self.radius[j], float(upper[on].max()))
            self.scanned[j] += int(scanned[on].sum())
            if own is not None:
                self.inertia[j] += int(_exact_sum(own[on]))

    def digits(self) -> list[dict]:
        out = []
        for j, n in enumerate(self.size):
            for t, s in enumerate(self.sums[j] if n else []):
                sign, s, place = (-1 if s < 0 else 1), abs(s), 0
                while s:
                    s, low = divmod(s, LIMB)
                    if low:
                        out.append({"cluster": j, "term": t, "place": place, "value": sign * low})
                    place += 1
        return out


# -- Spark jobs ------------------------------------------------------------------

def _matrix(batch: pa.RecordBatch, terms: int) -> tuple[np.ndarray, int]:
    """(integer rows, largest size); Python integers where a row has wide components."""
    w, wide = batch.column("w"), batch.column("wide")
    if wide.null_count == batch.num_rows:
        rows = w.flatten().to_numpy(zero_copy_only=False).reshape(-1, terms)
        return rows, max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    rows = np.array([[int(c) for c in (b if b is not None else a)] for a, b in zip(w.to_pylist(), wide.to_pylist())], object)
    return rows, max(abs(c) for r in rows for c in r)


def starting_rows(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ``seed:vec_id`` has the smallest hashes (null id: no text after the colon)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "w", "wide").orderBy("key", "w", "wide").limit(k).collect()
    return [[int(c) for c in (r["wide"] or r["w"])] for r in rows]


def _pass(state: DataFrame, centroids: Centroids, terms: int, last: bool, name: str) -> DataFrame:
    """One assignment of all vectors: the state, and a row of sums from each task."""
    now = centroids.now
    size = max(abs(c) for row in now for c in row)
    bounds = None
    if centroids.before is not None and _kind(max(size, *(abs(c) for row in centroids.before for c in row)), terms) != object:
        bounds = tuple(np.array(b) for b in drifts(centroids))

    def go(batches):
        totals = _Totals(len(now), terms)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, largest = _matrix(batch, terms)
            kind = _kind(max(largest, size), terms)
            held = None
            if bounds is not None:
                held = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, scanned = assign(rows, held, now, bounds, kind)
            own = own_distance(rows, cluster, now, kind) if last else None
            totals.add(rows, cluster, upper, own, scanned)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "w", "wide")), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower),
                 pa.nulls(n, SCHEMA.field("distance").type) if own is None else
                 pa.array([v if v <= LONGEST else None for v in own.tolist()], pa.int64()),
                 *(pa.nulls(n, SCHEMA.field(c).type) for c in ("digits", "totals"))], schema=SCHEMA)
        sums = [{"cluster": j, "size": n, "radius": totals.radius[j], "inertia": str(totals.inertia[j]), "scanned": totals.scanned[j]}
                for j, n in enumerate(totals.size) if n]
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(SCHEMA)[:-2]),
                                              pa.array([totals.digits()], SCHEMA.field("digits").type),
                                              pa.array([sums], SCHEMA.field("totals").type)], schema=SCHEMA)

    return cut(state.mapInArrow(go, STATE), name)


def _moved(state: DataFrame, old: list[list[int]]) -> Centroids:
    """The next centroids: floor of the mean of each cluster; empty ones stay."""
    each = state.where("totals is not null").select(F.inline("totals"))
    per = {r["cluster"]: r for r in each.groupBy("cluster").agg(F.sum("size").alias("size"), F.max("radius").alias("radius")).collect()}
    digits = state.where("digits is not null").select(F.inline("digits"))
    sums = {j: [0] * len(old[0]) for j in per}
    for r in digits.groupBy("cluster", "term", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        sums[r["cluster"]][r["term"]] += int(r["value"]) * LIMB ** r["place"]
    new = [[s // per[j]["size"] for s in sums[j]] if j in per else row for j, row in enumerate(old)]
    return Centroids(new, old, [per[j]["radius"] if j in per else 0.0 for j in range(len(old))])


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, terms: int = 64, scale: int = 64, seed: int = 1,
            id_col: str = "vec_id", vector_col: str = "embedding", report: list | None = None) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector kept.

    Kept are vectors of exactly ``terms`` components, none null or non-finite;
    a component x counts as floor(scale * x).  ``rounds`` times every vector
    goes to its nearest centroid (squared Euclidean distance, ties: the smaller
    number) and every non-empty centroid to the floor of its vectors' mean;
    then they are assigned once more.  Fewer vectors than ``k``: as many
    centroids.  No vector: no row.  Rows that repeat an id, or have none, are
    vectors of their own.  All arithmetic is exact; a distance or an inertia
    beyond a long is null.  Other columns are not read.

    ``report`` receives (vectors, vectors scanned against all centroids) of each pass.
    """
    spark = vectors.sparkSession
    whole = cut(integer_vectors(vectors, scale, id_col, vector_col, terms), "cluster-vectors")
    start = starting_rows(whole, k, seed)
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = whole
    centroids = Centroids(start, None, None)
    for n in range(rounds + 1):
        state = _pass(state.where("totals is null") if n else state, centroids, terms, n == rounds, f"cluster-round-{n}")
        if report is not None:
            report.append(tuple(state.where("totals is not null").select(F.inline("totals"))
                                .agg(F.sum("size"), F.sum("scanned")).first()))
        if n < rounds:
            centroids = _moved(state, centroids.now)
    return _result(spark, state, centroids.now)


def _result(spark: SparkSession, state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    each = state.where("totals is not null").select(F.inline("totals"))
    by = {r["cluster"]: None if r["sized"] < r["tasks"] else int(r["inertia"])  # k rows
          for r in each.groupBy("cluster").agg(F.sum(F.expr("try_cast(inertia as decimal(38,0))")).alias("inertia"), F.count("*").alias("tasks"),
                                               F.count(F.expr("try_cast(inertia as decimal(38,0))")).alias("sized")).collect()}

    def long(v: int | None) -> int | None:
        return v if v is not None and v <= LONGEST else None

    total = None if None in by.values() else sum(by.values())
    own = F.array(*(F.lit(long(by.get(j))).cast("long") for j in range(len(centroids))))
    names = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids))
    return state.where("totals is null").select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(long(total)).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"))
