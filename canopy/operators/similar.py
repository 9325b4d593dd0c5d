"""Pairs of similar vectors (J8): random-hyperplane signatures in bands, exact check.

Equal vectors are one class, found by grouping; pairs are between classes.  A
vector's signature says on which side of each of ``bits`` random planes it lies,
once for every band; vectors that agree in a whole band meet in its bucket and
their cosine is computed.  The number of bands follows from the least cosine
and the recall asked for: a pair at angle a agrees in a bit with 1 - a / pi.

A bucket of more than ``PART`` vectors is dealt into parts, every two of which
are one run of rows, so no task holds a bucket: within such a bucket the work
stays quadratic in its size, as every pair there is checked.  A pair that meets
in several bands is given by the first of them, so nothing is made distinct.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.session import materialize

PART = 2048             # vectors of a bucket's part: a run holds two parts and PART ** 2 scores
HOT_CLASS = 1_000_000   # rows of one class that one task takes
PAIRS = 1 << 16         # pairs of an output batch


def bands_for(threshold: float, recall: float, bits: int) -> int:
    """Bands with which a pair at the threshold meets with probability ``recall``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if agree >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def classes(vectors: DataFrame, dim: int, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """``id, class_id`` of every row: the least id (as a string) among equal vectors.

    Rows without id, and vectors that are null, of another length, zero, or hold
    nulls, NaN or infinities take no part.  A repeated id counts once per vector.
    """
    return _members(_clean(vectors, dim, id_col, vec))[0]


def _clean(vectors: DataFrame, dim: int, id_col: str, vec: str) -> DataFrame:
    v = F.transform(F.col(vec), lambda x: x.cast("float"))
    good = vectors.select(F.col(id_col).cast("string").alias("id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return good.where(F.col("id").isNotNull() & (F.size("vector") == dim) & finite
                      & F.exists("vector", lambda x: x != 0)).distinct()


def _members(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, class_id``; ``class_id, vector``): a class with many rows takes them back in parts."""
    same = clean.groupBy("vector").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    same = materialize(same.withColumn("parts", F.ceil(F.col("n") / HOT_CLASS).cast("int")), "vector-classes")
    hot = same.where("parts > 1").select("vector", "parts")  # at most rows / HOT_CLASS of them
    dealt = clean.join(hot, "vector", "left").select("id", "vector", F.coalesce(
        F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    named = same.select("vector", "class_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(named, ["vector", "part"]).select("id", "class_id"), same.select("class_id", "vector")


def similar_pairs(vectors: DataFrame, dim: int, threshold: float = 0.9, recall: float = 0.95, bits: int = 16,
                  seed: int = 11, id_col: str = "id", vec: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Pairs of classes whose cosine is ``threshold`` or more: ``a, b, score`` with a < b, each once; and ``id, class_id``.

    Every pair given is exact; a pair at the threshold is found with
    probability ``recall`` over the choice of the planes, a closer one with more.
    ``bits`` sets the size of buckets: about log2 of the number of classes.
    Rows that take no part: see ``classes``.  Empty table: no rows.
    """
    members, distinct = _members(_clean(vectors, dim, id_col, vec))
    bands = bands_for(threshold, recall, bits)
    planes = np.random.default_rng(seed).standard_normal((dim, bands * bits))
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    signed = pa.schema([("id", pa.string()), ("vector", pa.list_(pa.float32())), ("keys", pa.list_(pa.int64()))])

    def sign(batches):
        for batch in batches:
            x = _units(batch.column(1), dim)
            keys = ((x @ planes > 0).reshape(len(x), bands, bits) @ weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(signed.types[1]), _lists(keys)], schema=signed)

    rows = distinct.select(F.col("class_id").alias("id"), "vector") \
        .mapInArrow(sign, "id string, vector array<float>, keys array<long>")
    rows = materialize(rows, "signatures")
    met = rows.select("id", F.posexplode("keys").alias("band", "key"))
    size = met.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    hot = materialize(size.select("band", "key", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "buckets")
    dealt = rows.select("id", "vector", "keys", F.posexplode("keys").alias("band", "key")).join(hot, ["band", "key"], "left") \
        .withColumn("parts", F.coalesce("parts", F.lit(1))) \
        .withColumn("own", F.pmod(F.xxhash64("id", "band"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    runs = dealt.withColumn("other", other).select(
        "band", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "vector", "keys")
    where = ["band", "key", "p", "q"]
    runs = runs.repartition(*where).sortWithinPartitions(*where)

    def check(batches):
        run, held = None, []
        for batch in batches:
            keys = np.column_stack([np.asarray(batch.column(i)) for i in range(4)])
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                name = tuple(keys[a].tolist())
                if name != run:
                    yield from _matches(run, held, dim, bands, threshold)
                    run, held = name, []
                held.append(batch.slice(a, b - a))
        yield from _matches(run, held, dim, bands, threshold)

    return runs.mapInArrow(check, "a string, b string, score double"), members


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(vectors.flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matches(run, held: list, dim: int, bands: int, threshold: float):
    """Pairs of a run that reach the threshold and met in no earlier band."""
    if sum(map(len, held)) < 2:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    band, _, p, q = run
    unit = _units(t.column("vector").combine_chunks(), dim)
    keys = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(-1, bands)
    ids, own = t.column("id").to_numpy(), np.asarray(t.column("own"))
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    for at in range(0, len(left), 256):
        block = left[at:at + 256]
        scores = unit[block] @ unit[right].T
        i, j = np.nonzero(scores >= threshold)
        x, y = block[i], right[j]
        new = (ids[x] < ids[y]) if p == q else np.ones(len(x), bool)
        new[new] = (keys[x[new], :band] != keys[y[new], :band]).all(axis=1)
        x, y, s = x[new], y[new], scores[i[new], j[new]]
        flip = ids[x] > ids[y]
        x, y = np.where(flip, y, x), np.where(flip, x, y)
        for k in range(0, len(x), PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[k:k + PAIRS]]), pa.array(ids[y[k:k + PAIRS]]), pa.array(s[k:k + PAIRS])],
                                             names=["a", "b", "score"])
