"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints: words of a text in lower case (A-Z only), their shingles, XXH64
of each; a bit is set where more than half of the hashes have it.

Links: 64 bits are split into ``blocks`` blocks.  Fingerprints that differ in
``distance`` bits or fewer differ in as many blocks at most, so they agree in
``blocks - distance`` blocks: distinct fingerprints are joined on each choice
of that many blocks, and the Hamming distance is checked within a bucket.  A
larger corpus wants more blocks: with 7 and distance 4 a key has 27 bits and
a fingerprint 35 keys.

Within a bucket a search goes from fingerprint to fingerprint and drops each
from the rest once it is reached; it emits a link from every one reached to
the least of its component, so a bucket gives fewer links than it has
fingerprints, and a dense one costs little more than its size.  A bucket over
``bucket_rows`` is not held by one task: its rows are passed on, dealt into
parts, and every two parts searched by a task of their own.

Components of the links: repeated large-star and small-star steps on
DataFrames; each result is a table in the shared folder.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import cut, slices

TEXTS_AT_ONCE = 512
HASHES_AT_ONCE = 1 << 16
SEED = 42


# -- fingerprints --------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Signed 64-bit fingerprint of a text; 0 if it has no words."""
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    starts, ends = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    of = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts[at:at + HASHES_AT_ONCE],
                                                                 ends[at:at + HASHES_AT_ONCE])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text",
                 keep: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, fp`` of every row, then the long columns ``keep``; null text, or a text without words: 0."""
    names = ["doc_id", "fp", *(keep or {})]

    def run(batches):
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], pa.int64()),
                     *part.columns[2:]], names=names)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        *(c.alias(n) for n, c in (keep or {}).items()))
            .mapInArrow(run, ", ".join(f"{n} long" for n in names)))


# -- links ---------------------------------------------------------------------

def _masks(blocks: int, distance: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in itertools.combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a negative number numpy would count those of its absolute value


def search(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least of its component) for all but the least of each component of ``fps``."""
    rest = np.unique(fps)
    member, least = [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            near = _bits(rest ^ todo.pop()) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                todo.extend(found)
                member.append(found)
                least.append(np.full(len(found), root))
    if not member:
        return fps[:0], fps[:0]
    return np.concatenate(member), np.concatenate(least)


def _search_buckets(keyed: DataFrame, keys: list[str], distance: int, most: int | None) -> DataFrame:
    """Links ``a, b`` of all buckets; rows of buckets over ``most`` come out as
    they are (``b`` null), to be searched in parts."""
    dealt = keyed.repartition(*keys).sortWithinPartitions(*keys)
    n_keys = len(keys)
    names = [*keys, "a", "b"]

    def run(batches):
        held, size, current, over = [], 0, None, False

        def close():
            if over or size < 2:
                return [], []
            a, b = search(np.concatenate(held), distance)
            return a.tolist(), b.tolist()

        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column(n_keys).to_numpy(zero_copy_only=False)
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
            new = np.zeros(len(fps), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), len(fps)]
            out_a, out_b, passed = [], [], []
            last = len(starts) - 2
            sizes = np.diff(starts)
            inner = np.zeros(len(sizes), bool)
            inner[1:last] = True  # buckets that lie in this batch whole
            two = np.flatnonzero(inner & (sizes == 2))
            x, y = fps[np.asarray(starts)[two]], fps[np.asarray(starts)[two] + 1]
            near = (_bits(x ^ y) <= distance) & (x != y)
            out_a += np.maximum(x, y)[near].tolist()
            out_b += np.minimum(x, y)[near].tolist()
            for i in np.flatnonzero(~inner | (sizes > 2)).tolist():
                lo, hi = starts[i], starts[i + 1]
                key = tuple(c[lo] for c in columns)
                if key != current:
                    a, b = close()
                    out_a += a
                    out_b += b
                    held, size, current, over = [], 0, key, False
                held.append(fps[lo:hi])
                size += hi - lo
                if most is not None and size > most:
                    over = True
                if over:
                    passed += [(*key, f) for h in held for f in h.tolist()]
                    held = []
            yield _links(out_a, out_b, passed)
        a, b = close()
        yield _links(a, b, [])

    def _links(a, b, passed):
        columns = [pa.array([None] * len(a) + [p[i] for p in passed], pa.int64()) for i in range(n_keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(a + [p[-1] for p in passed], pa.int64()),
                                           pa.array(b + [None] * len(passed), pa.int64())], names=names)

    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def links(fps: DataFrame, distance: int = 4, blocks: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """``a, b``: links (b < a) that connect just the components of the distinct ``fp`` values."""
    masks = _masks(blocks, distance)
    choices = F.array(*(F.struct(F.lit(i).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                        for i, m in enumerate(masks)))
    keyed = fps.select(F.inline(choices), "fp")
    first = cut(_search_buckets(keyed, ["choice", "key"], distance, bucket_rows), "links")
    found = first.where("b is not null").select("a", "b")
    over = first.where("b is null").select("choice", "key", F.col("a").alias("fp"))
    if not over.isEmpty():
        parts = over.groupBy("choice", "key").agg(F.ceil(F.count("*") / bucket_rows).alias("parts"))
        part = F.pmod(F.xxhash64("fp"), F.col("parts"))
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
                             lambda o: F.struct(F.least(o, part).alias("p"), F.greatest(o, part).alias("q")))
        pairs = over.join(parts, ["choice", "key"]).select("choice", "key", F.inline(others), "fp").select(
            "choice", "key", "p", "q", "fp")
        second = _search_buckets(pairs, ["choice", "key", "p", "q"], distance, None)
        found = found.union(second.select("a", "b"))
    return found.distinct()


# -- components ----------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``a, root``: every vertex of the links but the least of its component, with that least."""

    def stars(e: DataFrame, both: bool) -> DataFrame:
        near = e.union(e.select("b", "a")).toDF("u", "v") if both else e.toDF("u", "v")
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(low, "u")
        if both:  # larger neighbours move to the least one
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:     # all smaller neighbours, and the vertex itself, move to the least one
            out = joined.select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                                 F.struct(F.col("u").alias("a"), F.col("m").alias("b")))))
        return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(edges, "edges")
    before = mark(edges)
    while before[0]:
        edges = cut(stars(stars(edges, True), False), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select("a", F.col("b").alias("root"))


def _rooted(own: DataFrame, distance: int, blocks: int, bucket_rows: int) -> DataFrame:
    """``fp, first, root`` of the distinct fingerprints of ``own``: the least doc_id, and the least fingerprint of the component."""
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), distance, blocks, bucket_rows))
    return fps.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int = 7, bucket_rows: int = 20_000,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits) ``, component_id`` of every row.

    ``component_id``: the smallest doc_id that links reach.  Null or wordless
    texts have fingerprint zero and are linked like others.  Equal rows give
    equal results; a null doc_id is never a component_id unless its component
    has no other.  Empty table: no rows.  Only the two columns are read.
    """
    own = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    rooted = _rooted(own, distance, blocks, bucket_rows)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, columns: list[str], distance: int = 4, shingle: int = 4, blocks: int = 7,
                    bucket_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``columns`` of one row of each component: of those with its least doc_id (null if it has no other),
    one of the least fingerprint, and of these the one with the least row hash.

    A row is named by 128 bits of hash over ``columns`` and their nulls, so rows that share a doc_id or have none
    stay apart if they differ; rows equal in all ``columns`` are one.
    """
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    key = {"h1": F.xxhash64(*parts), "h2": F.xxhash64(F.lit("second"), *parts)}
    own = cut(fingerprints(docs, shingle, id_col, text_col, key), "fingerprints")
    rooted = _rooted(own, distance, blocks, bucket_rows)
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    at = rooted.join(least, "root").where(F.col("first").eqNullSafe(F.col("least"))).groupBy("root").agg(
        F.min("fp").alias("at"), F.min("least").alias("least"))
    rows = own.join(at, (own["fp"] == at["at"]) & own["doc_id"].eqNullSafe(at["least"]))
    stay = rows.groupBy("root").agg(F.min(F.struct("h1", "h2")).alias("h")).select("h.h1", "h.h2")
    kept = docs.select(*columns, *(c.alias(n) for n, c in key.items())).join(stay, ["h1", "h2"], "left_semi")
    return kept.dropDuplicates(["h1", "h2"]).select(*columns)
