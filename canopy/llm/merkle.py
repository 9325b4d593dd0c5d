"""Merkle manifest of a dataset, with proofs by octopus multiproof.

Every row is a leaf, every value of a key column a tree over its leaves, and
the trees' roots are the leaves of a top tree, whose root stands for the whole
dataset.  A digest is the lowercase hex SHA-256 of its inputs' text, one after
the other; a node is the digest of a run of ``ARITY`` neighbours (the last run
may be shorter).

Building: leaves are range-partitioned and sorted, which gives each its place;
blocks of ``ARITY ** height`` neighbours become subtrees in one task each, and
their roots are the next round's leaves, so that a tree of any size takes a few
rounds and no task holds more than a block of it.  Nodes are a table, a folder
per level.

Proving: leaves are dealt into partitions of whole blocks.  A partition

1. computes the least union of coordinates that it can't derive from its own
   leaves and needs for any of their proofs (at each level the children of the
   known nodes' parents that are not known themselves),
2. fetches those once, by a join with the node table,
3. derives the interior nodes that its proofs share, and
4. expands the proof of each leaf and folds the claimed leaf with it.

Requests grow with the number of partitions times the height of the trees, not
with the number of leaves.  Nothing but the root and the height goes through
the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.shared import cut

ARITY = 3
TOP = "t"  # key of the top tree; other trees are 'n' (null) and 's' + value, which sorts null first, then by bytes


class Manifest(NamedTuple):
    leaves: DataFrame   # part, tree, n (leaves of the tree), idx, top_idx, trees, leaf and the kept columns
    nodes: DataFrame    # tree, level, idx, digest; level 0 only of the top tree
    root: str | None    # None: no leaf


# -- digests ---------------------------------------------------------------------

def record_digest(columns: list[Column]) -> Column:
    """Digest of a record: each value as its UTF-8 byte count, ``:`` and its text; null as ``-``."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts)), 256)


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def document_leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, leaf, claimed`` of documents.

    ``claimed`` is the leaf of the document as an untrustworthy copy would have
    it: without the newlines of its text where the CRC-32 of the decimal doc_id
    is even (null ids and null texts stay as they are).
    """
    number, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    tampered = F.coalesce(F.crc32(number.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    columns = [number, F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    copy = F.when(tampered & text.contains("\n"), record_digest([*columns, F.replace(text, F.lit("\n"), F.lit(""))]))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select(tree.alias("tree"), number.alias("doc_id"), record_digest([*columns, text]).alias("leaf"),
                       copy.alias("claimed"))


# -- building --------------------------------------------------------------------

def _climb(code: np.ndarray, n: np.ndarray, idx: np.ndarray, digests: list[bytes], height: int) -> Iterator[tuple]:
    """(level, code, n, idx, digests) of the nodes above rows sorted by (code, idx) that hold whole runs."""
    for level in range(1, height + 1):
        open_ = np.flatnonzero(n > 1)
        if not len(open_):
            return
        if len(open_) < len(n):
            code, n, idx, digests = code[open_], n[open_], idx[open_], [digests[i] for i in open_.tolist()]
        run = idx // ARITY
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (run[1:] != run[:-1])])
        cuts = [*start.tolist(), len(run)]
        digests = [_digest(b"".join(digests[a:b])) for a, b in zip(cuts, cuts[1:])]
        code, n, idx = code[start], -(-n[start] // ARITY), run[start]
        yield level, code, n, idx, digests


def _subtrees(rows: DataFrame, base: int, height: int) -> DataFrame:
    """``tree, level, n, idx, digest`` of the nodes up to ``height`` levels above
    ``rows`` (``tree, n, idx, digest``: all nodes of level ``base``, of which a tree has n)."""
    span = ARITY ** height

    def climb(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, now]) if held is not None else now
            code, blocks = _codes(held), held.column("idx").to_numpy() // span
            new = np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            if len(new):  # the last block may go on in the next batch
                yield from above(held.slice(0, int(new[-1])))
                held = held.slice(int(new[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield from above(held)

    def above(rows: pa.Table):
        trees = rows.column("tree").combine_chunks().dictionary_encode()
        digests = [d.encode() for d in rows.column("digest").to_pylist()]
        for level, code, n, idx, digests in _climb(_codes(rows), rows.column("n").to_numpy(), rows.column("idx").to_numpy(),
                                                   digests, height):
            names = _take(trees, code)
            yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(n), base + level, np.int32)), pa.array(n), pa.array(idx),
                                              pa.array([d.decode() for d in digests], pa.string())],
                                             names=["tree", "level", "n", "idx", "digest"])

    return (rows.select("tree", "n", "idx", "digest").repartition("tree", F.floor(F.col("idx") / span))
            .sortWithinPartitions("tree", "idx")
            .mapInArrow(climb, "tree string, level int, n long, idx long, digest string"))


def _one(column) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], whole.type)


def _codes(rows: pa.Table) -> np.ndarray:
    return _one(rows.column("tree")).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _take(trees, code: np.ndarray) -> pa.Array:
    trees = trees if isinstance(trees, pa.DictionaryArray) else _one(trees)
    return trees.dictionary.take(pa.array(code))


def _all_levels(rows: DataFrame, largest: int, height: int, name: str) -> list[DataFrame]:
    """Node tables of all rounds; ``largest``: the most leaves of a tree."""
    out, base = [], 0
    while largest > 1:
        out.append(cut(_subtrees(rows, base, height), f"merkle-{name}", "level"))
        base, largest = base + height, -(-largest // ARITY ** height)
        rows = out[-1].where((F.col("level") == base) & (F.col("n") > 1))
    return out


def build(leaves: DataFrame, order: list[str], height: int = 7, leaves_per_part: int = 65_536) -> Manifest:
    """The manifest of ``leaves`` (``tree, leaf``, the columns of ``order`` and others to keep).

    Leaves of a tree ascend by ``order`` (nulls first); rows that agree in it
    by their digests, so equal rows are interchangeable.  ``tree`` is never
    null.  No leaf: no node and no root.
    """
    keys = ["tree", *order, "leaf"]
    given = cut(leaves.withColumn("row_no", F.monotonically_increasing_id()), "merkle-leaves")  # splits rows that agree in all else
    kept = [c for c in leaves.columns if c not in ("tree", "leaf")]
    at = F.monotonically_increasing_id()
    placed = cut(given.repartitionByRange(*keys, "row_no").sortWithinPartitions(*keys, "row_no")
                 .select("tree", "leaf", *kept, F.shiftright(at, 33).cast("int").alias("task"),
                         at.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "merkle-sorted")

    # One row for each task and tree in it, the tasks' own totals, and from both the place of every tree.
    runs = placed.groupBy("task", "tree").agg(F.count("*").alias("here"), F.min("pos").alias("first"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # over one row a task
    starts = (runs.groupBy("task").agg(F.sum("here").alias("rows"))
              .select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("task_start")))
    whole = Window.partitionBy("tree")
    runs = cut(runs.join(starts, "task")
               .withColumn("tree_start", F.min(F.col("task_start") + F.col("first")).over(whole))
               .withColumn("n", F.sum("here").over(whole)), "merkle-runs")
    opens = runs.where(F.col("tree_start") == F.col("task_start") + F.col("first"))
    opened = (opens.groupBy("task").agg(F.count("*").alias("trees"))
              .select("task", F.coalesce(F.sum("trees").over(before), F.lit(0)).alias("earlier")))
    inside = F.row_number().over(Window.partitionBy("task").orderBy("tree"))
    trees = opens.join(opened, "task").select("tree", "n", (F.col("earlier") + inside - 1).alias("top_idx"))
    sizes = trees.agg(F.count("*").alias("trees"), F.max("n").alias("largest")).first()

    spot = runs.join(trees.select("tree", "top_idx"), "tree").select("task", "tree", "n", "task_start", "tree_start", "top_idx")
    rank = F.col("task_start") + F.col("pos") - F.col("tree_start")
    block = F.col("tree_start") + rank - rank % (ARITY ** height)
    indexed = placed.join(spot, ["task", "tree"]).select(
        F.floor(block / leaves_per_part).alias("part"), "tree", "n", rank.alias("idx"), "top_idx",
        F.lit(sizes["trees"]).cast("long").alias("trees"), "leaf", *kept)
    if not sizes["trees"]:
        return Manifest(indexed, cut(indexed.selectExpr("tree", "0 as level", "idx", "leaf as digest"), "merkle-none"), None)

    own = _all_levels(indexed.select("tree", "n", "idx", F.col("leaf").alias("digest")), sizes["largest"], height, "nodes")
    roots = indexed.where("n = 1").select("top_idx", F.col("leaf").alias("digest"))
    for level in own:
        roots = roots.unionByName(level.where("n = 1").join(trees.select("tree", "top_idx"), "tree").select("top_idx", "digest"))
    top = cut(roots.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.lit(sizes["trees"]).cast("long").alias("n"),
                           F.col("top_idx").alias("idx"), "digest"), "merkle-top", "level")
    upper = [top, *_all_levels(top, sizes["trees"], height, "top")]
    nodes = upper[0]
    for level in [*upper[1:], *own]:
        nodes = nodes.unionByName(level)
    root = upper[-1].where("n = 1").select("digest").first()["digest"]
    return Manifest(indexed, nodes.select("tree", "level", "idx", "digest"), root)


# -- proving ---------------------------------------------------------------------

def missing(idx: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, coordinates) that can't be derived from the leaves ``idx`` (ascending,
    distinct) of a tree of ``n`` leaves and that some proof of them needs."""
    level = 0
    while n > 1:
        parents = np.unique(idx // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        children = children[children < n]
        yield level, np.setdiff1d(children, idx, assume_unique=True)
        idx, n, level = parents, -(-n // ARITY), level + 1


def _parted(rows: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """(tree, its rows) of a partition's rows, both ascending."""
    rows = rows.sort_by([("tree", "ascending"), ("idx", "ascending")])
    code = _codes(rows)
    cuts = [*np.flatnonzero(np.r_[True, code[1:] != code[:-1]]).tolist(), len(code)] if len(code) else []
    for a, b in zip(cuts, cuts[1:]):
        yield rows.column("tree")[a].as_py(), rows.slice(a, b - a)


def _requests(rows: pa.Table) -> pa.Table:
    out = {"tree": [], "level": [], "idx": []}

    def ask(tree: str, idx: np.ndarray, n: int) -> None:
        for level, lost in missing(idx, n):
            out["tree"] += [tree] * len(lost)
            out["level"] += [level] * len(lost)
            out["idx"] += lost.tolist()

    for tree, own in _parted(rows):
        ask(tree, np.unique(own.column("idx").to_numpy()), own.column("n")[0].as_py())
    ask(TOP, np.unique(rows.column("top_idx").to_numpy()), rows.column("trees")[0].as_py())
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()] * len(out["idx"]), pa.int64()),
                     "tree": pa.array(out["tree"], pa.string()), "level": pa.array(out["level"], pa.int32()),
                     "idx": pa.array(out["idx"], pa.int64())})


class _Branch:
    """The part of a tree that some known leaves and fetched nodes determine.

    ``around[level][idx]``: the digests before and after a node in its run;
    ``path(idx)``: those of a leaf and all its ancestors.
    """

    def __init__(self, known: dict[int, bytes], n: int, fetched: dict[int, dict[int, bytes]]):
        self.around: list[dict[int, tuple[bytes, bytes]]] = []
        level = 0
        while n > 1:
            run = dict(known)
            run.update(fetched.get(level, {}))
            ups, around = {}, {}
            for up in sorted({i // ARITY for i in known}):
                here = [run[i] for i in range(up * ARITY, min(n, (up + 1) * ARITY))]
                ups[up] = _digest(b"".join(here))
                for k in range(len(here)):
                    around[up * ARITY + k] = (b"".join(here[:k]), b"".join(here[k + 1:]))
            self.around.append(around)
            known, n, level = ups, -(-n // ARITY), level + 1
        self.root = next(iter(known.values()))

    def path(self, idx: int) -> list[tuple[bytes, bytes]]:
        out = []
        for around in self.around:
            out.append(around[idx])
            idx //= ARITY
        return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in path:
        digest = _digest(before + digest + after)
    return digest


def _by_level(rows: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, idx, digest in zip(*(rows.column(c).to_pylist() for c in ("level", "idx", "digest"))):
        out.setdefault(level, {})[idx] = digest.encode()
    return out


def audit(manifest: Manifest, claims: DataFrame | None = None, claimed: str | None = "claimed", keep: tuple[str, ...] = ("doc_id",),
          with_proof: bool = False) -> DataFrame:
    """``keep, leaf, subroot, root, proof_sha256, folded_root, verified`` of each leaf in ``claims``.

    ``claims``: rows of ``manifest.leaves`` (all of them unless given); column
    ``claimed`` holds the digest that is to be proved (null or no such column:
    the leaf itself).  ``proof_sha256``: digest of the proof's siblings, level
    by level up to the dataset's root; ``folded_root``: what the claimed leaf
    and those siblings give; ``verified``: is that the manifest's root?
    ``with_proof`` adds ``proof``: the siblings, of each level those ``before``
    and ``after`` the node, one digest after the other.
    """
    rows = manifest.leaves if claims is None else claims
    spark, root = rows.sparkSession, manifest.root
    rows = rows.withColumn("claimed_leaf", F.col(claimed) if claimed else F.lit(None).cast("string"))
    asked = cut(rows.select("part", "tree", "n", "idx", "top_idx", "trees").groupBy("part")
                .applyInArrow(_requests, "part long, tree string, level int, idx long"), "merkle-requests")
    levels = [r["level"] for r in asked.select("level").distinct().collect()]  # at most a tree's height
    held = manifest.nodes.where(F.col("level").isin(levels))
    if 0 in levels:
        held = held.unionByName(manifest.leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest")))
    fetched = asked.join(held, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest")

    schema = rows.select(*keep).schema
    out_names = [*keep, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields),
                     "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"]
                    + (["proof array<struct<before:string,after:string>>"] if with_proof else []))

    def prove(key, leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        nodes = dict(_parted(nodes))
        own = list(_parted(leaves))
        none = {}
        branches = []
        for tree, part in own:
            idx = part.column("idx").to_pylist()
            known = dict(zip(idx, (d.encode() for d in part.column("leaf").to_pylist())))
            branches.append(_Branch(known, part.column("n")[0].as_py(), _by_level(nodes[tree]) if tree in nodes else none))
        tops = [part.column("top_idx")[0].as_py() for _, part in own]
        top = _Branch({i: b.root for i, b in zip(tops, branches)}, leaves.column("trees")[0].as_py(),
                      _by_level(nodes[TOP]) if TOP in nodes else none) if own else None
        made = []
        for (tree, part), branch, top_idx in zip(own, branches, tops):
            upper = top.path(top_idx)
            tail = b"".join(a + b for a, b in upper)
            columns = {c: [] for c in ("proof_sha256", "folded_root", "verified", "proof")}
            last, shared, above = None, [], b""
            for idx, leaf, claim in zip(*(part.column(c).to_pylist() for c in ("idx", "leaf", "claimed_leaf"))):
                first = branch.around[0][idx] if branch.around else None
                if idx // ARITY != last:  # the ancestors' siblings, shared by a run of leaves
                    last = idx // ARITY
                    shared = branch.path(idx)[1:] + upper
                    above = b"".join(a + b for a, b in shared)
                path = [first, *shared] if first is not None else upper
                folded = fold((claim or leaf).encode(), path).decode()
                columns["proof_sha256"].append(_digest(first[0] + first[1] + above if first is not None else tail).decode())
                columns["folded_root"].append(folded)
                columns["verified"].append(folded == root)
                if with_proof:
                    columns["proof"].append([{"before": a.decode(), "after": b.decode()} for a, b in path])
            size = part.num_rows
            arrays = {c: part.column(c) for c in (*keep, "leaf")}
            arrays.update(subroot=pa.array([branch.root.decode()] * size), root=pa.array([root] * size, pa.string()),
                          proof_sha256=pa.array(columns["proof_sha256"], pa.string()),
                          folded_root=pa.array(columns["folded_root"], pa.string()), verified=pa.array(columns["verified"], pa.bool_()))
            if with_proof:
                arrays["proof"] = pa.array(columns["proof"], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
            made.append(pa.table(arrays))
        return pa.concat_tables(made)

    if root is None:
        return spark.createDataFrame([], ddl).select(*out_names, *(["proof"] if with_proof else []))
    return rows.select("part", "tree", "n", "idx", "top_idx", "trees", "leaf", "claimed_leaf", *keep).groupBy("part").cogroup(
        fetched.groupBy("part")).applyInArrow(prove, ddl)


def document_proofs(docs: DataFrame, height: int = 7, leaves_per_part: int = 65_536, with_proof: bool = False) -> DataFrame:
    """Manifest of ``documents`` (a tree per source, leaves by doc_id) and the audit of their copies.

    Nulls count as values of their own (a null source is the first tree, null
    ids are a tree's first leaves).  Rows that repeat an id are leaves of their
    own, in the order of their digests; other columns are not read.  An empty
    table gives no row.
    """
    return audit(build(document_leaves(docs), ["doc_id"], height, leaves_per_part), with_proof=with_proof)
