"""The Merkle manifest against a plain tree, its proofs, and edge cases."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from canopy.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 3]) for i in range(0, len(last), 3)])
    return levels


def plain_path(levels, idx):
    out = []
    for level in levels[:-1]:
        a = idx // 3 * 3
        out.append((level[a:idx], level[idx + 1:a + 3]))
        idx //= 3
    return out


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda s: b"" if s is None else b"s" + s.encode())
    built = {s: plain_tree([leaf_of(r) for r in sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))]) for s in order}
    top = plain_tree([built[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for t, s in enumerate(order):
        upper = plain_path(top, t)
        for i, row in enumerate(sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))):
            path = plain_path(built[s], i) + upper
            copy = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                copy = (*row[:4], row[4].replace("\n", ""))
            digest = leaf_of(copy)
            for before, after in path:
                digest = h(*before, digest, *after)
            out.append((row[0], leaf_of(row), built[s][-1][0], root, h(*(d for b, a in path for d in (*b, *a))), digest, digest == root))
    return sorted(out, key=repr)


def made_rows():
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot", "hot", "b", "é", None, "", "solo" if i == 7 else "c"]), rnd.choice(["en", None]), rnd.choice([None, i]),
             rnd.choice([None, "", "line\nline", "é\n中" * 20, "no newline"])) for i in range(400)]
    rows += [rows[3], rows[3], (3, rows[3][1], "other", 1, "same id\n"), (None, "hot", None, None, None), (None, "hot", None, None, "a\nb")]
    return rows + [(5000 + i, "long" * 50, "en", 1, "x\n" * 50_000) for i in range(2)] + [(9, "eq", "en", 1, "copy\n")] * 90


def frame(spark, rows):
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "clash", 1) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, leaf string, part int")
    return df.repartition(5)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_matches_plain_trees_in_many_partitions(spark):
    rows = made_rows()
    want = brute(rows)
    assert {w[-1] for w in want} == {True, False}
    df = frame(spark, rows)
    assert result(merkle.document_proofs(df)) == want
    assert result(merkle.document_proofs(df, height=2, leaves_per_part=9)) == want      # several rounds, proofs across partitions
    assert result(merkle.document_proofs(df, height=1, leaves_per_part=1)) == want


def test_single_and_empty(spark):
    one = [(1, None, "en", 2, None)]
    assert result(merkle.document_proofs(frame(spark, one))) == brute(one)
    assert brute(one)[0][4] == h()
    none = merkle.document_proofs(frame(spark, one).where("false"), with_proof=True)
    assert none.collect() == [] and none.columns[-1] == "proof"


def test_proofs_of_some_leaves_fetch_only_what_is_missing(spark):
    rows = [(i, f"s{i % 2}", "en", i, f"text {i}\n") for i in range(500)]
    manifest = merkle.build(merkle.document_leaves(frame(spark, rows)), ["doc_id"], height=2, leaves_per_part=1000)
    some = manifest.leaves.where(F.col("doc_id").isin(0, 2, 4, 250, 499)).withColumn("claimed", F.lit(None).cast("string"))
    got = merkle.audit(manifest, some, with_proof=True).collect()
    assert sorted(r.doc_id for r in got) == [0, 2, 4, 250, 499]
    for r in got:
        assert r.verified and r.folded_root == manifest.root
        assert merkle.fold(r.leaf.encode(), [(p.before.encode(), p.after.encode()) for p in r.proof]).decode() == manifest.root
        assert h(*(p.before + p.after for p in r.proof)) == r.proof_sha256
    wrong = merkle.audit(manifest, some.withColumn("claimed", F.sha2("leaf", 256))).collect()
    assert not any(r.verified for r in wrong)


def test_missing_is_the_least_union():
    rnd = random.Random(1)
    for n in (1, 2, 3, 4, 10, 28, 100):
        for _ in range(20):
            idx = np.array(sorted(rnd.sample(range(n), rnd.randint(1, min(n, 8)))), np.int64)
            want, known, size, level = set(), set(idx.tolist()), n, 0
            while size > 1:
                need = {i for up in {k // 3 for k in known} for i in range(3 * up, min(size, 3 * up + 3))}
                want |= {(level, i) for i in need - known}
                known, size, level = {k // 3 for k in known}, -(-size // 3), level + 1
            assert {(lv, i) for lv, lost in merkle.missing(idx, n) for i in lost.tolist()} == want


def test_shared_nodes_are_requested_once_a_partition(spark):
    rows = [(i, "one", "en", i, "t") for i in range(3 ** 6)]
    manifest = merkle.build(merkle.document_leaves(frame(spark, rows)), ["doc_id"], height=3, leaves_per_part=3 ** 5)
    import pyarrow as pa
    parts = {}
    for r in manifest.leaves.select("part", "tree", "n", "idx", "top_idx", "trees").collect():
        parts.setdefault(r.part, []).append(r.asDict())
    assert len(parts) == 3
    for rows_ in parts.values():  # a third of the leaves: both siblings of its subtree's root and nothing else
        asked = merkle._requests(pa.Table.from_pylist(rows_)).to_pylist()
        assert [a["level"] for a in asked] == [5, 5]
