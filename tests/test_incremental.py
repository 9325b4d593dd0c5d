"""Bucketed merges and the incremental roll-up against a full recompute; what they leave untouched."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import tree, vectors as vo
from canopy.sources.store import Stale, TableStore


def _emb(spark, rows):
    return spark.createDataFrame([(i, "m", 2, [float(x), 1.0], b) for i, x, b in rows],
                                 "id string, model string, dim int, vector array<float>, batch long")


def test_merge_writes_touched_buckets_only(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    first = _emb(spark, [(f"n{i}", i, 1) for i in range(200)])
    assert len(store.merge("emb", first, ("id",), vo.upsert_embeddings)) > 40
    before = set(store.version("emb").split(","))
    change = _emb(spark, [("n5", 50, 2), ("new", 7, 2), ("n6", 9, 0)])
    touched = store.merge("emb", change, ("id",), vo.upsert_embeddings)
    after = set(store.version("emb").split(","))
    assert len(touched) <= 3 and before - after == {f for f in before if int(f.split("=")[1]) in touched}
    got = {r["id"]: r for r in store.read("emb").collect()}
    want = {r["id"]: r for r in vo.upsert_embeddings(vo.normalize_vectors(first), change).collect()}
    assert got == want and len(got) == 201 and got["n5"]["batch"] == 2 and got["n6"]["batch"] == 1


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    store.merge("t", spark.range(50), ("id",))
    manifest = store._manifest()

    def broken(old, rows):
        return old.unionByName(rows.select(F.raise_error(F.lit("broken")).cast("long").alias("id")))

    with pytest.raises(Exception):
        store.merge("t", spark.range(5), ("id",), broken)
    assert store._manifest() == manifest and store.read("t").count() == 50


def test_merges_that_meet_are_made_anew(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    pair = spark.createDataFrame([(1, 10), (2, 20)], "id long, v long")
    store.merge("t", pair, ("id",))
    calls = []

    def adding(old, rows):
        if not calls:  # another writer commits between our read and our commit
            calls.append(1)
            store.merge("t", spark.createDataFrame([(1, 5)], "id long, v long"), ("id",), adding)
        return old.unionByName(rows).groupBy("id").agg(F.sum("v").alias("v"))

    store.merge("t", spark.createDataFrame([(1, 100)], "id long, v long"), ("id",), adding)
    assert {r["id"]: r["v"] for r in store.read("t").collect()} == {1: 115, 2: 20}
    store.replace("t", spark.range(3))  # an ordinary table again
    assert store.read("t").count() == 3
    with pytest.raises(ValueError):
        store.merge("t", pair, ("id",))
    assert issubclass(Stale, Exception)


def _files(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, text string").repartition(3)


def _rollup(df):
    return sorted(tuple(r) for r in df.select("path", "id", "name", "parent_id", "loc", "file_count").collect())


def test_rollup_follows_adds_changes_and_removals(spark, tmp_path):
    rnd = random.Random(8)
    store = TableStore(spark, f"file://{tmp_path}")
    files = {f"d{rnd.randint(0, 9)}/e{rnd.randint(0, 5)}/f{i}.ts": "x\n" * rnd.randint(0, 9) for i in range(150)}
    files.update({"top.ts": "a", "only/here/one.ts": "a\nb", "only/two.ts": None, "d0/same.ts": "q"})
    assert tree.update_rollup(store, "dirs", _files(spark, files)).count() == len(files)
    assert _rollup(store.read("dirs")) == _rollup(tree.directory_rollup(_files(spark, {p: t or "" for p, t in files.items()})))
    version, state = store.version("dirs"), store._manifest()[0]
    assert tree.update_rollup(store, "dirs", _files(spark, files)).isEmpty() and store._manifest()[0] == state  # no change, no commit

    later = dict(files)
    del later["only/here/one.ts"], later["d0/same.ts"]        # 'only/here' has no file left
    later["only/two.ts"] = "1\n2\n3"
    later["brand/new/dir/file.py"] = "p"
    later["top.ts"] = "a\nb"                                  # in no directory
    changes = {r["path"]: (r["change"], r["loc"], r["n"]) for r in tree.update_rollup(store, "dirs", _files(spark, later)).collect()}
    assert changes == {"only/here/one.ts": ("removed", -2, -1), "d0/same.ts": ("removed", -1, -1), "only/two.ts": ("changed", 2, 0),
                       "brand/new/dir/file.py": ("added", 1, 1), "top.ts": ("changed", 1, 0)}
    assert _rollup(store.read("dirs")) == _rollup(tree.directory_rollup(_files(spark, {p: t or "" for p, t in later.items()})))
    assert "only/here" not in {r["path"] for r in store.read("dirs").collect()}
    kept = set(version.split(",")) & set(store.version("dirs").split(","))
    assert len(kept) >= len(version.split(",")) - 6           # d0, only, only/here and the three new ones
    tree.update_rollup(store, "dirs", _files(spark, later).limit(0))
    assert store.read("dirs").count() == 0 and store.read("dirs_files").count() == 0


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_document_stream_reads_a_table_of_one_file_or_many(spark, tmp_path, layout):
    from canopy.plans.q_pipeline import q_stream_incremental
    at = tmp_path / "sf[1]"   # characters of a pattern in the path stand for themselves
    texts = {i: f"text {i % 5}\nline {i % 3}" for i in range(40)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    (at / "labels.parquet").mkdir(parents=True)
    if layout == "folder":
        docs.repartition(3).write.parquet(f"file://{tmp_path}/made")
        (tmp_path / "made").rename(at / "documents.parquet")
    else:
        docs.coalesce(1).toPandas().to_parquet(at / "documents.parquet")
    got = [r["hash"] for r in q_stream_incremental(spark, f"file://{at}").collect()]
    assert len(got) == len(set(got)) == len(set(texts.values()))
