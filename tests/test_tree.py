"""Directory tree: hierarchy, roll-up metrics, summaries, integrity."""

from pyspark.sql import functions as F

from canopy.operators import tree
from canopy.functions.text import dir_id


def files_df(spark, items):
    data = [(fid, path, "\n".join(["x"] * loc) if loc else "") for fid, path, loc in items]
    df = spark.createDataFrame(data, "file_id string, path string, text string")
    return df.withColumn("size", F.octet_length("text").cast("long"))


def test_hierarchy(spark):
    f = files_df(spark, [("file1", "src/components/Button.tsx", 50), ("file2", "src/utils/helpers.ts", 100),
                         ("file3", "README.md", 20)])
    d = {r["path"]: r for r in tree.directory_tree(f).collect()}
    assert set(d) == {"src", "src/components", "src/utils"}
    assert d["src"]["parent_id"] is None
    src_id = spark.range(1).select(dir_id(F.lit("src"))).first()[0]
    assert d["src/components"]["parent_id"] == src_id and d["src"]["id"] == src_id
    counts = {r["path"]: r["child_count"] for r in tree.directory_child_counts(f).collect()}
    assert counts[""] == 2 and counts["src"] == 2  # root: src + README; src: two sub-directories


def test_nesting(spark):
    f = files_df(spark, [("file1", "src/components/ui/forms/Input.tsx", 80)])
    d = tree.directory_tree(f).collect()
    assert len(d) == 4
    fi = tree.files_in_directory(f).first()
    assert fi["dir_path"] == "src/components/ui/forms"


def test_metrics(spark):
    f = files_df(spark, [("f1", "src/app.ts", 200), ("f2", "src/utils/helper.ts", 150), ("f3", "tests/app.test.ts", 100)])
    r = {x["path"]: (x["loc"], x["file_count"]) for x in tree.directory_rollup(f).collect()}
    assert r["src"] == (350, 2) and r["tests"] == (100, 1) and r["src/utils"] == (150, 1)
    tot = tree.repo_totals(f).first()
    assert (tot["loc"], tot["file_count"]) == (450, 3)


def test_small_and_large_directory_summary(spark):
    small = files_df(spark, [("file1", "src/a.ts", 1), ("file2", "src/b.ts", 1)])
    s = {r["path"]: r for r in tree.directory_summary(small).collect()}
    assert s["src"]["summary"] == "Contains file1, file2" and not s["src"]["needs_provider"]
    big = files_df(spark, [(f"file{i}", f"src/f{i}.ts", 1) for i in range(4)])
    b = {r["path"]: r for r in tree.directory_summary(big).collect()}
    assert b["src"]["summary"] is None and b["src"]["needs_provider"]
    mixed = files_df(spark, [("file9", "src/lib/x.ts", 1), ("file1", "src/a.ts", 1)])
    m = {r["path"]: r for r in tree.directory_summary(mixed).collect()}
    assert m["src"]["summary"] == "Contains lib/, file1"  # sub-directories first


def test_empty_input(spark):
    f = files_df(spark, [])
    assert tree.directory_tree(f).count() == 0
    t = tree.repo_totals(f).first()
    assert (t["loc"], t["file_count"]) == (0, 0)


def test_large_module(spark):
    f = files_df(spark, [("f1", "src/a.ts", 800), ("f2", "src/b.ts", 300)])
    r = tree.large_directories(f).first()
    assert r["loc"] == 1100 and r["is_large"]


def test_integrity(spark):
    f = files_df(spark, [("f1", "src/a.ts", 1), ("f2", "b.ts", 1)])
    assert tree.tree_integrity(f).first()["passed"]
    bad = tree.tree_integrity(f, expected=3).first()
    assert not bad["passed"] and bad["found"] == 2


def test_top_level(spark):
    f = files_df(spark, [("f1", "src/app.ts", 1), ("f2", "docs/readme.md", 1)])
    names = {r["name"] for r in tree.root_directories(tree.directory_tree(f)).collect()}
    assert names == {"src", "docs"}
