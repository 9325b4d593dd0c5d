"""Directory scan with all scan-time filters, and the table store."""

import os

from pyspark.sql import functions as F

from canopy.sources import scan
from canopy.sources.store import TableStore


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)


def test_scan_directory_and_filters(spark, tmp_path):
    root = str(tmp_path / "repo")
    _write(root, "src/app.ts", "export function a() {}\n")
    _write(root, "src/util.py", "def f():\n    pass\n")
    _write(root, "src/image.png", "binary")
    _write(root, "node_modules/lib/index.js", "x")
    _write(root, ".github/workflows/ci.yml", "on: push")
    _write(root, "dist2/out.js", "x")  # 'dist' as a substring prunes it (kept reference behaviour)
    _write(root, "docs/big.md", "y" * 5000)
    _write(root, "logs/run.log", "z")
    _write(root, "README.md", "# title\n")
    rules = scan.parse_ignore_rules(["logs/", "# comment", ""])
    df = scan.scan_files(spark, root, rules=rules, max_bytes=1024)
    paths = sorted(r["path"] for r in df.collect())
    assert paths == ["README.md", "src/app.ts", "src/util.py"]
    rec = {r["path"]: r for r in scan.file_records(df).collect()}
    assert rec["src/util.py"]["loc"] == 3 and rec["src/util.py"]["name"] == "util.py"
    capped = scan.scan_files(spark, root, max_files=2).collect()
    assert [r["path"] for r in capped] == ["README.md", "docs/big.md"]


def test_scan_keeps_hidden_names_and_takes_uris(spark, tmp_path):
    root = tmp_path / "repo"
    names = ["pkg/__init__.py", "pkg/_app.tsx", "_shared/b.ts", ".eslintrc.json", "pkg/a.py", "top.py"]
    for n in names:
        _write(str(root), n, "x = 1\n")
    for given in (str(root), f"file://{root}", f"file:{root}/"):
        assert sorted(r["path"] for r in scan.scan_files(spark, given).collect()) == sorted(names)
    listed = scan.list_files(spark, str(root))
    assert scan.skipped_files(listed, 3).count() == len(names) and scan.scan_files(spark, str(root), max_bytes=3).count() == 0


def test_read_ignore_file(spark, tmp_path):
    p = tmp_path / ".gitignore"
    p.write_text("build/\n# c\n\n*.log\n!keep.log\n")
    assert scan.read_ignore_file(spark, str(p)) == ["build/", "*.log", "!keep.log"]


def test_store_replace_and_upsert(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    assert not store.exists("t")
    a = spark.createDataFrame([("x", "m", 2, [3.0, 4.0], 1)], "id string, model string, dim int, vector array<float>, batch long")
    store.upsert("emb", a)
    b = spark.createDataFrame([("x", "m", 2, [1.0, 0.0], 2), ("y", "m", 2, [0.0, 2.0], 2)],
                              "id string, model string, dim int, vector array<float>, batch long")
    v1 = store.version("emb")
    store.upsert("emb", b)
    assert store.version("emb") != v1  # new version written, pointer swapped
    r = {x["id"]: x for x in store.read("emb").collect()}
    assert r["x"]["batch"] == 2 and [round(v, 6) for v in r["y"]["vector"]] == [0.0, 1.0]
    store.replace("t", spark.range(3))
    store.append("t", spark.range(2))
    assert store.read("t").count() == 5
    staged = store.replace_many({"topics": spark.range(1), "topic_links": spark.range(4)})
    assert set(staged) == {"topics", "topic_links"} and store.read("topic_links").count() == 4


def test_store_commits_are_whole(spark, tmp_path):
    import pytest
    store = TableStore(spark, str(tmp_path / "atomic"))
    store.replace_many({"topics": spark.range(1), "topic_links": spark.range(4)})
    before = store._manifest()
    failing = spark.range(3).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception):  # the second table fails: neither changes
        store.replace_many({"topics": spark.range(9), "topic_links": failing})
    assert store._manifest() == before and store.read("topics").count() == 1
    with pytest.raises(Exception):  # nor does a failed append leave rows
        store.append("topics", failing)
    assert store.read("topics").count() == 1
    calls = []

    def late(tables):  # another writer commits between our read and our rename
        if not calls:
            calls.append(1)
            store.append("topics", spark.range(2))
        return {**tables, "topic_links": before[1]["topics"]}

    store._commit(late)
    assert store.read("topics").count() == 3 and store._manifest()[0] == before[0] + 2


def test_incremental_stream_restart_adds_nothing(spark, tmp_path):
    from tests.conftest import SF_SMALL
    from canopy.streaming.incremental import document_stream, start_incremental
    import uuid
    # run ids must be unique: the checkpoint folder is the session's shared, persistent one
    r1, r2 = f"t-{uuid.uuid4().hex[:8]}", f"t-{uuid.uuid4().hex[:8]}"
    store = TableStore(spark, str(tmp_path / "stream-store"))
    start_incremental(spark, document_stream(spark, SF_SMALL), store, r1).awaitTermination()
    n1 = store.read("summaries").count()
    start_incremental(spark, document_stream(spark, SF_SMALL), store, r1).awaitTermination()   # restart
    start_incremental(spark, document_stream(spark, SF_SMALL), store, r2).awaitTermination()   # fresh checkpoint, same data
    s = store.read("summaries")
    assert s.count() == n1 == s.select("hash").distinct().count() > 0


def test_a_later_rule_takes_a_file_back(spark):
    from canopy.sources import standins as st
    rules = scan.parse_ignore_rules(st.IGNORE_FILE_LINES)
    paths = ["src13/de/doc413.md", "src13/de/doc5.md", "src13/en/doc4.ts", "src5/en/doc41.ts", "src5/fr/doc41.py", "src3/en/doc41.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"] for r in scan.filter_ignore_rules(df, rules).collect()} == {"src13/de/doc413.md", "src5/en/doc41.ts"}


def test_rules_as_the_original_reads_them(spark):
    paths = ["top.log", "a/run.log", "src/x.ts", "src/d/y.ts", "src/de/z.ts", "lib/src/w.ts", "build/o.js", "a/build/p.js", "rebuild/q.js"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")

    def kept(*lines):
        return {r["path"] for r in scan.filter_ignore_rules(df, scan.parse_ignore_rules(lines), compat=True).collect()}

    assert kept("*.log") == set(paths) - {"top.log"}                         # the whole path, so the top level only
    assert kept("build/") == set(paths) - {"build/o.js", "a/build/p.js"}     # the final '/' means nothing
    assert kept("src/d**") == set(paths) - {"src/de/z.ts", "src/d/y.ts"}     # '**': any one character, then any but '/'
    assert kept("!src") == {"src/x.ts", "src/d/y.ts", "src/de/z.ts"}         # drops what it does not hit, folders above included
    assert kept("*.log", "!top.log") == set()                               # hit by the first or missed by the second
    assert kept() == set(paths)
