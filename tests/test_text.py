"""Scalar functions, scan filters and chunking edge cases."""

from pyspark.sql import functions as F

from canopy.functions import text as tx
from canopy.operators import chunking as ch
from canopy.sources import scan


def test_hash_language_loc(spark):
    df = spark.createDataFrame([("test.ts", "a\nb\n"), ("test2.ts", "a\nb\n"), ("test.py", ""), ("test.unknown", "x")],
                               "path string, text string")
    r = df.select("path", tx.content_hash("text").alias("h"), tx.detect_language("path").alias("l"),
                  tx.line_count("text").alias("n")).collect()
    d = {x["path"]: x for x in r}
    assert len(d["test.ts"]["h"]) == 64 and d["test.ts"]["h"] == d["test2.ts"]["h"]
    assert d["test.ts"]["h"] != d["test.py"]["h"]
    assert [d[p]["l"] for p in ("test.ts", "test.py", "test.unknown")] == ["typescript", "python", "plain"]
    assert d["test.ts"]["n"] == 3 and d["test.py"]["n"] == 1  # trailing newline counts; empty file is 1


def test_chunk_id_roundtrip(spark):
    df = spark.createDataFrame([("h", "func", 2, "a:b")], "h string, k string, i int, n string")
    cid = df.select(tx.chunk_id("h", "k", "i", "n").alias("c")).first()["c"]
    assert cid == "h:func:2:a:b"
    p = spark.createDataFrame([(cid,)], "c string").select(tx.parse_chunk_id("c").alias("p")).first()["p"]
    assert (p["file"], p["kind"], p["idx"], p["name"]) == ("h", "func", 2, "a:b")


def test_ignored_dirs_are_substrings(spark):
    df = spark.createDataFrame([(".github/x.ts",), ("rebuild/y.ts",), ("distribution/z.ts",), ("src/ok.ts",)], "path string")
    kept = {r["path"] for r in scan.filter_ignored_dirs(df).collect()}
    assert kept == {"src/ok.ts"}
    exact = {r["path"] for r in scan.filter_ignored_dirs(df, exact=True).collect()}
    assert exact == {".github/x.ts", "rebuild/y.ts", "distribution/z.ts", "src/ok.ts"}


def test_ignore_rules(spark):
    rules = scan.parse_ignore_rules(["dist/", "# comment", "", "*.log", "a*/b/*"])
    assert rules == ["dist/", "*.log", "a*/b/*"]
    df = spark.createDataFrame([("dist/x.ts",), ("x.log",), ("d/x.log",), ("ab/b/c.ts",), ("ab/c/c.ts",)], "path string")
    kept = {r["path"] for r in scan.filter_ignore_rules(df, rules).collect()}
    assert kept == {"ab/c/c.ts"}  # '*' stays inside one segment; a '/' inside anchors


def test_ignore_rules_last_match_and_anchors(spark):
    paths = ["a/b/x.log", "foo", "d/foo", "build/x", "d/build/x", "tmp1.c", "tmpx.c", "keep.log", "out/keep.log", "logs/a", "logs"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = lambda *rules: {r["path"] for r in scan.filter_ignore_rules(df, list(rules)).collect()}
    assert kept("*.log") == set(paths) - {"a/b/x.log", "keep.log", "out/keep.log"}
    assert kept("**/foo") == set(paths) - {"foo", "d/foo"}
    assert kept("/build") == set(paths) - {"build/x"}
    assert kept("tmp[0-9].c") == set(paths) - {"tmp1.c"} and kept("tmp[!0-9].c") == set(paths) - {"tmpx.c"}
    assert kept("!keep.log", "*.log") == kept("*.log")
    assert kept("*.log", "!keep.log") == set(paths) - {"a/b/x.log"}
    assert kept("out", "!keep.log") == set(paths) - {"out/keep.log"}  # its folder stays ignored
    assert kept("logs/") == set(paths) - {"logs/a"}
    assert kept() == set(paths)


def _text(n):
    return "\n".join(["function f() {"] + [f"  x{i}" for i in range(n - 1)])


def test_loc_windows_keep_every_line(spark):
    for n, expect in [(300, 1), (301, 2), (600, 2), (601, 3)]:
        df = spark.createDataFrame([(1, _text(n))], "file_id int, text string")
        c = ch.loc_windows(ch.declaration_chunks(df, r"^function"), 300).orderBy("start_line").collect()
        assert len(c) == expect
        assert c[0]["start_line"] == 0 and c[-1]["end_line"] == n - 1  # Q4 fixed: nothing lost


def test_fallback_and_segments(spark):
    df = spark.createDataFrame([(1, "intro\nfunction a() {\n}\nfunction b() {\n}"), (2, "no decl here")],
                               "file_id int, text string")
    segs = ch.declaration_chunks(df, r"^function").orderBy("pos").collect()
    assert [(s["start_line"], s["end_line"]) for s in segs] == [(1, 2), (3, 4)]  # intro dropped
    fb = ch.chunk_fallback(df, r"^function").collect()
    assert [(r["file_id"], r["end_line"]) for r in fb] == [(2, 0)]


def test_language_patterns(spark):
    df = spark.createDataFrame([(1, "x = 1\ndef f():\n  pass", "python"), (2, "export function g() {}\n", "typescript"),
                                (3, "plain words", "plain")], "file_id int, text string, language string")
    c = ch.chunk_by_language(df).collect()
    starts = sorted((r["file_id"], r["start_line"]) for r in c)
    assert starts == [(1, 1), (2, 0), (3, 0)]


def test_texts_are_cut_into_words_a_few_bytes_at_a_time(monkeypatch):
    """Vectors and term counts do not depend on the slices, and no slice has more bytes than it may."""
    import numpy as np
    import pyarrow as pa
    from canopy.functions import batches
    from canopy.operators import keyword as kw, vectors as vo
    texts = [("login page " * (i % 9)).strip() or None for i in range(70)] + ["é" * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(71)), pa.array(texts)], names=["id", "text"])
    parts = list(batches.byte_slices(batch, 1, 120))
    assert sum(p.num_rows for p in parts) == 71 and all(p.num_rows == 1 or pa.compute.sum(pa.compute.binary_length(p["text"])).as_py() <= 120
                                                        for p in parts if p["text"].null_count < p.num_rows)
    whole = [vo._hashed_tf_batches(["id"], "text", 8), kw._index_batches("id", "text", ["login", "page"])]
    for run in whole:
        want = [r for rb in run([batch]) for r in rb.to_pylist()]
        with monkeypatch.context() as m:
            m.setattr(batches.byte_slices, "__defaults__", (120,))
            cut = list(run([batch]))
        assert len(cut) == len(parts) > 5 and [r for rb in cut for r in rb.to_pylist()] == want
    monkeypatch.setattr(vo, "SCORES_AT_ONCE", 40)   # a few queries at a time
    x = np.random.default_rng(1).normal(size=(20, 4))
    rows = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(20)]), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vector"])
    out = list(vo._partial_topk_fn(np.arange(9), x[:9], 3, "id", "vector", None)([rows]))
    assert len(out) == 5
    got = [(r["query_id"], r["id"]) for rb in out for r in rb.to_pylist()]
    assert sorted(got) == sorted((q, str(i)) for q in range(9) for i in np.argsort(-(x @ x[q]))[:3])


def test_words_are_cut_as_the_pattern_cuts_them():
    import random
    import re

    import pyarrow as pa

    from canopy.functions.batches import cut_words
    from canopy.operators.vectors import TOKEN_SPLIT
    rng = random.Random(4)
    for size in (0, 1, 9, 9, 9):
        texts = [None if rng.random() < 0.2 else "".join(rng.choice("abz09 àßñú÷×ÿþ.€😀\n,ā") for _ in range(rng.randrange(30))) for _ in range(size)]
        for kind in (pa.string(), pa.large_string()):
            for skip in (0, min(2, size)):
                words, rows = cut_words(pa.array(texts, kind).slice(skip))
                want = [(w, i) for i, t in enumerate(texts[skip:]) for w in re.split(TOKEN_SPLIT, t or "") if w]
                assert list(zip(words.to_pylist(), rows.tolist())) == want
