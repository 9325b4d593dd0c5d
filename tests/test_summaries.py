"""Provider seam (C4/C5/C8), chunk rows (P7) and summary merging."""

from pyspark.sql import functions as F

from canopy.operators import summarise as sm
from canopy.operators.vectors import chunk_rows


def test_provider_errors_become_rows(spark):
    calls = {"n": 0}

    def flaky(text):
        if text.startswith("bad"):
            raise RuntimeError("model unavailable")
        return {"title": text.split("\n")[0], "summary": text, "functions": [], "classes": [], "loc": 1}

    df = spark.createDataFrame([("h1", "good text"), ("h2", "bad text\nline 2")], "hash string, text string")
    out = {r["hash"]: r for r in sm.summarise_with_provider(df, sm.FunctionProvider(flaky, retries=2)).collect()}
    assert out["h1"]["status"] == "ok" and out["h1"]["summary"]["title"] == "good text"
    assert out["h2"]["status"] == "error" and "model unavailable" in out["h2"]["error"]
    assert out["h2"]["summary"]["title"] == sm.ERROR_TITLE and out["h2"]["summary"]["loc"] == 2
    good, bad = sm.split_errors(sm.summarise_with_provider(df, sm.FunctionProvider(flaky, retries=1)))
    assert good.count() == 1 and bad.count() == 1


def test_summaries_once_per_content(spark):
    files = spark.createDataFrame([(2, "b/x.py", "same\ntext"), (1, "a/x.ts", "same\ntext"), (3, "c/y.md", "other")],
                                  "file_id long, path string, text string")
    s = {r["path"]: r for r in sm.summarise_files(files).collect()}
    assert set(s) == {"a/x.ts", "c/y.md"}  # equal content summarised once, lowest file id keeps its path
    assert s["a/x.ts"]["language"] == "typescript" and s["a/x.ts"]["summary"]["loc"] == 2
    cache = spark.createDataFrame([(s["c/y.md"]["hash"],)], "hash string")
    new = sm.incremental_new_content(files, cache).collect()
    assert [(r["file_id"]) for r in new] == [1]


def test_chunk_rows_skip_and_index(spark):
    item = "struct<name:string,loc:int,summary:string>"
    df = spark.createDataFrame(
        [("h", {"title": "t", "summary": "s", "loc": 3,
                "functions": [{"name": None, "loc": 1, "summary": "x"}, {"name": "a:b", "loc": 1, "summary": "does"},
                              {"name": "c", "loc": 1, "summary": ""}],
                "classes": [{"name": "K", "loc": 2, "summary": "klass"}]})],
        f"hash string, summary struct<title:string,summary:string,functions:array<{item}>,classes:array<{item}>,loc:int>")
    r = sorted((x["chunk_id"], x["idx"], x["text"]) for x in chunk_rows(df).collect())
    assert r == [("h:class:0:K", 0, "K: klass"), ("h:func:1:a:b", 1, "a:b: does")]


def test_merge_in_position_order(spark):
    rows = [("f", 1, {"title": "second", "summary": "B", "functions": [], "classes": [], "loc": 1}),
            ("f", 0, {"title": "first", "summary": "A", "functions": [{"name": "g", "loc": 1, "summary": "x"}],
                      "classes": [], "loc": 1})]
    df = spark.createDataFrame(rows, "hash string, pos int, summary struct<title:string,summary:string,"
                                     "functions:array<struct<name:string,loc:int,summary:string>>,"
                                     "classes:array<struct<name:string,loc:int,summary:string>>,loc:int>")
    m = sm.merge_chunk_summaries(df).first()
    assert m["title"] == "first" and m["summary"] == "A\n\nB" and len(m["functions"]) == 1


def test_a_provider_gets_texts_of_bounded_length(spark, monkeypatch):
    monkeypatch.setattr(sm, "TEXT_CHARS", 100)

    class Counting(sm.Provider):
        def apply(self, pdf):
            assert len(pdf) == 1 or pdf["text"].iloc[1:].str.len().sum() <= 100
            return super().apply(pdf)

        def summarise(self, text):
            return {"title": text, "summary": text, "functions": [], "classes": [], "loc": 1}

    rows = [(f"h{i}", "x" * (i * 7 % 60)) for i in range(90)] + [("long", "y" * 500), ("none", None)]
    df = spark.createDataFrame(rows, "hash string, text string").coalesce(1)
    got = {r["hash"]: (r["status"], r["summary"]["title"]) for r in sm.summarise_with_provider(df, Counting()).collect()}
    assert got == {h: ("ok", t) for h, t in rows}
