"""Composite jobs: reruns, titles from content, files of equal content, checks and the cost gate."""

import pytest
from pyspark.sql import functions as F

from canopy.plans.build import build_ontology, checked_assignments, default_assigner, run_pipeline
from canopy.sources.store import TableStore

FILES = [(i, f"src/{'auth' if i % 2 else 'chart'}/f{i}.ts",
          ("login token session\nverify the token" if i % 2 else "axis legend plot\ndraw the axis") + f"\nline {i}", 40)
         for i in range(12)] + [(100, "src/copy/of0.ts", "axis legend plot\ndraw the axis\nline 0", 40)]


def _files(spark):
    return spark.createDataFrame(FILES, "file_id long, path string, text string, size long")


def test_two_runs_leave_equal_tables(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input_price double, output_price double")
    first = {r["stage"]: r for r in run_pipeline(spark, _files(spark), store, prices=prices, model="m").collect()}
    assert all(r["status"] == "ok" for r in first.values()) and first["cost"]["rows"] == 12
    links = {(r["topic_id"], r["node_id"]) for r in store.read("topic_links").collect()}
    assert {n for _, n in links} == {str(r[0]) for r in FILES}      # the copy keeps its own path
    titles = {r["title"] for r in store.read("topics").where("depth = 1").collect()}
    assert any("token" in t for t in titles) and any("axis" in t for t in titles)
    tables = {t: sorted(map(str, store.read(t).drop("batch").collect())) for t in ("summaries", "directories", "embeddings")}
    again = {r["stage"]: r for r in run_pipeline(spark, _files(spark), store, prices=prices, model="m", with_ontology=False).collect()}
    assert again["cost"]["rows"] == 0
    assert tables == {t: sorted(map(str, store.read(t).drop("batch").collect())) for t in tables}


def test_cost_above_the_limit_needs_approval(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    dear = spark.createDataFrame([("m", 1e6, 1e6)], "model string, input_price double, output_price double")
    asked = []
    with pytest.raises(PermissionError):
        run_pipeline(spark, _files(spark), store, with_ontology=False, prices=dear, model="m",
                     approve=lambda total: asked.append(total))
    assert asked and asked[0] > 1 and not store.exists("summaries")


def test_subtopic_assignment_is_checked_and_asked_again(spark):
    assign = spark.createDataFrame([("a", 0, "p", [1.0, 0.0]), ("b", 0, "q", [0.0, 1.0])],
                                   "file_id string, domain_id int, path string, vector array<double>")
    subs = spark.createDataFrame([(0, 0, "x", [1.0, 0.0])], "domain_id int, pos int, title string, vector array<double>")
    calls = []

    def flawed(a, s, threshold):
        calls.append(1)
        good = default_assigner(a, s, threshold)
        return good.where("path = 'p'") if len(calls) == 1 else good

    assert {r["path"] for r in checked_assignments(assign, subs, 0.3, flawed).collect()} == {"p", "q"} and len(calls) == 2
    with pytest.raises(ValueError, match="not_assigned 1"):
        checked_assignments(assign, subs, 0.3, lambda a, s, t: default_assigner(a, s, t).where("path = 'p'"))


def test_build_without_texts_or_directions(spark):
    rows = [(str(i), f"p{i}", [1.0, float(i % 3)]) for i in range(9)] + [("zero", "pz", [0.0, 0.0])]
    files = spark.createDataFrame(rows, "file_id string, path string, vector array<double>")
    res = build_ontology(files, n_domains=2)
    m = res["metrics"].first()
    assert m["coverage"] == 100 and m["total_ms"] >= m["clustering_ms"] > 0
    assert {r["title"] for r in res["domains"].collect()} == {"domain-1", "domain-2"}


def test_a_norm_is_computed_once_a_row_not_once_an_element(spark):
    import re
    from canopy.functions.vector import let, normalize
    one = spark.range(50).select(let(F.rand(3), lambda n: F.transform(F.array(*[F.lit(1.0)] * 5), lambda x: x * n)).alias("v"))
    assert all(len(set(r["v"])) == 1 for r in one.collect())
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").withColumn("v", normalize("v"))
    assert [r["v"] and [round(x, 6) for x in r["v"]] for r in v.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"cast\(lambda x_\d+#\d+ as double\) / lambda x_\d+#\d+", plan) and not re.search(r"/ SQRT", plan)


def test_vectors_of_few_domains_are_not_scored_in_one_task(spark):
    from canopy.operators import discovery as dv, ontology as on
    rows = [(f"f{i}", i % 2, [1.0, float(i % 7), float(i % 3)]) for i in range(60)]
    assign = spark.createDataFrame(rows, "file_id string, domain_id int, vector array<float>").repartition(6)
    subs, members = dv.discover_subtopics(assign, max_sub=3)
    t = on.assign_subtopics(assign, subs, 0.99)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan   # the few rows of the domains are sent, not the files
    of = {(r["domain_id"], r["pos"]): r["vector"] for r in subs.collect()}
    vectors = {f: v for f, _, v in rows}
    for r in members.collect():   # a file is with the centre that is nearest, up to the last move of the centres
        mine = max(sum(a * b for a, b in zip(vectors[r["file_id"]], of[(r["domain_id"], p)])) for p in range(3))
        assert sum(a * b for a, b in zip(vectors[r["file_id"]], of[(r["domain_id"], r["pos"])])) >= 0.98 * mine
    assert members.count() == 60 and len(of) == 6


def test_a_file_of_many_topics_is_cut_and_scored_once(spark, monkeypatch):
    """Titles, subtopics and links take a row a file (or a file and domain), not one for each of its topics and words."""
    from canopy.operators import discovery as dv, ontology as on
    held = {}
    kept = dv.materialize
    monkeypatch.setattr(dv, "materialize", lambda df, name="tmp": held.setdefault(name, kept(df, name)))
    rows = [(f"f{i}", d, f"p{i % 6}", [1.0, float(i % 4), float(i % 3)]) for i in range(8) for d in range(5)]
    assign = spark.createDataFrame(rows, "file_id string, domain_id int, path string, vector array<float>").coalesce(1)
    subs, members = dv.discover_subtopics(assign, max_sub=3)
    assert held["subtopic-vectors"].count() == 8 and members.count() == 40
    texts = spark.createDataFrame([(f"f{i}", f"Common word{i} élan, of a ab") for i in range(8)], "file_id string, text string")
    titles = dv.cluster_titles(members, texts, ["domain_id", "pos"])
    given = default_assigner(assign, subs, 0.3)
    for df in (titles, given):
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    domains = spark.createDataFrame([(d, d) for d in range(5)], "domain_id int, pos int")
    links = on.ontology_links(given, assign.select("file_id", "path").distinct(), domains, subs)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("collect_set")   # lists are made distinct, then taken apart
    want = {f"link-domain-{r['domain_id'] + 1}-sub-{int(t[4:]) + 1}-{n}"
            for r in given.collect() for t in r["subtopics"] for n in [max(f for f, _, p, _ in rows if p == r["path"])]}
    assert sorted(r["id"] for r in links.collect()) == sorted(want)


def test_titles_count_files_of_clusters_by_hand(spark, monkeypatch):
    """Small blocks, words over several slices, repeated and null keys: the titles of a count by hand."""
    import math
    from collections import Counter

    from canopy.operators import discovery as dv
    texts = [(i % 7 if i % 5 else None, " ".join(f"t{(i * j) % 11:02d}" for j in range(1, 1 + i % 6)) + " xx É" if i % 9 else None) for i in range(60)]
    members = [(i % 3 if i % 4 else None, i % 2, i % 8 if i % 7 else None) for i in range(40)]
    n = Counter()
    for d, p, k in members:
        for key, text in texts:
            if k is not None and k == key:
                n.update((d, p, t) for t in set((text or "").lower().split()) if len(t) >= 3)
    total, spread = len({m[:2] for m in members}), Counter(t for _, _, t in n)
    want = {}
    for c in {k[:2] for k in n}:
        ranked = sorted((-round(v * math.log1p(total / spread[k[2]]), 9), k[2]) for k, v in n.items() if k[:2] == c)
        want[c] = ", ".join(t for _, t in ranked[:2])
    m = spark.createDataFrame(members, "domain_id int, pos int, file_id long").repartition(3)
    t = spark.createDataFrame(texts, "file_id long, text string").repartition(3)
    for at_once in (dv.COUNTS_AT_ONCE, 4):
        monkeypatch.setattr(dv, "COUNTS_AT_ONCE", at_once)
        got = {(r["domain_id"], r["pos"]): r["title"] for r in dv.cluster_titles(m, t, ["domain_id", "pos"], n_terms=2).collect()}
        assert got == want and len(got) > 3
    assert dv.cluster_titles(m.limit(0), t, ["domain_id"]).count() == 0


def test_subtopics_of_odd_vectors(spark):
    from canopy.operators import ontology as on
    nan, subs = float("nan"), [(0, 0, "x", [1.0, 0.0]), (0, 1, "zero", [0.0, 0.0]), (0, 2, "gone", None), (1, 0, "y", [0.0, 2.0])]
    rows = [("null", 0, None), ("hole", 0, [1.0, None]), ("nan", 0, [nan, 1.0]), ("zero", 0, [0.0, 0.0]), ("x", 0, [3.0, 4.0]),
            ("null", 1, None), ("nan", 1, [nan, 1.0]), ("y", 1, [0.0, 1.0]), ("none", 2, [1.0, 1.0]), ("none", None, [1.0, 1.0])]
    a = spark.createDataFrame(rows, "file_id string, domain_id int, vector array<float>")
    s = spark.createDataFrame(subs, "domain_id int, pos int, title string, vector array<float>")
    got = {(r["file_id"], r["domain_id"], r["title"], r["score"], r["via_fallback"]) for r in on.assign_subtopics(a, s, 0.3).collect()}
    # without a direction the score is 0, without a vector it is known for a zero vector alone; NaN is below all
    assert got == {("null", 0, "zero", 0.0, True), ("hole", 0, "zero", 0.0, True), ("nan", 0, "zero", 0.0, True), ("zero", 0, "x", 0.0, True),
                   ("x", 0, "x", 3.0 / 5.0, False), ("nan", 1, "y", None, True), ("y", 1, "y", 1.0, False)}
    with pytest.raises(Exception, match="same length"):
        on.assign_subtopics(a.unionByName(spark.createDataFrame([("long", 1, [1.0, 2.0, 3.0])], a.schema)), s, 0.3).collect()
