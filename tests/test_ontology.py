"""Ontology: assignment rules, links, violations, coverage, validation messages."""

from pyspark.sql import functions as F

from canopy.operators import ontology as on


def test_threshold_or_best(spark):
    doms = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "domain_id int, vector array<float>")
    files = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, -0.2]), ("c", [-1.0, -1.0])],
                                  "file_id string, vector array<float>")
    r = sorted((x["file_id"], x["domain_id"], x["via_fallback"]) for x in on.assign_domains(files, doms, 0.3).collect())
    # a: all three >= 0.3; b: domains 0 and 2 (equal vectors); c: none -> best, lowest id wins the tie
    assert r == [("a", 0, False), ("a", 1, False), ("a", 2, False), ("b", 0, False), ("b", 2, False), ("c", 0, True)]
    exact = spark.createDataFrame([("d", [0.3, 0.953939])], "file_id string, vector array<float>")
    assert on.assign_domains(exact, doms.where("domain_id = 0"), 0.3).first()["score"] >= 0.29


def _topic_inputs(spark):
    domains = spark.createDataFrame([(0, 0, "Auth", "login"), (1, 1, "UI", "widgets")],
                                    "domain_id int, pos int, title string, description string")
    subs = spark.createDataFrame([(0, 0, "Same", "x"), (0, 1, "Tokens", "y"), (1, 0, "Same", "z")],
                                 "domain_id int, pos int, title string, description string")
    files = spark.createDataFrame([("f1", "src/auth/login.ts"), ("f2", "src/auth/register.ts"), ("f3", "src/ui/button.ts")],
                                  "file_id string, path string")
    assign = spark.createDataFrame([
        (0, "src/auth/login.ts", ["Same", "Tokens", "Same"]), (0, "src/auth/register.ts", ["Tokens"]),
        (1, "src/ui/button.ts", ["Same"]), (1, "src/ui/missing.ts", ["Same"]), (1, "src/ui/button.ts", ["Nope"]),
    ], "domain_id int, path string, subtopics array<string>")
    return domains, subs, files, assign


def test_topics_and_links(spark):
    domains, subs, files, assign = _topic_inputs(spark)
    t = {r["id"]: r for r in on.ontology_topics(("Root", "all"), domains, subs).collect()}
    assert set(t) == {"root", "domain-1", "domain-2", "domain-1-sub-1", "domain-1-sub-2", "domain-2-sub-1"}
    assert t["root"]["is_root"] and t["domain-2-sub-1"]["parent_id"] == "domain-2" and t["domain-1"]["depth"] == 1
    links = {(r["topic_id"], r["node_id"]) for r in on.ontology_links(assign, files, domains, subs).collect()}
    # equal titles in two domains stay apart (Q7); duplicate link dropped
    assert links == {("domain-1-sub-1", "f1"), ("domain-1-sub-2", "f1"), ("domain-1-sub-2", "f2"), ("domain-2-sub-1", "f3")}
    rej = sorted((r["reason"], r["path"], r["title"]) for r in on.link_resolution(assign, files, domains, subs).collect())
    assert rej == [("unknown_path", "src/ui/missing.ts", "Same"), ("unknown_subtopic", "src/ui/button.ts", "Nope")]


def test_violations(spark):
    domains, subs, files, assign = _topic_inputs(spark)
    cand = spark.createDataFrame([(0, "src/auth/login.ts"), (0, "src/auth/register.ts"), (0, "src/auth/other.ts"),
                                  (1, "src/ui/button.ts")], "domain_id int, path string")
    a = assign.unionByName(spark.createDataFrame([(0, "src/auth/register.ts", [])], "domain_id int, path string, subtopics array<string>"))
    v = sorted((r["reason"], r["path"]) for r in on.assignment_violations(a, cand, subs).collect())
    assert ("not_assigned", "src/auth/other.ts") in v and ("unknown_path", "src/ui/missing.ts") in v
    assert ("unknown_subtopic", "src/ui/button.ts") in v and ("empty", "src/auth/register.ts") in v


def test_coverage_and_stats(spark):
    links = spark.createDataFrame([("t1", "f1"), ("t2", "f1"), ("t1", "f2")], "topic_id string, node_id string")
    n = spark.createDataFrame([(4,)], "n long")
    c = on.coverage(links, n).first()
    assert (c["coverage_compat"], c["coverage_distinct"]) == (75, 50)
    n0 = spark.createDataFrame([(0,)], "n long")
    assert on.coverage(links.limit(0), n0).first()["coverage_compat"] == 100
    topics = spark.createDataFrame([("root", 0), ("d", 1)], "id string, depth int")
    s = on.ontology_stats(topics, links).first()
    assert (s["total_topics"], s["total_links"], s["max_depth"]) == (2, 3, 1)
    s0 = on.ontology_stats(topics.limit(0), links.limit(0)).first()
    assert s0["max_depth"] is None


def test_validation_messages(spark):
    m = spark.createDataFrame([(100, 0, 5, 0.75), (85, 0, 5, 0.75), (100, 2100000, 5, 0.75), (100, 0, 150, 0.75),
                               (100, 0, 5, 0.05), (85, 2100000, 150, 0.75)],
                              "coverage int, total_ms long, calls int, similarity double")
    r = [(x["passed"], x["issues"]) for x in on.validation(m).collect()]
    assert r[0] == (True, [])
    assert r[1] == (False, ["Coverage below 100%: 85%"])
    assert r[2] == (False, ["Total time exceeds 30 minutes: 2100s"])
    assert r[3] == (False, ["LLM calls exceed 100: 150"])
    assert r[4] == (False, ["Low cluster similarity: 0.050"])
    assert len(r[5][1]) == 3


def test_call_count(spark):
    assert spark.range(1).select(on.call_count(F.lit(2)).alias("c")).first()["c"] == 5
    assert spark.range(1).select(on.call_count(F.lit(3)).alias("c")).first()["c"] == 7


def test_no_domains_gives_empty_assignment(spark):
    doms = spark.createDataFrame([], "domain_id int, vector array<float>")
    files = spark.createDataFrame([("a", [1.0, 0.0])], "file_id string, vector array<float>")
    assert on.assign_domains(files, doms).count() == 0
    assert on.best_domain(files, doms).count() == 0
    assert on.unassigned_files(files, doms).count() == 1


def test_many_domains_score_like_few(spark):
    """Above the literal limit scores come from a matrix product, with the same assignments; odd vectors included."""
    import numpy as np
    rng = np.random.default_rng(11)
    doms = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(on.LITERAL_DOMAINS + 3)] + [(900, [0.0] * 5)]
    rows = [(f"f{i}", [float(x) for x in rng.normal(size=5)]) for i in range(40)]
    rows += [("zero", [0.0] * 5), ("nan", [float("nan")] * 5), ("null", None)]
    files = spark.createDataFrame(rows, "file_id string, vector array<double>").repartition(3)
    domains = spark.createDataFrame(doms, "domain_id int, vector array<double>")
    few = [on.domain_scores(files, domains.where(f"domain_id {c} 40")).collect() for c in ("<", ">=")]
    want = {(r["file_id"], r["domain_id"]): r["score"] for part in few for r in part}
    got = {(r["file_id"], r["domain_id"]): r["score"] for r in on.domain_scores(files, domains).collect()}
    assert set(got) == set(want) and len(got) == 43 * len(doms)
    assert all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
    best = {r["file_id"]: r["domain_id"] for r in on.best_domain(files, domains).collect()}
    # NaN has a score, 0, only for the domain without a direction
    assert best["zero"] == 0 and best["nan"] == 900 and best["null"] is None
    assigned = {(r["file_id"], r["domain_id"]) for r in on.assign_domains(files, domains, 0.6).collect() if not r["via_fallback"]}
    assert assigned == {k for k, v in want.items() if v is not None and v >= 0.6}


def test_subtopics_of_odd_vectors(spark):
    subs = spark.createDataFrame([(0, 0, "a", [1.0, 0.0]), (0, 1, "b", [0.0, 1.0]), (0, 2, "c", [1.0, 1.0])],
                                 "domain_id int, pos int, title string, vector array<double>")
    rows = [("both", 0, [1.0, 0.9]), ("none", 0, [-1.0, -1.0]), ("nan", 0, [float("nan"), 1.0]), ("null", 0, None),
            ("zero", 0, [0.0, 0.0]), ("other", 7, [1.0, 0.0])]
    assign = spark.createDataFrame(rows, "file_id string, domain_id int, vector array<double>")
    got = sorted((r["file_id"], r["title"], r["via_fallback"]) for r in on.assign_subtopics(assign, subs, 0.3).collect())
    assert got == [("both", "a", False), ("both", "b", False), ("both", "c", False), ("nan", "a", True), ("none", "a", True),
                   ("zero", "a", True)]
    assert on.assign_subtopics(assign, subs.limit(0)).count() == 0


def test_batched_scores_are_the_same_numbers(spark):
    rows = [(f"f{i}", [float(i % 7) / 3, -float(i % 5) / 7, 1.0 / (i + 1)]) for i in range(30)]
    rows += [("zero", [0.0] * 3), ("nan", [float("nan")] * 3), ("null", None), ("hole", [1.0, None, 2.0])]
    files = spark.createDataFrame(rows, "file_id string, vector array<float>").repartition(3)
    for last in ([0.0, 0.0, 0.0], [0.2, -0.4, 0.1]):
        domains = spark.createDataFrame([(0, [0.3, 0.1, -0.7]), (1, [-0.9, 0.2, 0.4]), (5, last)], "domain_id int, vector array<float>")
        for threshold in (0.3, -0.5):
            one, two = (sorted(map(str, on.assign_domains(files, domains, threshold, batched=b).collect())) for b in (False, True))
            assert one == two
