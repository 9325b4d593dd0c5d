"""Graph traversal: closure at any depth, hops, walk scores and components against plain Python."""

import random
from collections import defaultdict

import numpy as np

from canopy.operators import graph as g


def _set(df, *cols):
    rows = df.collect()
    out = {tuple(r[c] for c in cols) for r in rows}
    assert len(out) == len(rows)
    return out


def test_closure_of_deep_tree_cycle_and_dangling_parent(spark):
    edges = [("r", None), *((f"n{i}", "r" if i == 0 else f"n{i - 1}") for i in range(6)),  # six levels below the root
             ("a", "b"), ("b", "c"), ("c", "a"), ("tail", "a"),                           # a cycle and what hangs on it
             ("self", "self"), ("lost", "gone"), ("lost", "gone"), (None, "r")]
    t = spark.createDataFrame(edges, "id string, parent_id string")
    got = _set(g.closure(t), "ancestor_id", "descendant_id", "distance")
    parent = {k: v for k, v in edges if k}
    want = set()
    for k in parent:
        at, n = k, 0
        seen = set()
        while at is not None and at not in seen:
            want.add((at, k, n))
            seen.add(at)
            at, n = parent.get(at), n + 1
    assert got == want
    assert g.closure(t.limit(0)).collect() == []


def _links(spark, seed, files=60, topics=25, n=90):
    r = random.Random(seed)
    pairs = [(f"f{r.randrange(files):02d}", f"t{r.randrange(topics)}") for _ in range(n)]
    pairs += [(f"f{i:02d}", "hot") for i in range(0, files, 3)]
    df = spark.createDataFrame(pairs + pairs[:5] + [(None, "t1"), ("f01", None)], "node_id string, topic_id string")
    return set(pairs), df


def _neighbours(pairs):
    of_topic = defaultdict(set)
    for f, t in pairs:
        of_topic[t].add(f)
    return {f: set().union(*(of_topic[t] for x, t in pairs if x == f)) for f, _ in pairs}


def test_hops_match_breadth_first_search(spark):
    pairs, df = _links(spark, 1)
    pairs = {(f, t) for f, t in pairs if t != "hot"}
    near = _neighbours(pairs)
    seeds = spark.createDataFrame([("f00",), ("f00",), (None,), ("nowhere",)], "node_id string")
    for limit in (None, 2):
        want, frontier, n = {"f00": 0, "nowhere": 0}, {"f00"}, 0
        while frontier and (limit is None or n < limit):
            n += 1
            frontier = set().union(*(near.get(f, set()) for f in frontier)) - set(want)
            want.update(dict.fromkeys(frontier, n))
        got = dict(_set(g.hops(df.where("topic_id <> 'hot'"), seeds, limit), "node_id", "hops"))
        assert got == want
    assert g.hops(df, seeds.limit(0)).collect() == []


def test_walk_matches_matrix_and_split_hot_topics(spark, monkeypatch):
    pairs, df = _links(spark, 2)
    files, topics = sorted({f for f, _ in pairs}), sorted({t for _, t in pairs})
    m = np.zeros((len(files), len(topics)))
    for f, t in pairs:
        m[files.index(f), topics.index(t)] = 1
    step = (m / m.sum(1, keepdims=True)) @ (m / m.sum(0)).T
    start = np.array([0.5 if f in ("f00", "f03") else 0.0 for f in files])
    score = start
    for _ in range(200):
        score = 0.85 * score @ step + 0.15 * start
    seeds = spark.createDataFrame([("f00",), ("f03",), ("nowhere",)], "node_id string")
    for hot in (g.HOT_LINKS, 4):  # in one part, and in several
        monkeypatch.setattr(g, "HOT_LINKS", hot)
        got = dict(_set(g.walk_scores(df, seeds, tolerance=1e-4), "node_id", "score"))
        assert abs(sum(got.values()) - 1) < 1e-9
        assert max(abs(got.get(f, 0) - s) for f, s in zip(files, score)) < 1e-3
    assert g.walk_scores(df, seeds.limit(0)).collect() == []


def test_components_match_union_find(spark):
    pairs = {(f"f{i:02d}", f"t{i // 2}") for i in range(40)} | {(f"f{i:02d}", f"u{(i + 1) // 2}") for i in range(20)}  # a long chain
    df = spark.createDataFrame(sorted(pairs), "node_id string, topic_id string")
    near, want = _neighbours(pairs), {}
    for f in sorted(near):
        todo = [] if f in want else [f]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = f
                todo += near[x]
    assert dict(_set(g.components(df), "node_id", "component_id")) == want
    assert g.components(df.limit(0)).collect() == []
