"""The pipeline's stages on odd rows, and the whole of it on the smallest tables."""

import random


import corpus_pipeline as P
from canopy.llm import langid, quality
from tests.llm.test_operators import SMALL, brute_components, brute_fingerprint, brute_secrets


def _docs(spark):
    rnd = random.Random(1)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*P.COLUMNS).limit(60).collect()]
    words = "the and of that thing other with from under over".split()
    prose = [" ".join(rnd.choice(words) for _ in range(60)) + "." for _ in range(6)]
    rows += [(1000 + i, p, None, None, None) for i, p in enumerate(prose)]
    rows += [(2000, prose[0].upper(), "en", "s", 1), (2001, prose[1] + " token = abcdefabcdef0123456789.", "en", "s", 1),
             (2002, None, None, None, None), (2003, "", "en", "s", 0), (2004, "12 34. " * 30, "en", "s", 0),
             rows[0], (None, prose[5].title(), "en", "s", 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages_take_effect(spark):
    docs = _docs(spark)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == P.COLUMNS and out.schema == docs.schema
        before, after = docs.collect(), out.collect()
        if name == "quality":
            want = [(r.doc_id, t[9]) for r in before for t in [quality.judge(r.text, 20, 30, 0.5, 0.2, 4)] if t[6]]
            assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in after)
        elif name == "language":
            assert len(after) == sum(any(map(str.isalpha, r.text or "")) for r in before)
        elif name == "near_duplicates":
            fps = [brute_fingerprint(r.text) for r in before]
            roots = brute_components(fps)
            least = {}
            for r, c in zip(before, roots):
                if r.doc_id is not None:
                    least[c] = min(least.get(c, r.doc_id), r.doc_id)
            want = [least.get(c) for c in set(roots)]
            assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in after)
        else:
            assert len(after) == len(before)
            assert not any(brute_secrets(r.text)[0] for r in after)
        assert all(r.n_chars == len(r.text) for r in after)
        docs = spark.createDataFrame(after, docs.schema)


def test_documents_stay_where_no_language_was_learned(spark):
    rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate(["A clean text.", "Ein Text.", None, "", "12 ?!", "é"])]
    rows += [(None, "No id, so held out.", "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for own in (docs, docs.where("lang is null")):
        got = P.language_stage(spark, own, SMALL)
        assert got.schema == docs.schema
        want = [r for r in own.collect() if any(map(str.isalpha, r.text or ""))]
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}


def test_rows_that_share_an_id_or_have_none_stay_apart(spark):
    rnd = random.Random(31)
    a, b, c, d, e = (" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(50)) for _ in range(5))
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, None, "s", 1), (1, c, "en", "s", 1), (1, d, "en", "s", 1),
            (1, d, "en", "s", 1), (2, d, "en", "s", 1), (None, c, "en", "s", 1), (3, e, "en", "s", 1), (3, e.upper(), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = P.near_duplicate_stage(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got) == sorted([(0, a), (0, b), (1, c), (1, d), (3, e)])


def test_an_empty_table_passes_through(spark):
    docs = _docs(spark).where("false")
    for _, stage in P.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0


def test_run(spark):
    out = P.run(spark, SMALL)
    rows = out.collect()
    assert rows and all(0 <= r.offset < 1024 and r.length <= 1024 for r in rows)
    ids = {r.doc_id for r in rows}
    assert ids <= {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    done = {}
    for r in rows:
        done.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert all(a == b for a, b in done.values())
