"""Decontamination against a window-by-window search, its places in the text, and edge cases."""

import hashlib
import random
import re

from canopy.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = WORDS.findall(lowered(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        found = list(WORDS.finditer(lowered(text)))
        w = [m[0] for m in found]
        hit, own = set(), set()
        for i in range(len(w)):
            for k in sizes:
                owners = windows.get(tuple(w[i:i + k])) if i + k <= len(w) else None
                if owners:
                    own |= owners
                    hit |= set(range(i, i + k))
        runs = []
        for p in sorted(hit):
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit),
                    tuple((found[a].start(), found[b].end()) for a, b in runs), tuple(sorted(own))))
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, items string, n_words int").repartition(3)
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(d, b, with_spans=True, **more).collect()
    plain = decontaminate.contamination(d, b, **more).collect()
    assert sorted(tuple(r) for r in plain if r.doc_id is not None) == sorted(tuple(r)[:6] for r in got if r.doc_id is not None)
    return sorted(((*tuple(r)[:6], tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in got), key=repr)


def cases(seed=1):
    rnd = random.Random(seed)
    vocab = ["the", "a", "Ünï", "中文", "x1", "42", "it", "no", "é", "Zoo"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([1 if i == 0 else 3, 4, 9, 10, 11, 25]))) for i in range(1, 40)]
    items += [(90, "lonelyword"), (91, None), (92, "?!"), (None, text(12)), (None, text(3)), (7, text(15)), (93, "ÀB c" + " tail" * 9)]
    items += [(i, items[5][1]) for i in range(1000, 1040)]  # copies
    docs = [(i, text(rnd.randint(0, 80))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " \n"), (103, "LONELYWORD, lonelyword's"), (104, items[3][1].upper() + "!!" + items[3][1]),
             (105, (items[10][1] + " other ") * 3000), (None, items[5][1]), (106, items[5][1].replace(" ", "\n -- \t")), (106, "again"),
             (107, "\0" + items[8][1] + "\x7f"), (108, "y" * 3_000_000), (109, "Àb c" + " TAIL" * 9 + " ΑΣς")]
    return docs, items


def test_matches_window_search(spark):
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    docs, items = cases(2)
    want = brute(docs, items)
    monkeypatch.setattr(decontaminate, "SEGMENT", 7)
    assert run(spark, docs, items, windows_a_block=150) == want
    assert decontaminate.write_items(spark.createDataFrame(items, "item_id long, text string"), windows_a_block=150).blocks > 3


def test_pieces_of_a_text(spark):
    docs, items = cases(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    machine = decontaminate.Automaton(decontaminate.write_items(b), 0)
    text = " ".join(t or "" for _, t in docs)
    whole = machine.scan(text)
    old, decontaminate.PIECE = decontaminate.PIECE, 37
    try:
        parts = machine.scan(text)
    finally:
        decontaminate.PIECE = old
    assert whole[0] == parts[0]
    assert sorted(zip(*(a.tolist() for a in whole[1:]))) == sorted(zip(*(a.tolist() for a in parts[1:])))
    assert len(whole[1]) > 100


def test_other_windows_and_empty_tables(spark):
    docs, items = cases(4)
    for window in (1, 3):
        assert run(spark, docs, items, window=window) == brute(docs, items, window)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, docs, [(1, None), (2, "...")]) == brute(docs, [])
    assert run(spark, [], items) == []
