"""Ranked lexical search against the plain formula."""

import math
import re
from collections import Counter

from tidegrid.llm import lexical

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LONG = " ".join(f"w{i % 977} Ä{i % 31}" for i in range(60_000))
TEXTS = ["the Cat sat", "THE cat; the\tdog-2", None, "", "... !", "ſun É été naïve the", LONG, "the cat sat", "cat", "dog2 2 dog"] * 3
ITEMS = [(1, "the cat"), (2, "The THE the dog 2"), (3, None), (4, "?!"), (5, "nowhere at all"), (6, "É w5 Ä7"), (1, "sat"), (None, "cat")]


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for d, b in bags:
            m = 100 - 50 + 50 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in own if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1.5, "x") for i, t in docs], "doc_id long, text string, score double, term string")
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, q, **more).collect()), key=str)


def test_equals_the_plain_formula(spark):
    docs = [(i * 700 - 5000, t) for i, t in enumerate(TEXTS)] + [(3, "the cat"), (3, "the cat"), (None, "cat sat"), (None, None)]
    for top in (1, 3, 50):
        assert run(spark, docs, ITEMS, top=top) == plain(docs, ITEMS, top)


def test_blocks_of_items_give_the_same(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    assert run(spark, docs, ITEMS, top=4, block=3) == plain(docs, ITEMS, 4)


def test_more_rows_than_a_window_holds(spark, monkeypatch):
    docs = [(k % 5, f"cat{k % 7} the {'x ' * (k % 3)}") for k in range(3000)] + [(k, "cat1") for k in range(5, 2500)]
    items = [(1, "cat1 the"), (2, "cat2 x")]
    assert run(spark, docs, items, top=50) == plain(docs, items, 50)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, [(1, "cat")], []) == [] and run(spark, [(1, None)], ITEMS) == []
