import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import ppm

WORD = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def read(t):
    return "".join(w + " " for w in re.findall(WORD, lower(t))).encode() + b"\n"


def plain_ppm(train, order, nodes):
    """Symbol by symbol, with the exclusion sets written out."""
    follow = {}
    for t in train:
        x = b"\n" * order + read(t)
        for i in range(order, len(x)):
            for k in range(order + 1):
                follow.setdefault(x[i - k : i], Counter())[x[i]] += 1
    total = sum(follow.get(b"", Counter()).values())
    follow = {c: f for c, f in follow.items() if not c or sum(f.values()) * nodes >= total}

    def log(t):
        x, out = b"\n" * order + read(t), 0.0
        for i in range(order, len(x)):
            p, gone = 1.0, set()
            for k in range(order, -1, -1):
                f = {s: n for s, n in follow.get(x[i - k : i], {}).items() if s not in gone}
                if not f:
                    continue
                top = sum(f.values()) + len(f)
                if x[i] in f:
                    p *= f[x[i]] / top
                    break
                p *= len(f) / top
                gone |= set(f)
            else:
                p /= 256 - len(gone)
            out += math.log10(p)
        return out

    return log


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(("Ba", "na", "an", " ", "é", "\n", "xyz ", "b")) for _ in range(r.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize(("order", "nodes"), [(3, 1 << 18), (2, 30), (0, 5)])
def test_scores_equal_plain_ppm_and_unigrams(spark, order, nodes):
    train, test = texts(60), texts(40, 2) + ["", None, "new words ζ", "a" * 9000]
    log = plain_ppm(train, order, nodes)
    df = spark.createDataFrame([(i, t, 1.0, "k") for i, t in enumerate(train)], "doc_id long, text string, score double, key string").drop("score")
    counts = ppm.count(df, order=order)
    model = ppm.fit(counts, order, nodes)
    rows = [(i, t, "k") for i, t in enumerate(test)] + [(3, test[3], "k"), (None, "ban", "k")]
    out = spark.createDataFrame(rows, "doc_id long, text string, key string")
    c = Counter(w for t in train for w in re.findall(WORD, lower(t)))
    total, v = sum(c.values()) + len(train), len(c) + 1
    for frequent in (1 << 23, 40):
        got = ppm.scores(out, counts, model, frequent=frequent).collect()
        assert len(got) == len(rows)
        want = {}
        for i, t, _ in rows:
            w = re.findall(WORD, lower(t))
            base = sum(math.log10((c[x] + 1) / (total + v + 1)) for x in w) + math.log10((len(train) + 1) / (total + v + 1))
            want[i] = (len(w) + 1, sum(c[x] > 0 for x in w) + 1, total, base, log(t))
        for x in got:
            assert (x.n_tokens, x.n_known, x.train_tokens) == want[x.doc_id][:3]
            assert x.base_score == pytest.approx(want[x.doc_id][3]) and x.score == pytest.approx(want[x.doc_id][4], rel=1e-5)
    plain = {x.doc_id: x.log10_probability for x in ppm.score(out, model).collect()}
    assert all(plain[x.doc_id] == x.score for x in got)


def test_probabilities_sum_to_one(spark):
    model = ppm.fit(ppm.count(spark.createDataFrame([(t,) for t in texts(50)], "text string"), order=2), 2, 200)
    p = 10.0 ** model.logs.reshape(-1, model.width)
    assert np.allclose(p[:, :-1].sum(1) + p[:, -1] * (257 - model.width), 1, atol=1e-4)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    counts = ppm.count(df.limit(0))
    got = {x.doc_id: x for x in ppm.scores(df, counts, ppm.fit(counts)).collect()}
    assert got[1].score == pytest.approx(-4 * math.log10(256)) and got[2].n_known == 0
    assert ppm.scores(df.limit(0), counts, ppm.fit(counts)).count() == 0


@pytest.mark.parametrize("order", [1, 3, 5])
def test_contexts_beyond_the_trie_are_looked_up(spark, order, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK", 200)
    train, test = texts(60), texts(40, 2) + ["", None, "new words ζ", "xyz \x01ban", "banana " * 300]
    log = plain_ppm(train, order, 1 << 40)
    counts = ppm.count(spark.createDataFrame([(t,) for t in train], "text string"), order=order)
    tree = ppm.edges(counts, order)
    rows = [*enumerate(test), (3, test[3]), (None, "ban")]
    out = spark.createDataFrame(rows, "doc_id long, text string")
    for nodes in (1, 30, 1 << 40):
        model, deep = ppm.fit(counts, order, nodes, tree), ppm.Deep(tree, order, nodes)
        got = ppm.scores(out, counts, model, deep=deep).collect()
        assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == sorted((i is None, i or 0) for i, _ in rows)
        want = dict(rows)
        assert all(x.score == pytest.approx(log(want[x.doc_id]), rel=1e-5) for x in got)


def test_all_contexts_without_training(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    counts = ppm.count(df.limit(0))
    tree = ppm.edges(counts)
    got = {x.doc_id: x.score for x in ppm.scores(df, counts, ppm.fit(counts, tree=tree), deep=ppm.Deep(tree)).collect()}
    assert got == pytest.approx({1: -4 * math.log10(256), 2: -math.log10(256)})
