import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import toxicity as T


def spectrum(s):
    s = [T.CLASS[x] for x in s.lower() if T.CLASS[x] != T.GAP]
    out = Counter()
    for i, j, k in itertools.combinations(range(len(s)), 3):
        if k - i < T.SPAN:
            out[s[i], s[j], s[k]] += T.DECAY ** (k - i + 1)
    return out


def plain_kernel(a, b):
    """Gap-weighted subsequences of three within five places, all occurrences; unit ``a`` and landmark ``b``."""
    x, y = spectrum(a), spectrum(b)
    dot = lambda u, v: sum(n * v[c] for c, n in u.items())
    return (dot(x, y) * min(1, T.LENGTH / math.sqrt(dot(x, x))) / dot(y, y)) ** T.POWER if x and y else 0.0


def plain_score(text, model):
    """A document's score by definition, sentence by sentence."""
    best = [model.bias]
    text = text.encode()
    begin, end, sentence, _ = T.units(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for a, b in itertools.pairwise(sentence.tolist()):
        units = [text[x:y] for x, y in zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True)]
        best.append(model.bias + sum(float(w) * max(plain_kernel(u, m) for u in units) for m, w in zip(model.marks, model.weights, strict=True)))
    top = max(best[1:]) if best[1:] else best[0]
    return 1 / (1 + math.exp(-min(max(model.curve[0] * top + model.curve[1], -40), 40)))


def test_kernel_equals_its_definition():
    r = random.Random(1)
    units = ["".join(r.choice("abcdé.") for _ in range(r.randrange(1, 12))).encode() for _ in range(200)] + [b"a b c d e"]
    marks = [u for u in units if len(spectrum(u)) > 2][:9]
    table = T.dense(*T._flat(marks))
    got = T.kernel(*T._flat(units), table)
    assert np.allclose(got, [[plain_kernel(u, m) for m in marks] for u in units], rtol=1e-3, atol=1e-4)
    near = set(T.reachable(*T._flat(units), table).tolist())
    assert near >= set(np.flatnonzero(got.max(1) >= T.FLOOR).tolist()) and len(near) < len(units)
    own = T.likeness(table)
    assert np.allclose(own, own.T) and np.allclose(own.diagonal(), 1) and np.linalg.eigvalsh(own).min() > -1e-9
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            x, y = spectrum(a), spectrum(b)
            size = lambda u: math.sqrt(sum(n * n for n in u.values()))
            assert own[i, j] == pytest.approx((sum(n * y[c] for c, n in x.items()) / size(x) / size(y)) ** T.POWER, abs=1e-4)


def test_one_symmetric_kernel():
    """What sentences are multiplied with is the kernel whose matrix is inverted."""
    marks = [b"idiot", b"schuft", b"abcab", b"grobian", b"stup", b"stupid"]
    table = T.dense(*T._flat(marks))
    size = np.array([math.sqrt(sum(n * n for n in spectrum(m).values())) for m in marks])
    assert np.allclose(T.lengths(table), size, rtol=1e-5)
    got = T.kernel(*T._flat(marks), table) * T.lengths(table) ** T.POWER  # with landmarks of length 1
    own = got / np.minimum(size, T.LENGTH)[:, None] ** T.POWER  # of units of length 1
    assert np.allclose(own, own.T, rtol=1e-4, atol=1e-6) and np.allclose(own, T.likeness(table), rtol=1e-4, atol=1e-6)


def test_units_and_sentences():
    text = b"One two. i d i o t x-y\nThree! four a b"
    begin, end, sentence, document = T.units(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [text[a:b] for a, b in zip(begin, end, strict=True)] == [b"One", b"two.", b"i d i o t", b"x-y", b"Three!", b"four", b"a", b"b"]
    assert sentence.tolist() == [0, 2, 4, 5, 8] and document.tolist() == [0, 4]


def corpus(n=400):
    r = random.Random(7)
    word = lambda: "".join(r.choice(("la", "mi", "ro", "ten", "su", "ka")) for _ in range(r.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() + r.choice(("", "", "", ".")) for _ in range(r.randrange(5, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(("grobian", "wicht", "schuft")))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_obfuscated_words(spark):
    docs, labels = corpus()
    more = [(1000, "la mi g r o b i a n ro"), (1001, "la mi gro-bian ro"), (1002, "la mi schuxft ro"), (1003, None), (1004, ""), (1005, "la mi ro"), (1005, "la mi ro")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs + more], "doc_id long, text string, score int")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = T.train(df, lab, out_of=(4, 2))
    assert model.marks and all(any(m in t.lower().encode() for _, t in docs) for m in model.marks)
    got = {(x.doc_id, x.text): x.toxicity for x in T.score(df, model).collect()}
    held = [(y, got[d, t] >= 0.3) for (d, t), (_, y) in zip(docs, labels, strict=True) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(held) > 60 and sum(bool(y) == p for y, p in held) >= 0.97 * len(held)
    assert got[1000, "la mi g r o b i a n ro"] >= 0.3 and got[1001, "la mi gro-bian ro"] >= 0.3
    assert got[1002, "la mi schuxft ro"] > got[1005, "la mi ro"] and got[1003, None] < 0.3 and got[1004, ""] < 0.3
    for (_, t), value in list(got.items())[::25] + [((0, t or ""), got[d, t]) for d, t in more]:
        assert value == pytest.approx(plain_score(t or "", model), abs=0.02)
    assert T.score(df, model).columns == [*df.columns, "toxicity"] and T.score(df.limit(0), model).count() == 0
    clash = T.score(df.withColumn("Toxicity", F.lit("x")).withColumn("row", F.lit("y")), model)
    assert clash.columns == ["doc_id", "text", "score", "row", "toxicity"] and {x.toxicity for x in clash.collect()} == set(got.values())
    long = spark.createDataFrame([(1, "la mi ro " * 40_000 + "grobian"), (2, "lamiro" * 50_000)], "doc_id long, text string")
    assert {x.doc_id: x.toxicity >= 0.3 for x in T.score(long, model).collect()} == {1: True, 2: False}


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = T.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({x.toxicity for x in T.score(df, model).collect()}) == 1
