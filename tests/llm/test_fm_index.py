import random
import re

import numpy as np

from tidegrid.llm import fm_index
from tidegrid.llm.fm_index import FMIndex, remove_repeats


def brute(rows, width):
    least, split = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    order = lambda d: -(10**9) if d is None else d
    for d, w in split:
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            least[x] = min(least.get(x, order(d)), order(d))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - width + 1) if least[tuple(w[i : i + width])] < order(d) for j in range(i, i + width)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_backward_search_counts_every_pattern():
    r = np.random.default_rng(3)
    text = np.concatenate([np.append(r.integers(1, 5, r.integers(4, 30)), 0) for _ in range(60)])
    index = FMIndex(text)
    plain = text.tolist()
    start = np.array([i for i in range(len(text) - 3) if 0 not in plain[i : i + 4]])
    length, low, high = index.matching(text, start, 4)
    for i, got, a, b in zip(start.tolist(), length.tolist(), low.tolist(), high.tolist(), strict=True):
        twice = [sum(plain[j : j + k] == plain[i + 4 - k : i + 4] for j in range(len(plain) - k + 1)) > 1 for k in range(1, 5)]
        assert got == sum(twice)
        if got == 4:
            assert sorted(index.suffix[a:b].tolist()) == [j for j in range(len(plain) - 3) if plain[j : j + 4] == plain[i : i + 4]]


def test_rows_equal_brute_force(spark):
    r = random.Random(11)
    word = lambda: r.choice(("a", "b,", "ç", "dd", "E", "ff"))
    text = lambda n: [word() + r.choice(("", str(r.randrange(9)))) for _ in range(n)]
    shared, long = text(20), text(200)
    rows = [(i, text(r.randrange(60)) + shared[r.randrange(8) :] + text(r.randrange(60))) for i in range(120)]
    rows += [(200, long), (201, long[:90] + ["!"] + long[91:]), (202, long), (202, long), (203, ["x"] * 80), (204, ["x"] * 40), (None, long[50:90]), (-5, long[60:120])]
    rows = [(d, r.choice((" ", "\n", " \t")).join(w)) for d, w in rows] + [(300, None), (301, ""), (302, " one ")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, h int")
    for width, settings in ((13, {}), (13, {"hot": 5, "shard": 300}), (6, {"block": 2, "hot": 30, "shard": 2000})):
        got = [(x.doc_id, x.n_words, x.n_removed, x.kept) for x in remove_repeats(df, width=width, **settings).collect()]
        assert sorted(got, key=str) == brute(rows, width)
    assert remove_repeats(df.limit(0)).count() == 0


def test_words_of_one_hash_differ(spark, monkeypatch):
    """Words count as equal only if their bytes are: numbered templates, and a hash that knows lengths only."""
    twelve = " ".join("abcdefghijkl")
    rows = [(1, f"id125065 {twelve}"), (2, f"id244206 {twelve}"), (3, f"{twelve} id125065"), (4, f"{twelve} id244206"), (5, f"x id125065 {twelve} y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    get = lambda: sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in remove_repeats(df).collect()), key=str)
    assert get() == brute(rows, 13) and [x[2] for x in get()] == [0, 0, 0, 0, 13]
    raw = np.frombuffer(b"ab cd ab xyz ", np.uint8)
    end = np.flatnonzero(raw == 0x20)
    monkeypatch.setattr(fm_index, "hashed", lambda raw, begin, end, salt=0: (end - begin).astype(np.uint64))
    a, b, c, d = fm_index._ranked(raw, np.array([0, 3, 6, 9]), end).tolist()
    assert a == c and len({a, b, d}) == 3


def thue_morse(n, a="a", b="b"):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


def test_long_words_of_regular_letters(spark):
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    rows = [(1, one + " a b c d e f g h i j k l"), (2, two + " a b c d e f g h i j k l"), (3, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 0}
