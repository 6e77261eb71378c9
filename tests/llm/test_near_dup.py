import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import near_dup
from tidegrid.llm.near_dup import _between, _least, edits, near_duplicates, representatives, similarities


def split(t):
    return (t or "").lower().split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(before + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def sim(a, b):
    return 1 - distance(a, b) / max(len(a), len(b)) if len(a) and len(b) else 0.0


def classes(rows, t=0.8):
    g = [split(x) for _, x in rows]
    bags = [Counter(x) for x in g]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or top(i) != top(j) and min(len(g[i]), len(g[j])) >= t * max(len(g[i]), len(g[j])) and sum((bags[i] & bags[j]).values()) >= t * max(len(g[i]), len(g[j]), 1) and sim(g[i], g[j]) >= t - 1e-9:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, least[top(i)]) for i, (d, _) in enumerate(rows))


def family(r, n):
    """Copies with one to five changed words, chains of copies, blocks moved, ends cut, and a shared passage."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text = lambda k: [word() for _ in range(k)]
    shared, out = text(30), []
    for _ in range(n):
        base = text(r.choice((3, 6, 9, 14, 30, 120)))
        out.append(base)
        for _ in range(r.randrange(4)):
            c = list(r.choice(out[-3:]))
            for _ in range(r.randrange(1, 6)):
                c[r.randrange(len(c))] = word()
            out.append(c)
        out.append(base[len(base) // 2 :] + base[: len(base) // 2])
        out.append(base[: max(1, len(base) * 9 // 10)])
        out.append(text(r.randrange(40)) + shared + text(r.randrange(40)))
    return [" ".join(x) for x in out]


def test_alignment_equals_plain_dynamic_programming():
    r = np.random.default_rng(1)
    pairs = []
    for _ in range(400):
        a = r.integers(1, r.integers(2, 40), r.integers(0, 60)).astype(np.uint64)
        b = np.concatenate([a[: r.integers(0, len(a) + 1)], r.integers(1, 9, r.integers(0, 8)).astype(np.uint64), a[r.integers(0, len(a) + 1) :]])
        pairs.append((a, b) if r.integers(2) else (b, a))
    want = [sim(list(a), list(b)) for a, b in pairs]
    for t in (0.3, 0.8):
        size = np.array([max(len(a), len(b), 1) for a, b in pairs])
        d = edits(pairs, np.floor(size * (1 - t) + 1e-9).astype(int), exact=1 << 62)
        got = np.where(d < 0, 0.0, 1 - d / size)
        assert (similarities(pairs, t) <= got + 1e-9).all() and ((similarities(pairs, t) > 0) == (got > 0)).all()
        assert got.tolist() == pytest.approx([s if s >= t - 1e-12 and max(map(len, p)) else got[i] for i, (s, p) in enumerate(zip(want, pairs, strict=True))])
    long = r.integers(1, 1000, 30_000).astype(np.uint64)
    more = np.delete(long, r.integers(0, 30_000, 400))
    assert 400 >= edits([(long, more)], np.array([6000]))[0] >= len(long) - len(more) and similarities([], 0.8).tolist() == []
    for size in (40, 400):  # bounds hold, and the anchored one is near the distance
        for _ in range(20):
            a = r.integers(1, 50, size).astype(np.uint64)
            b = a.copy()
            for _ in range(size // 20):
                at = int(r.integers(0, len(b)))
                b = np.delete(b, at) if r.integers(2) else np.insert(b, at, r.integers(1, 50, r.integers(1, 3)).astype(np.uint64))
            b = np.concatenate((b[5:], b[:5])) if r.integers(4) == 0 else b
            true = distance(a.tolist(), b.tolist())
            total, gaps = _between(a, b)
            assert _least(a, b) <= true <= total + sum(distance(x.tolist(), y.tolist()) for x, y in gaps) <= true + size // 8


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    r = random.Random(seed)
    texts = family(r, 30)
    rows = list(enumerate(texts + texts[::7] + ["", "", None, "one", "one", " one"]))
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, node int, key string")
    out = near_duplicates(df).collect()
    assert sorted((x.doc_id, x.class_id) for x in out) == classes(rows)
    text = {d: t or "" for d, t in rows}
    alone = {d for d, c in classes(rows) if sum(c == e and text[d] != text[f] for f, e in classes(rows)) == 0}
    assert {x.doc_id for x in out if x.n_links == 0} == alone and all((x.nearest is None) == (x.n_links == 0) for x in out)


def test_large_family_with_chains(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(110)]
    passage = [word() for _ in range(12)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        c = list(base)
        for _ in range(r.randrange(1, 6)):
            c[r.randrange(len(c))] = word()
        rows.append((i, " ".join(c)))
    for i in range(150, 160):  # copies of distant copies
        c = rows[i - 20][1].split()
        c[3] = word()
        rows.append((i, " ".join(c)))
    rows += [(200 + i, " ".join([*passage, *(word() for _ in range(8))])) for i in range(60)]
    rows += [(300 + i, rows[160 + i][1] + " " + word()) for i in range(20)]
    got = sorted((x.doc_id, x.class_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == classes(rows)


def partners(r, many, common=72, own=28, changed=18, among=None):
    """Texts with the same words at 72 of 100 places; each second one has a partner with ten more in common."""
    word = lambda: r.choice(among) if among else "".join(r.choice("abcdefghij") for _ in range(6))
    core = [word() for _ in range(common)]
    places = list(range(40, 40 + own))
    rows = []
    for i in range(many):
        mine = [word() for _ in range(own)]
        for mate in range(1 + i % 2):
            if mate:
                mine = [word() if k < changed else w for k, w in enumerate(mine)]
            text, rest = [], iter(core)
            for k in range(common + own):
                text.append(mine[places.index(k)] if k in places else next(rest))
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("many", [16, 60, 200, 2000])
def test_pairs_in_large_families_far_from_their_centre(spark, many):
    rows = partners(random.Random(many), many)
    pairs = [(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False) if sum(x == y for x, y in zip(a[1].split(), b[1].split(), strict=True)) >= 80]
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) == many // 2 and [p for p in pairs if got[p[0]] != got[p[1]]] == []
    assert len(set(got.values())) == len(rows) - len(pairs)


def test_families_without_rare_words(spark, monkeypatch):
    """All words are common, so lists are long and blocks are compared."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    r = random.Random(8)
    rows = partners(r, 60, among=[f"w{k}" for k in range(40)])
    got = sorted((x.doc_id, x.class_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == classes(rows)


def test_partners_whose_only_common_keys_are_large(spark):
    """A sketch by hand: near texts share one large key only, of few large ones, and neither is near its centre."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(45):
        base = [word() for _ in range(30)]
        texts += [" ".join(base), " ".join([*base[:25], *(word() for _ in range(5))])]
    name = lambda k: f"{k:03d}".encode()
    docs = spark.createDataFrame([(name(k), t) for k, t in enumerate(texts)], "node binary, text string")
    sketches = spark.createDataFrame([(name(k), 30, [1, *range(100 * k + 100, 100 * k + 131)]) for k in range(90)], "node binary, n int, keys array<bigint>")
    got = {(bytes(x.a), bytes(x.b)) for x in near_dup.links(docs, sketches, 0.8).collect()}
    assert got == {(name(k), name(k + 1)) for k in range(0, 90, 2)}


def test_first_words_of_near_texts_meet():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 1 << 16)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, rng.integers(1, 40)).astype(np.uint64)
        b = a.copy()
        b[rng.permutation(len(a))[: int(len(a) * 0.2 + 1e-9)]] = rng.integers(0, 1 << 63)
        bags = np.concatenate((a, b)), np.array([0, len(a), 2 * len(a)])
        word, of = near_dup.first_words(*bags, counts, 0.8)
        assert set(word[: of[1]].tolist()) & set(word[of[1] :].tolist())


def test_one_row_of_each_class_stays(spark):
    rows = [(3, "a b c", "x"), (3, "a b c", "x"), (4, "a b c", "y"), (None, "a b c", "z"), (None, None, "q"), (5, "d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies string")
    got = [tuple(x) for x in representatives(df).collect()]
    assert sorted(got, key=str) == sorted([(3, "a b c", "x"), (None, None, "q"), (5, "d", None)], key=str)
    assert representatives(df.limit(0)).columns == df.columns


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bound_of_shared_words_is_never_too_low():
    rng = np.random.default_rng(5)
    bags = [[rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint16) for _ in range(n)] for n in (7, 9)]
    bound = near_dup.shared_at_most(*bags)
    assert bound.shape == (7, 9)
    for i, x in enumerate(bags[0]):
        for j, y in enumerate(bags[1]):
            assert bound[i, j] >= sum((Counter(x.tolist()) & Counter(y.tolist())).values())
    one = [np.arange(5, dtype=np.uint16)]
    assert near_dup.shared_at_most(one, [np.arange(3, 9, dtype=np.uint16)]).tolist() == [[2.0]]  # exact where nothing repeats


def test_blocks_tell_near_pairs_of_different_components_only():
    words = [" ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(2, 22)), " ".join(f"v{i}" for i in range(20)), ""]
    texts = pa.record_batch([pa.array([b"a", b"b", b"c", b"d"], pa.binary()), pa.array(words)], names=["node", "text"])
    (bags,) = near_dup._bags([texts])
    assert [len(b.as_py()) // 2 for b in bags.column("brief")] == [len(o.as_py()) for o in bags.column("own")] == [20, 20, 20, 0]
    member = [{"node": n, "component": p, "brief": b.as_py()} for n, p, b in zip((b"a", b"b", b"c", b"d"), (b"a", b"b", b"a", b"d"), bags.column("brief"), strict=True)]

    def told(x, y, same):
        kind = pa.list_(pa.struct([("node", pa.binary()), ("component", pa.binary()), ("brief", pa.binary())]))
        rows = pa.record_batch([pa.array([0]), pa.array([0 if same else 1]), pa.array([x], kind), pa.array([y], kind)], names=["block", "other", "x", "y"])
        return [tuple(p.values()) for out in near_dup._alike(0.8)([rows]) for p in out.to_pylist()]

    assert told(member, member, True) == [(b"a", b"b")]
    assert told(member[1:2], member[:1], False) == [(b"a", b"b")]
    member[1]["component"] = b"a"
    assert told(member, member, True) == []


def alike(r, many, words=60):
    """Texts that are all near each other, and a far one that shares most keys with them, which makes it their centre."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(words)]
    texts = [" ".join(word() if k == i % words or k == i // words else w for k, w in enumerate(base)) for i in range(many)]
    keys = [[1, 2] if i < 40 else [1] for i in range(many)]
    return [*texts, " ".join(word() for _ in range(words))], [*keys, [1, 2, 3]]


def linked(spark, texts, keys):
    name = lambda k: f"{k:03d}".encode()
    docs = spark.createDataFrame([(name(k), t) for k, t in enumerate(texts)], "node binary, text string")
    sketches = spark.createDataFrame([(name(k), len(t.split()), keys[k]) for k, t in enumerate(texts)], "node binary, n int, keys array<bigint>")
    return [(bytes(x.a), bytes(x.b)) for x in near_dup.links(docs, sketches, 0.8).collect()]


def tops(pairs):
    up = {}

    def top(c):
        while up.get(c, c) != c:
            c = up[c]
        return c

    for a, b in pairs:
        up[top(a)] = top(b)
    return Counter(top(c) for c in {c for p in pairs for c in p})


def test_links_of_a_family_grow_with_its_members(spark):
    """Not with the square: 100 texts near each other had 4,950 candidates."""
    texts, keys = alike(random.Random(2), 100)
    texts[40:40] = [texts[-1] + " x"]  # so the centre is a member of a component of its own
    keys[40:40] = [[3]]
    got = linked(spark, texts, keys)
    large = [p for p in got if b"040" not in p]
    assert len(large) == len(set(large)) == 99 and len(got) == 100
    assert sorted(tops(got).values()) == [2, 100]


def test_members_of_one_centre_are_one_list_where_lists_of_words_would_be_more(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a row a word")

    monkeypatch.setattr(near_dup, "_first", never)
    assert sorted(tops(linked(spark, *alike(random.Random(3), 100))).values()) == [100]


@pytest.mark.parametrize("block,words", [(1, 1 << 16), (8, 1 << 16), (128, 300)])
def test_lists_and_blocks_of_any_size_find_the_same_classes(spark, monkeypatch, block, words):
    """Blocks of one text: lists of words. Others: all members of a centre, dealt by their number or their words."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "WORDS", words)
    ran = []
    first = near_dup._first
    monkeypatch.setattr(near_dup, "_first", lambda *a: ran.append(1) or first(*a))
    rows = partners(random.Random(9), 60, among=[f"w{k}" for k in range(400)])
    got = sorted((x.doc_id, x.class_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == classes(rows) and bool(ran) == (block == 1)


def test_connecting_links_are_a_forest_and_lose_no_component():
    r = random.Random(6)
    words = {f"{i}".encode(): np.array([k if r.random() < 0.9 else r.randrange(1000, 9999) for k in range(40 * (i % 3), 40 * (i % 3) + 40)], np.uint64) for i in range(30)}
    part = {n: n if i % 5 else b"0" if i % 3 == 0 else n for i, n in enumerate(words)}
    pairs = [(a, b) for a in words for b in words if a < b and part[a] != part[b]]
    got = near_dup.connecting(pairs, part, words, 0.8)
    near = [p for p in pairs if similarities([(words[p[0]], words[p[1]])], 0.8)[0]]
    same = [(n, part[n]) for n in words]
    assert sorted(tops([*same, *near]).values()) == sorted(tops([*same, *((a, b) for a, b, _ in got)]).values())
    assert len(got) < len(near) and len(got) == len(set(part.values())) - len(tops([*same, *near]))
