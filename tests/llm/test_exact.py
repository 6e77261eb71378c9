"""Polynomial fingerprints against whole numbers, groups of equal texts against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from tidegrid.llm import exact


def plain(data, point):
    lanes = [int.from_bytes(data[i : i + exact.LANE], "little") for i in range(0, len(data), exact.LANE)]
    return sum(v * pow(point, k, exact.PRIME) for k, v in enumerate(lanes)) % exact.PRIME


def flat(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def test_fingerprints_are_polynomials():
    r = random.Random(1)
    texts = [b"", b"a", b"\0" * 8, b"\xff" * 7, b"\xff" * 50_000] + [bytes(r.randrange(256) for _ in range(r.choice([6, 7, 8, 30, 3000]))) for _ in range(60)]
    raw, at = flat(texts)
    for point in exact.POINTS:
        want = [plain(t, point) for t in texts]
        for chunk in (7, 70, exact.CHUNK):
            assert exact.fingerprint(raw, at, point, chunk).tolist() == want


def test_products_of_large_numbers():
    r = random.Random(2)
    a, b = ([r.choice([0, 1, exact.PRIME - 1, r.randrange(exact.PRIME)]) for _ in range(500)] for _ in range(2))
    got = exact.product(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [x * y % exact.PRIME for x, y in zip(a, b, strict=True)]


def test_parts_on_any_tasks_compose(spark):
    r = random.Random(3)
    docs = {k: bytes(r.randrange(256) for _ in range(n)) for k, n in enumerate([0, 5, 700, 701, 9000])}
    parts = [(k, i // 700, bytearray(b[i : i + 700])) for k, b in docs.items() for i in range(0, max(len(b), 1), 700)]
    r.shuffle(parts)
    rows = exact.of_parts(spark.createDataFrame(parts, "doc_id long, place int, text binary").repartition(4)).collect()
    assert {x.doc_id: (x.n_bytes, x.f1, x.f2) for x in rows} == {k: (len(b), *(plain(b, p) for p in exact.POINTS)) for k, b in docs.items()}


LONG = "naïve text " * 200_000
ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (5, "a"), (None, "c"), (None, "c"), (None, "b"), (7, LONG), (8, LONG), (9, LONG + "."), (10, "A"), (11, "a ")] + [(100 + k, "copy") for k in range(500)]


def expected(rows):
    out, by = [], {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    for t, ds in by.items():
        top = max((d for d in ds if d is not None), default=None)
        kept = True
        for d in ds:
            out.append((d, top, len(ds), d == top and kept, hashlib.sha256(t.encode()).hexdigest()))
            kept &= d != top
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, f1 string, copies int")


def got(df):
    return sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in df.collect()), key=str)


def test_groups_of_equal_texts(spark):
    assert got(exact.exact_duplicates(frame(spark, ROWS))) == expected(ROWS)
    assert exact.exact_duplicates(frame(spark, [])).collect() == []


def test_texts_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    """With points at which all texts of one length collide in pairs, only the comparison can tell."""
    monkeypatch.setattr(exact, "POINTS", (0, 0))  # the polynomial is its first lane
    rows = [(k, "same head " + "xyz"[k % 3] * 20_000) for k in range(12)] + [(20, "same head"), (21, "same head"), (None, "same head " + "x" * 20_000)]
    assert got(exact.exact_duplicates(frame(spark, rows))) == expected(rows)


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(d, t) for d, t in ROWS if d is not None]
    out = exact.distinct_texts(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "f1", "copies"]
    left = {x.text or "": x.doc_id for x in out.collect()}
    assert left == {t or "": max(d for d, u in rows if (u or "") == (t or "")) for _, t in rows} and out.count() == len(left)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filter_passes_all_it_holds(spark, n):
    prints = spark.range(n).selectExpr("id * 7919 as f1")
    words = exact._filter(prints)
    at = np.arange(n) * 7919 % (len(words) * 64)
    assert (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all() and len(words) * 64 <= exact.BITS
