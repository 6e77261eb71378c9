"""The queries and the pipeline themselves on the driver's smallest tables: contracts, SQL and plain Python."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidegrid.llm import queries

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(con):
    return {d: t or "" for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    out = con.execute(queries.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert got == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in out.fetchall())


def test_near_duplicates_by_plain_alignment(spark, docs):
    words = {d: lower(t).split() for d, t in docs.items()}
    up = {d: d for d in docs}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], min(before + (x != y), row[j] + 1, row[j + 1] + 1)
        return row[-1]

    bags = {d: Counter(w) for d, w in words.items()}
    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            size = max(len(words[a]), len(words[b]))
            same = docs[a] == docs[b]
            if same or size and sum((bags[a] & bags[b]).values()) >= 0.8 * size and distance(words[a], words[b]) <= 0.2 * size:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    got = {x.doc_id: x.class_id for x in queries.op1_order_minhash(spark, SF).collect()}
    assert got == {d: top(d) for d in docs}


def test_toxicity_contract(spark, docs):
    rows = queries.op2_string_kernel(spark, SF).collect()
    assert sorted(x.doc_id for x in rows) == sorted(docs)
    for x in rows:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
    score = {}
    assert all(score.setdefault(docs[x.doc_id], x.score) == x.score for x in rows)


def test_language_model_contract(spark, docs):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    split = {d: re.findall(WORD, lower(t)) for d, t in docs.items()}
    c = Counter(w for d, ws in split.items() if not held[d] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    for x in queries.op4_ppm(spark, SF).collect():
        ws = split[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1)))
        assert x.score < 0


def test_fingerprint_contract(spark, docs):
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    prints = {}
    for x in queries.op5_syncmers(spark, SF).collect():
        t, half = docs[x.doc_id], len(docs[x.doc_id]) // 2
        assert x.n_chars == len(t) and x.edited_sha256 == sha(t[: len(t) - half] + docs[after[x.doc_id]][:half])
        assert prints.setdefault(t, x.fingerprint) == x.fingerprint
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        a, b = set(x.fingerprint.split()), set(x.edited_fingerprint.split())
        assert x.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_substrings_by_brute_force(spark, docs):
    seen, whole = Counter(), {d: t.encode() for d, t in docs.items()}
    for b in whole.values():
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    rows = queries.op7_suffix_dedup(spark, SF).collect()
    assert len(rows) == len(docs)
    for x in rows:
        b = whole[x.doc_id]
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(b), sum(gone), spans, sha(kept))


def test_whitening_contract(spark):
    con = duckdb.connect()
    rows = con.execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.floor(1024 * np.array([r[1] for r in rows], float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    white = np.abs((x - s / n) @ vectors / np.sqrt(values))
    far = ((n * x - s) ** 2).sum(1)
    place = {r[0]: k for k, r in enumerate(rows)}
    out = queries.op13_whitening(spark, SF).collect()
    assert len(out) == 8 * n
    for o in out:
        k = place[o.vec_id]
        assert (o.n, o.deviation) == (n, far[k]) and abs(o.whitened) == pytest.approx(white[k, o.component - 1], abs=1e-6) and o.identity_error < 1e-9


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    shapes = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
              "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string",
              "embeddings": "vec_id long, embedding array<float>, label int"}
    for name, schema in shapes.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (name == "op10_chat"), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, ties, repeated rows, a very long text and columns of the operators' own names."""
    import corpus_pipeline

    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
    texts = [None, "", "one two three", "one two three", long, long + " end", "a\nb\nc\nd", "a\nb\nc\nd"]
    rows = [(i // 2 * 2 if i > 5 else i, t, "en", None if i == 3 else "s", len(t or ""), "t", "c", 1.5, "k", 7) for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s", 5, "t", "c", 1.5, "k", 7)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, Copy string, score double, key string, row int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "nothing of this stands in any text of the whole table")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert [c for c in out.columns if c not in ("copy", "_copy")] == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {x.text for x in docs.collect()}
    assert left >= {"one two three", "no id"} and len([t for t in left if t and len(t) > 1000]) == 1
