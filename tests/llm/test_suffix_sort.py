import hashlib
import random
from collections import Counter

from tidegrid.llm.suffix_sort import remove_repeats


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdé ñ") for _ in range(n))
    shared, long = text(60), text(400)
    rows = [(1, None), (2, ""), (3, "x" * 300), (4, shared), (5, text(90) + shared + text(50)), (6, shared[5:] + text(20)), (7, long), (7, long), (8, long[:200] + "!" + long[201:])]
    rows += [(9, "ab " * 70), (None, long[50:150]), (10, text(19)), (11, text(10) + "ab " * 20)]
    rows += [(20 + i, text(r.randrange(60)) + shared + text(r.randrange(60))) for i in range(40)]
    return rows


def test_whole_digest_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "k", 5) for d, t in rows], "doc_id long, text string, key string, spans int")
    for length, block in ((40, 12), (20, 20), (33, 8)):
        got = []
        for x in remove_repeats(df, length=length, block=block).collect():
            spans = [(s["start"], s["end"]) for s in x.spans]
            got.append((x.doc_id, x.n_bytes, sum(e - s for s, e in spans), len(spans), hashlib.sha256(bytes(x.kept)).hexdigest()))
        assert sorted(got, key=str) == brute(rows, length)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
