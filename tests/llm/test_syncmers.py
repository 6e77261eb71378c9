import random
import re

from pyspark.sql import functions as F

from tidegrid.llm import syncmers


def test_anchors_by_definition_and_neighbours(spark):
    r = random.Random(9)
    texts = ["".join(r.choice(("ab ", "c\t", "dé\n", "ef ", "g", "😀")) for _ in range(r.randrange(0, 60))) for _ in range(60)]
    rows = [(i * 3 % 61, t) for i, t in enumerate(texts)] + [(7, "ties a b c d e f"), (7, "ties a b c d e f"), (None, None), (99, ""), (98, "x " * 3000)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, range int, anchors string")
    got = syncmers.compared(df).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, [-ord(c) for c in x[1] or ""] + [9]), reverse=True)
    order = [(d, t or "") for d, t in order]
    want = []
    for i, (d, t) in enumerate(order):
        n = len(t) // 2
        want.append((d, t, t[: len(t) - n] + order[(i + 1) % len(order)][1][:n]))
    assert sorted(((x.doc_id, x.text, x.edited) for x in got), key=str) == sorted(want, key=str)

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    every = sorted({w for x in got for w in words(x.text) + words(x.edited)})
    h = {x.w: x.h for x in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {(h[a], h[b]) for x in got for t in (x.text, x.edited) for a, b in zip(words(t), words(t)[1:], strict=False)}
    p = {(x.a, x.b): x.h for x in spark.createDataFrame(list(pairs), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    for x in got:
        for t, anchors in ((x.text, x.anchors), (x.edited, x.edited_anchors)):
            w = [h[a] for a in words(t)]
            inner = [p[a, b] for a, b in zip(w, w[1:], strict=False)]
            closed = [i for i in range(len(w) - 4) if min(inner[i : i + 4]) in (inner[i], inner[i + 3])]
            assert len(anchors) == max(len(closed), 1 if w else 0)
            if closed:
                seen = {}
                for i, a in zip(closed, anchors, strict=True):
                    assert seen.setdefault((inner[i], inner[i + 2], w[i + 4]), a) == a
                assert len(set(seen.values())) == len(seen)
    by = {}
    for x in got:
        assert by.setdefault(x.text, x.anchors) == x.anchors


def test_likeness_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p", "q"), (2, "a b c d e f g h i j k l m n o z", "r"), (3, None, "s")], "doc_id long, text string, row string")
    out = syncmers.fingerprints(df)
    assert out.columns == ["doc_id", "text", "row", "fingerprint"] and [x.fingerprint for x in out.where("doc_id = 3").collect()] == [""]
    both = syncmers.with_anchors(df.where("doc_id < 3").select("doc_id", "text"), a="text").alias("x")
    near = both.crossJoin(both.withColumnRenamed("a", "b").select("b", F.col("doc_id").alias("other"))).select(F.col("doc_id") == F.col("other"), syncmers.likeness(F.col("a"), F.col("b"))).collect()
    assert all((n == 1.0) == same and 0 < n <= 1 for same, n in near)
    assert syncmers.compared(df.limit(0)).count() == 0 and syncmers.compared(df.limit(1)).count() == 1
