import random
import re

from tidegrid.llm.decontaminate import clean, find


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def data():
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(("ab", "Ba", "cé", "d9", "the,", "The", "É", "_x")) for _ in range(n))
    items = [(i, text(r.choice((3, 9, 10, 11, 25, 40)))) for i in range(40)] + [(50, None), (51, ""), (52, "?!"), (None, text(15)), (53, "ab ba"), (54, "ab ba")]
    docs = [(i, text(r.randrange(80)) + " " + (r.choice(items)[1] or "") + "; " + text(r.randrange(80))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, items[3][1].upper()), (103, "AB-ba"), (103, "AB-ba"), (104, "b" * 50000)]
    return docs, items


def test_rows_equal_brute_force_in_one_block_and_in_many(spark):
    docs, items = data()
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, hits int, items string")
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, w1 int")
    want = brute(docs, items)
    for block in (400_000, 200):
        got = find(df, bench, block=block).collect()
        assert sorted(((x.row.doc_id, x.n_words, sum(h.end - h.start for h in x["hits"]), x["items"]) for x in got), key=str) == want
    left = clean(df, bench)
    assert left.columns == df.columns and sorted((x.doc_id for x in left.collect()), key=str) == sorted((x[0] for x in want if not x[2]), key=str)


def test_empty_tables(spark):
    docs, items = data()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert clean(df, bench.limit(0)).count() == len(docs) and find(df.limit(0), bench).count() == 0
