import random

from tidegrid.llm.line_windows import dedup_lines, without_repeats

SPACE = " \t\n\x0b\f\r"


def brute(rows, width=3):
    seen, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        numbered = [(n, x.strip(SPACE)) for n, x in enumerate((rows[i][1] or "").split("\n")) if x.strip(SPACE)]
        for at in range(len(numbered) - width + 1):
            window = tuple(x for _, x in numbered[at : at + width])
            if seen.setdefault(window, (i, at)) != (i, at):
                gone.setdefault(i, set()).update(n for n, _ in numbered[at : at + width])
    out = []
    for i, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        kept = "\n".join(x for n, x in enumerate(lines) if n not in gone.get(i, ())) if i in gone else t
        out.append((d, sum(bool(x.strip(SPACE)) for x in lines), len(gone.get(i, ())), kept))
    return sorted(out, key=str)


def test_rows_equal_brute_force(spark):
    r = random.Random(4)
    pool = ["eins", " zwei ", "drei\t", "vier", "fünf", "", "  ", "sechs\r"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(14)))) for i in range(60)]
    rows += [(None, "a\nb\nc\nd"), (100, "a\nb\nc\nd"), (101, None), (102, ""), (103, "x\ny"), (104, "q\nq\nq\nq\nq"), (105, "a\n\n b\nc"), (106, "p\n" * 2000 + "end")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, place int")
    got = [(x.doc_id, x.n_lines, x.n_removed, x.kept) for x in dedup_lines(df).collect()]
    assert sorted(got, key=str) == brute(rows)
    left = without_repeats(df)
    assert left.columns == df.columns and sorted((x.text or "" for x in left.collect()), key=str) == sorted((x[3] or "" for x in got), key=str)


def test_equal_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted(tuple(x) for x in dedup_lines(df).select("doc_id", "n_removed", "kept").collect()) == [(1, 0, "a\nb\nc"), (1, 0, "a\nb\nc"), (2, 3, "d")]
    assert dedup_lines(df.limit(0)).count() == 0
