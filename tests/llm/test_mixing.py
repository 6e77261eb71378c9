import random
import re
from fractions import Fraction

from tidegrid.llm.mixing import mix, repeat, targets


def level(sizes, weights, cap):
    """Water filling, a round at a time."""
    target, free, left = {}, set(sizes), Fraction(sum(sizes.values()))
    while True:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = Fraction(cap * sizes[s])
            free.discard(s)
            left -= target[s]


def test_targets_equal_water_filling(spark):
    r = random.Random(2)
    for _ in range(6):
        names = [*(f"s{i}" for i in range(r.randrange(2, 9))), None]
        sizes = {n: r.choice((0, 1, 7, 50, 1000, 90000)) for n in names}
        sizes[names[0]] += 1
        order = sorted(names, key=lambda n: (n is None, n or ""))
        weights = {n: (1, 2, 3)[i % 3] for i, n in enumerate(order)}
        got = {x.source: x.target for x in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = level(sizes, weights, 3)
        assert all(abs(got[n] - float(want[n])) <= 1e-9 * max(1, float(want[n])) for n in names), (sizes, got, want)


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(60))), r.choice("aaaaaab"), i % 5) for i in range(3000)]
    rows += [(9000, None, None, 1), (9001, "", "z", 2), (9002, "one  two x\n", None, 3), (9002, "one  two x\n", None, 3), (None, "four", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))
    for x in got:
        assert x.size == len(re.findall(r"[^\x20\x09-\x0D]+", x.row.text or "")) and 0 <= x.copies <= 3
    for s in ("a", "b"):
        own = [x for x in got if x.row.source == s]
        taken = sum(x.size * x.copies for x in own)
        assert abs(taken - own[0].target) <= 0.06 * own[0].target
    assert repeat(df).count() == sum(x.copies for x in got) and repeat(df).columns == [*df.columns, "copy"]
    assert mix(df.limit(0)).count() == 0 and repeat(df.limit(0)).count() == 0
