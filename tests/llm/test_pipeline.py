import random

import corpus_pipeline
from tidegrid.llm import mixing


def write(spark, at, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(12)
    word = lambda: "".join(r.choice(("la", "mi", "ro", "ten", "su", "ka")) for _ in range(r.randrange(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = ["\n".join(line(9) for _ in range(r.randrange(3, 8))) for _ in range(160)]
    toxic, shared, item = set(range(0, 160, 4)), "\n".join(line(7) for _ in range(3)), line(12)
    for i in toxic:
        w = texts[i].split(" ")
        w[5:5] = [r.choice(("grobian", "wicht", "schuft"))] * 2
        texts[i] = " ".join(w)
    repeated, copied, leaked = (9, 17, 21), (30, 31), (50, 51, 53)
    for i in repeated:
        texts[i] += "\n" + shared
    texts[31] = texts[30].replace("\n", " ")  # other lines, same words
    for i in leaked:
        texts[i] += "\nx " + item.upper() + " y"
    docs = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)] + [(900, None, "en", None, 0), (901, "", "en", "a", 0)]
    write(spark, tmp_path, docs, [(i, 1, int(i in toxic)) for i in range(160)], [(1, item)])
    left, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        left.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({x.doc_id: x.text for x in left.collect()})
        assert set(left.columns) - {"copy"} == {"doc_id", "text", "lang", "source", "n_chars"}
    clean = {i for i, *_ in docs} - toxic
    assert set(seen[0]) == clean
    want = {i: t for i, t, *_ in docs if i in clean}
    for i in repeated[1:]:
        want[i] = want[i].removesuffix("\n" + shared)
    assert seen[1] == want
    del want[31], want[901]
    assert seen[2] == want
    for i in leaked:
        del want[i]
    assert seen[3] == want
    mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/decontamination"), seed=1).collect()
    got = {}
    for x in left.collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + 1
    assert got == {x.doc_id: x.copies for x in mixed if x.copies}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(got.values())
