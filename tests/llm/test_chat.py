import random

from pyspark.sql import functions as F

from tidegrid.llm import chat


def test_round_trip_and_loss(spark):
    r = random.Random(8)
    bits = ("</s>", "<s>", "[TEXT]", "[INST] ok [/INST]", "&lt;", "&amp;", "&lsqb;", "é😀", "\n", " ", "a", "[IMAGE 0]", "&")
    rows = [(c, t, r.choice(("user", "assistant", "system", "a[b", None)), "".join(r.choice(bits) for _ in range(r.randrange(9))) if r.random() < 0.9 else None) for c in [*range(40), None] for t in range(r.randrange(1, 7))]
    rows += [(100, 1, "user", "x"), (100, 1, "user", "x"), (100, 1, "assistant", "y"), (100, None, "assistant", "z" * 9000)]
    df = spark.createDataFrame([(*x, "k") for x in r.sample(rows, len(rows))], "conv_id long, turn long, role string, text string, rows string")
    out = chat.format_chat(df)
    got = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {x.conv_id for x in got} == set(want)
    for x in got:
        assert [tuple(t) for t in x.turns] == want[x.conv_id] and x.n_turns == len(x.turns)
        assert x.loss == "".join(t for role, t in want[x.conv_id] if role == "assistant")
        assert x.formatted.count("</s>") == x.formatted.count("<s>") == x.formatted.count("[TEXT]") == x.n_turns
    assert chat.format_chat(df.limit(0)).count() == 0


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,amount:double>"
    rows = [
        (1, 0, "user", [("text", "see <b>", None, None), ("image", None, "a.png", 4.0), ("text", " and ", None, None), ("audio", None, "b.wav", 1.5)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None), ("odd", "plain[", None, None), None]),
        (1, 2, "user", None),
        (2, 0, "assistant", []),
    ]
    got = {x.conv_id: x for x in chat.format_chat(spark.createDataFrame(rows, f"conv_id int, turn int, role string, content array<{part}>"), content="content").collect()}
    assert got[1].formatted == "<s>user[TEXT]see &lt;b>[IMAGE 0] and [AUDIO 1]</s><s>assistant[TEXT][DOCUMENT 2]plain&lsqb;</s><s>user[TEXT]</s>"
    assert [tuple(a) for a in got[1].attachments] == [(0, "image", "a.png", 340), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 512)]
    s = got[1].loss_spans[0]
    assert got[1].formatted[s.start : s.end] == "[DOCUMENT 2]plain&lsqb;" and got[2].formatted == "<s>assistant[TEXT]</s>"
