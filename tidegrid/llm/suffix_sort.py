"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``length`` bytes of a suffix are ever compared. The sort goes
from the most significant digit on, and each pass is a shuffle that keeps the
groups of two or more; a suffix alone in its group repeats nothing and leaves:

1. The first digit of a suffix is the *anchor block* inside its first
   ``length`` bytes: the leftmost ``block`` bytes of least hash. Equal strings
   have equal anchors at equal places, and neighbouring suffixes share theirs,
   so a run of suffixes travels as one row (about one row in 75 bytes).
2. The second digit is all bytes that a run's suffixes cover. Runs that agree
   in it are equal suffix by suffix and are done.
3. What is left (runs with a common anchor and different surroundings: the
   edges of shared passages, and one run of each group that pass 2 found equal)
   is cut into steps of up to ``STEP`` suffixes at fixed distances from the anchor.
   The third digit is the bytes that all suffixes of a step have in common: a
   step alone in them repeats nothing and leaves. Steps that agree in all bytes
   they cover are done, as in pass 2.
4. The rest, and one step of each group that pass 3 found equal, goes suffix by
   suffix through a last pass over all ``length`` bytes, under a 128-bit hash.

A sort by the first byte on would deal out a row for each byte, some ten times the
input; by anchors the same equal groups come of one row in 75 bytes.

Counts are aggregated before they are shuffled, and the joins back have a
unique, written right side, so where a passage is in a third of all documents
adaptive execution splits its rows.

Cases: a null text is empty; texts under ``length`` bytes have no suffix and
stay; exact copies cover each other, the first one too; two equal rows are two
documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import BYTE, Rolling, flat, hashed, lowest, merged, mix, pieces, ranges


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row by its content: equal rows share it, and everything else differs."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def _runs(length: int, block: int):
    schema = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for low, _, raw, at in pieces(batch.column("text")):
                counts = np.maximum(np.diff(at) - length + 1, 0)
                p = ranges(at[:-1], counts)
                if not len(p):
                    continue
                owner = np.repeat(np.arange(len(counts)), counts)
                roll = Rolling(BYTE[raw])
                h = roll.grams(block)
                a = lowest(h, length - block + 1)[p]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:] - 1, [len(p) - 1]))
                begin, anchor = p[first], a[first]
                ctx = roll.of(begin, p[last] + length, 1) ^ mix(anchor - begin)
                who = owner[first]
                yield pa.record_batch(
                    [h[anchor].view(np.int64), ctx.view(np.int64), keys[low + who], (begin - at[who]).astype(np.int32), (last - first + 1).astype(np.int32)],
                    schema=schema,
                )

    return run


#: Suffixes in a step of the third pass.
STEP = 8


def _steps(length: int, block: int):
    schema = pa.schema([("core", pa.int64()), ("cover", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            runs = batch.column("runs")
            bounds = np.asarray(runs.offsets)
            start, n = (runs.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n"))
            for low, high, raw, at in pieces(batch.column("text")):
                part = slice(bounds[low], bounds[high])
                who = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))
                roll = Rolling(BYTE[raw])
                begin = start[part] + at[who]
                away = lowest(roll.grams(block), length - block + 1)[begin] - begin  # the anchor's distance
                p, of = ranges(begin, n[part]), np.repeat(np.arange(len(begin)), n[part])
                step = (away[of] - (p - begin[of])) // STEP
                first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (step[1:] != step[:-1]))))
                many = np.diff(np.concatenate((first, [len(p)])))
                b, of, step = p[first], of[first], step[first]
                anchor = begin[of] + away[of]
                left = anchor - step * STEP  # the last suffix a step can hold, in this run or not
                core = roll.of(left, left - STEP + 1 + length, 3) ^ mix(step)
                cover = roll.of(b, b + many - 1 + length, 4) ^ mix(anchor - b)
                yield pa.record_batch([core.view(np.int64), cover.view(np.int64), keys[low + who[of]], (b - at[who[of]]).astype(np.int32), many.astype(np.int32)], schema=schema)

    return run


def _windows(length: int):
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("key", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            runs = batch.column("runs")
            bounds = np.asarray(runs.offsets)
            start, n = (runs.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n"))
            for low, high, raw, at in pieces(batch.column("text")):
                part = slice(bounds[low], bounds[high])
                who = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))
                p = ranges(start[part] + at[who], n[part])
                who = np.repeat(who, n[part])
                yield pa.record_batch(
                    [
                        Rolling(BYTE[raw]).of(p, p + length).view(np.int64),
                        hashed(raw, p, p + length, 2).view(np.int64),
                        keys[low + who],
                        (p - at[who]).astype(np.int32),
                    ],
                    schema=schema,
                )

    return run


def repeated_spans(docs: DataFrame, length: int = 200, block: int = 48) -> DataFrame:
    """(key, spans) of the rows of ``docs(key, text)`` in which some string of ``length`` bytes repeats."""
    runs = docs.mapInArrow(_runs(length, block), "h long, ctx long, key long, start int, n int")
    shared = runs.groupBy("h").agg(F.count("*").alias("c"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("c > 1")
    # What is looked up is written first: then a hot key is a plain join side, which adaptive execution splits.
    shared = written(shared.select("h", (F.col("lo") == F.col("hi")).alias("same")), "suffix-anchors", free=False)
    second = written(runs.join(shared, "h"), "suffix-runs")

    third = written(_told(second.where("NOT same"), "h", "ctx"), "suffix-rest")

    rest = third.where("sorted_on").groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    steps = docs.join(rest, "key").select("key", "text", "runs").mapInArrow(_steps(length, block), "core long, cover long, key long, start int, n int")
    twice = steps.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core")
    twice = written(twice, "suffix-cores", free=False)
    fourth = written(_told(written(steps.join(twice, "core"), "suffix-steps"), "core", "cover"), "suffix-steps-rest")

    rest = fourth.where("sorted_on").groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    windows = docs.join(rest, "key").select("key", "text", "runs").mapInArrow(_windows(length), "w1 long, w2 long, key long, start int")
    again = written(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2"), "suffix-repeats", free=False)

    end = (F.col("start") + F.col("n") - 1 + length).alias("end")
    return (
        second.where("same").select("key", "start", end)
        .unionByName(third.where("equal").select("key", "start", end))
        .unionByName(fourth.where("equal").select("key", "start", end))
        .unionByName(windows.join(again, ["w1", "w2"]).select("key", "start", (F.col("start") + length).alias("end")))
        .groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    )


def _told(rows: DataFrame, group: str, digit: str) -> DataFrame:
    """Of rows in one group: ``equal`` if others have its digit too, and ``sorted_on`` but for all but one of those."""
    equal = rows.groupBy(group, digit).agg(F.count("*").alias("c"), F.min(F.struct("key", "start")).alias("first")).where("c > 1")
    equal = written(equal, "suffix-equal", free=False)
    return rows.join(equal, [group, digit], "left").select(
        "key", "start", "n", F.col("c").isNotNull().alias("equal"), F.coalesce(F.col("first") == F.struct("key", "start"), F.lit(True)).alias("sorted_on")
    )


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each row's spans and take them out of its bytes."""
    for batch in batches:
        raw, at = flat(batch.column("text"))
        spans = batch.column("spans")
        bounds = np.asarray(spans.offsets)
        starts, ends = (spans.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "end"))
        taken, kept = [], []
        for i in range(len(batch)):
            s, e = merged(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])
            own = raw[at[i] : at[i + 1]]
            cuts = [0, *np.stack((s, e), 1).ravel().tolist(), len(own)]
            kept.append(b"".join(own[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            taken.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(taken, _CUT.field("spans").type), pa.array(kept, pa.binary())], schema=_CUT)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, block: int = 48) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (maximal removed byte ranges), kept (the other bytes).

    A byte goes if any string of ``length`` bytes over it also starts anywhere
    else, in this document or another; overlapping occurrences count, and
    strings are judged on the input.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", row_key())
    spans = repeated_spans(docs.select("key", "text"), length, block)
    whole = docs.join(spans, "key", "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    return whole.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
