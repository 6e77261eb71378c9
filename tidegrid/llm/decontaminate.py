"""Benchmark decontamination by a prefix-filtered containment join of word windows.

A benchmark item is cut into windows of ``width`` consecutive words (an item of
fewer words is one window); a window occurs in a document if all its words stand
there side by side. Words are lower-cased runs of letters, digits and bytes
beyond ASCII.

The words of all items are counted in all documents. As a window must occur
whole, its rarest word is a prefix that any document holding it shares: documents
are joined to windows on that word alone. Its place in the window gives the only
place where the window can start (positional bound), which must leave room for
all of it (length bound); what is left is verified word by word under two
independent hashes of 64 bits.

Windows are dealt into blocks of at most about ``BLOCK`` and every block is
broadcast to one narrow pass over the documents, so what is broadcast never
grows with the benchmark and documents are never shuffled. Counts are summed in
the tasks first.

Cases: null and empty texts have no words, on either side; equal items are found
together; items without an id are found but not listed; equal rows have equal
results; an empty benchmark finds nothing; an empty table gives no rows; columns
of any name pass through as ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, hashed, merged, mix, pieces, ranges, spans

#: Windows (with their items) in one broadcast block: some 60 MB.
BLOCK = 400_000

#: Bytes of a word, after lower-casing: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _words(raw: np.ndarray, at: np.ndarray, pair: bool = True) -> tuple[np.ndarray, ...]:
    """A hash of every word, each document's first word, and another hash of every word."""
    low = LOWER[raw]
    begin, end, of = spans(WORD[low], at)
    return hashed(low, begin, end), of, hashed(low, begin, end, 1) if pair else begin[:0]


_WINDOW = "w1 long, w2 long, words array<long>, item_id string"


def _item_windows(width: int):
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("words", pa.list_(pa.int64())), ("item_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for low, high, raw, at in pieces(batch.column("text")):
                word, of, other = _words(raw, at)
                n = np.diff(of)
                size = np.minimum(n, width)
                counts = np.where(n > 0, n - size + 1, 0)
                start = ranges(of[:-1], counts)
                size = np.repeat(size, counts)
                offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                flat = word[ranges(start, size)].view(np.int64)
                who = np.repeat(np.arange(low, high), counts)
                one, two = _sequence(word, start, size), _sequence(other, start, size)
                yield pa.record_batch([one.view(np.int64), two.view(np.int64), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), ids.take(pa.array(who))], schema=schema)

    return run


def _sequence(word: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` words from each start on."""
    out = size.astype(np.uint64)
    for j in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > j)
        out[on] = mix(out[on] * np.uint64(0x9E3779B97F4A7C15) ^ word[start[on] + j])
    return out


def _count(vocabulary):
    """How often each word of a sorted vocabulary stands in the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, raw, at in pieces(batch.column("text")):
                word, _, _ = _words(raw, at, pair=False)
                place = np.minimum(np.searchsorted(known, word), len(known) - 1)
                total += np.bincount(place[known[place] == word], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["word", "n"])

    return run


def _find(index):
    """Adds a block's occurrences to the word spans ``hits`` and the ``items`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, offset, size, one, two, first, items = index.value
        keys, low_at = np.unique(token, return_index=True)
        runs = np.diff(np.concatenate((low_at, [len(token)])))
        for batch in batches:
            totals, hits, named = [], [], []
            for low, high, raw, at in pieces(batch.column("text")):
                word, of, other = _words(raw, at)
                place = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
                p = np.flatnonzero(keys[place] == word)
                owner = np.searchsorted(of, p, "right") - 1
                entry = ranges(low_at[place[p]], runs[place[p]])
                p, owner = np.repeat(p, runs[place[p]]), np.repeat(owner, runs[place[p]])
                start = p - offset[entry]
                fits = (start >= of[owner]) & (start + size[entry] <= of[owner + 1])
                start, entry, owner = start[fits], entry[fits], owner[fits]
                same = (_sequence(word, start, size[entry]) == one[entry]) & (_sequence(other, start, size[entry]) == two[entry])
                start, entry, owner = start[same], entry[same], owner[same]
                totals.append(np.diff(of))
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(high - low + 1))
                for i in range(high - low):
                    mine = order[bounds[i] : bounds[i + 1]]
                    s, e = merged(start[mine] - of[i], start[mine] - of[i] + size[entry[mine]])
                    hits.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                    named.append(sorted({items[x] for w in np.unique(entry[mine]).tolist() for x in range(first[w], first[w + 1])}))
            old_hits, old_items = batch.column("hits"), batch.column("items")
            if len(old_items.flatten()):
                named = [sorted({*a, *b}) for a, b in zip(old_items.to_pylist(), named, strict=True)]
            if len(old_hits.flatten()):
                hits = [_union(a + b) for a, b in zip(old_hits.to_pylist(), hits, strict=True)]
            n = np.concatenate(totals) if totals else np.empty(0, np.int64)
            out = {"n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, old_hits.type), "items": pa.array(named, old_items.type)}
            yield pa.record_batch([out.get(x, batch.column(x)) for x in batch.schema.names], names=batch.schema.names)

    return run


def _union(parts: list[dict]) -> list[dict]:
    s, e = merged(np.array([x["start"] for x in parts], np.int64), np.array([x["end"] for x in parts], np.int64))
    return [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block: int = BLOCK) -> DataFrame:
    """Per row: n_words, hits (disjoint spans of words inside windows), items (their ids as text, sorted), and the whole row as ``row``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    windows = items.mapInArrow(_item_windows(width), _WINDOW).distinct()
    n = windows.count()
    blocks = max(1, math.ceil(n / block))
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = own.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() AS array<struct<start:int,end:int>>)").alias("hits"), F.expr("cast(array() AS array<string>)").alias("items"))
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("w1", "item_id"), F.lit(blocks)) == b).collect() if n else []  # one block
        vocabulary = np.unique(np.array([w for r in rows for w in r["words"]] or [0], np.int64).view(np.uint64))
        counted = own.select("text").mapInArrow(_count(spark.sparkContext.broadcast(vocabulary)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        often = {r["word"]: r["n"] for r in counted.collect()} if rows else {}  # a row for each word of the block at most
        out = out.mapInArrow(_find(spark.sparkContext.broadcast(_index(rows, often))), out.schema)
    return out.drop("text")


def _index(rows: list, often: dict[int, int]) -> tuple:
    """Windows by their rarest word: word, its offset, size, hashes, and the slice of item ids of each."""
    by: dict[tuple, tuple] = {}
    for r in rows:
        entry = by.setdefault((r["w1"], r["w2"], len(r["words"])), (r["words"], set()))
        if r["item_id"] is not None:
            entry[1].add(r["item_id"])
    order = []
    for (one, two, size), (words, ids) in by.items():
        at = min(range(size), key=lambda i: (often.get(words[i], 0), words[i]))
        order.append((words[at] % (1 << 64), at, size, one % (1 << 64), two % (1 << 64), sorted(ids)))
    order = sorted(order, key=lambda x: x[:5]) or [(0, 0, 1, 0, 0, [])]
    token, offset, size, one, two, ids = zip(*order, strict=True)
    first = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).tolist()
    return np.array(token, np.uint64), np.array(offset), np.array(size), np.array(one, np.uint64), np.array(two, np.uint64), first, [y for x in ids for y in x]


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without any window; all columns as they were."""
    return find(docs, benchmark, text, **settings).where(F.size("hits") == 0).select("row.*")
