"""Ranked lexical search: the documents that score highest for each item, by windowed bucket scoring.

*Terms* are the maximal runs of letters, digits and characters beyond ASCII,
only A-Z lower-cased. With ``n`` the number of a document's terms, N the documents
that have any, L all their terms and df the documents that hold a term, its weight is
``w = floor(1000 ln((2N + 2) / (2df + 1)))``, a document's length mark is
``m = 100 - 50 + (50 n N) div L``, and a document scores
``sum of w ((10**9 tf) div (1000 tf + 20 m))`` over an item's terms, once each, in
64-bit integers.

*Plan.* One pass over the texts keeps of each document its length and how often it
holds each of the items' terms. These postings are dealt out by fixed windows of
``WIDTH`` doc_ids and written; N, L and the terms' df are counted in them. In each
window they are turned into one list of places for each term, with what each adds to a
score and a bitset of the places. For an item the lists of its terms are scatter-added
into one array as wide as the window, the bitsets are joined, the occupied places are
harvested into the item's heap, and the places are cleared. A task returns its heaps,
which meet in two steps, so that no task sees more than some hundred of them.

What is broadcast is a block of items with about ``BLOCK`` pairs of item and term;
more items are ranked in more blocks. Each scans the texts again, which is little
beside the scoring of thousands of items. Terms are compared by two independent
64-bit hashes (the first tells a block's terms apart).

Cases: null texts and texts without terms are in no count and no result; items
without terms give no rows; rows with equal item_id are one item with the terms of
all; rows with equal doc_id are documents of their own and may take a rank each; a
null doc_id comes after others of equal score, a null item_id is an item; empty
tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .text import LOWER, hashed, pieces, spans

#: doc_ids of a window, and places of the array that scores are added in (8 KB).
WIDTH = 1024
#: Windows that documents without a doc_id are dealt to.
LOOSE = 4096
#: Pairs of item and term of a block, about: what is broadcast of the items at once.
BLOCK = 1 << 18
#: Groups of tasks whose heaps meet first.
GROUPS = 64

#: Bytes of terms: digits, letters, and all of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, byte starts and ends of terms, and each text's first term."""
    begin, end, of = spans(TERM[raw], at)
    return LOWER[raw], begin, end, of


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, t1, t2): the hashes of each text's terms, once each."""
    for batch in batches:
        for low, high, raw, at in pieces(batch.column("text")):
            lower, begin, end, of = _terms(raw, at)
            who = np.repeat(np.arange(low, high), np.diff(of))
            pair = np.unique(np.stack([who.astype(np.uint64), hashed(lower, begin, end), hashed(lower, begin, end, 1)], 1), axis=0)
            yield pa.record_batch([batch.column("item_id").take(pa.array(pair[:, 0].astype(np.int64))), pair[:, 1].view(np.int64), pair[:, 2].view(np.int64)], names=["item_id", "t1", "t2"])


def _postings(t1: np.ndarray, t2: np.ndarray):
    """Of each document with terms: its length, its terms among those of rising hash ``t1`` (with ``t2``), by place there, and their numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, raw, at in pieces(batch.column("text")):
                lower, begin, end, of = _terms(raw, at)
                n = np.diff(of)
                value = hashed(lower, begin, end)
                place = np.minimum(np.searchsorted(t1, value), len(t1) - 1)
                hit = np.flatnonzero(t1[place] == value)
                who = np.repeat(np.arange(len(n)), n)[hit]
                pair, first, tf = np.unique(who * len(t1) + place[hit], return_index=True, return_counts=True)
                who, place = pair // len(t1), pair % len(t1)
                same = hashed(lower, begin[hit][first], end[hit][first], 1) == t2[place]
                full = np.flatnonzero(n)
                ends = np.concatenate((np.searchsorted(who[same], full), [same.sum()])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[same].astype(np.int32))) for x in (place, tf)]
                yield pa.record_batch([batch.column("doc_id").take(pa.array(low + full)), pa.array(n[full]), *lists], schema=schema)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each window, of ``WIDTH`` at most, as one batch; windows come one after the other."""
    held: list[pa.RecordBatch] = []
    last, rows = None, 0
    for batch in batches:
        window = batch.column("window").to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(window)) + 1, [len(window)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            while a < b:
                if held and (window[a] != last or rows == WIDTH):
                    yield pa.concat_batches(held)
                    held, rows = [], 0
                step = min(b - a, WIDTH - rows)
                held.append(batch.slice(a, step))
                last, rows, a = window[a], rows + step, a + step
    if held:
        yield pa.concat_batches(held)


def _ranked(items: list[tuple[int | None, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, top: int):
    """The ``top`` best documents of each item among the postings of a task."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in items]
        score = np.zeros(WIDTH, np.int64)
        for block in _windows(batches):
            ids = block.column("doc_id").to_pylist()
            mark = 100 - 50 + 50 * block.column("n").to_numpy() * n_docs // n_terms
            lists = block.column("terms")
            term, tf = (block.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            slot = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
            order = np.argsort(term, kind="stable")
            term, slot, tf = term[order], slot[order], tf[order]
            adds = weight[term] * (10**9 * tf // (1000 * tf + 20 * mark[slot]))
            here, start = np.unique(term, return_index=True)
            row = np.full(len(weight), -1)
            row[here] = np.arange(len(here))
            ends = [*start.tolist(), len(term)]
            places = np.zeros((len(here), WIDTH), bool)
            places[row[term], slot] = True
            bits = np.packbits(places, axis=1).view(np.uint64)
            for heap, (_, asked) in zip(heaps, items, strict=True):
                rows = row[asked]
                rows = rows[rows >= 0]
                if not len(rows):
                    continue
                for r in rows.tolist():
                    part = slice(ends[r], ends[r + 1])
                    score[slot[part]] += adds[part]
                occupied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[rows], axis=0).view(np.uint8)))
                got = score[occupied]
                score[occupied] = 0
                least = max(1, heap[0][0] if len(heap) == top else 0)
                good = np.flatnonzero(got >= least)
                if len(good) > top:  # those that tie with the last of the best stay
                    good = good[got[good] >= np.partition(got[good], -top)[-top]]
                for s, k in zip(got[good].tolist(), occupied[good].tolist(), strict=True):
                    entry = (s, ids[k] is not None, -(ids[k] or 0))
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
        for heap, (item, _) in zip(heaps, items, strict=True):
            if heap:
                s, real, doc = zip(*heap, strict=True)
                yield pa.record_batch([pa.array([item] * len(heap), pa.int64()), pa.array([-d if r else None for d, r in zip(doc, real, strict=True)], pa.int64()), pa.array(s, pa.int64())], schema=schema)

    return run


def _block(docs: DataFrame, asked: DataFrame, top: int) -> DataFrame | None:
    """The best documents of each task for one block of items, None for no items."""
    got = asked.toArrow()  # bounded by BLOCK
    if not len(got):
        return None
    t1, t2 = (got.column(c).to_numpy().view(np.uint64) for c in ("t1", "t2"))
    vocabulary, first = np.unique(t1, return_index=True)
    terms: dict[int | None, list[int]] = {}
    for item, place in zip(got.column("item_id").to_pylist(), np.searchsorted(vocabulary, t1).tolist(), strict=True):
        terms.setdefault(item, []).append(place)
    rows = docs.mapInArrow(_postings(vocabulary, t2[first]), "doc_id long, n long, terms array<int>, tfs array<int>")
    rows = rows.withColumn("window", F.coalesce(F.shiftright("doc_id", WIDTH.bit_length() - 1), -1 - F.pmod(F.xxhash64("n", "terms"), F.lit(LOOSE))))
    rows = written(rows.repartition("window").sortWithinPartitions("window", "doc_id"), "postings")
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row a term
    df = np.zeros(len(vocabulary))
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    items = [(item, np.array(places)) for item, places in terms.items()]
    return rows.mapInArrow(_ranked(items, weight, n_docs, n_terms or 1, top), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item, ranks from 1 by falling score, then rising doc_id."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    asked = written(own.mapInArrow(_asked, "item_id long, t1 long, t2 long").distinct(), "asked", free=False)
    many = -(-asked.count() // block)
    if not many:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    blocks = [_block(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == k), top) for k in range(many)]
    best = reduce(DataFrame.unionByName, [b for b in blocks if b is not None])
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    first = Window.partitionBy("item_id", "part").orderBy(*order)
    best = best.withColumn("part", F.spark_partition_id() % GROUPS).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    last = Window.partitionBy("item_id").orderBy(*order)
    return best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
