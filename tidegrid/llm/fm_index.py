"""Substring dedup with a compressed FM-index per shard.

A window is ``width`` consecutive words of one document. It is removed, with all
words it covers, if the same words also start in a document of smaller id.

*Shards.* An index is only searched for what can stand in it. Each window is
named by its anchor, the ``block`` words of least hash in it; equal windows have
equal anchors, and neighbours mostly share theirs, so a run of windows travels as
one segment. Anchors of one document only repeat nothing and stay at home; the
segments of the others, each different one once with the least id it stands in,
are dealt to shards by anchor. An anchor with more than ``HOT`` segments (the
edges of a passage in very many documents) deals its windows one by one instead,
by the hash of the window. So work follows the corpus, not shards times corpus,
and a shard is of bounded size.

*Index.* A shard's segments are joined, sorted by suffix, and kept as the
Burrows-Wheeler transform in a wavelet matrix: one bit vector for each bit of a
word's rank among the shard's words, with counts for each 64 bits. All segments
are streamed through it: backward search goes left from the end of every window
at once, word by word, and gives its matching statistic, the number of words (up
to ``width``) that stand elsewhere in the shard too. A search whose interval has
shrunk to one suffix matches only itself and ends. Places whose statistic reaches
``width`` are reported; the least id in their interval is told to every document
that has the segment.

Segments travel with the bytes of their words, and a shard ranks its words by
these bytes, so two windows are equal only if all their words
(``[^\\x20\\x09-\\x0D]+``, unchanged) are; hashes only deal work out. Windows of
an anchor over ``HOT`` stand alone in their shard: there the fold of equal segments
has found the least id, and the index confirms that nothing else matches.

Cases: a null or empty text has no words; a null doc_id is smaller than all
others; equal ids are no smaller than each other, so copies of a row keep or lose
the same; a window repeated in one document only stays; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import Rolling, flat, hashed, lowest, merged, pieces, ranges, words

#: Words in a shard, about, and segments of one anchor from which on its windows go singly.
SHARD, HOT = 400_000, 4_000


def _hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    begin, end, of = words(raw, at)
    return hashed(raw, begin, end), begin, end, of


def _segments(width: int, block: int):
    """Runs of windows of one anchor: its hash, the document, and first window * 256 + windows."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
            for low, _, raw, at in pieces(batch.column("text")):
                word, _, _, of = _hashes(raw, at)
                counts = np.maximum(np.diff(of) - width + 1, 0)
                p = ranges(of[:-1], counts)
                if not len(p):
                    continue
                owner = np.repeat(np.arange(len(counts)), counts)
                grams = Rolling(word).grams(block)
                anchor = lowest(grams, width - block + 1)[p]
                first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
                n = np.diff(np.concatenate((first, [len(p)])))
                who = owner[first]
                h = (grams[anchor[first]] >> np.uint64(16)).view(np.int64)  # 48 bits: chance equals only cost a search
                yield pa.record_batch([h, ids[low + who], keys[low + who], (p[first] - of[who]) * 256 + n], schema=schema)

    return run


def _joined(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, a space after each, and the offsets of groups of ``size`` words."""
    n = end - begin + 1
    flat_ = np.append(raw, np.uint8(0))[ranges(begin, n)]
    at = np.concatenate(([0], np.cumsum(n)))
    flat_[at[1:] - 1] = 0x20
    return flat_, at[np.concatenate(([0], np.cumsum(size)))]


#: Words of segments put together at once.
_BATCH = 200_000


def _cut_out(width: int):
    """The chosen segments of each text: what they are dealt by, two hashes of their words, the words, and where they stand."""
    schema = pa.schema([("d", pa.int64()), ("g", pa.int64()), ("s", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
            chosen = batch.column("chosen")
            bounds = np.asarray(chosen.offsets)
            packed, anchor, hot = (chosen.values.field(f).to_numpy(zero_copy_only=False) for f in ("at", "h", "hot"))
            for low, high, raw, at in pieces(batch.column("text")):
                begin, end, of = words(raw, at)
                part = slice(bounds[low], bounds[high])
                who = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))
                start, n, single = packed[part] // 256, packed[part] % 256, hot[part]
                many = np.where(single, n, 1)  # a hot anchor's windows one by one
                start, who = ranges(start, many), np.repeat(who, many)
                size = np.repeat(np.where(single, 1, n), many) + width - 1
                deal, single = np.repeat(anchor[part], many), np.repeat(single, many)
                step = max(1, _BATCH // (256 + width))
                for i in range(0, len(size), step):
                    now = slice(i, i + step)
                    which = ranges(of[who[now]] + start[now], size[now])
                    body, offsets = _joined(raw, begin[which], end[which], size[now])
                    g, s = (hashed(body, offsets[:-1], offsets[1:], salt).view(np.int64) for salt in (1, 2))
                    d = np.where(single[now], g, deal[now])
                    text = pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
                    yield pa.record_batch([pa.array(d), pa.array(g), pa.array(s), ids[low + who[now]], keys[low + who[now]], start[now].astype(np.int32), text], schema=schema)

    return run


def _ranked(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, the same only for equal bytes."""
    _, first, rank = np.unique(hashed(raw, begin, end), return_index=True, return_inverse=True)
    n, other = end - begin, begin[first[rank]]
    same = n == (end - begin)[first[rank]]
    if same.all() and np.array_equal(raw[ranges(begin, n)], raw[ranges(other, n)]):
        return rank
    body, seen = raw.tobytes(), {}  # two words of one hash: number the bytes themselves
    return np.array([seen.setdefault(body[a:b], len(seen)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of a sequence of small integers, 0 being the end mark."""

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        rank, step = text.astype(np.uint64), 1
        while True:  # prefix doubling
            after = np.zeros(n, np.uint64)
            after[: max(n - step, 0)] = rank[step:] + np.uint64(1)
            both = rank << np.uint64(32) | after
            order = np.argsort(both)
            new = np.concatenate(([0], np.cumsum(both[order][1:] != both[order][:-1])))
            rank[order] = new.astype(np.uint64)
            if new[-1] == n - 1:
                break
            step *= 2
        self.suffix = order
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.bits = max(1, int(text.max()).bit_length())
        level, self.zeros = text[order - 1], []
        size = n // 64 + 2
        self.packed, self.before = np.zeros((self.bits, size), np.uint64), np.zeros((self.bits, size), np.int32)
        for b in range(self.bits):
            bit = (level >> (self.bits - 1 - b)) & 1
            padded = np.zeros(size * 64, np.uint8)
            padded[:n] = bit
            self.packed[b] = np.packbits(padded, bitorder="little").view(np.uint64)
            self.before[b, 1:] = np.cumsum(np.bitwise_count(self.packed[b]).astype(np.int32))[:-1]
            self.zeros.append(n - int(bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.base = self._down(np.arange(int(text.max()) + 1), np.zeros(int(text.max()) + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b in range(self.bits):
            block = at >> 6
            ones = self.before[b].take(block) + np.bitwise_count(self.packed[b].take(block) & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.bits - 1 - b)) & 1 == 1, self.zeros[b] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self._down(symbol, at) - self.base[symbol]

    def matching(self, text: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the ``width`` places of ``text`` from each start: how many of the last ones stand elsewhere too, and their suffix intervals.

        Intervals are those of the whole width where the statistic reaches it.
        """
        length, lows, highs = (np.zeros(len(start), np.int64) for _ in range(3))
        live = np.arange(len(start))
        c = text[start + width - 1]
        low, high = self.first[c], self.first[c + 1]
        for t in range(width - 2, -1, -1):
            go = high - low > 1
            live, low, high = live[go], low[go], high[go]
            length[live] += 1
            c = text[start[live] + t]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
        go = high - low > 1
        length[live[go]] += 1
        lows[live], highs[live] = low, high
        return length, lows, highs


def _searched(width: int):
    """For each segment of a shard, the least id of any document each of its windows stands in."""

    def run(group: pa.Table) -> pa.Table:
        raw, at = flat(group.column("words"))
        raw = raw[at[0] : at[-1]]
        end = np.flatnonzero(raw == 0x20)  # no word holds one
        n = np.diff(np.searchsorted(end, at - at[0]))
        ranked = _ranked(raw, np.concatenate(([0], end[:-1] + 1)), end)
        # Segments side by side, an end mark after each.
        begin = np.concatenate(([0], np.cumsum(n + 1)))
        text = np.zeros(int(begin[-1]), np.int64)
        text[ranges(begin[:-1], n)] = ranked + 1
        index = FMIndex(text)
        counts = n - width + 1
        start = ranges(begin[:-1], counts)
        ids = group.column("doc_id").to_numpy()
        least = np.repeat(ids, counts)
        length, low, high = index.matching(text, start, width)
        found = np.flatnonzero(length >= width)
        if len(found):
            low, high = low[found], high[found]
            of_suffix = np.repeat(ids, n + 1)[index.suffix]
            low, which = np.unique(low, return_inverse=True)
            ends = np.empty(len(low), np.int64)
            ends[which] = high
            cuts = np.stack((low, ends), 1).ravel()
            least[found] = np.minimum.reduceat(np.append(of_suffix, np.iinfo(np.int64).max), cuts)[::2][which]
        # Only segments that some document has to lose words of are told.
        told = np.flatnonzero(np.minimum.reduceat(least, np.cumsum(counts) - counts) < group.column("last").to_numpy())
        least = least[ranges((np.cumsum(counts) - counts)[told], counts[told])]
        offsets = np.concatenate(([0], np.cumsum(counts[told]))).astype(np.int32)
        pick = pa.array(told)
        return pa.table({"g": group.column("g").take(pick), "s": group.column("s").take(pick), "least": pa.ListArray.from_arrays(pa.array(offsets), pa.array(least))})

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _without(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            bounds, place = np.asarray(hits.offsets), hits.values.to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column("doc_id")
            total, gone, kept, spans = [], [], [], []
            for low, high, raw, at in pieces(batch.column("text")):
                begin, end, of = words(raw, at)
                body = raw.tobytes()
                for i in range(high - low):
                    s = place[bounds[low + i] : bounds[low + i + 1]]
                    s, e = merged(s, s + width)
                    stay = np.ones(of[i + 1] - of[i], bool)
                    stay[ranges(s, e - s)] = False
                    left = np.flatnonzero(stay) + of[i]
                    total.append(len(stay))
                    gone.append(len(stay) - len(left))
                    kept.append(b" ".join([body[a:b] for a, b in zip(begin[left].tolist(), end[left].tolist(), strict=True)]).decode())
                    spans.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
            yield pa.record_batch([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, _KEPT.field("spans").type)], schema=_KEPT)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 13, block: int = 4, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the other words, one space between), spans (removed ranges of words)."""
    least = -(1 << 63)
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(least)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("key", F.xxhash64("doc_id", "text"))
    runs = own.mapInArrow(_segments(width, block), "h long, doc_id long, key long, at long")
    anchors = runs.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("c")).where("a < b")
    anchors = written(anchors.select("h", (F.col("c") > hot).alias("hot")), "anchors")
    chosen = runs.join(anchors, "h").groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "h", "hot")).alias("chosen"))
    chosen = written(chosen, "chosen")
    size = chosen.select(F.aggregate("chosen", F.lit(0).cast("long"), lambda n, x: n + x["at"] % 256 + (width - 1)).alias("n")).agg(F.sum("n")).head()[0] or 0
    shards = max(1, math.ceil(size / shard))

    cut = own.join(chosen, ["doc_id", "key"]).select("doc_id", "key", "text", "chosen").mapInArrow(_cut_out(width), "d long, g long, s long, doc_id long, key long, start int, words binary")
    once = cut.select(F.pmod("d", F.lit(shards)).cast("int").alias("shard"), "g", "s", "words", "doc_id").groupBy("shard", "g", "s", "words").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    once = written(once, "folded")  # the texts' shuffle goes before that of the shards comes
    found = once.groupBy("shard").applyInArrow(_searched(width), "g long, s long, least array<long>")
    found = written(found, "found")
    hit = cut.select("g", "s", "doc_id", "key", "start").join(found, ["g", "s"])
    places = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    by_key = hit.select("doc_id", "key", places.alias("places")).where(F.size("places") > 0).groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("hits"))
    by_key = written(by_key, "hits")  # before the texts are shuffled once more
    whole = own.join(by_key, ["doc_id", "key"], "left").select("doc_id", "text", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"))
    out = whole.mapInArrow(_without(width), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
