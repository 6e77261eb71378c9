"""Language-model scores by prediction by partial matching (PPM) over bytes.

*Text.* A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), each
followed by one space, and an end symbol; a context at the beginning is made of
end symbols. A score is the log10 probability of all of it, so it accumulates a
code length: ``-score * log2(10)`` bits. Every document is scored by the same
pretrained model, so scores do not depend on order or partitions.

*Training.* The bytes that follow each context of ``order`` bytes are counted in
all training documents, summed in the tasks before the shuffle; shorter contexts
are sums of longer ones. Contexts with at least one in ``NODES`` of all training
bytes (at most ``NODES`` of each length) are the trie that is broadcast; nodes
keep everything that follows them. All others stay in tables (``deep``): bytes
after a context that the trie lacks are looked up there, each different one once
for ``CHUNK`` bytes of text, so every counted context is used and nothing that is
collected grows with the corpus. Without those tables the trie is the model.

*Prediction.* A byte that followed the longest context has probability
``c / (T + q)`` (T: occurrences, q: different bytes); otherwise the escape
``q / (T + q)`` leads to the next shorter context, in which all bytes that
followed the longer one are excluded, from c, T and q alike; beyond the empty
context, the remaining bytes are equally likely. As what follows a context also
follows each shorter one, the exclusion depends on the last context only, and
all of it can be worked out once for each node and byte.

*Unigram baseline.* ``scores`` also sums ``log10((c + 1) / (N + V + 1))`` over the
words and one end of each text, from word counts of all training documents.
Words with at least one in ``FREQUENT`` of all tokens are broadcast (at most
``FREQUENT`` of them); the others are joined.

Cases: a null or empty text is the end symbol alone; without training documents
all bytes are equally likely; equal texts have equal scores, equal rows equal
results; null ids are ids; an empty table gives no rows; other columns are not
read or pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from ..session import written
from .text import LOWER, hashed, pieces, ranges, words

#: A node of the broadcast trie has one in so many of all training bytes at least.
NODES = 1 << 18
#: A word is frequent from one in so many of all training tokens on.
FREQUENT = 1 << 23
#: Bytes of text that look up what the trie lacks together.
CHUNK = 1 << 23
END, GAP = 0x0A, 0x20


def symbols(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as the model reads them, ``order`` end symbols before each; offsets of what precedes each."""
    begin, end, of = words(raw, at)
    docs = len(at) - 1
    # A word and the gap after it are an entry; marks at both ends of a text are entries without a word.
    start = np.insert(begin, np.concatenate((np.repeat(of[:-1], order), of[1:])), np.zeros(docs * (order + 1), np.int64))
    size = np.insert(end - begin, np.concatenate((np.repeat(of[:-1], order), of[1:])), np.zeros(docs * (order + 1), np.int64))
    n = np.diff(of) + order + 1
    entry = np.concatenate(([0], np.cumsum(n)))
    first = np.concatenate(([0], np.cumsum(size + 1)))
    flat = np.append(LOWER[raw], np.uint8(0))[ranges(start, size + 1)] if len(size) else np.empty(0, np.uint8)
    flat[first[1:] - 1] = GAP
    marks = ranges(entry[:-1], np.full(docs, order))
    flat[first[marks]] = END
    flat[first[entry[1:]] - 1] = END
    return flat, first[entry]


def _counts(order: int):
    """Rows (kind, key, n): 0 for ``order + 1`` bytes, 1 for words, 2 for ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, at in pieces(batch.column("text"), 1 << 21):
                flat, block = symbols(raw, at, order)
                key = np.zeros(len(flat), np.uint64)
                for j in range(order + 1):
                    key[j:] |= flat[: len(flat) - j].astype(np.uint64) << np.uint64(8 * j)
                real = np.ones(len(flat), bool)
                real[ranges(block[:-1], np.full(len(block) - 1, order))] = False
                begin, end, _ = words(raw, at)
                for kind, keys in ((0, key[real]), (1, hashed(LOWER[raw], begin, end))):
                    k, n = np.unique(keys, return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])
                yield pa.record_batch([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([high - low], pa.int64())], names=["kind", "key", "n"])

    return run


def count(docs: DataFrame, text: str = "text", order: int = 5) -> DataFrame:
    """Counts (kind, key, n) of all training documents, written."""
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(own.mapInArrow(_counts(order), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


class Model:
    """The trie as dense tables: the longer node from a node and the byte before it, and log10 of each byte after a node."""

    def __init__(self, order: int, index: np.ndarray, width: int, child: np.ndarray, logs: np.ndarray):
        self.order, self.index, self.width, self.child, self.logs = order, index, width, child, logs

    def state(self) -> tuple:
        """What makes the model, without its code."""
        return self.order, self.index, self.width, self.child, self.logs

    def of_symbols(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each symbol after those before it, and whether the trie lacks the longest context."""
        s = self.index[flat]
        node = np.zeros(len(s), np.int32)
        top = node.copy()
        dead = len(self.child) // self.width - 1
        for j in range(1, self.order + 1):
            node[j:] = self.child.take(node[j:] * np.int32(self.width) + s[:-j])
            np.copyto(top, node, where=node != dead)
        return self.logs.take(top * np.int32(self.width) + s), node == dead

    def of_documents(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        flat, block = symbols(raw, at, self.order)
        logs = self.of_symbols(flat)[0].astype(np.float64)
        logs[ranges(block[:-1], np.full(len(block) - 1, self.order))] = 0
        return np.add.reduceat(logs, block[:-1]) if len(block) > 1 else np.empty(0)

    def open_documents(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over what follows the trie's longest contexts; document and ``order + 1`` bytes of every other place."""
        flat, block = symbols(raw, at, self.order)
        logs, lacks = self.of_symbols(flat)
        logs, marks = logs.astype(np.float64), ranges(block[:-1], np.full(len(block) - 1, self.order))
        lacks[marks] = False
        logs[marks] = 0
        places = np.flatnonzero(lacks)
        logs[places] = 0
        grams = np.zeros(len(places), np.uint64)
        for j in range(self.order + 1):
            grams |= flat[places - j].astype(np.uint64) << np.uint64(8 * j)
        sums = np.add.reduceat(logs, block[:-1]) if len(block) > 1 else np.empty(0)
        return sums, np.searchsorted(block, places, "right") - 1, grams


def _model(order: int, level: np.ndarray, edge: np.ndarray, n: np.ndarray) -> Model:
    """Tables from the counts of bytes (lowest 8 bits of ``edge``) after the kept contexts of each length."""
    seen = np.unique(edge[level == 0].astype(np.int64))
    a = len(seen)
    index = np.full(256, a, np.int32)
    index[seen] = np.arange(a)
    logs, links, total = [], [], 0
    up: tuple | None = None
    for k in range(order + 1):
        mine = level == k
        ctx, row = np.unique(edge[mine] >> np.uint64(8), return_inverse=True)
        if k and not len(ctx):
            break
        c = np.zeros((max(len(ctx), 1), a + 1))
        c[row, index[(edge[mine] & np.uint64(255)).astype(np.int64)]] = n[mine]
        t, q = c.sum(1), (c > 0).sum(1)
        if up is None:
            rest = np.full(c.shape, 1 / (256 - a) if a < 256 else 0.0)
        else:
            above, c1, t1, q1, rest1 = up
            p = np.searchsorted(above, ctx & np.uint64((1 << 8 * (k - 1)) - 1)) if k > 1 else np.zeros(len(ctx), np.int64)
            links.append((p, index[(ctx >> np.uint64(8 * (k - 1))).astype(np.int64)]))
            own = c > 0
            left = t1[p] - (c1[p] * own).sum(1)
            below = np.maximum(left + q1[p] - q, 1e-9)[:, None]
            rest = np.where(c1[p] > 0, c1[p] / below, (q1[p] - q)[:, None] / below * rest1[p])
            rest = np.where((left <= 0)[:, None], rest1[p], rest)
        sum_ = np.maximum(t + q, 1e-9)[:, None]
        prob = np.where(c > 0, c / sum_, np.where((t > 0)[:, None], q[:, None] / sum_, 1.0) * rest)
        logs.append(np.log10(np.maximum(prob, 1e-300)).astype(np.float32))
        up = (ctx, c, t, q, rest)
        total += len(c)
    child = np.full((total + 1, a + 1), total, np.int32)
    at, over = 0, 0
    for k, (p, byte) in enumerate(links):
        over = at + len(logs[k])
        child[at + p, byte] = over + np.arange(len(p))
        at = over
    return Model(order, index, a + 1, child.ravel(), np.concatenate(logs).ravel())


def edges(counts: DataFrame, order: int = 5) -> DataFrame:
    """Counts (level, edge, n) of bytes after all contexts of each length, written."""
    grams = counts.where("kind = 0").select("key", "n")
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("edge")) for k in range(order + 1)]))
    return written(grams.select(levels.alias("e"), "n").groupBy("e.level", "e.edge").agg(F.sum("n").alias("n")), "edges")


def fit(counts: DataFrame, order: int = 5, nodes: int = NODES, tree: DataFrame | None = None) -> Model:
    """The trie of the contexts with one in ``nodes`` of ``count``'s bytes, which bounds what is collected; ``tree`` is ``edges``' table."""
    every = counts.where("kind = 0").agg(F.sum("n")).head()[0] or 0
    tree = edges(counts, order) if tree is None else tree
    ctx = F.shiftright("edge", 8).alias("ctx")
    kept = tree.groupBy("level", ctx).agg(F.sum("n").alias("all")).where((F.col("level") == 0) | (F.col("all") * nodes >= every)).select("level", "ctx")
    out = tree.select("*", ctx).join(kept, ["level", "ctx"]).select("level", "edge", "n").toArrow()
    level, edge, n = (out.column(c).to_numpy() for c in ("level", "edge", "n"))
    return _model(order, level, edge.astype(np.int64).view(np.uint64), n.astype(np.float64))


class Deep:
    """All contexts as tables: what is known of each, and the bytes that follow the longest ones with their log10."""

    def __init__(self, tree: DataFrame, order: int = 5, nodes: int = NODES):
        every = tree.where("level = 0").agg(F.sum("n")).head()[0] or 0
        ctx = F.shiftright("edge", 8).alias("ctx")
        upper = tree.select((F.col("level") + 1).alias("level"), F.col("edge").alias("up"), F.col("n").alias("n_up"))
        mask = F.expr("shiftleft(1L, 8 * level) - 1")
        with_upper = tree.select("*", ctx, F.col("edge").bitwiseAND(mask).alias("up")).join(upper, ["level", "up"], "left")
        # Of each context: occurrences, different bytes, and how often those follow the next shorter context.
        self.contexts = written(with_upper.groupBy("level", "ctx").agg(F.sum("n").alias("t"), F.count("*").alias("q"), F.coalesce(F.sum("n_up"), F.lit(0)).alias("gone")), "contexts")
        self.tree, self.order = tree, order
        rare = self.contexts.where((F.col("level") == order) & (F.col("t") * nodes < every)).select("ctx", "t", "q")
        followers = tree.where(F.col("level") == order).select("edge", "n", ctx)
        self.seen = followers.join(rare, "ctx").select(F.col("edge").alias("gram"), F.log10(F.col("n") / (F.col("t") + F.col("q"))).alias("log"))

    def unseen(self, grams: DataFrame) -> DataFrame:
        """(gram, log) of different ``grams(gram)`` that no training document holds."""
        levels = range(self.order + 1)
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("edge")) for k in levels]))
        rows = grams.select("gram", each.alias("e")).select("gram", "e.*").withColumn("ctx", F.shiftright("edge", 8))
        rows = rows.join(self.contexts, ["level", "ctx"]).join(self.tree, ["level", "edge"], "left")
        of = rows.groupBy("gram").agg(*[F.coalesce(F.max(F.when(F.col("level") == k, F.col(c))), F.lit(0)).cast("double").alias(f"{c}{k}") for c in ("t", "q", "gone", "n") for k in levels])
        return grams.join(of, "gram", "left").mapInArrow(_escapes(self.order), "gram long, log double")


def _escapes(order: int):
    """log10 of bytes from what is known of their context of each length: occurrences, different bytes, excluded ones and the byte's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, q, gone, c = ([np.nan_to_num(batch.column(f"{x}{k}").to_numpy(zero_copy_only=False).astype(float)) for k in range(order + 1)] for x in ("t", "q", "gone", "n"))
            p, met, done = np.ones(batch.num_rows), np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for k in range(order, -1, -1):
                # The first context that occurs excludes nothing; a shorter one what followed the longer one.
                left = np.where(met, t[k] - (gone[k + 1] if k < order else 0), t[k])
                new = np.where(met, q[k] - (q[k + 1] if k < order else 0), q[k])
                own = np.where(c[k] > 0, c[k], new)
                here = ~done & (left > 0)
                p[here] *= own[here] / (left + new)[here]
                done |= here & (c[k] > 0)
                met |= t[k] > 0
            p[~done] /= 256 - q[0][~done]
            yield pa.record_batch([batch.column("gram"), pa.array(np.log10(p))], names=["gram", "log"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "log10_probability") -> DataFrame:
    """``docs`` with one more column, the log10 probability of each text; a column of its name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Model(*shared.value)
        for batch in batches:
            out = [trie.of_documents(raw, at) for _, _, raw, at in pieces(batch.column("row").field(text))]
            yield pa.record_batch([batch.column("row"), pa.array(np.concatenate(out) if out else np.empty(0))], names=["row", "score"])

    own = docs.select(F.struct("*").alias("row"))
    same = [c for c in docs.columns if c.lower() != name.lower()]
    out = own.mapInArrow(run, StructType([*own.schema.fields, StructField("score", DoubleType())]))
    return out.select(*[F.col("row")[c].alias(c) for c in same], F.col("score").alias(name))


def _by_word(batch: pa.RecordBatch, known: np.ndarray) -> Iterator[tuple]:
    """Of each piece: rows, words and owners of its different (document, word) pairs, how often, and where ``known`` has the word."""
    for low, high, raw, at in pieces(batch.column("text")):
        begin, end, of = words(raw, at)
        word = hashed(LOWER[raw], begin, end)
        owner = np.repeat(np.arange(high - low), np.diff(of))
        place = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
        found = known[place] == word if len(known) else np.zeros(len(word), bool)
        yield low, high, np.diff(of), word, owner, place, found


def _near(shared, model):
    """PPM scores, and the frequent words' part of the unigram ones; texts stay behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value, end = shared.value
        trie = Model(*model.value)
        for batch in batches:
            scores = [trie.of_documents(raw, at) for _, _, raw, at in pieces(batch.column("text"))]
            scores, rest = np.concatenate(scores) if scores else np.empty(0), batch.drop_columns(["text"])
            for low, high, n, _, owner, place, found in _by_word(batch, known):
                sums = np.bincount(owner[found], value[place[found]], minlength=high - low) + end
                many = np.bincount(owner[found], minlength=high - low)
                new = [pa.array(x) for x in (n, many, sums, scores[low:high])]
                yield pa.record_batch([*(c[low:high] for c in rest.columns), *new], names=[*rest.schema.names, "n_words", "many", "sums", "score"])

    return run


def _open(shared, model):
    """As ``_near``, but what the trie lacks stays open: each document's places in its chunk's list of bytes to look up, which the first one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value, end = shared.value
        trie = Model(*model.value)
        chunk, size, rows = TaskContext.get().partitionId() << 32, 0, 0
        parts, owners, grams = [], [], []

        def closed() -> pa.Table:
            different, place = np.unique(np.concatenate(grams), return_inverse=True)
            owner = np.concatenate(owners)
            order = np.lexsort((place, owner))
            place, of = place[order], np.searchsorted(owner, np.arange(rows + 1))
            step = np.diff(place, prepend=0)
            starts = of[:-1][np.diff(of) > 0]
            step[starts] = place[starts]
            # Steps by byte of significance: most of the upper ones are zero.
            step = step.astype("<u4").view(np.uint8).reshape(-1, 4)
            places = [step[a:b].T.tobytes() for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(rows, len(different))).astype(np.int32)), pa.array(different.view(np.int64)))
            return pa.Table.from_batches(parts).append_column("chunk", pa.array(np.full(rows, chunk))).append_column("places", pa.array(places, pa.binary())).append_column("grams", lists)

        for batch in batches:
            rest = batch.drop_columns(["text"])
            for (low, high, raw, at), (_, _, n, _, owner, place, found) in zip(pieces(batch.column("text")), _by_word(batch, known), strict=True):
                scores, of, gram = trie.open_documents(raw, at)
                sums = np.bincount(owner[found], value[place[found]], minlength=high - low) + end
                many = np.bincount(owner[found], minlength=high - low)
                new = [pa.array(x) for x in (n, many, sums, scores)]
                parts.append(pa.record_batch([*(c[low:high] for c in rest.columns), *new], names=[*rest.schema.names, "n_words", "many", "sums", "score"]))
                owners.append(rows + of)
                grams.append(gram)
                size, rows = size + len(raw), rows + high - low
                if size >= CHUNK:
                    yield from closed().to_batches()
                    chunk, size, rows = chunk + 1, 0, 0
                    parts, owners, grams = [], [], []
        if parts:
            yield from closed().to_batches()

    return run


def _closed(names: list[str]):
    """Adds what a chunk has looked up to its documents' scores."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        place = found.column("place").to_numpy()
        logs = np.zeros(int(place.max(initial=-1)) + 1)
        logs[place] = found.column("log").to_numpy()
        more = []
        for each in rows.column("places").to_pylist():
            step = np.ascontiguousarray(np.frombuffer(each, np.uint8).reshape(4, -1).T).view("<u4").ravel()
            more.append(logs[np.cumsum(step, dtype=np.int64)].sum())
        score = rows.column("score").to_numpy() + np.array(more)
        return rows.select(names[:-1]).append_column("score", pa.array(score))

    return run


def _looked_up(asking: DataFrame, deep: Deep, fields: list[StructField]) -> DataFrame:
    """The documents of ``_open`` with whole scores."""
    rows = written(asking, "asking")
    asked = rows.where(F.size("grams") > 0).select("chunk", F.posexplode("grams").alias("place", "gram"))
    # Both sides grow with the corpus, so neither is broadcast.
    met = asked.join(deep.seen.hint("merge"), "gram", "left").select("chunk", "place", F.col("log").cast("float").alias("log"), F.when(F.col("log").isNull(), F.col("gram")).alias("gram"))
    met = written(met, "looked-up")
    open_ = met.where("log is null")
    other = written(deep.unseen(open_.select("gram").distinct()), "unseen")
    found = met.where("log is not null").select("chunk", "place", "log").unionByName(open_.select("chunk", "place", "gram").join(other.hint("merge"), "gram").select("chunk", "place", F.col("log").cast("float").alias("log")))
    names = [x.name for x in fields]
    return rows.drop("grams").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_closed(names), StructType(fields))


def _rare(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _, _ = shared.value
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for low, _, _, word, owner, _, found in _by_word(batch, known):
                word, owner = word[~found], owner[~found]
                order = np.lexsort((word, owner))
                word, owner = word[order], owner[order]
                new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])))) if len(word) else np.empty(0, np.int64)
                n = np.diff(np.concatenate((new, [len(word)])))
                yield pa.record_batch([pa.array(word[new].view(np.int64)), pa.array(keys[low + owner[new]]), pa.array(n.astype(np.int32))], names=["word", "key", "n"])

    return run


def scores(docs: DataFrame, counts: DataFrame, model: Model, text: str = "text", frequent: int = FREQUENT, deep: Deep | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens, n_known, train_tokens, base_score and score; by all contexts if ``deep`` is given."""
    known = counts.where("kind = 1").select(F.col("key").alias("word"), F.col("n").alias("c"))
    n_words, v = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    ends = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    total, bottom = n_words + ends, float(n_words + ends + v + (ends > 0) + 1)
    often = known.where(F.col("c") * frequent >= total).toArrow()
    word, c = (often.column(x).to_numpy().astype(np.int64) for x in ("word", "c"))
    order = np.argsort(word.view(np.uint64))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((word.view(np.uint64)[order], np.log10((c[order] + 1) / bottom), float(np.log10((ends + 1) / bottom))))

    others = [x for x in docs.columns if x != text]
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(*[F.col(x).alias(f"own_{x}") for x in others], F.xxhash64(*[F.col(x) for x in others], body).alias("key"), body.alias("text"))
    keyed = own.select("key", "text")
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    rare = keyed.mapInArrow(_rare(shared), "word long, key long, n int")
    less = known.where(F.col("c") * frequent < total)
    each = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(bottom))
    sums = rare.join(less, "word", "left").groupBy("key").agg(F.sum(each).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("met"))
    sums = sums.join(copies, "key", "left").select("key", (F.col("rest") / F.coalesce("copies", F.lit(1))).alias("rest"), F.expr("met div coalesce(copies, 1)").alias("met"))
    new = [StructField("n_words", LongType()), StructField("many", LongType()), StructField("sums", DoubleType()), StructField("score", DoubleType())]
    fields, trie = [*own.schema.fields[:-1], *new], context.broadcast(model.state())
    if deep is None:
        near = own.mapInArrow(_near(shared, trie), StructType(fields))
    else:
        kinds = [StructField("chunk", LongType()), StructField("places", BinaryType()), StructField("grams", ArrayType(LongType()))]
        near = _looked_up(own.mapInArrow(_open(shared, trie), StructType([*fields, *kinds])), deep, fields)
    return near.join(sums, "key", "left").select(
        *[F.col(f"own_{x}").alias(x) for x in others],
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("many") + F.coalesce("met", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether the CRC-32 of the id as text falls into the part that is not trained on; a null id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
