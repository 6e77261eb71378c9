"""Near-duplicate classes by Order MinHash over five-word shingles and banded alignment.

*Similarity* of two texts is the edit similarity of their words
(``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased): ``1 - edits / max(n, m)``, edits being
insertions, deletions and replacements of words; near is 0.8 or more.

*Sketches.* A text is the sequence of its five-word shingles (a text of fewer
words is one), each labelled with its occurrence number. A sketch takes the
``ell`` shingles of least hash under one of ``bands`` hash functions and keeps
them *in text order*; its key is the hash of that sequence. Texts that share a
key are candidates. At a Jaccard index j of shingles a key is shared with chance
about ``j**ell``: of pairs at j = 0.4 (every eleventh word replaced) 32 keys of
two miss 4 in 1,000, at 0.6 one in a million; edits that stand together break
fewer shingles. In texts of up to ``SHORT`` words few edits break all shingles, so
these have keys of three single words too.

*Verification.* Words are aligned in a band around the diagonal that is widened
until the distance fits into it or passes the threshold; many pairs are aligned
side by side. Texts of over 32 words are cut at shingles that stand once in both and
their parts aligned first; if that shows them near, it is the similarity told (a
lower bound).

*Keys that many share.* A text is compared with the centre of its largest key, the
member that shares most keys, first; then with those of its other keys that it is not connected
with by then; of a key of up to ``SMALL`` all others too, unless they
are connected. A larger key's members, all that have its centre together, go through
an exact filter instead, where they are not connected already: near texts share at least
``max(n, m) - edits`` words, so if all texts' words are put in one order, the first
``floor(n / 5) + 1`` of two near texts have one in common, whatever the order is. It is the one from words that few of
the texts have to those that many have, by counts of ``BUCKETS`` classes of words. Members of one list, of the same centre and word,
are dealt to blocks of about ``BLOCK`` and those blocks compared that may hold members of several components, by two bytes of each
word first (words that are alike by chance only add candidates). Where that makes fewer copies of a member than
its lists would, all members of a centre are one list. Candidates are aligned where they meet, the likeliest first,
and not if links have connected them by then: two blocks tell fewer links than they have members. So no partner is lost
that a text has a key in common with. How much work that is depends on the size of a family, the answer does not.

*Classes* are the connected components of verified links over distinct texts;
exact copies are folded first and join their text's class.

Cases: null is the empty text; a text without words is a class of its own with
its exact copies; rows with equal doc_id keep their
own texts and classes; an empty table gives no rows; columns of any name pass
through ``representatives`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .text import LOWER, Rolling, hashed, mix, pieces, ranges, words

#: Words up to which a text has keys of single words too.
SHORT = 50
#: Texts of one key up to which all of them are compared with each other.
SMALL = 32
#: Texts of a block of a longer list, and their words (about).
BLOCK, WORDS = 128, 1 << 16
#: Classes of words, by the first two bytes of their hashes, that are counted for the order of words.
BUCKETS = 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' words, and each document's first one."""
    begin, end, of = words(raw, at)
    return hashed(LOWER[raw], begin, end), of


def shingles(word: np.ndarray, of: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' word k-grams in order, and each document's first one."""
    n = np.diff(of)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    start = ranges(of[:-1], counts)
    width = np.repeat(np.minimum(n, k), counts)
    return Rolling(word).of(start, start + width), np.concatenate(([0], np.cumsum(counts)))


def labelled(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Values together with their occurrence numbers in their documents."""
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    return mix(values + occurrences(values, owner).astype(np.uint64) * _ODD)


def occurrences(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each value stood before in its document."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    out = np.empty(len(v), np.int64)
    out[order] = np.arange(len(v)) - first
    return out


def sketch(labelled: np.ndarray, owner: np.ndarray, of: np.ndarray, seed: int, ell: int) -> np.ndarray:
    """One key a document: the hash of its ``ell`` shingles of least hash, in text order."""
    m, s = mix(np.array([2 * seed + 1, 2 * seed + 2], np.uint64))
    x = (labelled ^ s) * (m | np.uint64(1))
    n = np.diff(of)
    want = np.minimum(n, ell)
    # Few can be among the least: look at those below a bound, raised where it was too low.
    bound = np.where(n > 8 * ell, 2.0**64 * 4 * ell / np.maximum(n, 1), 2.0**64)
    while True:
        full = bound >= 2.0**64
        limit = np.where(full, 2.0**63, bound).astype(np.uint64)
        near = np.flatnonzero((x < limit[owner]) | full[owner])
        got = np.bincount(owner[near], minlength=len(n))
        if not (low := got < want).any():
            break
        bound = np.where(low, 2.0**64, bound)
    order = near[np.lexsort((x[near], owner[near]))]
    begin = np.concatenate(([0], np.cumsum(got)))[:-1]
    chosen = np.sort(order[ranges(begin, want)])  # of a document side by side, so in text order
    ends = np.concatenate(([0], np.cumsum(want)))
    return Rolling(labelled[chosen]).of(ends[:-1], ends[1:], seed + 1)


def _table(values: np.ndarray, of: np.ndarray, seeds: range, ell: int) -> np.ndarray:
    """A key of each document under each seed."""
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    return np.stack([sketch(values, owner, of, seed, ell) for seed in seeds], 1)


def _sketches(k: int, bands: int, ell: int, short_bands: int):
    schema = pa.schema([("node", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, at in pieces(batch.column("text")):
                word, first = tokens(raw, at)
                n = np.diff(first)
                gram, of = shingles(word, first, k)
                table = np.zeros((len(n), bands + short_bands), np.uint64)
                table[:, :bands] = _table(labelled(gram, of), of, range(bands), ell)
                few = np.flatnonzero(n <= SHORT)
                if len(few):
                    part, ends = word[ranges(first[few], n[few])], np.concatenate(([0], np.cumsum(n[few])))
                    table[few, bands:] = _table(labelled(part, ends), ends, range(1000, 1000 + short_bands), 3)
                has = np.empty(table.shape, bool)
                has[:, :bands], has[:, bands:] = (n > 0)[:, None], (n <= SHORT)[:, None] & (n > 0)[:, None]
                offsets = np.concatenate(([0], np.cumsum(has.sum(1)))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(table[has].view(np.int64)))
                rows = slice(low, high)
                yield pa.record_batch([batch.column("node")[rows], batch.column("doc_id")[rows], pa.array(n.astype(np.int32)), keys], schema=schema)

    return run


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Edit distances of sequences (the first not longer), right where they are up to ``k``; others are more than ``k``."""
    size, more = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    rows, width = int(size.max()), 2 * k + 1
    a = np.zeros((len(pairs), rows), np.uint64)
    b = np.zeros((len(pairs), rows + width), np.uint64)
    for p, (x, y) in enumerate(pairs):
        a[p, : len(x)] = x
        y = y[: rows + k + 1]
        b[p, k : k + len(y)] = y
    far = np.int32(1 << 29)
    step = np.arange(width, dtype=np.int32)
    row = np.broadcast_to(np.where(step >= k, step - k, far), (len(pairs), width)).astype(np.int32)
    out = np.full(len(pairs), far)
    at = more - size + k  # the last column of each pair, as a diagonal
    done = (size == 0) & (at < width)
    out[done] = row[done, at[done]]
    order = np.argsort(size, kind="stable")
    ends = np.searchsorted(size[order], np.arange(rows + 2))
    for i in range(1, rows + 1):
        new = row + (b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new -= step
        np.minimum.accumulate(new, axis=1, out=new)
        row = new + step
        here = order[ends[i] : ends[i + 1]]
        here = here[at[here] < width]
        out[here] = row[here, at[here]]
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two multisets."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def _least(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: an edit changes one word and breaks two neighbours' pairs at most."""
    size = max(len(a), len(b))
    bound = size - _shared(a, b)
    if min(len(a), len(b)) > 1:
        pair = lambda x: x[:-1] * _ODD ^ x[1:]
        bound = max(bound, -(-(size - 1 - _shared(pair(a), pair(b))) // 2))
    return bound


def _between(a: np.ndarray, b: np.ndarray, k: int = 5, most: int = 2000) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """An upper bound of the edit distance of two sequences: k-grams that stand once in both, in a long common order, are kept; a number of
    edits, and the parts between that are still to be aligned. Parts of over ``most`` words count as replaced."""
    grams = []
    for x in (a, b):
        value, first, count = np.unique(Rolling(x).grams(k), return_index=True, return_counts=True)
        grams.append((value[count == 1], first[count == 1]))
    _, i, j = np.intersect1d(grams[0][0], grams[1][0], assume_unique=True, return_indices=True)
    p, q = grams[0][1][i], grams[1][1][j]
    order = np.argsort(p)
    p, q = p[order], q[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(q) != 1)))) if len(p) else np.empty(0, np.int64)
    size = np.diff(np.append(new, len(p)))
    p, q = p[new], q[new]
    end_p, end_q = p + size + k - 1, q + size + k - 1  # runs of words that are the same
    best, back = size.astype(np.int64), np.full(len(p), -1)
    for n in range(1, len(p)):
        near = slice(max(0, n - 400), n)
        fits = np.where((end_q[near] <= q[n]) & (end_p[near] <= p[n]), best[near], 0)
        if len(fits) and (m := int(fits.argmax())) >= 0 and fits[m]:
            best[n] += fits[m]
            back[n] = near.start + m
    chain, n = [], int(best.argmax()) if len(best) else -1
    while n >= 0:
        chain.append(n)
        n = int(back[n])
    total, gaps, x, y = 0, [], 0, 0
    for u, v, e, f in [(p[n], q[n], end_p[n], end_q[n]) for n in chain[::-1]] + [(len(a), len(b), len(a), len(b))]:
        one, two = a[x:u], b[y:v]
        if len(one) and len(two) and max(len(one), len(two)) <= most:
            gaps.append((one, two))
        else:
            total += max(len(one), len(two))
        x, y = e, f
    return int(total), gaps


def edits(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray, cells: int = 1 << 18, exact: int = 32) -> np.ndarray:
    """Edit distance of each pair of sequences, or -1 where it is over its ``most``; of those of over ``exact`` words an upper bound, if it is enough."""
    out, open_, between = np.full(len(pairs), -1), {}, {}
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        low = len(a)
        differ = np.flatnonzero(a != b[:low])
        head = int(differ[0]) if len(differ) else low
        a, b, low = a[head:], b[head:], low - head
        differ = np.flatnonzero(a[::-1] != b[::-1][:low])
        tail = int(differ[0]) if len(differ) else low
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a):
            out[i] = len(b) if len(b) <= most[i] else -1
        elif (least := 0 if most[i] >= len(b) else _least(a, b)) <= most[i]:
            open_[i] = (a, b, least)
            if len(b) > exact:
                total, gaps = _between(a, b)
                between[i] = (total, len(parts), len(parts) + len(gaps))
                parts += gaps
    if between:
        sums = np.concatenate(([0], np.cumsum(edits(parts, np.array([max(len(x), len(y)) for x, y in parts], np.int64), cells, 1 << 62))))
        for i, (total, low, high) in between.items():
            if (bound := int(total + sums[high] - sums[low])) <= most[i]:
                out[i] = bound
                del open_[i]
    k = 8
    while open_:
        by_size = sorted((i for i in open_ if open_[i][2] <= k), key=lambda i: len(open_[i][0]))
        while by_size:
            longest = len(open_[by_size[-1]][0]) + 2 * k + 1
            take = by_size[-max(1, cells // longest) :]
            del by_size[-len(take) :]
            for i, d in zip(take, _banded([open_[i][:2] for i in take], k).tolist(), strict=True):
                if d <= k or k >= most[i]:
                    out[i] = d if d <= min(k, most[i]) else -1
                    del open_[i]
        k *= 4
    return out


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """``1 - edits / max(n, m)`` of each pair of word sequences if it reaches ``threshold``, else 0."""
    size = np.array([max(len(a), len(b), 1) for a, b in pairs], np.int64).reshape(-1)
    d = edits(pairs, np.floor(size * (1 - threshold) + 1e-9).astype(np.int64))
    return np.where(d < 0, 0.0, 1 - d / size)


def _verified(threshold: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for low, high, raw, at in pieces(batch.column("text_a")):
                one, of = tokens(raw, at)
                for l2, h2, raw2, at2 in pieces(batch.column("text_b")[low:high]):
                    two, of2 = tokens(raw2, at2)
                    score.append(similarities([(one[of[i] : of[i + 1]], two[of2[i - l2] : of2[i - l2 + 1]]) for i in range(l2, h2)], threshold))
            score = np.concatenate(score) if score else np.empty(0)
            at = pa.array(np.flatnonzero(score))
            yield pa.record_batch([batch.column("a").take(at), batch.column("b").take(at), pa.array(score[score > 0])], schema=schema)

    return run


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text with their occurrence numbers; ``brief`` holds two bytes of each one's hash, ``word`` the words alone."""
    for batch in batches:
        for low, high, raw, at in pieces(batch.column("text")):
            word, of = tokens(raw, at)
            own = labelled(word, of)
            bags = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(own.view(np.int64)))
            brief = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((2 * of).astype(np.int32)), pa.py_buffer((own >> np.uint64(48)).astype(np.uint16))])
            plain = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((8 * of).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(word))])
            yield pa.record_batch([batch.column("node")[low:high], bags, brief, plain], names=["node", "own", "brief", "word"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each class of words is there."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for brief in batch.column("brief"):
            total += np.bincount(np.frombuffer(brief.as_buffer(), np.uint16), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "c"])


def first_words(own: np.ndarray, of: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest words of each text that near ones have one of in common, and each text's first one."""
    n = np.diff(of)
    order = np.lexsort((own, counts[own >> np.uint64(48)], np.repeat(np.arange(len(n)), n)))
    take = np.minimum(np.floor(n * (1 - threshold) + 1e-9).astype(np.int64) + 1, n)
    return own[order[ranges(of[:-1], take)]], np.concatenate(([0], np.cumsum(take)))


def _first(counts: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = batch.column("own")
            of = np.asarray(bags.offsets).astype(np.int64)
            word, ends = first_words(bags.flatten().to_numpy().view(np.uint64), of - of[0], counts, threshold)
            yield pa.record_batch([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(word.view(np.int64)))], names=["node", "w"])

    return run


def shared_at_most(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Upper bounds of how many values each of ``one`` shares with each of ``two``: the sums of their counts' products."""
    bags = one + two
    _, column = np.unique(np.concatenate(bags), return_inverse=True)
    width = int(column.max(initial=0)) + 1
    at = np.repeat(np.arange(len(bags)), [len(b) for b in bags]) * width + column
    count = np.bincount(at, minlength=len(bags) * width).reshape(-1, width).astype(np.float32)
    return count[: len(one)] @ count[len(one) :].T


def _alike(threshold: float):
    """Pairs of two blocks' members, of different components, that may share enough words to be near, the likeliest first; a batch a row."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                x, y = row["x"], row["y"]
                bags = [[np.frombuffer(m["brief"], np.uint16) for m in side] for side in (x, y)]
                ids = {c: i for i, c in enumerate({m["component"] for m in x + y})}
                part, size = ([np.array([f(m) for m in side]) for side in (x, y)] for f in (lambda m: ids[m["component"]], lambda m: len(m["brief"]) // 2))
                most = np.maximum.outer(*size)
                need = most - np.floor(most * (1 - threshold) + 1e-9)
                shared = shared_at_most(*bags)
                near = (shared >= need) & (np.minimum.outer(*size) >= need) & np.not_equal.outer(*part)
                if row["block"] == row["other"]:
                    near = np.triu(near, 1)
                at = np.argwhere(near)
                at = at[np.argsort(-(shared / np.maximum(most, 1))[near], kind="stable")]
                pairs = [(x[i]["node"], y[j]["node"]) for i, j in at.tolist()]
                yield pa.record_batch([pa.array([f(p) for p in pairs], pa.binary()) for f in (min, max)], schema=schema)

    return run


def connecting(pairs: list[tuple[bytes, bytes]], part: dict[bytes, bytes], word: dict[bytes, np.ndarray], threshold: float) -> list[tuple[bytes, bytes, float]]:
    """Links among ``pairs`` that connect what they connect, none of them between parts that others have connected.

    Of each part the first pair that is left is aligned, then two, four and so on, until no pair of two parts is left.
    """
    up: dict[bytes, bytes] = {}

    def top(c: bytes) -> bytes:
        while (d := up.get(c, c)) != c:
            up[c] = c = up.get(d, d)
        return c

    out, some = [], 1
    while pairs:
        now, later, met = [], [], {}
        for a, b in pairs:
            if (one := top(part[a])) != (two := top(part[b])):
                seen = met.get(one, 0), met.get(two, 0)
                met[one], met[two] = seen[0] + 1, seen[1] + 1
                (now if min(seen) < some else later).append((a, b))
        score = similarities([(word[a], word[b]) for a, b in now], threshold).tolist()
        for (a, b), s in zip(now, score, strict=True):
            if s and (one := top(part[a])) != (two := top(part[b])):
                up[one] = two
                out.append((a, b, s))
        pairs, some = later, 2 * some
    return out


def _connected(threshold: float):
    """Links that connect the components of two blocks' members."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
    alike = _alike(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, told in enumerate(alike([batch])):
                found = []
                if told.num_rows:
                    row = batch.slice(r, 1).to_pylist()[0]
                    member = row["x"] + row["y"]
                    part, word = {m["node"]: m["component"] for m in member}, {m["node"]: np.frombuffer(m["word"], np.uint64) for m in member}
                    found = connecting(list(zip(*(told.column(c).to_pylist() for c in "ab"), strict=True)), part, word, threshold)
                yield pa.record_batch([pa.array([f[i] for f in found], schema.types[i]) for i in range(3)], schema=schema)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; a component is named by its least node.

    Labels go to neighbours and along their own pointers, so rounds grow with
    the logarithm of the longest path; each round is written, which cuts the
    lineage.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    two = written(edges.select(ends.alias("e")).select("e.*").distinct(), "ends", free=False)
    both = written(two.unionByName(two.select("a", F.col("a").alias("b")).distinct()), "edges", free=False)  # either way round, and every node with itself
    near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"), F.first("a").alias("was"))
    while True:
        near = written(near, "labels", free=False)
        if near.where("was <> to").isEmpty():
            return near.select("node", F.col("to").alias("component"))
        ahead = near.select(F.col("node").alias("to"), F.col("to").alias("component"))
        label = near.join(ahead, "to").select("node", "component")
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("to"), F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("was"))


def _grouped(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``keys(key, node, n)`` those that several have, counted, and (node, n, centre, m, c, rank) of the members of each and
    its centre: the size of the largest key they have in common, and which one of the node's it is."""
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    held = written(keys.join(shared, "key"), "keys")
    # Of each node its weight (how many it meets in all its keys) and its keys.
    node = held.groupBy("node").agg(F.sum("c").alias("weight"), F.first("n").alias("n"), F.collect_list(F.struct("key", "c")).alias("k"))
    weighed = node.select("node", "n", "weight", F.explode("k").alias("k")).select("node", "n", "weight", "k.*")
    centre = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("top"))
    told = weighed.join(centre, "key").select("node", "n", F.col("top.node").alias("centre"), F.col("top.n").alias("m"), "c").where("node <> centre")
    told = told.groupBy("node", "n", "centre", "m").agg(F.max("c").alias("c"))
    fits = F.least("n", "m") >= F.greatest("n", "m") * 0.5  # the likelier ones first
    return held, written(told.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(fits.desc(), F.desc("c"), "centre"))), "told", free=False)


def _small(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of each key of ``rows(key, node, n, component)``, a few for each key, without those of one component."""
    members = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n", "component"))).alias("m"))
    near = lambda x, y: (x["node"] < y["node"]) & (x["component"] != y["component"]) & (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * threshold)
    one = members.select(F.explode("m").alias("x"), "m")
    return one.select("x", F.explode(F.filter("m", lambda y: near(F.col("x"), y))).alias("y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _placed(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the component of their node, itself if it has none."""
    return rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(rows: DataFrame, key: str) -> DataFrame:
    """The keys of ``rows(key, component, n)`` whose members belong to several components: how many there are, of how many words, those
    (``rest``) outside the largest component (``most``) and how many words they have."""
    part = rows.groupBy(key, "component").agg(F.count("*").alias("c"), F.sum("n").alias("words"))
    each = part.groupBy(key).agg(F.sum("c").alias("c"), F.sum("words").alias("words"), F.max(F.struct("c", "component", "words")).alias("top"))
    return each.where("c > top.c").select(key, "c", "words", F.col("top.component").alias("most"), (F.col("c") - F.col("top.c")).alias("rest"), (F.col("words") - F.col("top.words")).alias("rest_words"))


def _star(told: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of the members of keys and their centres."""
    return told.where(F.least("n", "m") >= F.greatest("n", "m") * threshold).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))


def _rare(docs: DataFrame, told: DataFrame, label: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, node, component, n): the lists of large keys' members, all of a centre or those with a rare word in common, of several
    components only; and (node, brief, word), their words."""
    one = told.where(F.col("c") > SMALL)
    centre = one.select(F.col("centre").alias("node"), F.col("m").alias("n"), F.col("centre").alias("group")).distinct()
    members = one.select("node", "n", F.col("centre").alias("group")).unionByName(centre)
    members = _placed(members, label).select(F.xxhash64("group").alias("g"), "node", "component", "n")  # two groups that are equal by chance only cost work
    members = written(members, "members")
    # A member meets as many blocks as there are of those outside the largest component, or has so many lists.
    whole = F.col("rest") <= BLOCK * (F.col("words") / F.col("c") * (1 - threshold) + 1)
    members = written(members.join(_open(members, "g").select("g", whole.alias("whole")), "g"), "open")
    wanted = docs.join(members.select("node").distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    bags = written(wanted.mapInArrow(_bags, "node binary, own array<bigint>, brief binary, word binary"), "bags")
    lists = members.where("whole").select(F.col("g").alias("key"), "node", "component", "n")
    members = members.where("not whole")
    if not members.isEmpty():
        own = bags.select("node", "own").join(members.select("node").distinct(), "node", "left_semi")
        brief = bags.select("node", "brief").join(members.select("node").distinct(), "node", "left_semi")
        counts = np.zeros(BUCKETS, np.int64)
        for bucket, c in brief.mapInArrow(_counted, "bucket long, c long").groupBy("bucket").agg(F.sum("c")).collect():  # as many rows as classes, at most
            counts[bucket] = c
        first = own.mapInArrow(_first(counts, threshold), "node binary, w array<bigint>")
        by_word = members.join(first, "node").select("g", "node", "component", "n", F.explode("w").alias("word"))
        lists = lists.unionByName(by_word.select(F.xxhash64("g", "word").alias("key"), "node", "component", "n"))
    return written(lists, "lists"), bags.drop("own")


def _blocks(lists: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, similarity) that connect the components of each list: its blocks outside the largest one are compared with each
    other and with those of the largest, wherever there is room."""
    blocks = lambda c, words: F.ceil(F.greatest(F.col(c) / BLOCK, F.col(words) / WORDS)).cast("int")
    rows = lists.join(_open(lists, "key"), "key").withColumn("all", blocks("c", "words"))
    rest = F.when(F.col("all") == 1, 1).otherwise(blocks("rest", "rest_words"))
    others = F.when(F.col("all") == 1, 0).otherwise(blocks("large", "large_words"))
    rows = rows.withColumns({"large": F.col("c") - F.col("rest"), "large_words": F.col("words") - F.col("rest_words")}).withColumns({"few": rest, "many": rest + others})
    at = F.xxhash64("node", "key")
    block = F.when((F.col("all") > 1) & (F.col("component") == F.col("most")), F.col("few") + F.pmod(at, F.greatest(F.col("many") - F.col("few"), F.lit(1)))).otherwise(F.pmod(at, "few"))
    rows = rows.select("key", "few", "many", block.cast("int").alias("block"), "node", "component").join(bags, "node")
    members = F.sort_array(F.collect_list(F.struct("node", "component", "brief", "word")))  # in one order, so that reruns agree
    block = written(rows.groupBy("key", "few", "many", "block").agg(members.alias("x")), "blocks")
    alone = block.where("many = 1").select("block", F.col("block").alias("other"), "x", F.col("x").alias("y"))
    # As many tasks as a shuffle has: comparing takes long beside what it reads.
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = block.where("many > 1 and block < few").withColumn("other", F.explode(F.sequence("block", F.col("many") - 1))).select("key", "block", "other", "x")
    two = block.where("many > 1").select("key", F.col("block").alias("other"), F.col("x").alias("y"))
    both = one.repartition(tasks, "key", "other").join(two.repartition(tasks, "key", "other"), ["key", "other"])
    both = alone.unionByName(both.select("block", "other", "x", "y"))
    found = both.mapInArrow(_connected(threshold), "a binary, b binary, similarity double")
    return written(found.dropDuplicates(["a", "b"]), "connected")


def _checked(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the candidates that are near, with their similarity."""
    pairs = written(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # The list grows with the corpus, so it is never broadcast.
    texts = written(docs.join(wanted.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts", free=False)
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified(threshold), "a binary, b binary, similarity double"), "links")


def links(docs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b, similarity) between the distinct texts of ``docs(node, text)``.

    Texts are compared with the centre of their largest key first, with others that they are not connected with then; of other pairs
    that share a small key, or a large one and a rare word, only those that are not connected by then.
    """
    held, told = _grouped(sketches.select("node", "n", F.explode("keys").alias("key")))
    found = _checked(docs, _star(told.where("rank = 1"), threshold), threshold)
    label = components(found)
    centre = label.select(F.col("node").alias("centre"), F.col("component").alias("other"))
    apart = _placed(told.where("rank > 1"), label).join(centre, "centre", "left").where(F.col("component") != F.coalesce("other", "centre"))
    found = found.unionByName(_checked(docs, _star(apart, threshold), threshold))
    label = components(found)
    pairs = _small(_placed(held.where((F.col("c") <= SMALL) & (F.col("c") > 2)), label), threshold)
    if told.where(F.col("c") > SMALL).isEmpty():
        return found.unionByName(_checked(docs, pairs, threshold))
    found = found.unionByName(_checked(docs, pairs, threshold))
    lists, bags = _rare(docs, told, components(found), threshold)
    return found.unionByName(_blocks(lists, bags, threshold))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, bands: int = 32, ell: int = 2, short_bands: int = 16) -> DataFrame:
    """(doc_id, node, copies, n_links, nearest, class_id, class_node): one row for each distinct pair of doc_id and text.

    ``node`` names a text (its MD5), ``copies`` counts the rows with this doc_id
    and text, ``n_links`` the other texts that were found near it and ``nearest``
    the highest similarity among them (null without one); ``class_id`` is the
    least doc_id of the class and ``class_node`` the text of that row. In a large
    family a text is linked to its centre and to what connects it, not to every other member.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select(F.unhex(F.md5("text")).alias("node"), "doc_id", "text")
    rows = written(own.mapInArrow(_sketches(k, bands, ell, short_bands), "node binary, doc_id long, n int, keys array<bigint>"), "sketches")
    sketches = written(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "texts-sketched")
    found = links(own.select("node", "text"), sketches, threshold)
    each = found.select(F.explode(F.array("a", "b")).alias("node"), "similarity").groupBy("node").agg(F.count("*").alias("n_links"), F.max("similarity").alias("nearest"))
    comp = components(found).join(each, "node")
    placed = rows.groupBy("node", "doc_id").agg(F.count("*").alias("copies")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed, "placed")
    head = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head"))
    out = placed.join(written(head, "heads", free=False), "component")
    return out.select("doc_id", "node", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "nearest", F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("class_node"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one of least doc_id, once; all columns as they were."""
    classes = near_duplicates(docs, doc_id, text, **settings)
    keep = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))).select(F.col("doc_id").alias("id"), "node", "copies")
    row = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("hash"))
    kept = row.join(keep, (F.col("hash") == F.col("node")) & F.col("key").eqNullSafe(F.col("id")))
    same = kept.where("copies > 1").dropDuplicates(["hash", "key"])
    return kept.where("copies = 1").select("row.*").unionByName(same.select("row.*"))
