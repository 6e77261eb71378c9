"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

*Units.* A sentence ends at a newline or at ``.``, ``!`` or ``?`` before white
space. Its units are its words; three or more single characters in a row
(``i d i o t``) are one unit, white space and all.

*Kernel.* Two units are compared by their common subsequences of three
characters: the gap-weighted subsequence kernel, in which every occurrence of a
subsequence counts with ``DECAY`` for each place it spans (up to ``SPAN``), to the
power ``POWER``, which is a kernel again. Units of more than ``LENGTH`` in its feature
space (about 12 letters) are scaled down to that length, so that long ones do not
match by chance. Letters put in between (``idxiot``) only weaken a match, letters
around it (``idiotic``) do not; other characters inside a unit (``i.d.i.o.t``) count as
nothing. As few classes of characters make a small, fixed set of subsequences
(``CLASSES**3``), it is computed through its explicit features. A sentence is
compared by its nearest unit.

*Nyström landmarks.* The kernel with some dozens of landmarks of length 1, times the
inverse root of the kernel matrix of these, stands for the kernel's feature space.
Landmarks are strings of four to eight bytes out of labelled sentences: those in
whose neighbourhood, as the kernel sees it, toxic documents exceed clean ones most,
taken greedily so that they differ. When sentences are compared, landmarks are scaled so that
a unit that holds one has the kernel 1 with it, which is undone before the inverse root is taken; units
that cannot reach ``FLOOR`` with any of them are cut off, their values count as 0.

*Training.* A linear machine (squared hinge, L2) is trained on sentences. Labels
are given by document: all sentences of a clean one are clean; of a toxic one, the
sentence that scores highest is toxic and the others are left out, which is
settled in a few rounds. A document's score is its highest sentence, through a
logistic curve fitted on the training documents.

The sample has at most ``per_class`` labelled documents of each class, those of
least hash among texts of up to ``longest`` characters: a fixed bound, whatever the
corpus. All documents are scored, whole, in one narrow pass; the model is a table
of fixed size.

Cases: a null or empty text has the score of no sentence; a label of null is no
label; without labels of both classes the score is the same for all; equal texts
have equal scores; an empty table gives no rows; other columns of any name pass
through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import LOWER, SPACE, hashed, pieces, ranges, spans

#: Classes of bytes: letters, other ASCII as one, and the rest by its low bits.
CLASSES = 32
CLASS = np.empty(256, np.int64)
CLASS[:] = 27 + np.arange(256) % 5
GAP = 26
CLASS[:128] = GAP
CLASS[0x61:0x7B] = np.arange(26)
#: Weight of each place a subsequence spans, the places it may span, the power of the kernel, and the length units have at most.
DECAY, SPAN, POWER, LENGTH = 0.7, 5, 4, 1.7
#: Units whose kernel with all landmarks is bound to stay under this are not compared with them.
FLOOR = 0.01
#: Places of the second and third character from the first one on.
SHAPES = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def held_out(doc_id: str | Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text falls into this part."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts == part, F.lit(False))


def units(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Byte starts and ends of units, first unit of each sentence, first sentence of each document."""
    inside = ~SPACE[raw]
    begin, end, of = spans(inside, at)
    if not len(begin):
        return begin, end, np.zeros(1, np.int64), np.zeros(len(at), np.int64)
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    single = end - begin == 1
    joined = np.zeros(len(begin), bool)  # to the word before
    joined[1:] = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
    run = np.cumsum(~joined)
    joined &= np.bincount(run)[run] >= 3
    last = raw[end - 1]
    stop = (last == 0x2E) | (last == 0x21) | (last == 0x3F)
    lines = np.concatenate(([0], np.cumsum(raw == 0x0A)))
    new = np.ones(len(begin), bool)
    new[1:] = (owner[1:] != owner[:-1]) | stop[:-1] | (lines[begin[1:]] != lines[end[:-1]])
    first = ~(joined & ~new)
    tail = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(begin) - 1]))
    sentence = np.flatnonzero(new[first])
    documents = np.searchsorted(np.flatnonzero(new), of)
    return begin[first], end[tail], np.concatenate((sentence, [int(first.sum())])), documents


def letters(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the letters of units side by side, and the unit of each."""
    n = end - begin
    text = CLASS[LOWER[raw[ranges(begin, n)]]]
    real = text != GAP
    return text[real], np.repeat(np.arange(len(n)), n)[real]


def occurrences(text: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Of each shape the units and subsequences of all its occurrences, and their weight."""
    for i, j in SHAPES:
        on = np.flatnonzero(owner[j:] == owner[: max(len(owner) - j, 0)])
        yield owner[on], (text[on] * CLASSES + text[on + i]) * CLASSES + text[on + j], DECAY ** (j + 1)


def spectra(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, most: float = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The explicit features of units: unit, subsequence and value, by unit."""
    keys, weights = [], []
    for unit, code, weight in occurrences(*letters(raw, begin, end)):
        keys.append(unit * CLASSES**3 + code)
        weights.append(np.full(len(code), weight))
    keys, which = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(which, np.concatenate(weights), len(keys))
    unit = keys // CLASSES**3
    norm = np.sqrt(np.bincount(unit, value * value, len(begin)))
    return unit, keys % CLASSES**3, (value * np.minimum(1, most / np.maximum(norm, 1e-9))[unit]).astype(np.float32)


def reachable(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Units whose kernel with some landmark can reach ``FLOOR``: a bound that needs no sorting."""
    best, most = table.max(1), np.zeros(len(begin))
    for unit, code, weight in occurrences(*letters(raw, begin, end)):
        most += np.bincount(unit, best[code] * weight, len(begin))
    return np.flatnonzero(most >= FLOOR ** (1 / POWER))


def dense(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(CLASSES**3, landmarks): their features, scaled so that a unit that holds one has the kernel 1 with it."""
    unit, code, value = spectra(raw, begin, end, np.inf)
    out = np.zeros((CLASSES**3, len(begin)), np.float32)
    out[code, unit] = value
    return out / np.maximum((out**2).sum(0), 1e-9)


def kernel(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """The kernel of each unit with each landmark (columns of ``table``)."""
    unit, code, value = spectra(raw, begin, end)
    out = np.zeros((len(begin), table.shape[1]), np.float32)
    new = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))) if len(unit) else np.empty(0, np.int64)
    ends = np.append(new, len(unit))
    low = 0
    while low < len(new):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + cells // table.shape[1], "right")) - 1)
        a, b = ends[low], ends[high]
        out[unit[new[low:high]]] = np.add.reduceat(table[code[a:b]] * value[a:b, None], new[low:high] - a, axis=0)
        low = high
    return out**POWER


class Model:
    """Landmarks, what each weighs in a sentence's score, and the logistic curve."""

    def __init__(self, marks: list[bytes], weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.marks, self.weights, self.bias, self.curve = marks, weights, bias, curve
        self.table = dense(*_flat(marks))

    def state(self) -> tuple:
        """What makes the model, without its code."""
        return self.marks, self.weights, self.bias, self.curve

    def of_documents(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin, end, sentence, document = units(raw, at)
        best = np.full(len(at) - 1, self.bias, np.float64)
        if len(begin) and self.marks:
            each = sentences(raw, begin, end, sentence, self.table) @ self.weights + self.bias
            some = np.flatnonzero(np.diff(document))
            best[some] = np.maximum.reduceat(each, document[:-1][some])
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * best + self.curve[1], -40, 40)))


def different(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different unit, and which of them each unit is."""
    _, first, which = np.unique(hashed(LOWER[raw], begin, end), return_index=True, return_inverse=True)
    return first, which


def sentences(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, sentence: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The kernel of each sentence with each landmark; equal units are computed once."""
    first, which = different(raw, begin, end)
    near = reachable(raw, begin[first], end[first], table)
    k = np.zeros((len(first) + 1, table.shape[1]), np.float32)
    k[near] = kernel(raw, begin[first[near]], end[first[near]], table)
    out = np.zeros((len(sentence) - 1, table.shape[1]), np.float32)
    some = np.flatnonzero(k.any(1)[which])
    if len(some):
        owner = np.searchsorted(sentence, some, "right") - 1
        new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[new]] = np.maximum.reduceat(k[which[some]], new, axis=0)
    return out


def _chunks(texts: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes: first text, bytes, offsets."""
    size, low = np.cumsum([0, *map(len, texts)]), 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(size, size[low] + limit, "right")) - 1)
        yield low, np.frombuffer(b"".join(texts[low:high]), np.uint8), size[low : high + 1] - size[low]
        low = high


def _flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(strings), np.uint8), ends - sizes, ends


def _landmarks(texts: list[bytes], toxic: np.ndarray, count: int, candidates: int = 400) -> list[bytes]:
    """Strings around which toxic texts exceed clean ones most, unlike each other."""
    n1, n0 = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    likely: list[tuple[float, bytes]] = []
    for size in (4, 5, 6, 8):
        hashes, owners, places = [], [], []
        for first, raw, at in _chunks(texts):
            at_most = np.maximum(len(raw) - size + 1, 0)
            start = np.arange(at_most)
            owner = np.searchsorted(at, start, "right") - 1
            inside = np.concatenate(([0], np.cumsum(CLASS[LOWER[raw]] == GAP)))
            start = start[(inside[size:] == inside[:at_most]) & (start + size <= at[owner + 1])]
            owner = owner[start]
            h = hashed(LOWER[raw], start, start + size)
            order = np.lexsort((owner, h))
            h, owner, start = h[order], owner[order], start[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])  # each once a document
            hashes.append(h[new])
            owners.append(first + owner[new])
            places.append(start[new] - at[owner[new]])
        h, owner, place = np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)
        _, one, which, seen = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        hits = np.bincount(which, toxic[owner], len(seen))
        gain = (hits + 0.5) / (n1 + 1) * np.log((hits + 0.5) * (n0 + 1) / ((seen - hits + 0.5) * (n1 + 1)))
        string = lambda i: texts[owner[one[i]]][place[one[i]] :][:size].lower()  # noqa: B023, E731
        likely += [(float(gain[i]), string(i)) for i in np.argsort(-gain, kind="stable")[: candidates // 4] if gain[i] > 0 and hits[i] > 1]
    likely = sorted(set(likely), key=lambda x: (-x[0], x[1]))
    if not likely:
        return []
    names = [x for _, x in likely]
    table = dense(*_flat(names))
    best = np.zeros((len(texts), len(names)), np.float32)
    for first, raw, at in _chunks(texts):
        begin, end, _, document = units(raw, at)
        if len(begin):
            some = np.flatnonzero(np.diff(document))
            k = sentences(raw, begin, end, units(raw, at)[2], table)
            best[first + some] = np.maximum.reduceat(k, document[:-1][some], axis=0)
    q = (best[~toxic].sum(0) + 0.5) / (n0 + 1)
    alike, open_, bad = likeness(table), np.ones(len(names), bool), best[toxic]
    rest = np.ones(len(bad), np.float32)  # half of a toxic document counts no more once a landmark is near it
    chosen: list[int] = []
    while open_.any() and len(chosen) < count:
        p = (rest @ bad + 0.5) / (n1 + 1)
        score = np.where(open_, p * np.log(p / q), 0)  # how far toxic documents exceed clean ones around each string
        i = int(score.argmax())
        if score[i] <= 0:
            break
        chosen.append(i)
        open_ &= alike[i] < 0.2
        rest = np.minimum(rest, 1 - 0.5 * np.minimum(bad[:, i], 1))
    return [names[i] for i in chosen]


def lengths(table: np.ndarray) -> np.ndarray:
    """The length of each landmark in feature space, which its column of ``table`` is divided by twice."""
    return np.maximum((table.astype(np.float64) ** 2).sum(0), 1e-18) ** -0.5


def likeness(table: np.ndarray) -> np.ndarray:
    """The landmarks' own kernel matrix, each scaled to length 1."""
    near = table.astype(np.float64) * lengths(table)
    return (near.T @ near) ** POWER


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 1e-5) -> np.ndarray:
    """Squared-hinge machine by Newton steps; the last feature is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        margin = 1 - y * (x @ w)
        on = margin > 0
        part = x[on] * weight[on, None]
        step = np.linalg.solve(part.T @ x[on] + ridge * weight.sum() * np.eye(len(w)), part.T @ y[on])
        if np.abs(step - w).max() < 1e-6:
            break
        w = step
    return w


def fit(texts: list[bytes], toxic: np.ndarray, count: int = 32, rounds: int = 5) -> Model:
    """A model of labelled documents, trained on their sentences."""
    marks = _landmarks(texts, toxic, count) if len(texts) and 0 < toxic.sum() < len(texts) else []
    if not marks:
        rate = (float(toxic.sum()) + 0.5) / (len(texts) + 1)
        return Model([], np.zeros(0), 0.0, (0.0, float(np.log(rate / (1 - rate)))))
    table = dense(*_flat(marks))
    parts, counts = [], []
    for _, raw, at in _chunks(texts):
        begin, end, sentence, document = units(raw, at)
        counts.append(np.diff(document))
        if len(begin):
            parts.append(sentences(raw, begin, end, sentence, table).astype(np.float64))
    by_sentence = np.concatenate(parts)
    document = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    values, vectors = np.linalg.eigh(likeness(table))
    real = values > 1e-3
    root = vectors[:, real] / np.sqrt(values[real])
    size = lengths(table) ** POWER  # from landmarks scaled for sentences to those of length 1, whose matrix is inverted
    x = np.concatenate((by_sentence * size @ root, np.ones((len(by_sentence), 1))), 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(document))
    bad = toxic[owner]
    some = np.flatnonzero(np.diff(document))
    score = by_sentence @ _contrast(by_sentence, owner, toxic)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        top = np.zeros(len(x), bool)
        order = np.lexsort((-score, owner))
        top[order[document[:-1][some]]] = True
        use = ~bad | top
        y = np.where(bad[use], 1.0, -1.0)
        weight = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1))
        w = _svm(x[use], y, weight)
        score = x @ w
    best = np.full(len(texts), w[-1])
    best[some] = np.maximum.reduceat(score, document[:-1][some])
    a, b = 1.0, 0.0
    for _ in range(50):  # logistic regression of the label on the highest sentence
        p = 1 / (1 + np.exp(-np.clip(a * best + b, -30, 30)))
        g = np.array([((p - toxic) * best).sum() + 1e-3 * a, (p - toxic).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * best * best).sum() + 1e-3, (v * best).sum()], [(v * best).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return Model(marks, (size * (root @ w[:-1])).astype(np.float32), float(w[-1]), (max(float(a), 0.0), float(b)))


def _contrast(by_sentence: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """What to begin with: by how much documents of both classes differ in each landmark."""
    best = np.zeros((len(toxic), by_sentence.shape[1]))
    np.maximum.at(best, owner, by_sentence)
    return np.maximum(best[toxic].mean(0) - best[~toxic].mean(0), 0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", out_of: tuple[int, int] | None = (4, 2), per_class: int = 1500, longest: int = 20_000) -> Model:
    """Fit on a bounded sample of labelled rows; ``out_of`` names the part of ids that is not looked at."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("toxic")).where("toxic IS NOT NULL AND id IS NOT NULL")
    if out_of:
        known = known.where(~held_out("id", *out_of))
    known = known.groupBy("id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= longest)
    there = known.join(own.select("id").distinct(), "id").withColumn("draw", F.md5(F.col("id").cast("string")))
    sample = [there.where(F.col("bad") == y).orderBy("draw").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(sample[0].unionByName(sample[1]))  # of fixed size
    rows = own.join(sample, "id").groupBy("id", "bad", "draw").agg(F.min("text").alias("text"))
    # The sample is bounded, so one task can fit the model; the driver only carries it on.
    fitted = rows.select("bad", "draw", "text").coalesce(1).mapInArrow(_fitted, "model binary").head()
    return Model(*pickle.loads(fitted["model"])) if fitted else fit([], np.empty(0, bool))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("bad", "draw", "text")), strict=True))
    if rows:
        model = fit([text.encode() for _, _, text in rows], np.array([bad == 1 for bad, _, _ in rows]))
        yield pa.record_batch([pa.array([pickle.dumps(model.state())], pa.binary())], names=["model"])


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score): each row of ``docs`` as one column, and its score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            out = [model.of_documents(raw, at) for _, _, raw, at in pieces(batch.column("row").field(text))]
            yield pa.record_batch([batch.column("row"), pa.array(np.concatenate(out) if out else np.empty(0))], names=["row", "score"])

    own = docs.select(F.struct("*").alias("row"))
    return own.mapInArrow(run, StructType([*own.schema.fields, StructField("score", DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with one more column, the score; a column of its name is replaced."""
    same = [c for c in docs.columns if c.lower() != name.lower()]
    return scored(docs, model, text).select(*[F.col("row")[c].alias(c) for c in same], F.col("score").alias(name))
