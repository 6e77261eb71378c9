"""Line dedup over overlapping windows of three consecutive lines.

Each document's lines are hashed three by three; a window that stands at more
than one place in the corpus is kept where it stands first (by doc_id, then
place) and its lines are removed everywhere else. Removed windows overlap, so a
document loses the union of the covered lines. Windows are judged on the input.

Only hashes (two independent ones of 64 bits a window) and places are shuffled; the earliest place of
each window is aggregated before the shuffle, so a passage in every document
makes no hot task. Lines are compared without the white space around them;
lines of nothing else are in no window and are never removed.

Cases: a null or empty text has no lines; a document of fewer than three lines
has no window and stays; a window repeated inside one document is removed from
its second place on; rows with equal doc_id and text are one document (both
keep or lose the same lines); null doc_ids come first; an empty table gives no
rows; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import flat, hashed, mix, pieces, ranges, spans, words

NEWLINE = 0x0A


def lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trimmed, non-blank lines: byte starts, byte ends, first line of each document."""
    begin, end, _ = spans(raw != NEWLINE, at)
    first, last, _ = words(raw, at)
    low, high = np.searchsorted(first, begin), np.searchsorted(first, end)
    full = high > low
    begin, end = first[low[full]], last[high[full] - 1]
    return begin, end, np.searchsorted(begin, at)


def _in_a_row(line: np.ndarray, width: int) -> np.ndarray:
    """Hash of the lines from each one on."""
    n = max(len(line) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ line[j : j + n])
    return out


def _windows(width: int):
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            for low, high, raw, at in pieces(batch.column("text")):
                begin, end, of = lines(raw, at)
                counts = np.maximum(np.diff(of) - width + 1, 0)
                place = ranges(of[:-1], counts)
                if not len(place):
                    continue
                who = np.repeat(np.arange(high - low), counts)
                hashes = [_in_a_row(hashed(raw, begin, end, salt), width)[place].view(np.int64) for salt in (0, 1)]
                yield pa.record_batch([*hashes, ids.take(pa.array(low + who)), keys[low + who], (place - of[who]).astype(np.int32)], schema=schema)

    return run


def _kept(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = flat(batch.column("text"))
            places = batch.column("places")
            bounds = np.asarray(places.offsets)
            place = places.values.to_numpy(zero_copy_only=False)
            removed, kept = [], []
            for i in range(len(batch)):
                own = raw[at[i] : at[i + 1]]
                begin, _, _ = lines(own, np.array([0, len(own)]))
                gone = np.unique(ranges(place[bounds[i] : bounds[i + 1]].astype(np.int64), np.full(bounds[i + 1] - bounds[i], width)))
                body = own.tobytes()
                if len(gone):  # by number among all lines, blank ones too
                    number = set((np.searchsorted(np.flatnonzero(own == NEWLINE), begin[gone])).tolist())
                    body = b"\n".join(x for n, x in enumerate(body.split(b"\n")) if n not in number)
                removed.append(len(gone))
                kept.append(body.decode("utf-8"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def repeated_places(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, key, places): the windows of ``docs(doc_id, key, text)`` that stand at an earlier place too."""
    windows = docs.mapInArrow(_windows(width), "w1 long, w2 long, doc_id long, key long, place int")
    first = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "place")).alias("first")).where("n > 1").drop("n")
    again = windows.join(first, ["w1", "w2"]).where(~F.col("first").eqNullSafe(F.struct("doc_id", "key", "place")))
    return again.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept (the text that is left), and the whole row as ``row``.

    A row that loses nothing keeps its text as it is, a null one too.
    """
    own = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("key", F.xxhash64("doc_id", "text"))
    places = repeated_places(own.select("doc_id", "key", "text"), width)
    same = (F.col("own.doc_id").eqNullSafe(F.col("more.doc_id"))) & (F.col("own.key") == F.col("more.key"))
    hit = own.alias("own").join(places.alias("more"), same).select("own.doc_id", "own.key", "text", "places").dropDuplicates(["doc_id", "key"])
    cut = hit.mapInArrow(_kept(width), "doc_id long, key long, n_removed long, kept string")
    # Lines are counted before the join, so that a text travels once, in its row.
    rows = own.select("row", "doc_id", "key", n_lines("text"))
    return rows.alias("own").join(cut.alias("more"), same, "left").select(
        "own.doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", F.col("row")[text]).alias("kept"), "row"
    )


def n_lines(text: str) -> Column:
    """Lines that are more than white space."""
    return F.regexp_count(F.col(text), F.lit(r"(?dm)^[ \t\x0B\f\r]*[^ \t-\r\n].*$")).cast("long").alias("n_lines")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with the text that is left; all rows and columns stay."""
    return dedup_lines(docs, doc_id, text, width).select(*[F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
