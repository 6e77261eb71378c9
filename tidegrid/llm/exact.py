"""Exact dedup by composable polynomial fingerprints, with a comparison of the texts themselves.

*Fingerprint.* A text's UTF-8 bytes are lanes of seven bytes, the last one filled
with zeros; its fingerprint is the number of bytes and the value of the polynomial with
these coefficients at two fixed points, modulo ``2**61 - 1``. Fingerprints compose: of
a text A followed by B, ``h(AB) = h(A) + r**lanes(A) h(B)`` if A fills its lanes. So chunks of
``CHUNK`` bytes are hashed side by side, whatever texts they belong to, and each text's
chunks are combined by their shifts. ``of_parts`` does the same for documents that come as
many rows, hashed on any tasks and combined by one group-by.

*Comparison.* Texts of equal fingerprints are cut into chunks, and for each place
of a fingerprint the least and the greatest chunk are aggregated: they are the same
if and only if all texts agree there. Spark does this by sorting a task's chunks and
streaming through them; a task sends at most two chunks of a place on, so
copies of which a third of all rows consist are no hot group, and a document of any
length passes in pieces. Where they differ (two texts with one fingerprint), rows are
told apart by their texts. Texts whose fingerprint stands alone are not shuffled: a filter of
at most ``BITS`` bits, broadcast, lets some of them pass in vain.

Of equal texts the row of largest doc_id stays. Cases: null is the empty text; all
empty texts are equal; a null doc_id is below all others, a group of nothing else has
keep_id null; of repeated rows with the largest doc_id one stays; an empty table gives no
rows; other columns are not looked at, ``distinct_texts`` passes all columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import pieces, ranges

LANE = 7
#: Bytes of a chunk: full lanes, so that chunks compose, and two fit into one block of the shuffle's compression.
CHUNK = LANE * 1170
#: The prime of the fingerprints.
PRIME = (1 << 61) - 1
#: The two points at which the polynomials are taken.
POINTS = (0x0F6E1D2C3B4A5968 % PRIME, 0x1A2B9C8D7E6F5041 % PRIME)
#: Bits of the filter of fingerprints, at most (16 MB).
BITS = 1 << 27

_KEY = ["n_bytes", "f1", "f2"]
_P = np.uint64(PRIME)


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b modulo 2**61 - 1, of numbers below it: halves of 31 bits, as 2**61 is one."""
    s, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> s, a & low, b >> s, b & low
    middle = a1 * b0 + a0 * b1
    return _folded((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << s) + a0 * b0)


def total(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums modulo 2**61 - 1 of the runs of ``x`` that start at ``begin``, none of them empty."""
    half = np.uint64(32)
    high, low = np.add.reduceat(x >> half, begin), np.add.reduceat(x & np.uint64((1 << 32) - 1), begin)
    return _folded(product(_folded(high), np.full(len(begin), 1 << 32, np.uint64)) + _folded(low))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    for k in range(bits):  # doubles: base ** 0 to base ** (2 ** bits - 1)
        out = np.concatenate((out, product(out, np.full(len(out), pow(base, 1 << k, PRIME), np.uint64))))
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1)."""
    return _powers(base, max(0, int(n - 1).bit_length()))[:n]


def fingerprint(raw: np.ndarray, at: np.ndarray, point: int, chunk: int = CHUNK) -> np.ndarray:
    """The polynomial of each text's lanes at ``point``; offsets ``at`` have one more than there are texts."""
    size = np.diff(at)
    many = -(-size // chunk)
    begin = np.repeat(at[:-1], many) + ranges(np.zeros(len(size), np.int64), many) * chunk
    end = np.minimum(begin + chunk, np.repeat(at[1:], many))
    lanes = -(-(end - begin) // LANE)
    start = np.repeat(begin, lanes) + (place := ranges(np.zeros(len(begin), np.int64), lanes)) * LANE
    view = np.ndarray(len(raw) + 1, "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))
    inside = np.minimum(np.repeat(end, lanes) - start, LANE).astype(np.uint64) << np.uint64(3)
    value = view[start] & ((np.uint64(1) << inside) - np.uint64(1))
    out = np.zeros(len(size), np.uint64)
    if len(begin):
        each = total(product(value, powers(point, int(lanes.max()))[place]), np.concatenate(([0], np.cumsum(lanes)[:-1])))
        shift = powers(pow(point, chunk // LANE, PRIME), int(many.max()))[ranges(np.zeros(len(size), np.int64), many)]
        full = np.flatnonzero(many)
        out[full] = total(product(each, shift), np.concatenate(([0], np.cumsum(many)[:-1]))[full])
    return out


def _marked(passing: np.ndarray | None = None):
    """Adds the fingerprint of ``text``; with a filter only rows that may pass it are returned, text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, at in pieces(batch.column("text")):
                prints = [fingerprint(raw, at, p).view(np.int64) for p in POINTS]
                rows = batch.slice(low, high - low)
                rows = pa.record_batch([*(c for c, n in zip(rows.columns, rows.schema.names, strict=True) if n != "text" or passing is not None), np.diff(at), *prints], names=[n for n in rows.schema.names if n != "text" or passing is not None] + _KEY)
                if passing is not None:
                    bit = prints[0] % (len(passing) * 64)
                    rows = rows.take(pa.array(np.flatnonzero(passing[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))))
                yield rows

    return run


def combined(parts: Column, point: int) -> Column:
    """The fingerprint of parts that follow each other: an array of structs (lanes, h) in order, all but the last filling their lanes.

    Decimals of 38 digits hold the products; a shift is a power by squaring over the bits of ``lanes``.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    times = lambda a, b: wide(wide(a) * wide(b) % F.lit(PRIME).cast("decimal(19,0)"))
    squares = F.array(*[wide(F.lit(pow(point, 1 << k, PRIME))) for k in range(40)])
    power = lambda n: F.aggregate(F.sequence(F.lit(0), F.lit(39)), wide(F.lit(1)), lambda acc, k: F.when(F.getbit(n, k) == 1, times(acc, F.get(squares, k))).otherwise(acc))
    start = F.struct(F.lit(0).cast("long").alias("lanes"), wide(F.lit(0)).alias("h"))
    step = lambda acc, x: F.struct((acc["lanes"] + x["lanes"]).alias("lanes"), wide((acc["h"] + times(power(acc["lanes"]), x["h"])) % F.lit(PRIME).cast("decimal(19,0)")).alias("h"))
    return F.aggregate(parts, start, step, lambda acc: acc["h"].cast("long"))


def of_parts(parts: DataFrame, doc_id: str = "doc_id", place: str = "place", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, f1, f2) of documents that come in parts, each hashed where it is.

    ``text`` holds the parts' bytes (binary); all but the last of a document are full lanes long.
    """
    own = parts.select(F.col(doc_id).alias("doc_id"), F.col(place).cast("long").alias("place"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    each = own.mapInArrow(_marked(), f"doc_id {dict(own.dtypes)['doc_id']}, place long, n_bytes long, f1 long, f2 long")
    each = each.withColumn("lanes", F.expr(f"(n_bytes + {LANE - 1}) div {LANE}"))
    told = each.groupBy("doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("place", "lanes", "f1", "f2"))).alias("p"))
    one = lambda f: F.transform("p", lambda x: F.struct(x["lanes"].alias("lanes"), x[f].alias("h")))
    return told.select("doc_id", "n_bytes", combined(one("f1"), POINTS[0]).alias("f1"), combined(one("f2"), POINTS[1]).alias("f2"))


def _filter(prints: DataFrame) -> np.ndarray:
    """A bit for each fingerprint: 16 bits a row of ``prints``, ``BITS`` at most."""
    bits = 1 << max(6, (min(16 * prints.count(), BITS) - 1).bit_length())
    at = prints.select(F.pmod("f1", F.lit(bits)).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _candidates(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, text, n_bytes, f1, f2) of the rows whose fingerprint may be among ``prints``."""
    return docs.mapInArrow(_marked(_filter(prints)), "doc_id long, text binary, n_bytes long, f1 long, f2 long")


def unequal(docs: DataFrame, prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Those of the fingerprints ``prints`` that different texts of ``docs(doc_id, text)`` have, by chunkwise comparison."""
    places = F.sequence(F.lit(0), F.greatest((F.col("n_bytes") - 1), F.lit(0)), F.lit(chunk))
    parts = _candidates(docs, prints).select(*_KEY, "text", F.explode(places).alias("place"))
    # In SQL, as the function takes no column for its place.
    parts = parts.select(*_KEY, "place", F.expr(f"substring(text, cast(place + 1 as int), {chunk})").alias("chunk"))
    ends = parts.groupBy(*_KEY, "place").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return ends.where("low <> high").select(*_KEY).distinct().join(prints, _KEY, "left_semi")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sha256, copies, keep_id, group_size): a row for each doc_id and text; ``sha256`` is the text's, in lowercase hex."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    marked = own.withColumn("sha256", F.unhex(F.sha2("text", 256))).mapInArrow(_marked(), "doc_id long, sha256 binary, n_bytes long, f1 long, f2 long")
    ids = written(marked.groupBy(*_KEY, "doc_id").agg(F.count("*").alias("copies"), F.first("sha256").alias("sha256")), "fingerprints")
    tops = ids.groupBy(*_KEY).agg(F.sum("copies").alias("group_size"), F.max("doc_id").alias("keep_id"))
    tops = written(tops.where("group_size > 1"), "same-fingerprints", free=False)
    found = written(unequal(own, tops.select(*_KEY)), "unequal", free=False)
    out = ids
    if not found.isEmpty():  # by their texts; no such pair of texts is known
        rest = _candidates(own, found).join(found, _KEY, "left_semi")
        each = rest.groupBy(*_KEY, "text", "doc_id").agg(F.count("*").alias("copies"))
        told = each.groupBy(*_KEY, "text").agg(F.sum("copies").alias("group_size"), F.max("doc_id").alias("keep_id"))
        apart = each.alias("e").join(told.alias("t"), [F.col(f"e.{c}") == F.col(f"t.{c}") for c in [*_KEY, "text"]])
        apart = apart.select("e.doc_id", F.unhex(F.sha2("e.text", 256)).alias("sha256"), "e.copies", "t.keep_id", "t.group_size")
        out = ids.join(found, _KEY, "left_anti")
    out = out.join(tops, _KEY, "left").select("doc_id", "sha256", "copies", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if not found.isEmpty():
        out = out.unionByName(apart)
    return out.withColumn("sha256", F.lower(F.hex("sha256")))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of ``docs``."""
    rows = groups(docs, doc_id, text).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256"))


def distinct_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, each with all its columns; of repeated rows with the largest doc_id any one."""
    keep = groups(docs, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("id"), "sha256", "copies")
    row = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("key"), F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256).alias("hash"))
    kept = row.join(keep, (F.col("hash") == F.col("sha256")) & F.col("key").eqNullSafe(F.col("id")))
    return kept.where("copies = 1").select("row.*").unionByName(kept.where("copies > 1").dropDuplicates(["hash", "key"]).select("row.*"))
