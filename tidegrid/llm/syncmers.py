"""Document fingerprints of closed syncmers, in DataFrame expressions only.

A text is its words (``[^\\x20\\x09-\\x0D]+``). Of its k-mers of five words, those
are kept whose inner 2-mer of least hash is the first or the last of the four: a
closed syncmer. Whether a k-mer is kept depends on nothing but itself, so texts
that share a passage share its anchors, whatever stands around it; about half of
all k-mers are kept, and of any three in a row at least one. A fingerprint is
their 64-bit hashes in the order of the text, so anchors of two texts can be
matched by place. A text of fewer words, or of one k-mer that is not kept, has one
anchor for all its words; a text without words has none.

Likeness of two fingerprints is the Jaccard index of their anchors, 1 if neither
has any.

Neighbours in the order of doc_id are found without a global sort: ids are dealt
into ranges by quantiles, a range is sorted in its task, and the row at the
upper end of each range also visits the one above, where it follows the last row.
Each text is shuffled once.

Cases: null is the empty text; equal texts have equal fingerprints; a null doc_id
comes last; equal doc_ids go by text; the only row of a table follows itself; an
empty table gives no rows; columns of any name pass through ``fingerprints``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a k-mer and in its inner substrings.
K, S = 5, 2


def with_anchors(docs: DataFrame, **anchors: str) -> DataFrame:
    """``docs`` with an array of anchors for each text column; keywords are new name = text column."""
    h, pair = {a: f"__h_{a}" for a in anchors}, {a: f"__p_{a}" for a in anchors}
    out = docs.withColumns({h[a]: F.transform(F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)) for a, t in anchors.items()})
    out = out.withColumns({pair[a]: F.zip_with(F.slice(h[a], F.lit(1), F.greatest(F.size(h[a]) - 1, F.lit(0))), F.slice(h[a], F.lit(2), F.greatest(F.size(h[a]) - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y)) for a in anchors})

    def kept(a: str) -> Column:
        p = F.col(pair[a])

        def closed(i: Column) -> Column:
            first, last = F.get(p, i), F.get(p, i + (K - S))
            inner = [F.get(p, i + j) for j in range(1, K - S)]
            return F.when(F.least(first, last) <= F.least(*inner), F.xxhash64(first, F.get(p, i + 2), F.get(F.col(h[a]), i + (K - 1))))

        places = F.when(F.size(h[a]) >= K, F.sequence(F.lit(0), F.size(h[a]) - K)).otherwise(F.array().cast("array<int>"))
        return F.array_compact(F.transform(places, closed))

    out = out.withColumns({a: kept(a) for a in anchors})
    out = out.withColumns({a: F.when((F.size(a) == 0) & (F.size(h[a]) > 0), F.array(F.xxhash64(F.col(h[a])))).otherwise(F.col(a)) for a in anchors})
    return out.drop(*h.values(), *pair.values())


def shown(anchors: Column) -> Column:
    """A fingerprint as text: hexadecimal anchors in order."""
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.hex(x))), " ")


def likeness(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text; a column of its name is replaced."""
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    same = [c for c in docs.columns if c.lower() != name.lower()]
    return with_anchors(own, anchors="text").select(*[F.col("row")[c].alias(c) for c in same], shown(F.col("anchors")).alias(name))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Place of the first bound that is not under ``key``; looked up in two steps, so it takes few comparisons."""
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    lists = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = F.least(F.size(F.filter(coarse, lambda b: b < key)), F.lit(len(lists) - 1))
    fine = F.array(*[F.array(*[F.lit(b) for b in x]) for x in lists])
    return block * step + F.size(F.filter(F.get(fine, block), lambda b: b < key))


def beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Window]:
    """(doc_id, text, next_text, guest): each text and the one of the next lower doc_id; the lowest is followed by the
    highest. ``guest`` marks visiting rows, to be dropped at last; the window is theirs."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(key, [(i + 1) / parts for i in range(parts)], 20 * parts)).head()[0]
    bounds = sorted(set(found or [0]))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("range", _range_of(F.col("key"), bounds))
    at_bound = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("range")) == F.col("key")
    here = F.struct("range", F.lit(0).alias("guest"))
    above = F.struct(((F.col("range") + 1) % len(bounds)).alias("range"), F.lit(1).alias("guest"))
    dealt = own.select("doc_id", "key", "text", F.explode(F.when(at_bound, F.array(here, above)).otherwise(F.array(here))).alias("at")).select("doc_id", "key", "text", "at.*")
    order = Window.partitionBy("range").orderBy("guest", F.col("key").desc(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)), order


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text, edited, anchors, edited_anchors, next_anchors.

    ``edited`` is the text with its second half replaced by as much of the
    beginning of the next document, by descending doc_id.
    """
    beside, order = beside_next(docs, doc_id, text)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = beside.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))).drop("next_text")
    told = with_anchors(edited, anchors="text", edited_anchors="edited").withColumn("next_anchors", F.lead("anchors").over(order))
    return told.where("guest = 0").select("doc_id", "text", "edited", "anchors", "edited_anchors", "next_anchors")
