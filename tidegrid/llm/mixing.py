"""Mixing sources to target weights by repeating and thinning documents.

Tokens are summed by source, each source gets a target, and the rate
``target / source_size`` says how often its documents are taken: ``floor(rate)``
times for certain and once more with probability ``rate - floor(rate)``. The
draw is a hash of seed and doc_id, so reruns and any partitioning agree.

Targets share the total by weight; none may pass ``cap`` times its source's
size, and what it would have beyond goes to the others by weight, until none is
above. This fixed point is found in one pass over the sources in ascending order of
``cap * size / weight``: a source is capped exactly if its share of what the
earlier ones leave exceeds its cap. Only the table of sources (one row each)
meets in one task; documents are shuffled without their texts.

Cases: a null or empty text has size 0; the null source is a source, the last
in order; a source of size 0 has target 0 and its documents are not taken; rows
with one doc_id draw alike; an empty table gives no rows; columns of any name
pass through ``repeat`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``.

    The weights are dealt to the sources in order of code points, null last,
    again and again.
    """
    deal = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    each = sizes.withColumn("weight", deal.cast("decimal(38,0)")).withColumn("most", (F.col("source_size") * cap).cast("decimal(38,0)"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = each.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("words"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("shares"),
        F.row_number().over(order).alias("at"),
    )
    free = F.col("most") * F.col("shares") > F.col("weight") * F.col("words")
    level = F.col("words").cast("double") / F.col("shares").cast("double")
    shared = F.min_by(F.when(free, level), F.when(free, F.col("at"))).over(every)
    return left.select("source", "source_size", F.when(free, F.col("weight").cast("double") * shared).otherwise(F.col("most").cast("double")).alias("target"))


def draw(seed: int, doc_id: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed and doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 1) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies (times to take it), and the whole row as ``row``."""
    sized = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    plan = targets(docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    plan = plan.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = draw(seed, F.col("doc_id")) < rate - F.floor(rate)
    return sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", (F.floor(rate) + extra.cast("long")).alias("copies"), "row")


def repeat(docs: DataFrame, name: str = "copy", **settings) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as the mix takes it, with a column that counts from 1.

    The column is called ``name``, with underscores before it as long as ``docs`` has one of that name.
    """
    taken_names = {c.lower() for c in docs.columns}
    while name.lower() in taken_names:
        name = f"_{name}"
    taken = mix(docs, **settings).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n"))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("n").alias(name))
