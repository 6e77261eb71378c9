"""Column functions: flags, guards, unit conversions, wall-clock checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_to_null(value: Column, high: float) -> Column:
    """Values over an upper bound become null; there is no lower bound."""
    return F.when(value <= high, value)


def present(*values: Column) -> Column:
    """1 if no value is null, else 0."""
    return reduce(lambda a, b: a & b, [v.isNotNull() for v in values]).cast("int")


def enough(n: Column, least: float) -> Column:
    """1 from ``least`` on, else 0; null counts as 0."""
    return (F.coalesce(n, F.lit(0)) >= least).cast("int")


def in_bounds(x: Column, y: Column, width: float, height: float, tolerance: float = 0) -> Column:
    """1 inside the closed rectangle, else 0; null is inside."""
    inside = lambda v, top: F.coalesce(v.between(-tolerance, top + tolerance), F.lit(True))
    return (inside(x, width) & inside(y, height)).cast("int")


def inside_open(x: Column, y: Column, width: float, height: float) -> Column:
    """Whether a point lies strictly inside the rectangle."""
    return (x > 0) & (x < width) & (y > 0) & (y < height)


def all_of(*flags: Column) -> Column:
    """1 if all flags are 1."""
    return reduce(lambda a, b: a * b, flags).cast("int")


def finite(*values: Column) -> Column:
    """Whether no value is null, NaN or infinite."""
    each = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in values]
    return F.coalesce(reduce(lambda a, b: a & b, each), F.lit(False))


def rescaled(value: Column, of: float, to: float) -> Column:
    """A length in units of one image as one of another."""
    return value / of * to


def wall_clock(day: Column, time: Column, zone: str) -> Column:
    """What a zone's clock makes of dd/MM/yyyy and HH:mm:ss.SSS: "ok", "missing" (skipped), "ambiguous" (shown twice), null if unreadable."""
    local = F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("dd/MM/yyyy HH:mm:ss.SSS")).cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    shown = lambda hours: F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + F.expr(f"INTERVAL '{hours}' HOUR")) == local
    return F.when(local.isNull(), None).when(~shown(0), "missing").when(shown(1) | shown(-1), "ambiguous").otherwise("ok")
