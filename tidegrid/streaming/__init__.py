"""Quality of live signals by Structured Streaming: event-time windows behind a watermark (an extension; the survey names no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_shares(stream: DataFrame, time: str = "ts", flag: str = "ok", window: str = "10 seconds", late: str = "30 seconds", key: str = "record_id") -> DataFrame:
    """(key, start, end, n, valid): the share of valid samples of each record and time window; samples later than ``late`` are dropped.

    State is one row for each record and open window. Works on batch tables too.
    """
    w = F.window(F.col(time), window)
    out = stream.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.avg(flag).alias("valid"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "valid")


def sessions(stream: DataFrame, time: str = "ts", gap: str = "1 minute", late: str = "30 seconds", key: str = "record_id") -> DataFrame:
    """(key, start, end, n): runs of samples of a record without a gap of ``gap``."""
    w = F.session_window(F.col(time), gap)
    out = stream.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
