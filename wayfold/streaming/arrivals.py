"""Windows over streams in order of arrival, with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(t_ns: str) -> Column:
    """A timestamp (microseconds, rounded down) of nanoseconds since 1970; null and 0 are unset."""
    return F.expr(f"CASE WHEN `{t_ns}` <> 0 THEN timestamp_micros((`{t_ns}` - pmod(`{t_ns}`, 1000)) div 1000) END")


def windowed_counts(rows: DataFrame, t_ns: str, by: str, value: str, width: str, late: str) -> DataFrame:
    """``by, start, n, mean, top``: tumbling windows; rows later than the watermark by ``late`` are dropped by
    the stream, repeated ones within it count once."""
    timed = rows.withColumn("at", instant(t_ns)).filter("at IS NOT NULL")
    if timed.isStreaming:
        timed = timed.withWatermark("at", late).dropDuplicatesWithinWatermark([by, t_ns])
    else:
        timed = timed.dropDuplicates([by, t_ns])
    g = timed.groupBy(by, F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top"))
    return g.select(by, F.col("w.start").alias("start"), "n", "mean", "top")


def sessions(rows: DataFrame, t_ns: str, by: str, gap: str, late: str) -> DataFrame:
    """``by, start, stop, n``: stretches of activity parted by gaps."""
    timed = rows.withColumn("at", instant(t_ns)).filter("at IS NOT NULL")
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    g = timed.groupBy(by, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
