"""Irregular readings onto a regular grid by kernel-weighted local regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots that one exploded row makes; longer series take several rows.
CHUNK = 4096


def regular_grid(readings: DataFrame, rates: DataFrame, key: str, source: str, t: str, value: str, hz: str, *, reach: float = 2.0, least_support: float = 1.5) -> DataFrame:
    """``key, slot, slot_t_ns, n_readings, value, support, missing``: one row per slot of each series.

    Slots begin at the smallest set ``t`` of the series and are ``1e9 / hz`` ns long; the last holds the
    largest ``t``.  A null or 0 ``t`` is unset.  ``missing`` marks a slot without a reading.
    At the middle of each slot a local line is fitted to the distinct readings (t, value) within ``reach``
    slots, under Epanechnikov weights; ``support`` is the effective number of readings,
    (sum w)^2 / sum w^2, 0 without any, and ``value`` is null where it is below ``least_support``.
    Readings with a null value make their slot filled but carry no weight.

    ``rates`` has one row per ``source`` with ``hz``; a series whose source has no positive rate there
    has no grid.  A series under two sources takes the smaller one.  Empty input gives no rows.
    """
    there = readings.filter(F.col(t).isNotNull() & (F.col(t) != 0)).select(key, source, F.col(t).alias("_t"), F.col(value).cast("double").alias("_y"))
    lengths = rates.filter(F.col(hz) > 0).groupBy(source).agg(F.round(F.lit(1e9) / F.min(hz)).cast("bigint").alias("_len"))
    series = there.groupBy(key).agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.min(source).alias(source)).join(lengths, source)
    series = series.select(F.col(key), "_t0", "_len", F.expr("(_t1 - _t0) div _len").alias("_last"))

    # Each distinct reading goes to the slots whose middle it reaches: a fixed few, whatever the series.
    one = there.groupBy(key, "_t", "_y").agg(F.lit(1).alias("_one")).join(series, key)
    offset = F.col("_t") - F.col("_t0")
    own = F.expr("(_t - _t0) div _len")
    wide = int(reach + 1)
    near = one.select(key, "_y", F.col("_len"), F.col("_last"), offset.alias("_off"), own.alias("_own"), F.explode(F.sequence(own - wide, own + wide)).alias("slot"))
    u = (F.col("_off") / F.col("_len") - F.col("slot") - 0.5).alias("_u")
    near = near.filter((F.col("slot") >= 0) & (F.col("slot") <= F.col("_last"))).select(key, "slot", "_y", u, (F.col("slot") == F.col("_own")).alias("_in"))
    w = F.greatest(F.lit(0.0), 1 - F.pow(F.col("_u") / reach, 2))
    near = near.filter(F.col("_in") | (F.abs("_u") < reach)).withColumn("_w", F.when(F.col("_y").isNotNull(), w).otherwise(0.0)).withColumn("_y", F.coalesce("_y", F.lit(0.0)))
    fitted = near.groupBy(key, "slot").agg(
        F.count_if("_in").alias("_n"),
        F.sum("_w").alias("_s0"),
        F.sum(F.col("_w") * F.col("_u")).alias("_s1"),
        F.sum(F.col("_w") * F.col("_u") * F.col("_u")).alias("_s2"),
        F.sum(F.col("_w") * F.col("_y")).alias("_r0"),
        F.sum(F.col("_w") * F.col("_u") * F.col("_y")).alias("_r1"),
        F.sum(F.col("_w") * F.col("_w")).alias("_ww"),
    )

    # The grid itself, in chunks, so that a long series doesn't hang on one row.
    chunks = series.select(key, "_t0", "_len", "_last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"_last div {CHUNK}"))).alias("_chunk"))
    first = F.col("_chunk") * CHUNK
    slots = chunks.select(F.col(key), "_t0", "_len", F.explode(F.sequence(first, F.least(first + CHUNK - 1, F.col("_last")))).alias("slot"))

    det = F.col("_s0") * F.col("_s2") - F.col("_s1") * F.col("_s1")
    line = F.when(det > F.col("_s0") * F.col("_s0") * 1e-9, (F.col("_s2") * F.col("_r0") - F.col("_s1") * F.col("_r1")) / det).otherwise(F.try_divide("_r0", "_s0"))
    support = F.coalesce(F.try_divide(F.col("_s0") * F.col("_s0"), "_ww"), F.lit(0.0))
    filled = slots.join(fitted, [key, "slot"], "left")
    n = F.coalesce("_n", F.lit(0).cast("bigint"))
    return filled.select(
        F.col(key), "slot", (F.col("_t0") + F.col("slot") * F.col("_len")).alias("slot_t_ns"), n.alias("n_readings"), F.when(support >= least_support, line).alias("value"), support.alias("support"), (n == 0).alias("missing")
    )
