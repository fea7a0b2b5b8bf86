"""Checks and statistics of timestamp streams, resampling, and alignment of clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import settings as S


def steps(df: DataFrame, key: str, t: str) -> DataFrame:
    """Distinct set instants of each key with their place ``i`` and the step ``dt`` from the one before (null at first)."""
    one = df.filter(F.col(t).isNotNull() & (F.col(t) != 0)).select(key, F.col(t).alias("t_ns")).distinct()
    over = f"OVER (PARTITION BY `{key}` ORDER BY t_ns)"
    return one.select(key, "t_ns", F.expr(f"row_number() {over} - 1").alias("i"), F.expr(f"t_ns - lag(t_ns) {over}").alias("dt"))


def timing_report(df: DataFrame, key: str, t: str) -> DataFrame:
    """One row per key: frames, duration, mean rate, median, least and most step, jitter, whether the rate
    varies, and the places after which a gap lies.  The median step is truncated to whole ns; a gap is a
    step over ``GAP_FACTOR`` medians; a key with one instant has null statistics."""
    s = steps(df, key, t)
    m = s.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("n_frames"), F.min("t_ns").alias("_a"), F.max("t_ns").alias("_b"), F.expr("cast(median(dt) AS bigint)").alias("median_dt_ns"), F.min("dt").alias("min_dt_ns"), F.max("dt").alias("max_dt_ns")
    )
    g = s.join(m, F.col(key).eqNullSafe(F.col("_key"))).filter(F.col("dt") > F.lit(S.GAP_FACTOR) * F.col("median_dt_ns")).groupBy(F.col(key).alias("_gkey")).agg(F.array_sort(F.collect_list(F.col("i").cast("bigint"))).alias("gap_indices"))
    j = m.join(g, F.col("_key").eqNullSafe(F.col("_gkey")), "left")
    span = (F.col("_b") - F.col("_a")).cast("double")
    jitter = F.coalesce(F.try_divide((F.col("max_dt_ns") - F.col("min_dt_ns")).cast("double"), "median_dt_ns"), F.lit(0.0))
    return j.select(
        F.col("_key").alias(key), "n_frames", (span / 1e9).alias("duration_s"), F.try_divide((F.col("n_frames") - 1) * F.lit(1e9), span).alias("mean_fps"), "median_dt_ns", "min_dt_ns", "max_dt_ns",
        jitter.alias("jitter_ratio"), (jitter > S.VFR_JITTER).alias("is_vfr"), F.coalesce("gap_indices", F.array().cast("array<bigint>")).alias("gap_indices"),
    )


def stream_faults(df: DataFrame, key: str, t: str, arrival: str) -> DataFrame:
    """Per key whether its stream in order of arrival is usable: number of instants that don't rise, span, verdict.
    Null instants count as unset."""
    over = f"OVER (PARTITION BY `{key}` ORDER BY `{arrival}`)"
    s = df.filter(F.col(t).isNotNull() & (F.col(t) != 0)).select(key, F.col(t).alias("t_ns"), F.expr(f"`{t}` - lag(`{t}`) {over}").alias("dt"))
    a = s.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("dt") <= 0).alias("n_not_rising"), (F.max("t_ns") - F.min("t_ns")).alias("span_ns"))
    return a.withColumn("verdict", F.when(F.col("n_not_rising") > 0, "not increasing").when(F.col("span_ns") < 1_000_000, "too short").otherwise("ok"))


def interpolated(samples: DataFrame, grid: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """``grid`` with ``value``: linear interpolation of the samples at each grid instant, the ends held.
    Samples of null instant or value are passed over; of several at one instant the mean holds; a key
    without samples has null values."""
    s = samples.filter(F.col(t).isNotNull() & F.col(value).isNotNull()).groupBy(key, t).agg(F.avg(value).alias("_v"))
    both = s.select(key, t, "_v", F.lit(False).alias("_grid")).unionAll(grid.select(key, t, F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_grid")))
    item = f"CASE WHEN _v IS NOT NULL THEN struct(`{t}` AS t, _v AS v) END"
    back = F.expr(f"last({item}, true) OVER (PARTITION BY `{key}` ORDER BY `{t}` RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    # The other way round too: a frame without an end ahead would be gone over for every row.
    ahead = F.expr(f"last({item}, true) OVER (PARTITION BY `{key}` ORDER BY `{t}` DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    met = both.select(key, t, "_grid", back.alias("_p"), ahead.alias("_q")).filter("_grid")
    share = F.try_divide((F.col(t) - F.col("_p.t")).cast("double"), F.col("_q.t") - F.col("_p.t"))
    v = F.when(F.col("_p").isNull(), F.col("_q.v")).when(F.col("_q").isNull() | (F.col("_p.t") == F.col("_q.t")), F.col("_p.v")).otherwise(F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * share)
    return met.select(key, t, v.alias(value))


def lag_correlations(left: DataFrame, right: DataFrame, key: str, i: str, value: str, most_lag: int | str) -> DataFrame:
    """``key, lag, corr``: the cross-correlation of two signals on one grid, per key, at lags -most..most
    (``most_lag`` is a number, or the column of ``left`` that has it, the same throughout a key).
    Signals are brought to mean 0 and population deviation 1 (a flat one to 0); the sum runs over the
    overlap and is divided by the number of points of the left signal."""
    def normal(df: DataFrame, name: str, most: Column) -> DataFrame:
        st = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
        z = F.when(F.col("_s") < 1e-12, 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))
        return df.join(st, key).select(key, F.col(i).alias(f"i_{name}"), z.alias(f"z_{name}"), F.col("_n").alias(f"n_{name}"), most.alias(f"most_{name}"))

    most = F.col(most_lag) if isinstance(most_lag, str) else F.lit(most_lag)
    a = normal(left, "a", most).withColumn("lag", F.explode(F.sequence(-F.col("most_a"), F.col("most_a")))).withColumn("i_b", F.col("i_a") - F.col("lag"))
    met = a.join(normal(right, "b", F.lit(0)), [key, "i_b"])
    return met.groupBy(key, "lag").agg((F.sum(F.col("z_a") * F.col("z_b")) / F.max("n_a")).alias("corr"))


def best_lag(corr: DataFrame, key: str) -> DataFrame:
    """``key, lag, corr, lag_refined``: the lag of the highest correlation (the smallest among equals), moved by
    the vertex of the parabola through it and its two neighbours, at most half a step."""
    over = f"OVER (PARTITION BY `{key}` ORDER BY lag)"
    c = corr.select("*", F.expr(f"lag(corr) {over}").alias("_y0"), F.expr(f"lead(corr) {over}").alias("_y2"), F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY corr DESC, lag)").alias("_rn")).filter("_rn = 1")
    bend = F.col("_y0") - 2 * F.col("corr") + F.col("_y2")
    move = F.when(F.abs(bend) > 1e-12, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("_y0") - F.col("_y2")) / bend))).otherwise(0.0)
    return c.select(key, "lag", "corr", (F.col("lag") + F.coalesce(move, F.lit(0.0))).alias("lag_refined"))


def trapezoid(df: DataFrame, key: str, t: str, rate: str) -> DataFrame:
    """``key, t, turned``: the running integral of a rate over time (ns), by trapezoids; 0 at the first sample."""
    over = f"OVER (PARTITION BY `{key}` ORDER BY `{t}`)"
    part = F.expr(f"coalesce((`{rate}` + lag(`{rate}`) {over}) / 2 * ((`{t}` - lag(`{t}`) {over}) / 1e9D), 0D)")
    return df.select(key, t, part.alias("_part")).select(key, t, F.expr(f"sum(_part) OVER (PARTITION BY `{key}` ORDER BY `{t}` ROWS UNBOUNDED PRECEDING)").alias("turned"))


def assigned_split(raw_id: Column, stratum: Column, ratio: float = S.SPLIT_RATIO, seed: int = S.SPLIT_SEED) -> Column:
    """Split by hash: the first 8 bytes of SHA-256 of ``seed|stratum|id`` as a fraction of 2^64, below ``ratio`` dev."""
    head = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), stratum, raw_id), 256), 1, 16)
    draw = F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))
    return F.when(raw_id.isNotNull() & stratum.isNotNull(), F.when(draw < ratio, "dev").otherwise("test"))


def inferred_stratum(name: Column) -> Column:
    """Obstacle category from a name, by the first rule that fits."""
    low = F.lower(name)
    return F.when(low.contains("pole"), "pole").when(low.contains("curb") | low.contains("kerb"), "curb").when(low.contains("box") | low.contains("cone"), "box").otherwise("mixed")


def raw_id(kind: Column, stem: Column, day: Column, index: Column | None = None) -> Column:
    """``kind_yyyymmdd_slug[_nn]``: the slug has anything but letters and digits as ``_``, none at its ends."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""))
    parts = F.concat_ws("_", kind, F.date_format(day, "yyyyMMdd"), slug)
    return parts if index is None else F.concat_ws("_", parts, F.lpad(index.cast("string"), 2, "0"))
