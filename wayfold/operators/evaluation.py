"""Metrics of alert streams and labels against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import settings as S
from wayfold.operators.medians import exact_quantiles
from wayfold.sources.checkpoints import join_small


def episodes(frames: DataFrame, key: str, t: str, on: Column) -> DataFrame:
    """``key, episode, start_ns, end_ns, n``: maximal runs of successive frames that are on; ``end_ns`` is the
    last frame that was.  A null condition counts as off."""
    over = f"OVER (PARTITION BY `{key}` ORDER BY `{t}`)"
    f = frames.select(key, F.col(t).alias("t_ns"), F.coalesce(on, F.lit(False)).alias("on"))
    f = f.withColumn("_new", F.expr(f"CASE WHEN on AND NOT coalesce(lag(on) {over.replace(t, 't_ns')}, false) THEN 1 ELSE 0 END"))
    f = f.withColumn("episode", F.expr(f"sum(_new) OVER (PARTITION BY `{key}` ORDER BY t_ns ROWS UNBOUNDED PRECEDING)")).filter("on")
    return f.groupBy(key, "episode").agg(F.min("t_ns").alias("start_ns"), F.max("t_ns").alias("end_ns"), F.count("*").alias("n"))


def unexplained(found: DataFrame, events: DataFrame, key: str, horizon_ns: int) -> DataFrame:
    """Episodes without an event of the same key from their start to the later of their end and ``horizon_ns``
    after the start, both included.  ``events`` has ``key, t_event_ns``."""
    e = events.select(F.col(key).alias("_key"), "t_event_ns")
    hit = (F.col(key) == F.col("_key")) & F.col("t_event_ns").between(F.col("start_ns"), F.greatest("end_ns", F.col("start_ns") + horizon_ns))
    return found.join(e, hit, "left_anti")


def false_alarm_rate(frames: DataFrame, found: DataFrame, events: DataFrame, key: str, t: str, horizon_s: float = S.FALSE_ALARM_HORIZON_S) -> DataFrame:
    """``key, n_episodes, n_false, minutes, per_min``; the rate is null under two frames or without a span."""
    span = frames.groupBy(key).agg(F.count("*").alias("_n"), (F.max(t) - F.min(t)).alias("_span"))
    n = found.groupBy(key).agg(F.count("*").alias("_ne"))
    bad = unexplained(found, events, key, int(horizon_s * 1e9)).groupBy(key).agg(F.count("*").alias("_nf"))
    zero = F.lit(0).cast("bigint")
    j = span.join(n, key, "left").join(bad, key, "left")
    minutes = F.col("_span") / F.lit(60e9)
    return j.select(key, F.coalesce("_ne", zero).alias("n_episodes"), F.coalesce("_nf", zero).alias("n_false"), minutes.alias("minutes"), F.when(F.col("_n") >= 2, F.try_divide(F.coalesce("_nf", zero).cast("double"), minutes)).alias("per_min"))


def first_flags(frames: DataFrame, key: str, t: str, on: Column, keep: list[str]) -> DataFrame:
    """The first frame of each key that is on, with ``keep``; keys without have no row."""
    return frames.filter(F.coalesce(on, F.lit(False))).groupBy(key).agg(F.min_by(F.struct(t, *keep), t).alias("f")).select(key, F.col(f"f.{t}").alias("first_ns"), *[F.col(f"f.{c}").alias(c) for c in keep])


def iou_per_class(df: DataFrame, predicted: str, truth: str, classes: list[str] | None = None) -> DataFrame:
    """``class, iou, n_union`` of the given classes, or of all in either column; those in neither column are left
    out; null is no class."""
    pt = df.select(F.col(predicted).alias("p"), F.col(truth).alias("t"))
    named = F.array_distinct(F.array("p", "t")) if classes is None else F.array(*[F.lit(x) for x in classes])
    c = pt.select(F.explode(named).alias("class"), "p", "t").filter("class IS NOT NULL")
    hit = (F.coalesce(F.col("p") == F.col("class"), F.lit(False)), F.coalesce(F.col("t") == F.col("class"), F.lit(False)))
    g = c.groupBy("class").agg(F.count_if(hit[0] & hit[1]).alias("n_both"), F.count_if(hit[0] | hit[1]).alias("n_union"))
    return g.filter("n_union > 0").select("class", (F.col("n_both") / F.col("n_union")).alias("iou"), "n_union")


def metric_summary(log: DataFrame, gates: DataFrame) -> DataFrame:
    """``metric, latest, previous, n, limit, direction, status, trend`` of all logged or gated metrics.

    ``log`` has ``metric, ts, line, value``; the latest is by ``ts``, then ``line``.  A gate is strict: a value
    equal to its limit fails.  Status: pass, fail, no gate, or not measured; the trend compares with the
    value before, in the gate's direction.
    """
    r = log.select("*", F.expr("row_number() OVER (PARTITION BY metric ORDER BY ts DESC, line DESC)").alias("_rn"), F.expr("count(*) OVER (PARTITION BY metric)").alias("_n")).filter("_rn <= 2")
    s = r.groupBy("metric").agg(F.max(F.when(F.col("_rn") == 1, F.col("value"))).alias("latest"), F.max(F.when(F.col("_rn") == 2, F.col("value"))).alias("previous"), F.max("_n").alias("n"))
    j = s.join(gates, "metric", "full")
    good = F.when(F.col("direction") == "below", F.col("latest") < F.col("limit")).otherwise(F.col("latest") > F.col("limit"))
    status = F.when(F.col("latest").isNull(), "not measured").when(F.col("limit").isNull(), "no gate").when(good, "pass").otherwise("fail")
    change = F.col("latest") - F.col("previous")
    better = F.when(F.col("direction") == "above", change > 0).otherwise(change < 0)
    trend = F.when(F.col("previous").isNull() | F.col("latest").isNull(), F.lit(None).cast("string")).when(change == 0, "same").when(better, "better").otherwise("worse")
    return j.select("metric", "latest", "previous", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "limit", "direction", status.alias("status"), trend.alias("trend"))


def stage_times(df: DataFrame, stage: str, order: str, ms: str, warmup: int) -> DataFrame:
    """``stage, n, p50, p95, fps``: exact percentiles of the times after the first ``warmup`` in ``order`` (unique in a stage);
    the rate is infinite for a median of 0.  Non-finite times are passed over."""
    ranked = df.select(stage, F.col(order).alias("_o")).withColumn("_part", F.pmod(F.xxhash64("_o"), F.lit(64)))
    # The first of each part of a stage, then the first of these: no task sorts a stage.
    low = ranked.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY `{stage}`, _part ORDER BY _o)")).filter(F.col("_n") <= warmup)
    low = low.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY `{stage}` ORDER BY _o)")).filter(F.col("_n") <= warmup)
    last = low.groupBy(F.col(stage).alias("_s")).agg(F.max("_o").alias("_last"))
    r = join_small(df.select(stage, F.col(order).alias("_o"), F.col(ms).cast("double").alias("ms")), last, F.col(stage).eqNullSafe(F.col("_s")), "left").filter((F.col("_o") > F.col("_last")) | F.col("_last").isNull() if warmup else F.lit(True))
    q = exact_quantiles(r.withColumn("_c", F.lit(0)), [stage], "_c", "ms", {"p50": 0.5, "p95": 0.95})
    n = r.groupBy(F.col(stage).alias("_t")).agg(F.count("*").alias("n"))
    g = n.join(q, F.col("_t").eqNullSafe(F.col(stage))).select(stage, "n", "p50", "p95")
    return g.withColumn("fps", F.coalesce(F.try_divide(F.lit(1000.0), "p50"), F.lit(float("inf"))))


def trimmed_middles(df: DataFrame, key: str, value: str, percent: float, least: int) -> DataFrame:
    """``key, middle, low, high, n``: the middle of the range trimmed by ``percent`` at each end, by exact quantiles of the finite
    values; keys under ``least`` values are left out."""
    there = df.filter(F.col(value).isNotNull() & (F.abs(value) < F.lit(float("inf"))))
    q = exact_quantiles(there.withColumn("_c", F.lit(0)), [key], "_c", value, {"low": percent / 100, "high": 1 - percent / 100})
    n = there.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return n.join(q, F.col("_k").eqNullSafe(F.col(key))).select(key, ((F.col("low") + F.col("high")) / 2).alias("middle"), "low", "high", "n")
