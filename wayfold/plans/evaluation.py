"""Queries that score alert streams, labels, tracks and metrics.

The near approaches of a pass (an obstacle first within a metre in plan) stand for its true events, and the
component nearest then for the true one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import settings as S
from wayfold.operators import evaluation as E
from wayfold.operators import risk as R
from wayfold.operators.levels import level_rank
from wayfold.plans.risk import _COMP, _FRAMES, _RANK, distinct_frames
from wayfold.sources.tables import read_table

GATES = [("damage_mean", 0.5, "below"), ("speed_max", 2.0, "below"), ("contact_share", 0.1, "above"), ("never_logged", 1.0, "above")]


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_frames(spark, folder).select("pass_id", "t_ns", level_rank("alert_level").alias("rank"), "worst_component").filter("rank IS NOT NULL")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "obstacles").filter("t_ns IS NOT NULL AND sqrt(pow(get(center_veh, 0), 2) + pow(get(center_veh, 1), 2)) < 1.0")
    return o.groupBy("pass_id", "id").agg(F.min("t_ns").alias("t_event_ns"))


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    """Per pass its first frame with a component within 0.3 m: the instant and the nearest component."""
    c = R.exploded(distinct_frames(spark, folder)).filter("min_distance_m < 0.3")
    return c.groupBy("pass_id").agg(F.min(F.struct("t_ns", "min_distance_m", "ord", "component")).alias("m")).select("pass_id", F.col("m.t_ns").alias("t_event_ns"), F.col("m.component").alias("true_component"))


def alert_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return E.episodes(_levels(spark, folder), "pass_id", "t_ns", F.col("rank") >= 2).drop("episode")


def false_alarms(spark: SparkSession, folder: str) -> DataFrame:
    f = _levels(spark, folder)
    out = E.false_alarm_rate(f, E.episodes(f, "pass_id", "t_ns", F.col("rank") >= 2), _events(spark, folder), "pass_id", "t_ns")
    return out.withColumns({c: F.round(c, 6) for c in ("minutes", "per_min")})


def lead_times(spark: SparkSession, folder: str) -> DataFrame:
    """First warning of each pass with an event: seconds ahead of it (null if never), and whether it names the truth in time."""
    flags = E.first_flags(_levels(spark, folder), "pass_id", "t_ns", F.col("rank") >= 2, ["worst_component"])
    j = _truth(spark, folder).join(flags, "pass_id", "left")
    right = F.coalesce((F.col("first_ns") <= F.col("t_event_ns")) & (F.col("worst_component") == F.col("true_component")), F.lit(False))
    return j.select("pass_id", "first_ns", F.round((F.col("t_event_ns") - F.col("first_ns")) / 1e9, 6).alias("lead_s"), right.alias("attributed"))


def system_score(spark: SparkSession, folder: str) -> DataFrame:
    """All passes together: attribution, median lead, never warned, pooled false alarms per minute."""
    a = lead_times(spark, folder).agg(F.count("*").alias("n_passes"), F.round(F.avg(F.col("attributed").cast("double")), 6).alias("attribution"), F.round(F.expr("percentile(lead_s, 0.5)"), 6).alias("median_lead_s"), F.count_if(F.col("lead_s").isNull()).alias("n_never"))
    b = false_alarms(spark, folder).filter("minutes > 0").agg(F.sum("n_false").alias("n_false"), F.round(F.sum("n_false") / F.sum("minutes"), 4).alias("false_per_min"))
    return a.crossJoin(b)


def ttc_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Per pass the median absolute error of the predicted time to the event, over earlier frames of the true component."""
    c = R.exploded(distinct_frames(spark, folder)).filter("ttc_s IS NOT NULL").join(_truth(spark, folder), "pass_id").filter("component = true_component AND t_ns <= t_event_ns")
    e = c.select("pass_id", F.abs(F.col("ttc_s") - (F.col("t_event_ns") - F.col("t_ns")) / 1e9).alias("e"))
    return e.groupBy("pass_id").agg(F.count("*").alias("n"), F.round(F.expr("percentile(e, 0.5)"), 6).alias("median_error_s"))


def alert_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Frames whose level differs from the one before, with how long it is held in the end."""
    over = "OVER (PARTITION BY pass_id ORDER BY t_ns)"
    f = _levels(spark, folder).select("pass_id", "t_ns", "rank", F.expr(f"lag(rank) {over}").alias("before")).filter("before IS NULL OR before <> rank")
    held = F.expr(f"(lead(t_ns) {over} - t_ns) / 1e9D")
    return f.select("pass_id", "t_ns", "before", "rank", F.round(held, 6).alias("held_s"))


def frame_holds(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds each level is shown per pass: every frame until the next, the last as long as the one before it."""
    over = "OVER (PARTITION BY pass_id ORDER BY t_ns)"
    f = _levels(spark, folder).select("pass_id", "rank", F.expr(f"coalesce(lead(t_ns) {over} - t_ns, t_ns - lag(t_ns) {over})").alias("ns"))
    return f.groupBy("pass_id", "rank").agg(F.round(F.sum("ns") / 1e9, 6).alias("shown_s"), F.count("*").alias("n"))


def level_iou(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of the worst component stated with the one recomputed, per component."""
    f = distinct_frames(spark, folder)
    near = R.exploded(f).groupBy("pass_id", "t_ns").agg(F.min(F.struct("min_distance_m", "ord", "component"))["component"].alias("nearest"))
    pairs = f.select("pass_id", "t_ns", "worst_component").join(near, ["pass_id", "t_ns"])
    return E.iou_per_class(pairs, "worst_component", "nearest").withColumn("iou", F.round("iou", 6))


def metric_report(spark: SparkSession, folder: str) -> DataFrame:
    """Daily metrics of the risk frames against gates."""
    f = distinct_frames(spark, folder).select(F.expr("date_format(timestamp_seconds(t_ns div 1000000000), 'yyyy-MM-dd')").alias("ts"), "expected_damage", "ego_speed_mps", "p_any_contact")
    days = f.groupBy("ts").agg(F.avg("expected_damage").alias("damage_mean"), F.max(F.abs("ego_speed_mps")).alias("speed_max"), F.avg((F.col("p_any_contact") > 0.5).cast("double")).alias("contact_share"))
    log = days.unpivot(["ts"], ["damage_mean", "speed_max", "contact_share"], "metric", "value").filter("value IS NOT NULL").withColumn("line", F.lit(0)).withColumn("value", F.round("value", 9))
    gates = spark.createDataFrame(GATES, "metric string, limit double, direction string")
    return E.metric_summary(log, gates)


def source_timing(spark: SparkSession, folder: str) -> DataFrame:
    """Delay of arrival of ego rows per rig, after 10 rows of warm-up, in ms."""
    e = read_table(spark, folder, "ego_states").filter("t_ns IS NOT NULL")
    ms = F.expr("(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', arrived_at) - t_ns div 1000) / 1000D")
    return E.stage_times(e.select("rig_id", "ego_row", ms.alias("ms")), "rig_id", "ego_row", "ms", 10).withColumns({c: F.round(c, 6) for c in ("p50", "p95", "fps")})


def position_middles(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed middle of the forward positions per obstacle kind."""
    o = read_table(spark, folder, "obstacles").select("kind", F.expr("get(center_veh, 0)").alias("x")).filter("kind IS NOT NULL AND NOT isnan(x)")
    return E.trimmed_middles(o, "kind", "x", 2.0, 10).withColumns({c: F.round(c, 6) for c in ("middle", "low", "high")})


QUERIES = {q.__name__: q for q in (alert_episodes, false_alarms, lead_times, system_score, ttc_errors, alert_changes, frame_holds, level_iou, metric_report, source_timing, position_middles)}

_LEVELS = f"lv AS (SELECT * FROM (SELECT pass_id, t_ns, worst_component, {_RANK} AS rank FROM (SELECT *, regexp_replace(lower(alert_level), '[^a-z0-9]', '', 'g') AS b FROM frames)) WHERE rank IS NOT NULL)"
_EPISODES = "ep AS (SELECT pass_id, min(t_ns) AS start_ns, max(t_ns) AS end_ns, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY t_ns) - row_number() OVER (PARTITION BY pass_id, rank >= 2 ORDER BY t_ns) AS g FROM lv) WHERE rank >= 2 GROUP BY pass_id, g)"
_EVENTS = "ev AS (SELECT pass_id, id, min(t_ns) AS t_event_ns FROM obstacles WHERE t_ns IS NOT NULL AND sqrt(center_veh[1] ** 2 + center_veh[2] ** 2) < 1.0 GROUP BY 1, 2)"
_TRUTH = "truth AS (SELECT pass_id, t_ns AS t_event_ns, component AS true_component FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY t_ns, min_distance_m, ord) AS rn FROM comp WHERE min_distance_m < 0.3) WHERE rn = 1)"
_FALSE = f"""fa AS (SELECT pass_id, (SELECT count(*) FROM ep WHERE ep.pass_id = s.pass_id) AS n_episodes, (SELECT count(*) FROM ep WHERE ep.pass_id = s.pass_id AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.pass_id = ep.pass_id AND t_event_ns BETWEEN start_ns AND greatest(end_ns, start_ns + {int(S.FALSE_ALARM_HORIZON_S * 1e9)}))) AS n_false,
 span / 60e9::DOUBLE AS minutes, n AS nf FROM (SELECT pass_id, count(*) AS n, max(t_ns) - min(t_ns) AS span FROM lv GROUP BY 1) s)"""
_FALSE_OUT = "SELECT pass_id, n_episodes, n_false, round(minutes, 6) AS minutes, round(CASE WHEN nf >= 2 AND minutes > 0 THEN n_false / minutes END, 6) AS per_min FROM fa"
_LEADS = """leads AS (SELECT truth.pass_id, first_ns, round((t_event_ns - first_ns) / 1e9::DOUBLE, 6) AS lead_s, coalesce(first_ns <= t_event_ns AND worst_component = true_component, false) AS attributed
 FROM truth LEFT JOIN (SELECT pass_id, t_ns AS first_ns, worst_component FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY t_ns) AS rn FROM lv WHERE rank >= 2) WHERE rn = 1) USING (pass_id))"""
_GATES = ", ".join(f"('{m}', {v}::DOUBLE, '{d}')" for m, v, d in GATES)
_BASE = f"WITH {_FRAMES}, {_COMP}, {_LEVELS}, {_EPISODES}, {_EVENTS}, {_TRUTH}, {_FALSE}, {_LEADS}"

ORACLES = {
    "alert_episodes": f"WITH {_FRAMES}, {_LEVELS}, {_EPISODES} SELECT * FROM ep",
    "false_alarms": f"{_BASE} {_FALSE_OUT}",
    "lead_times": f"{_BASE} SELECT * FROM leads",
    "system_score": f"""{_BASE}, fo AS ({_FALSE_OUT}) SELECT * FROM (SELECT count(*) AS n_passes, round(avg(attributed::INT), 6) AS attribution, round(median(lead_s), 6) AS median_lead_s, count_if(lead_s IS NULL) AS n_never FROM leads), (SELECT sum(n_false)::BIGINT AS n_false, round(sum(n_false) / sum(minutes), 4) AS false_per_min FROM fo WHERE minutes > 0)""",
    "ttc_errors": f"{_BASE} SELECT pass_id, count(*) AS n, round(median(abs(ttc_s - (t_event_ns - t_ns) / 1e9::DOUBLE)), 6) AS median_error_s FROM comp JOIN truth USING (pass_id) WHERE ttc_s IS NOT NULL AND component = true_component AND t_ns <= t_event_ns GROUP BY 1",
    "alert_changes": f"""WITH {_FRAMES}, {_LEVELS}, c AS (SELECT * FROM (SELECT pass_id, t_ns, rank, lag(rank) OVER (PARTITION BY pass_id ORDER BY t_ns) AS before FROM lv) WHERE before IS NULL OR before <> rank)
 SELECT pass_id, t_ns, before, rank, round((lead(t_ns) OVER (PARTITION BY pass_id ORDER BY t_ns) - t_ns) / 1e9::DOUBLE, 6) AS held_s FROM c""",
    "frame_holds": f"""WITH {_FRAMES}, {_LEVELS} SELECT pass_id, rank, round(sum(ns)::BIGINT / 1e9::DOUBLE, 6) AS shown_s, count(*) AS n FROM (SELECT pass_id, rank, coalesce(lead(t_ns) OVER w - t_ns, t_ns - lag(t_ns) OVER w) AS ns FROM lv WINDOW w AS (PARTITION BY pass_id ORDER BY t_ns)) GROUP BY 1, 2""",
    "level_iou": f"""WITH {_FRAMES}, {_COMP}, near AS (SELECT pass_id, t_ns, component AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, t_ns ORDER BY min_distance_m NULLS FIRST, ord) AS rn FROM comp) WHERE rn = 1)
, e AS (SELECT unnest(list_distinct([worst_component, nearest])) AS class, worst_component AS p, nearest AS t FROM frames JOIN near USING (pass_id, t_ns))
 SELECT class, round(b / u, 6) AS iou, u AS n_union FROM (SELECT class, count_if(coalesce(p = class, false) AND coalesce(t = class, false)) AS b, count_if(coalesce(p = class, false) OR coalesce(t = class, false)) AS u FROM e WHERE class IS NOT NULL GROUP BY 1) WHERE u > 0""",
    "metric_report": f"""WITH {_FRAMES}, d AS (SELECT strftime(make_timestamp(t_ns // 1000), '%Y-%m-%d') AS ts, round(avg(expected_damage), 9) AS damage_mean, round(max(abs(ego_speed_mps)), 9) AS speed_max, round(avg((p_any_contact > 0.5)::INT), 9) AS contact_share FROM frames GROUP BY 1),
 l AS (SELECT metric, ts, value FROM (UNPIVOT d ON damage_mean, speed_max, contact_share INTO NAME metric VALUE value)), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC) AS rn, count(*) OVER (PARTITION BY metric) AS c FROM l),
 s AS (SELECT metric, max(value) FILTER (rn = 1) AS latest, max(value) FILTER (rn = 2) AS previous, max(c) AS n FROM r GROUP BY 1)
 SELECT metric, latest, previous, coalesce(n, 0) AS n, "limit", direction, CASE WHEN latest IS NULL THEN 'not measured' WHEN "limit" IS NULL THEN 'no gate' WHEN CASE WHEN direction = 'below' THEN latest < "limit" ELSE latest > "limit" END THEN 'pass' ELSE 'fail' END AS status,
 CASE WHEN previous IS NULL OR latest IS NULL THEN NULL WHEN latest = previous THEN 'same' WHEN (direction = 'above' AND latest > previous) OR (coalesce(direction, '') <> 'above' AND latest < previous) THEN 'better' ELSE 'worse' END AS trend FROM s FULL JOIN (VALUES {_GATES}) g(metric, "limit", direction) USING (metric)""",
    "source_timing": """SELECT rig_id, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(1000::DOUBLE / quantile_cont(ms, 0.5), 6) AS fps FROM (SELECT rig_id, (epoch_us(arrived_at) - t_ns // 1000) / 1000::DOUBLE AS ms, row_number() OVER (PARTITION BY rig_id ORDER BY ego_row) AS rn FROM ego_states WHERE t_ns IS NOT NULL) WHERE rn > 10 GROUP BY 1""",
    "position_middles": """SELECT kind, round((low + high) / 2, 6) AS middle, round(low, 6) AS low, round(high, 6) AS high, n FROM (SELECT kind, count(*) AS n, quantile_cont(x, 0.02) AS low, quantile_cont(x, 0.98) AS high FROM (SELECT kind, center_veh[1] AS x FROM obstacles) WHERE kind IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) GROUP BY 1) WHERE n >= 10""",
}
