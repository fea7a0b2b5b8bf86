"""Queries whose state runs along a pass: held alert levels, tracks, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import settings as S
from wayfold.operators import risk as R
from wayfold.operators import tracking
from wayfold.plans.perception import placed
from wayfold.plans.risk import _SUMMARY, _WITH, _risks
from wayfold.sources.tables import read_table
from wayfold.streaming import alerts, arrivals


def frame_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Raw and widened level of each frame, from its components."""
    return R.frame_risks(_risks(spark, folder, keep_empty=True)).select("pass_id", "t_ns", F.col("level").alias("raw"), "release")


def held_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.held_levels(frame_grades(spark, folder))


def alert_flicker(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of level per pass before and after the hysteresis."""
    over = "OVER (PARTITION BY pass_id ORDER BY t_ns)"
    h = held_alerts(spark, folder).select("pass_id", *[F.expr(f"CASE WHEN {c} <> lag({c}) {over} THEN 1 ELSE 0 END").alias(c) for c in ("raw", "level")])
    return h.groupBy("pass_id").agg(F.sum("raw").alias("raw_changes"), F.sum("level").alias("held_changes"), F.count("*").alias("n"))


def obstacle_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks of all obstacles; a stated deviation gives the score."""
    d = placed(spark, folder).select("pass_id", "t_ns", "x", "y", F.greatest(F.lit(0.0), 1 - F.coalesce("pos_sigma_m", F.lit(0.6)) * 2).alias("score"), "kind")
    return tracking.track(d).withColumns({c: F.round(c, 4) for c in ("x", "y", "vx", "vy")})


def speed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Speeds per rig and minute."""
    e = read_table(spark, folder, "ego_states").filter("abs(speed_mps) < 100").select("rig_id", "t_ns", "speed_mps", "ego_row")
    one = e.groupBy("rig_id", "t_ns").agg(F.min_by("speed_mps", "ego_row").alias("speed_mps"))
    w = arrivals.windowed_counts(one, "t_ns", "rig_id", "speed_mps", "1 minute", "10 minutes")
    return w.select("rig_id", F.unix_seconds("start").alias("start_s"), "n", F.round("mean", 12).alias("mean"), F.round("top", 6).alias("top"))


def frame_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of recording per rig, parted by 5 minutes without a frame."""
    f = read_table(spark, folder, "video_frames").select("rig_id", "t_ns")
    s = arrivals.sessions(f, "t_ns", "rig_id", "5 minutes", "10 minutes")
    return s.select("rig_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n")


QUERIES = {q.__name__: q for q in (frame_grades, held_alerts, alert_flicker, obstacle_tracks, speed_windows, frame_sessions)}

# The ladder, one frame of every pass at a time.
_HELD = f"""WITH RECURSIVE {_WITH.removeprefix("WITH ")}, gr AS (SELECT pass_id, t_ns, level AS raw, release, row_number() OVER (PARTITION BY pass_id ORDER BY t_ns) AS i FROM ({_SUMMARY})),
 walk(pass_id, i, t_ns, raw, release, level, entered, up, up_to, down, down_to) AS (SELECT pass_id, 0::BIGINT, min(t_ns), 0, 0, 0, min(t_ns), 0, 0, 0, 0 FROM gr GROUP BY 1 UNION ALL
 SELECT pass_id, i, t_ns, raw, release, CASE WHEN raise THEN ut WHEN lower THEN dt ELSE level END, CASE WHEN raise OR lower THEN t_ns ELSE entered END, CASE WHEN raise OR lower THEN 0 ELSE nu END, ut, CASE WHEN raise OR lower THEN 0 ELSE nd END, dt
 FROM (SELECT *, nu >= {S.FRAMES_UP} AS raise, nd >= {S.FRAMES_DOWN} AND t_ns - entered >= {round(S.DWELL_S * 1e9)} AS lower FROM (SELECT g.pass_id, g.i, g.t_ns, g.raw, g.release, w.level, w.entered,
 CASE WHEN g.raw > w.level THEN w.up + 1 ELSE 0 END AS nu, CASE WHEN g.raw > w.level THEN CASE WHEN w.up > 0 THEN least(g.raw, w.up_to) ELSE g.raw END ELSE w.up_to END AS ut,
 CASE WHEN g.raw <= w.level AND g.release < w.level THEN w.down + 1 ELSE 0 END AS nd, CASE WHEN g.raw <= w.level AND g.release < w.level THEN CASE WHEN w.down > 0 THEN greatest(g.release, w.down_to) ELSE g.release END ELSE w.down_to END AS dt FROM walk w JOIN gr g ON g.pass_id = w.pass_id AND g.i = w.i + 1)))"""

ORACLES = {
    "frame_grades": f"{_WITH} SELECT pass_id, t_ns, level AS raw, release FROM ({_SUMMARY})",
    "speed_windows": """SELECT rig_id, start_s, count(*) AS n, round(avg(speed_mps), 12) AS mean, round(max(speed_mps), 6) AS top FROM (SELECT rig_id, (t_ns // 60000000000) * 60 AS start_s, speed_mps FROM (SELECT *, row_number() OVER (PARTITION BY rig_id, t_ns ORDER BY ego_row) AS rn FROM ego_states WHERE t_ns <> 0 AND isfinite(speed_mps) AND abs(speed_mps) < 100) WHERE rn = 1) GROUP BY 1, 2""",
    "frame_sessions": """SELECT rig_id, min(us) AS start_us, max(us) + 300000000 AS stop_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY rig_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT rig_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY rig_id ORDER BY us) <= 300000000 THEN 0 ELSE 1 END AS new FROM (SELECT rig_id, t_ns // 1000 AS us FROM video_frames WHERE t_ns <> 0))) GROUP BY rig_id, s""",
    "held_alerts": f"{_HELD} SELECT pass_id, t_ns, raw, release, level FROM walk WHERE i > 0",
    "alert_flicker": f"""{_HELD} SELECT pass_id, sum(a)::BIGINT AS raw_changes, sum(b)::BIGINT AS held_changes, count(*) AS n FROM (SELECT pass_id, CASE WHEN raw <> lag(raw) OVER w THEN 1 ELSE 0 END AS a, CASE WHEN level <> lag(level) OVER w THEN 1 ELSE 0 END AS b FROM walk WHERE i > 0 WINDOW w AS (PARTITION BY pass_id ORDER BY t_ns)) GROUP BY 1""",
}
