"""Queries of problems 2 and 4: implausible readings, and regular grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.grid import regular_grid
from wayfold.operators.spikes import Measure, fence_rows, flag_rows
from wayfold.sources.tables import read_table

MOTION = [
    Measure("speed_mps", ["speed_mps"], lambda v: F.abs(v) > 15, lambda v: v == 0),
    Measure("yaw_rate_radps", ["yaw_rate_radps"], lambda v: F.abs(v) > 3, lambda v: v == 0),
]
CENTRE = [Measure("center_veh", [f"get(center_veh, {i})" for i in range(3)], lambda x, y, z: (F.hypot(x, y) > 60) | (z < -3) | (z > 10))]


def flagged_measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged rows of both tables with what is wrong: ``tbl, row_no, field, impossible, frozen, spike``."""
    ego = flag_rows(read_table(spark, folder, "ego_states"), "ego_row", "rig_id", ["pass_id"], "t_ns", MOTION)
    obs = flag_rows(read_table(spark, folder, "obstacles"), "obs_row", "rig_id", ["pass_id", "id"], "t_ns", CENTRE)
    ego = ego.select(F.lit("ego_states").alias("tbl"), F.col("ego_row").alias("row_no"), "field", "impossible", "frozen", "spike")
    return ego.unionAll(obs.select(F.lit("obstacles").alias("tbl"), F.col("obs_row").alias("row_no"), "field", "impossible", "frozen", "spike"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return flagged_measurements(spark, folder).select("tbl", "row_no", "field")


def p2_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each table and field are flagged, by reason."""
    return (
        flagged_measurements(spark, folder)
        .groupBy("tbl", "field")
        .agg(F.count_if("impossible").alias("n_impossible"), F.count_if("frozen").alias("n_frozen"), F.count_if("spike").alias("n_spike"), F.count("*").alias("n_rows"))
    )


def p2_fences(spark: SparkSession, folder: str) -> DataFrame:
    """Speeds, yaw rates and coordinates of centres outside the rig's interquartile fences of the hour."""
    ego, obs = read_table(spark, folder, "ego_states"), read_table(spark, folder, "obstacles")
    parts = [(ego, "ego_states", "ego_row", m.name, m.name, 0) for m in MOTION] + [(obs, "obstacles", "obs_row", CENTRE[0].name, e, i) for i, e in enumerate(CENTRE[0].parts)]
    found = None
    for df, table, row, field, value, i in parts:
        one = fence_rows(df.select(F.col(row).alias("row_no"), "rig_id", "t_ns", F.expr(value).alias("reading")), "row_no", "rig_id", "t_ns", "reading")
        one = one.select(F.lit(table).alias("tbl"), "row_no", F.lit(field).alias("field"), F.lit(i).alias("part"), "hour", "value", "low", "high")
        found = one if found is None else found.unionAll(one)
    return found


def frame_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every pass of ``video_frames`` on the grid of its rig; the value is the frame index."""
    return regular_grid(read_table(spark, folder, "video_frames"), read_table(spark, folder, "rig_sync").select("rig_id", "resample_hz"), "pass_id", "rig_id", "t_ns", "frame_index", "resample_hz")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return frame_grid(spark, folder).filter("missing").select("pass_id", "slot_t_ns")


def p4_series(spark: SparkSession, folder: str) -> DataFrame:
    """The series itself: every slot with its frames, smoothed frame index and support."""
    return frame_grid(spark, folder).select("pass_id", "slot", "slot_t_ns", "n_readings", F.round("value", 4).alias("value"), F.round("support", 4).alias("support"), "missing")


QUERIES = {"p2_found": p2_found, "p2_summary": p2_summary, "p2_fences": p2_fences, "p4_found": p4_found, "p4_series": p4_series}

_EGO_SERIES = " UNION ALL ".join(f"SELECT 'ego_states' AS tbl, '{f}' AS field, ego_row AS row_no, rig_id, pass_id AS key, t_ns, [{f}] AS v FROM ego_states WHERE t_ns IS NOT NULL AND {f} IS NOT NULL" for f in ("speed_mps", "yaw_rate_radps"))
_FLAGS = f"""src AS ({_EGO_SERIES} UNION ALL SELECT 'obstacles', 'center_veh', obs_row, rig_id, pass_id || '/' || id, t_ns, center_veh FROM obstacles WHERE t_ns IS NOT NULL AND len(center_veh) = 3),
 one AS (SELECT DISTINCT tbl, field, rig_id, key, t_ns, v, len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AS fin FROM src),
 fz AS (SELECT *, count(*) OVER (PARTITION BY tbl, field, rig_id, key, grp) AS run FROM (SELECT *, sum(new) OVER (PARTITION BY tbl, field, rig_id, key ORDER BY t_ns) AS grp FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY tbl, field, rig_id, key ORDER BY t_ns) THEN 0 ELSE 1 END AS new FROM one))),
 part AS (SELECT tbl, field, rig_id, key, t_ns, v, unnest(range(1, len(v) + 1)) AS i FROM one WHERE fin),
 near AS (SELECT *, v[i] AS x, lag(v[i]) OVER w AS p1, lag(v[i], 2) OVER w AS p2, lag(v[i], 3) OVER w AS p3, lead(v[i]) OVER w AS n1, lead(v[i], 2) OVER w AS n2, lead(v[i], 3) OVER w AS n3 FROM part WINDOW w AS (PARTITION BY tbl, field, rig_id, key, i ORDER BY t_ns)),
 usual AS (SELECT tbl, field, rig_id, i, median(abs(x - p1)) AS u FROM near WHERE x <> p1 GROUP BY 1, 2, 3, 4),
 sp AS (SELECT DISTINCT tbl, field, rig_id, key, t_ns, v FROM (SELECT *, list_median([p1, p2, p3]) AS a, list_median([n1, n2, n3]) AS b FROM near WHERE p3 IS NOT NULL AND n3 IS NOT NULL) JOIN usual USING (tbl, field, rig_id, i) WHERE ((x > a AND x > b) OR (x < a AND x < b)) AND abs(x - a) > 9 * u AND abs(x - b) > 9 * u),
 judged AS (SELECT fz.tbl, fz.field, fz.rig_id, fz.key, fz.t_ns, fz.v, NOT fin OR CASE fz.field WHEN 'speed_mps' THEN abs(fz.v[1]) > 15 WHEN 'yaw_rate_radps' THEN abs(fz.v[1]) > 3 ELSE sqrt(fz.v[1] ** 2 + fz.v[2] ** 2) > 60 OR fz.v[3] < -3 OR fz.v[3] > 10 END AS impossible,
 run >= 6 AND NOT (fz.tbl = 'ego_states' AND fz.v[1] = 0) AS frozen, sp.t_ns IS NOT NULL AS spike FROM fz LEFT JOIN sp ON fz.tbl = sp.tbl AND fz.field = sp.field AND fz.rig_id = sp.rig_id AND fz.key = sp.key AND fz.t_ns = sp.t_ns AND fz.v = sp.v),
 hits AS (SELECT s.tbl, s.row_no, s.field, j.impossible, j.frozen, j.spike FROM src s JOIN judged j ON s.tbl = j.tbl AND s.field = j.field AND s.rig_id = j.rig_id AND s.key = j.key AND s.t_ns = j.t_ns AND s.v = j.v WHERE j.impossible OR j.frozen OR j.spike)"""
_SLOTS = """f AS (SELECT pass_id, rig_id, t_ns FROM video_frames WHERE t_ns IS NOT NULL AND t_ns <> 0), b AS (SELECT pass_id, t0, t1, (1e9 / resample_hz)::BIGINT AS len FROM (SELECT pass_id, min(rig_id) AS rig_id, min(t_ns) AS t0, max(t_ns) AS t1 FROM f GROUP BY 1) JOIN rig_sync USING (rig_id)),
 slots AS (SELECT pass_id, unnest(range(0, (t1 - t0) // len + 1)) AS slot, t0, len FROM b), used AS (SELECT pass_id, (t_ns - t0) // len AS slot, count(DISTINCT t_ns) AS n FROM f JOIN b USING (pass_id) GROUP BY 1, 2)"""

ORACLES = {
    "p2_found": f"WITH {_FLAGS} SELECT tbl, row_no, field FROM hits",
    "p2_summary": f"WITH {_FLAGS} SELECT tbl, field, count_if(impossible) AS n_impossible, count_if(frozen) AS n_frozen, count_if(spike) AS n_spike, count(*) AS n_rows FROM hits GROUP BY 1, 2",
    "p4_found": f"WITH {_SLOTS} SELECT pass_id, t0 + slot * len AS slot_t_ns FROM slots ANTI JOIN used USING (pass_id, slot)",
    "p4_series": f"""WITH {_SLOTS}, rd AS (SELECT DISTINCT pass_id, t_ns, frame_index::DOUBLE AS y FROM video_frames WHERE t_ns IS NOT NULL AND t_ns <> 0), n AS (SELECT pass_id, t_ns, y, t0, len, (t_ns - t0) // len AS own, (t1 - t0) // len AS last FROM rd JOIN b USING (pass_id)),
 e AS (SELECT *, (t_ns - t0) / len::DOUBLE - slot - 0.5 AS u FROM (SELECT *, unnest(range(own - 3, own + 4)) AS slot FROM n) WHERE slot >= 0 AND slot <= last), k AS (SELECT pass_id, slot, slot = own AS here, CASE WHEN y IS NULL THEN 0 ELSE greatest(0, 1 - (u / 2) ** 2) END AS w, u, coalesce(y, 0) AS y FROM e WHERE slot = own OR abs(u) < 2),
 ft AS (SELECT pass_id, slot, count_if(here) AS n, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS r0, sum(w * u * y) AS r1, sum(w * w) AS ww FROM k GROUP BY 1, 2),
 v AS (SELECT pass_id, slot, t0 + slot * len AS slot_t_ns, coalesce(n, 0) AS n_readings, CASE WHEN s0 * s2 - s1 * s1 > s0 * s0 * 1e-9 THEN (s2 * r0 - s1 * r1) / (s0 * s2 - s1 * s1) ELSE r0 / nullif(s0, 0) END AS line, coalesce(s0 * s0 / nullif(ww, 0), 0) AS support FROM slots LEFT JOIN ft USING (pass_id, slot))
 SELECT pass_id, slot, slot_t_ns, n_readings, round(CASE WHEN support >= 1.5 THEN line END, 4) AS value, round(support, 4) AS support, n_readings = 0 AS missing FROM v""",
}
