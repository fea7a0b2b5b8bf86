"""Queries that sum up maps, metrics and tables, and the one box that stands for the vehicle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import frames as G
from wayfold.functions import settings as S
from wayfold.operators import clouds as C
from wayfold.operators import occupancy as O
from wayfold.operators import risk as R
from wayfold.operators import sweep
from wayfold.operators.nearest import nearest_in_time
from wayfold.plans import evaluation, perception
from wayfold.plans.capture import _ego
from wayfold.plans.perception import _CELLS, _N, _OBS, MAP_CELL, MAP_SIZE, map_clusters, placed
from wayfold.plans.quality import EGO_TOLERANCE_NS
from wayfold.plans.risk import _COMP, _FRAMES, distinct_frames
from wayfold.sources.tables import read_table

SEEN_RANGE = 12.0


def accumulated_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Greatest heights of each pass's cells while they are hit again and again."""
    p = O.cells(placed(spark, folder), "x", "y", MAP_CELL, MAP_SIZE)
    return O.accumulated_map(p, "pass_id", "t_ns", "z", persist_s=2.0).withColumn("height", F.round("height", 6))


def seen_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The same where cells ahead are in view of the camera, so that what isn't hit at the end is cleared."""
    p = O.cells(placed(spark, folder), "x", "y", MAP_CELL, MAP_SIZE)
    x, y = ((F.col(c) + 0.5) * MAP_CELL - MAP_SIZE / 2 for c in ("ci", "cj"))
    pixel = G.projected(F.array(-y, F.lit(1.5) - 0 * x, x), 900.0, 900.0, 639.5, 359.5, (1280, 720))
    seen = pixel.isNotNull() & (F.hypot(x, y) <= SEEN_RANGE)
    return O.accumulated_map(p, "pass_id", "t_ns", "z", seen, persist_s=2.0).withColumn("height", F.round("height", 6))


def enclosing_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The rectangle of least area around all places of each pass."""
    b = C.enclosing_boxes(placed(spark, folder).select("pass_id", "obs_row", "x", "y"), "pass_id", "obs_row")
    return b.select("pass_id", "n_corners", *[F.round(c, 6).alias(c) for c in ("area", "x", "y")])


def baseline_swept(spark: SparkSession, folder: str) -> DataFrame:
    """The vehicle as one box around all its components, swept like them: contacts of each instant of an obstacle, and
    their risk by the kind's multiplier alone."""
    parts = sweep.component_table(spark)
    whole = parts.agg(*[f(c).alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("zmin", F.min), ("xmax", F.max), ("ymax", F.max), ("zmax", F.max))]).select(F.lit("vehicle").alias("component"), "*")
    k = G.curvature_of(F.col("yaw_rate_radps"), F.col("speed_mps"))
    fan = F.array_min(F.array(*[F.struct(F.abs(k - F.lit(c)).alias("d"), F.lit(c).alias("c")) for c in S.CURVATURES]))["c"]
    state = F.struct("t_ns", F.col("speed_mps").alias("speed"), fan.alias("curvature"))
    o = placed(spark, folder).filter("forall(extent, v -> v > 0 AND v < 50) AND size(extent) = 3")
    o = o.select("pass_id", "t_ns", F.col("id").alias("obstacle_id"), "kind", "x", "y", "z", *[F.expr(f"extent[{i}]").alias(f"s{c}") for i, c in enumerate("xyz")])
    e = nearest_in_time(o.select("pass_id", "t_ns").distinct(), _ego(spark, folder).select("pass_id", "t_ns", state.alias("state")), "pass_id", "t_ns", "state", tolerance=EGO_TOLERANCE_NS)
    e = e.filter("state IS NOT NULL").select("pass_id", "t_ns", "state.speed", "state.curvature")
    met = sweep.reachable(sweep.swept_pairs(e, o.drop("kind"), whole)).join(o.select("pass_id", "t_ns", "obstacle_id", "kind"), ["pass_id", "t_ns", "obstacle_id"]).join(e, ["pass_id", "t_ns"])
    risk = R.severity_for(F.col("component"), F.col("kind"), {}, {}) * R.speed_factor(F.col("speed")) * R.p_contact(F.col("ttc_s"))
    return met.select("pass_id", "t_ns", "obstacle_id", *[F.round(c, 6).alias(c) for c in ("min_distance_m", "ttc_s")], F.round(risk, 6).alias("risk"))


def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of each pass's clusters of tall cells, the largest first."""
    c = map_clusters(spark, folder).groupBy("pass_id").agg(F.sort_array(F.collect_list("n_cells"), asc=False).alias("sizes"))
    return c.select("pass_id", F.size("sizes").alias("n"), F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"))


def largest_passes(spark: SparkSession, folder: str) -> DataFrame:
    """The pass of each rig with most frames, the first by name among equals."""
    n = read_table(spark, folder, "video_frames").groupBy("rig_id", "pass_id").agg(F.count("*").alias("n"))
    return n.groupBy("rig_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "pass_id")).alias("b"), F.count("*").alias("n_passes")).select("rig_id", F.col("b.pass_id").alias("pass_id"), (-F.col("b.m")).alias("n_frames"), "n_passes")


def merged_obstacles(spark: SparkSession, folder: str) -> DataFrame:
    """Tracked and mapped obstacles of each pass under ids that never collide: those of the map are moved beyond the tracked ones."""
    o = placed(spark, folder).select("pass_id", "id", "source").distinct()
    tracked, mapped = o.filter("source = 'detector'"), o.filter("source = 'occupancy'")
    top = tracked.groupBy(F.col("pass_id").alias("_p")).agg(F.max("id").alias("top"))
    moved = mapped.join(top, F.col("pass_id") == F.col("_p"), "left").select("pass_id", (F.col("id") + F.coalesce("top", F.lit(0))).alias("id"), "source")
    return tracked.unionByName(moved)


def dangling_obstacles(spark: SparkSession, folder: str) -> DataFrame:
    """Obstacles that frames of a pass name and the pass's obstacles lack."""
    named = R.exploded(distinct_frames(spark, folder)).filter("obstacle_id IS NOT NULL").groupBy("pass_id", "obstacle_id").agg(F.count("*").alias("n_rows"))
    return named.join(read_table(spark, folder, "obstacles").select("pass_id", F.col("id").alias("obstacle_id")).distinct(), ["pass_id", "obstacle_id"], "left_anti")


def metric_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a report: failing metrics first, then by name, with the gate and the latest value as text."""
    m = evaluation.metric_report(spark, folder)
    gate = F.when(F.col("limit").isNull(), "-").otherwise(F.format_string("%s %.3f", F.when(F.col("direction") == "below", "<").otherwise(">"), "limit"))
    place = F.expr("row_number() OVER (ORDER BY CASE WHEN status = 'fail' THEN 0 ELSE 1 END, metric)")  # a report has a few lines
    return m.select(place.alias("place"), "metric", gate.alias("gate"), F.when(F.col("latest").isNull(), "-").otherwise(F.format_string("%.4f", F.round("latest", 4))).alias("shown"), "status")


def mean_iou(spark: SparkSession, folder: str) -> DataFrame:
    """The unweighted mean over components, and how many there are; without any it is null."""
    return evaluation.level_iou(spark, folder).agg(F.round(F.avg("iou"), 5).alias("mean_iou"), F.count("*").alias("n"))


def centre_steps(spark: SparkSession, folder: str) -> DataFrame:
    """How much successive centres of a track differ on the mean of their coordinates, per pass."""
    p = placed(spark, folder).select("pass_id", "center_veh", F.expr("lag(center_veh) OVER (PARTITION BY pass_id, id ORDER BY t_ns)").alias("b")).filter("b IS NOT NULL")
    step = F.aggregate(F.zip_with("center_veh", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 3
    return p.select("pass_id", step.alias("s")).groupBy("pass_id").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean_step"), F.round(F.max("s"), 6).alias("most"))


def paired_by_place(spark: SparkSession, folder: str) -> DataFrame:
    """Frames and ego states of a pass cut to the shorter of the two and paired by place: how far apart in time they lie."""
    def placed_(table: str, name: str) -> DataFrame:
        t = read_table(spark, folder, table).filter("t_ns IS NOT NULL AND t_ns <> 0").select("pass_id", F.col("t_ns").alias(name)).distinct()
        return t.withColumn("i", F.expr(f"row_number() OVER (PARTITION BY pass_id ORDER BY {name})"))

    j = placed_("video_frames", "a").join(placed_("ego_states", "b"), ["pass_id", "i"])
    return j.groupBy("pass_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("most_ns"))


QUERIES = {q.__name__: q for q in (accumulated_maps, seen_maps, enclosing_boxes, baseline_swept, cluster_sizes, largest_passes, merged_obstacles, dangling_obstacles, metric_lines, mean_iou, centre_steps, paired_by_place)}

_HITS = f"""ht AS (SELECT pass_id, ci, cj, t_ns AS t, max(z) AS z FROM cl WHERE ci >= 0 AND ci < {_N} AND cj >= 0 AND cj < {_N} AND z BETWEEN {S.HEIGHT_BAND[0]} AND {S.HEIGHT_BAND[1]} GROUP BY 1, 2, 3, 4), fin AS (SELECT pass_id, max(t_ns) AS fin FROM obs GROUP BY 1),
 sg AS (SELECT *, sum(new) OVER (PARTITION BY pass_id, ci, cj ORDER BY t) AS n FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY pass_id, ci, cj ORDER BY t) <= 2000000000 THEN 0 ELSE 1 END AS new FROM ht)),
 ac AS (SELECT pass_id, ci, cj, height, last_seen, last_z, fin FROM (SELECT pass_id, ci, cj, n, max(z) AS height, max(t) AS last_seen, arg_max(z, t) AS last_z, row_number() OVER (PARTITION BY pass_id, ci, cj ORDER BY n DESC) AS k FROM sg GROUP BY 1, 2, 3, 4) JOIN fin USING (pass_id) WHERE k = 1 AND fin - last_seen <= 2000000000)"""
_XY = f"(ci + 0.5::DOUBLE) * {MAP_CELL} - {MAP_SIZE / 2} AS px, (cj + 0.5::DOUBLE) * {MAP_CELL} - {MAP_SIZE / 2} AS py"
_IN = f"coalesce(px > 1e-6 AND 900 * -py / px + 639.5 >= 0 AND 900 * -py / px + 639.5 < 1280 AND 900 * 1.5 / px + 359.5 >= 0 AND 900 * 1.5 / px + 359.5 < 720 AND sqrt(px * px + py * py) <= {SEEN_RANGE}, false)"

ORACLES = {
    "accumulated_maps": f"WITH {_OBS}, {_CELLS}, {_HITS} SELECT pass_id, ci, cj, round(height, 6) AS height, last_seen FROM ac",
    "seen_maps": f"WITH {_OBS}, {_CELLS}, {_HITS} SELECT pass_id, ci, cj, round(CASE WHEN seen THEN last_z ELSE height END, 6) AS height, last_seen FROM (SELECT *, {_IN} AS seen FROM (SELECT *, {_XY} FROM ac)) WHERE NOT seen OR last_seen = fin",
    "cluster_sizes": f"WITH m AS ({perception.ORACLES['map_clusters']}) SELECT pass_id, count(*)::INT AS n, string_agg(n_cells::VARCHAR, ',' ORDER BY n_cells DESC) AS sizes FROM m GROUP BY 1",
    "largest_passes": "SELECT rig_id, pass_id, n AS n_frames, n_passes FROM (SELECT *, row_number() OVER (PARTITION BY rig_id ORDER BY n DESC, pass_id) AS k, count(*) OVER (PARTITION BY rig_id) AS n_passes FROM (SELECT rig_id, pass_id, count(*) AS n FROM video_frames GROUP BY 1, 2)) WHERE k = 1",
    "merged_obstacles": f"""WITH {_OBS}, o AS (SELECT DISTINCT pass_id, id, source FROM obs), t AS (SELECT pass_id, max(id) AS top FROM o WHERE source = 'detector' GROUP BY 1)
 SELECT pass_id, id, source FROM o WHERE source = 'detector' UNION ALL SELECT o.pass_id, id + coalesce(top, 0), source FROM o LEFT JOIN t ON t.pass_id = o.pass_id WHERE source = 'occupancy'""",
    "dangling_obstacles": f"WITH {_FRAMES}, {_COMP} SELECT pass_id, obstacle_id, count(*) AS n_rows FROM comp WHERE obstacle_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM obstacles o WHERE o.pass_id = comp.pass_id AND o.id = comp.obstacle_id) GROUP BY 1, 2",
    "metric_lines": f"""WITH m AS ({evaluation.ORACLES["metric_report"]}) SELECT row_number() OVER (ORDER BY CASE WHEN status = 'fail' THEN 0 ELSE 1 END, metric)::INT AS place, metric, CASE WHEN "limit" IS NULL THEN '-' ELSE CASE direction WHEN 'below' THEN '<' ELSE '>' END || ' ' || printf('%.3f', "limit") END AS gate, coalesce(printf('%.4f', round(latest, 4)), '-') AS shown, status FROM m""",
    "mean_iou": f"WITH m AS ({evaluation.ORACLES['level_iou']}) SELECT round(avg(iou), 5) AS mean_iou, count(*) AS n FROM m",
    "centre_steps": f"""WITH {_OBS}, s AS (SELECT pass_id, (abs(x - lag(x) OVER w) + abs(y - lag(y) OVER w) + abs(z - lag(z) OVER w)) / 3 AS s FROM obs WINDOW w AS (PARTITION BY pass_id, id ORDER BY t_ns)) SELECT pass_id, count(*) AS n, round(avg(s), 6) AS mean_step, round(max(s), 6) AS most FROM s WHERE s IS NOT NULL GROUP BY 1""",
    "paired_by_place": """WITH a AS (SELECT pass_id, t_ns AS a, row_number() OVER (PARTITION BY pass_id ORDER BY t_ns) AS i FROM (SELECT DISTINCT pass_id, t_ns FROM video_frames WHERE t_ns <> 0)), b AS (SELECT pass_id, t_ns AS b, row_number() OVER (PARTITION BY pass_id ORDER BY t_ns) AS i FROM (SELECT DISTINCT pass_id, t_ns FROM ego_states WHERE t_ns <> 0))
 SELECT pass_id, count(*) AS n, max(abs(a - b)) AS most_ns FROM a JOIN b USING (pass_id, i) GROUP BY 1""",
}
