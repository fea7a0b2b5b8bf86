"""Queries over the vehicle's own motion, and scores of what was seen against where it stood."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import frames as G
from wayfold.functions import settings as S
from wayfold.operators import odometry as O
from wayfold.operators import timing as T
from wayfold.plans.capture import _REPORT, _ego, _ego_sql
from wayfold.plans.perception import _BUCKET, _OBS, placed
from wayfold.sources.tables import read_table


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    """Poses of each pass, chained from speed and yaw rate, each step along the heading before it (``x, y``) and along
    the heading midway (``mx, my``)."""
    over, before = "OVER (PARTITION BY pass_id ORDER BY t_ns)", "OVER (PARTITION BY pass_id ORDER BY t_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    e = _ego(spark, folder).select("pass_id", "t_ns", "speed_mps", "yaw_rate_radps", F.expr(f"coalesce((lead(t_ns) {over} - t_ns) / 1e9D, 0D)").alias("dt"))
    e = e.withColumn("yaw", F.expr(f"coalesce(sum(yaw_rate_radps * dt) {before}, 0D)")).withColumn("d", F.expr("speed_mps * dt")).withColumn("mid", F.expr("yaw + yaw_rate_radps * dt / 2"))
    steps = {"x": "d * cos(yaw)", "y": "d * sin(yaw)", "mx": "d * cos(mid)", "my": "d * sin(mid)"}
    return e.select("pass_id", "t_ns", "yaw", *[F.expr(f"coalesce(sum({s}) {before}, 0D)").alias(n) for n, s in steps.items()])


def pose_motions(spark: SparkSession, folder: str) -> DataFrame:
    """Speed and yaw rate read back from the chained poses."""
    return O.pose_motions(_chain(spark, folder), "pass_id", "t_ns").withColumns({c: F.round(c, 4) for c in ("speed_mps", "yaw_rate_radps")})


def path_drifts(spark: SparkSession, folder: str) -> DataFrame:
    """How far the chain along earlier headings ends from the one along midway headings."""
    c = _chain(spark, folder).groupBy("pass_id").agg(*[f(F.struct("x", "y", "mx", "my", "yaw"), "t_ns").alias(n) for n, f in (("a", F.min_by), ("b", F.max_by))])
    ends = c.select("pass_id", *[F.col(f"{r}.{c}").alias(f"{p}{q}{i}") for p, (x, y) in (("e", ("x", "y")), ("t", ("mx", "my"))) for i, r in enumerate("ab") for c, q in ((x, "x"), (y, "y"), ("yaw", "a"))])
    d = O.drift(ends).filter("displacement_m >= 1")
    return d.select("pass_id", *[F.round(c, 5).alias(c) for c in ("displacement_m", "endpoint_error_m", "drift_frac", "heading_error_deg")])


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "video_frames").filter("t_ns IS NOT NULL AND t_ns <> 0").select("pass_id", "t_ns").distinct()


def frame_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The turn between successive frames by the yaw rates between them, their number and mean."""
    r = O.running_integral(_ego(spark, folder, "yaw_rate_radps"), _frames(spark, folder), "pass_id", "t_ns", "yaw_rate_radps")
    over = "OVER (PARTITION BY pass_id ORDER BY t_ns)"
    d = r.select("pass_id", "t_ns", *[F.expr(f"{a} - lag({b}) {over}").alias(n) for n, a, b in (("turn", "integral", "integral"), ("n", "upto", "below"), ("s", "sum_upto", "sum_below"))]).filter("n IS NOT NULL")
    return d.select("pass_id", "t_ns", F.round("turn", 7).alias("turn"), "n", F.round(F.coalesce(F.try_divide("s", "n"), F.lit(0.0)), 6).alias("mean_rate"))


def turn_axes(spark: SparkSession, folder: str) -> DataFrame:
    """The axis about which each pass turns, of rates read in a sensor tilted by speed."""
    e = _ego(spark, folder).select("pass_id", "yaw_rate_radps", (F.col("speed_mps") * 0.01).alias("wx"), (F.col("yaw_rate_radps") * 0.1 - F.col("speed_mps") * 0.02).alias("wy"), F.col("yaw_rate_radps").alias("wz"))
    return O.turn_axis(e, "pass_id", ["wx", "wy", "wz"], "yaw_rate_radps").withColumns({f"a{c}": F.round(f"a{c}", 6) for c in "xyz"})


def coasted_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The way of each pass where readings that can't be used are coasted with the last usable speed, and how many were."""
    e = read_table(spark, folder, "ego_states").filter("t_ns IS NOT NULL").groupBy("pass_id", "t_ns").agg(F.min_by("speed_mps", "ego_row").alias("v"))
    over = "OVER (PARTITION BY pass_id ORDER BY t_ns)"
    good = "CASE WHEN NOT isnan(v) AND abs(v) < 100 THEN v END"
    c = e.select("pass_id", F.expr(f"{good} IS NULL").alias("lost"), F.expr(f"last({good}, true) {over}").alias("held"), F.expr(f"(lead(t_ns) {over} - t_ns) / 1e9D").alias("dt"))
    return c.groupBy("pass_id").agg(F.count("*").alias("n"), F.count_if("lost").alias("n_lost"), F.round(F.sum(F.abs(F.coalesce("held", F.lit(0.0))) * F.col("dt")), 5).alias("way_m"))


TRACK, TRACK_TOLERANCE = 1.6, 1.2


def hub_poses(spark: SparkSession, folder: str) -> DataFrame:
    """A pose per pass from two marks, the first places of its two lowest tracks as left and right hub; whether they lie as far apart
    as the track, and where the third track's first place stands in that pose."""
    first = placed(spark, folder).groupBy("pass_id", "id").agg(F.min_by(F.struct("x", "y"), "t_ns").alias("p"))
    r = first.select("pass_id", "p", F.expr("row_number() OVER (PARTITION BY pass_id ORDER BY id)").alias("k")).filter("k <= 3")
    m = r.groupBy("pass_id").agg(*[F.max(F.when(F.col("k") == k, F.col(f"p.{c}"))).alias(f"{c}{k}") for k in (1, 2, 3) for c in "xy"]).filter("x2 IS NOT NULL")
    span = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    m = m.withColumn("span", span).withColumns({"ux": F.try_divide(F.col("y1") - F.col("y2"), "span"), "uy": F.try_divide(F.col("x2") - F.col("x1"), "span"), "ox": F.expr("(x1 + x2) / 2"), "oy": F.expr("(y1 + y2) / 2")})
    fx = F.col("ux") * (F.col("x3") - F.col("ox")) + F.col("uy") * (F.col("y3") - F.col("oy"))
    fy = F.col("ux") * (F.col("y3") - F.col("oy")) - F.col("uy") * (F.col("x3") - F.col("ox"))
    why = F.when(F.abs(F.col("span") - TRACK) > TRACK_TOLERANCE, "span").when(fx < 0, "swapped").otherwise("ok")
    return m.select("pass_id", F.round("span", 6).alias("span"), *[F.round(c, 6).alias(n) for n, c in (("ox", F.col("ox")), ("oy", F.col("oy")), ("front_x", fx), ("front_y", fy))], why.alias("verdict"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Where static tracks first stood in each pass's window (1.5 s from its start, 1 s long), against all that was seen there."""
    o = placed(spark, folder).join(placed(spark, folder).groupBy(F.col("pass_id").alias("_p")).agg(F.min("t_ns").alias("_t0")), F.col("pass_id") == F.col("_p"))
    w = o.filter(F.col("t_ns").between(F.col("_t0") + 1_500_000_000, F.col("_t0") + 2_500_000_000)).withColumn("frame", F.expr("(t_ns - _t0) div 100000000"))
    truth = w.filter("source = 'occupancy'").groupBy("pass_id", "id").agg(F.min_by(F.struct("x", "y"), "t_ns").alias("p")).select("pass_id", "id", F.col("p.x").alias("tx"), F.col("p.y").alias("ty"))
    return O.nearest_found(truth, w.select("pass_id", "frame", "x", "y", F.col("obs_row").alias("ord")), w, "pass_id", "frame", 1.0)


def cone_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the places of static tracks within 15 m."""
    return _scored(spark, folder).filter("range_m <= 15").select("pass_id", "id", F.round("range_m", 6).alias("range_m"), "n_frames", "n_found", F.round("median_error_m", 6).alias("median_error_m"), (F.col("n_found") < 0.5 * F.col("n_frames")).alias("missed"))


def signed_range_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the ranges of static tracks, positive where seen too far, by the distance bucket they fall in."""
    return _scored(spark, folder).select("pass_id", "id", G.depth_bucket(F.col("range_m")).alias("bucket"), "n_found", F.round("median_signed_m", 6).alias("median_signed_m"))


def preflight_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every check of a pass with its status, and the verdict of all: NO-GO if one failed, CHECK if one warned, else GO."""
    frames = read_table(spark, folder, "video_frames")
    t = T.timing_report(frames, "pass_id", "t_ns").select("pass_id", "n_frames", "duration_s", F.size("gap_indices").alias("gaps"))
    how = frames.groupBy("pass_id").agg(F.min("rig_id").alias("rig_id"), F.max((F.lower("backend") == "opencv").cast("int")).alias("rough"))
    video = F.when((F.col("n_frames") < 2) | (F.col("duration_s") <= 0), "FAIL").when((F.coalesce("rough", F.lit(0)) == 1) | (F.col("gaps") > F.col("n_frames") * 0.02), "WARN").otherwise("OK")
    imu = _ego(spark, folder, "yaw_rate_radps").groupBy("pass_id").agg(F.count("*").alias("n_imu"), ((F.max("t_ns") - F.min("t_ns")) / 1e9).alias("imu_s"), F.max(F.abs("yaw_rate_radps")).alias("most"))
    rate = F.try_divide(F.col("n_imu") - 1, "imu_s")
    log = F.when(F.col("n_imu").isNull(), "SKIP").when((F.col("n_imu") < 2) | (F.col("most") == 0), "FAIL").when(rate < 8, "WARN").otherwise("OK")
    sync = F.when(F.col("correlation").isNull() | F.col("n_imu").isNull(), "SKIP").when(F.col("correlation") >= S.TRUSTED_CORRELATION, "OK").otherwise("WARN")
    j = t.join(how, "pass_id").join(imu, "pass_id", "left").join(read_table(spark, folder, "rig_sync").select("rig_id", "correlation"), "rig_id", "left")
    checks = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("status")) for n, c in (("timestamps", video), ("imu log", log), ("sync", sync), ("stabilisation", F.lit("SKIP")))])
    j = j.select("pass_id", checks.alias("checks"))
    verdict = F.when(F.exists("checks", lambda c: c["status"] == "FAIL"), "NO-GO").when(F.exists("checks", lambda c: c["status"] == "WARN"), "CHECK").otherwise("GO")
    return j.select("pass_id", verdict.alias("verdict"), F.inline("checks"))


def split_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded passes scored as test: those that belong to another split, to none, or to test as they should."""
    scored = read_table(spark, folder, "risk_frames").select("pass_id").distinct()
    r = read_table(spark, folder, "raw_records").select(F.col("id").alias("pass_id"), F.lower(F.trim("split")).alias("split"))
    dev, test = (r.filter(F.col("split") == s).select("pass_id").distinct() for s in ("dev", "test"))
    leaked = scored.join(dev, "pass_id", "left_semi").withColumn("why", F.lit("leaks dev"))
    rest = scored.join(dev, "pass_id", "left_anti")
    return leaked.unionAll(rest.join(test, "pass_id", "left_semi").withColumn("why", F.lit("test"))).unionAll(rest.join(test, "pass_id", "left_anti").withColumn("why", F.lit("not listed"))).groupBy("why").agg(F.count("*").alias("n"), F.min("pass_id").alias("first"))


def registration_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of a pass that have a file among all it should have, with gates on that share and on its jitter."""
    f = read_table(spark, folder, "video_frames").filter("t_ns IS NOT NULL AND t_ns <> 0").groupBy("pass_id").agg(F.count_distinct("frame_index").alias("n_frames"), F.count_distinct(F.when(F.col("file").isNotNull(), F.col("frame_index"))).alias("n_registered"))
    t = T.timing_report(read_table(spark, folder, "video_frames"), "pass_id", "t_ns").select("pass_id", "jitter_ratio")
    share = F.coalesce(F.try_divide("n_registered", "n_frames"), F.lit(0.0))
    j = f.join(t, "pass_id").withColumn("fraction", share).withColumns({"registration_ok": share >= 0.90, "jitter_ok": F.col("jitter_ratio") < 30.0})
    return j.select("pass_id", "n_frames", "n_registered", F.round("fraction", 6).alias("fraction"), "registration_ok", "jitter_ok", (F.col("registration_ok") & F.col("jitter_ok")).alias("passed"))


QUERIES = {q.__name__: q for q in (pose_motions, path_drifts, frame_turns, turn_axes, coasted_paths, hub_poses, cone_errors, signed_range_errors, preflight_checks, split_guard, registration_gates)}

_BEFORE = "OVER (PARTITION BY pass_id ORDER BY t_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_CHAIN = f"""st AS (SELECT *, coalesce((lead(t_ns) OVER (PARTITION BY pass_id ORDER BY t_ns) - t_ns) / 1e9::DOUBLE, 0) AS dt FROM ego), he AS (SELECT *, coalesce(sum(yaw_rate_radps * dt) {_BEFORE}, 0) AS yaw, speed_mps * dt AS d FROM st), hm2 AS (SELECT *, yaw + yaw_rate_radps * dt / 2 AS mid FROM he),
 ch AS (SELECT pass_id, t_ns, yaw, coalesce(sum(d * cos(yaw)) {_BEFORE}, 0) AS x, coalesce(sum(d * sin(yaw)) {_BEFORE}, 0) AS y, coalesce(sum(d * cos(mid)) {_BEFORE}, 0) AS mx, coalesce(sum(d * sin(mid)) {_BEFORE}, 0) AS my FROM hm2)"""
_SCORED = f"""o AS (SELECT obs.*, t0, (t_ns - t0) // 100000000 AS frame FROM obs JOIN (SELECT pass_id, min(t_ns) AS t0 FROM obs GROUP BY 1) USING (pass_id) WHERE t_ns BETWEEN t0 + 1500000000 AND t0 + 2500000000),
 tr AS (SELECT pass_id, id, arg_min(x, t_ns) AS tx, arg_min(y, t_ns) AS ty FROM o WHERE source = 'occupancy' GROUP BY 1, 2), nf AS (SELECT pass_id, count(DISTINCT frame) AS n_frames FROM o GROUP BY 1),
 me AS (SELECT tr.pass_id, tr.id, frame, sqrt((x - tx) ** 2 + (y - ty) ** 2) AS d, sqrt(x * x + y * y) - sqrt(tx * tx + ty * ty) AS s, obs_row FROM tr JOIN o ON o.pass_id = tr.pass_id WHERE sqrt((x - tx) ** 2 + (y - ty) ** 2) <= 1.0),
 er AS (SELECT pass_id, id, count(*) AS n_found, median(d) AS median_error_m, median(s) AS median_signed_m FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, id, frame ORDER BY d, obs_row) AS k FROM me) WHERE k = 1 GROUP BY 1, 2),
 sc AS (SELECT tr.pass_id, tr.id, sqrt(tx * tx + ty * ty) AS range_m, n_frames, coalesce(n_found, 0) AS n_found, median_error_m, median_signed_m FROM tr JOIN nf USING (pass_id) LEFT JOIN er USING (pass_id, id))"""
_WRAP = "atan2(sin({0}), cos({0}))"

ORACLES = {
    "pose_motions": f"""WITH {_ego_sql()}, {_CHAIN}, m AS (SELECT pass_id, t_ns, (cos(a0) * (x - x0) + sin(a0) * (y - y0)) / dt AS v, {_WRAP.format('(yaw - a0)')} / dt AS w FROM (SELECT *, lag(x) OVER o AS x0, lag(y) OVER o AS y0, lag(yaw) OVER o AS a0, (t_ns - lag(t_ns) OVER o) / 1e9::DOUBLE AS dt FROM ch WINDOW o AS (PARTITION BY pass_id ORDER BY t_ns)))
 SELECT pass_id, t_ns, round(coalesce(v, lead(v) OVER o, 0), 4) AS speed_mps, round(coalesce(w, lead(w) OVER o, 0), 4) AS yaw_rate_radps FROM m WINDOW o AS (PARTITION BY pass_id ORDER BY t_ns)""",
    "path_drifts": f"""WITH {_ego_sql()}, {_CHAIN}, e AS (SELECT pass_id, {', '.join(f'arg_{f}({c}, t_ns) AS {c}{i}' for i, f in enumerate(('min', 'max')) for c in ('x', 'y', 'mx', 'my', 'yaw'))} FROM ch GROUP BY 1),
 r AS (SELECT pass_id, cos(yaw0) * (x1 - x0) + sin(yaw0) * (y1 - y0) AS ex, cos(yaw0) * (y1 - y0) - sin(yaw0) * (x1 - x0) AS ey, cos(yaw0) * (mx1 - mx0) + sin(yaw0) * (my1 - my0) AS tx, cos(yaw0) * (my1 - my0) - sin(yaw0) * (mx1 - mx0) AS ty FROM e)
 SELECT pass_id, round(disp, 5) AS displacement_m, round(err, 5) AS endpoint_error_m, round(err / disp, 5) AS drift_frac, 0::DOUBLE AS heading_error_deg FROM (SELECT pass_id, sqrt(tx * tx + ty * ty) AS disp, sqrt((ex - tx) ** 2 + (ey - ty) ** 2) AS err FROM r) WHERE disp >= 1""",
    "frame_turns": f"""WITH {_ego_sql("yaw_rate_radps")}, s AS (SELECT pass_id, t_ns, yaw_rate_radps AS r FROM ego), f AS (SELECT pass_id, t_ns AS t1, lag(t_ns) OVER (PARTITION BY pass_id ORDER BY t_ns) AS t0 FROM (SELECT DISTINCT pass_id, t_ns FROM video_frames WHERE t_ns IS NOT NULL AND t_ns <> 0)), g AS (SELECT * FROM f WHERE t0 IS NOT NULL),
 seg AS (SELECT pass_id, t_ns AS a, r AS ra, lead(t_ns) OVER w AS b, lead(r) OVER w AS rb FROM s WINDOW w AS (PARTITION BY pass_id ORDER BY t_ns)), ends AS (SELECT pass_id, min(t_ns) AS first, max(t_ns) AS last, arg_min(r, t_ns) AS rf, arg_max(r, t_ns) AS rl FROM s GROUP BY 1),
 part AS (SELECT g.pass_id, g.t1, sum((greatest(a, t0) - a + (least(b, t1) - a)) / (b - a)::DOUBLE * (rb - ra) / 2 * ((least(b, t1) - greatest(a, t0)) / 1e9::DOUBLE) + ra * ((least(b, t1) - greatest(a, t0)) / 1e9::DOUBLE)) AS turn FROM g JOIN seg ON seg.pass_id = g.pass_id AND a < t1 AND b > t0 GROUP BY 1, 2),
 mean AS (SELECT g.pass_id, g.t1, count(r) AS n, avg(r) AS mean_rate FROM g LEFT JOIN s ON s.pass_id = g.pass_id AND s.t_ns BETWEEN t0 AND t1 GROUP BY 1, 2)
 SELECT g.pass_id, g.t1 AS t_ns, CASE WHEN first IS NOT NULL THEN round(coalesce(turn, 0) + rf * greatest(0, least(first, g.t1) - g.t0) / 1e9::DOUBLE + rl * greatest(0, g.t1 - greatest(last, g.t0)) / 1e9::DOUBLE, 7) END AS turn, n, round(coalesce(mean_rate, 0), 6) AS mean_rate
 FROM g JOIN mean USING (pass_id, t1) LEFT JOIN part USING (pass_id, t1) LEFT JOIN ends USING (pass_id)""",
    "turn_axes": f"""WITH {_ego_sql()}, s AS (SELECT pass_id, sum(r * (v * 0.01::DOUBLE)) AS s0, sum(r * (r * 0.1::DOUBLE - v * 0.02::DOUBLE)) AS s1, sum(r * r) AS s2 FROM (SELECT pass_id, speed_mps AS v, yaw_rate_radps AS r FROM ego) GROUP BY 1)
 SELECT pass_id, round(s0 / l, 6) AS ax, round(s1 / l, 6) AS ay, round(s2 / l, 6) AS az FROM (SELECT *, sqrt(s0 * s0 + s1 * s1 + s2 * s2) AS l FROM s WHERE s2 > 0)""",
    "coasted_paths": """WITH e AS (SELECT pass_id, t_ns, CASE WHEN isfinite(v) AND abs(v) < 100 THEN v END AS g FROM (SELECT pass_id, t_ns, speed_mps AS v, row_number() OVER (PARTITION BY pass_id, t_ns ORDER BY ego_row) AS k FROM ego_states WHERE t_ns IS NOT NULL) WHERE k = 1)
 SELECT pass_id, count(*) AS n, count_if(g IS NULL) AS n_lost, round(sum(abs(coalesce(held, 0)) * dt), 5) AS way_m FROM (SELECT *, last_value(g IGNORE NULLS) OVER (PARTITION BY pass_id ORDER BY t_ns ROWS UNBOUNDED PRECEDING) AS held, (lead(t_ns) OVER (PARTITION BY pass_id ORDER BY t_ns) - t_ns) / 1e9::DOUBLE AS dt FROM e) GROUP BY 1""",
    "hub_poses": f"""WITH {_OBS}, f AS (SELECT pass_id, id, arg_min(x, t_ns) AS x, arg_min(y, t_ns) AS y FROM obs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY id) AS k FROM f),
 m AS (SELECT pass_id, {', '.join(f'max({c}) FILTER (k = {k}) AS {c}{k}' for k in (1, 2, 3) for c in 'xy')} FROM r GROUP BY 1), p AS (SELECT *, (x1 + x2) / 2 AS ox, (y1 + y2) / 2 AS oy, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS span FROM m WHERE x2 IS NOT NULL),
 q AS (SELECT *, (y1 - y2) / span * (x3 - ox) + (x2 - x1) / span * (y3 - oy) AS fx, (y1 - y2) / span * (y3 - oy) - (x2 - x1) / span * (x3 - ox) AS fy FROM p)
 SELECT pass_id, round(span, 6) AS span, round(ox, 6) AS ox, round(oy, 6) AS oy, round(fx, 6) AS front_x, round(fy, 6) AS front_y, CASE WHEN abs(span - {TRACK}::DOUBLE) > {TRACK_TOLERANCE}::DOUBLE THEN 'span' WHEN fx < 0 THEN 'swapped' ELSE 'ok' END AS verdict FROM q""",
    "cone_errors": f"WITH {_OBS}, {_SCORED} SELECT pass_id, id, round(range_m, 6) AS range_m, n_frames, n_found, round(median_error_m, 6) AS median_error_m, n_found < 0.5 * n_frames AS missed FROM sc WHERE range_m <= 15",
    "signed_range_errors": f"WITH {_OBS}, {_SCORED} SELECT pass_id, id, {_BUCKET} AS bucket, n_found, round(median_signed_m, 6) AS median_signed_m FROM (SELECT *, range_m AS d FROM sc)",
    "preflight_checks": f"""WITH {_REPORT}, {_ego_sql("yaw_rate_radps")}, h AS (SELECT pass_id, min(rig_id) AS rig_id, coalesce(max((lower(backend) = 'opencv')::INT), 0) AS rough FROM video_frames GROUP BY 1), i AS (SELECT pass_id, count(*) AS n_imu, (max(t_ns) - min(t_ns)) / 1e9::DOUBLE AS imu_s, max(abs(yaw_rate_radps)) AS most FROM ego GROUP BY 1),
 c AS (SELECT r.pass_id, CASE WHEN n_frames < 2 OR duration_s <= 0 THEN 'FAIL' WHEN rough = 1 OR len(gap_indices) > n_frames * 0.02 THEN 'WARN' ELSE 'OK' END AS c1, CASE WHEN n_imu IS NULL THEN 'SKIP' WHEN n_imu < 2 OR most = 0 THEN 'FAIL' WHEN (n_imu - 1) / nullif(imu_s, 0) < 8 THEN 'WARN' ELSE 'OK' END AS c2,
 CASE WHEN correlation IS NULL OR n_imu IS NULL THEN 'SKIP' WHEN correlation >= {S.TRUSTED_CORRELATION} THEN 'OK' ELSE 'WARN' END AS c3 FROM r JOIN h USING (pass_id) LEFT JOIN i USING (pass_id) LEFT JOIN rig_sync USING (rig_id)),
 v AS (SELECT *, CASE WHEN 'FAIL' IN (c1, c2, c3) THEN 'NO-GO' WHEN 'WARN' IN (c1, c2, c3) THEN 'CHECK' ELSE 'GO' END AS verdict FROM c)
 SELECT pass_id, verdict, 'timestamps' AS name, c1 AS status FROM v UNION ALL SELECT pass_id, verdict, 'imu log', c2 FROM v UNION ALL SELECT pass_id, verdict, 'sync', c3 FROM v UNION ALL SELECT pass_id, verdict, 'stabilisation', 'SKIP' FROM v""",
    "split_guard": """WITH s AS (SELECT DISTINCT pass_id FROM risk_frames), d AS (SELECT DISTINCT id FROM raw_records WHERE lower(trim(split)) = 'dev'), t AS (SELECT DISTINCT id FROM raw_records WHERE lower(trim(split)) = 'test')
 SELECT why, count(*) AS n, min(pass_id) AS first FROM (SELECT pass_id, CASE WHEN pass_id IN (FROM d) THEN 'leaks dev' WHEN pass_id IN (FROM t) THEN 'test' ELSE 'not listed' END AS why FROM s) GROUP BY 1""",
    "registration_gates": f"""WITH {_REPORT}, f AS (SELECT pass_id, count(DISTINCT frame_index) AS n_frames, count(DISTINCT frame_index) FILTER (file IS NOT NULL) AS n_registered FROM video_frames WHERE t_ns IS NOT NULL AND t_ns <> 0 GROUP BY 1)
 SELECT pass_id, n_frames, n_registered, round(fraction, 6) AS fraction, fraction >= 0.9 AS registration_ok, jitter_ratio < 30 AS jitter_ok, fraction >= 0.9 AND jitter_ratio < 30 AS passed FROM (SELECT f.*, coalesce(f.n_registered / nullif(f.n_frames, 0), 0) AS fraction, jitter_ratio FROM f JOIN r USING (pass_id))""",
}
