"""Queries that look for broken records, and the sweep over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import frames as G
from wayfold.functions import settings as S
from wayfold.functions.text import day, digest16, padded
from wayfold.operators import sweep
from wayfold.operators.levels import level_rank
from wayfold.operators.nearest import nearest_in_time
from wayfold.plans.capture import _ego
from wayfold.plans.perception import placed
from wayfold.sources.tables import read_table

#: How far in time an ego state may lie from an obstacle that it is swept with.
EGO_TOLERANCE_NS = 60_000_000


def _violations(df: DataFrame, row: str, rules: dict) -> DataFrame:
    """``rule, row_no`` of each broken rule; an unknown outcome counts as kept."""
    broken = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return df.select(F.explode(F.array_compact(broken)).alias("rule"), F.col(row).alias("row_no"))


def obstacle_violations(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "obstacles")
    rules = {
        "no instant": F.col("t_ns").isNull(), "negative instant": F.col("t_ns") < 0, "no kind": F.col("kind").isNull(), "no centre": F.col("center_veh").isNull(),
        "extent not positive": F.exists("extent", lambda x: x <= 0), "deviation not positive": F.col("pos_sigma_m") <= 0,
        "unknown kind": ~F.col("kind").isin("person", "cyclist", "vehicle", "static_geom", "unknown"), "centre not finite": F.exists("center_veh", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))),
    }
    return _violations(o, "obs_row", rules)


def frame_violations(spark: SparkSession, folder: str) -> DataFrame:
    f = read_table(spark, folder, "risk_frames")
    p = F.col("per_component")
    rules = {
        "probability outside 0..1": (F.col("p_any_contact") < 0) | (F.col("p_any_contact") > 1), "negative damage": F.col("expected_damage") < 0,
        "negative time to contact": F.exists(p, lambda c: c["ttc_s"] < 0), "negative distance": F.exists(p, lambda c: c["min_distance_m"] < 0),
        "worst component not listed": (F.size(p) > 0) & ~F.exists(p, lambda c: c["component"] == F.col("worst_component")), "unreadable level": F.col("alert_level").isNotNull() & level_rank("alert_level").isNull(),
        "component listed twice": F.size(F.array_distinct(F.transform(p, lambda c: c["component"]))) < F.size(p), "old schema": F.col("schema_version") < 2,
    }
    return _violations(f, "risk_row", rules)


def record_violations(spark: SparkSession, folder: str) -> DataFrame:
    r = read_table(spark, folder, "raw_records")
    rules = {
        "no digest": digest16("sha256").isNull(), "no date": F.col("date").isNull(), "date not iso": ~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "unknown split": ~padded("split").isin("dev", "val", "test"),
        "no backup": F.coalesce(F.size("backups"), F.lit(0)) <= 0, "not verified": ~F.col("verified"), "no size": F.coalesce(F.col("size_bytes"), F.lit(0)) <= 0,
    }
    return _violations(r, "rec_no", rules)


def id_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Record ids that stand more than once, with whether the rows agree on digest and day."""
    r = read_table(spark, folder, "raw_records").select("id", digest16("sha256").alias("d"), day("date").alias("day"), "rec_no")
    g = r.groupBy("id").agg(F.count("*").alias("n"), F.min("rec_no").alias("first_rec_no"), F.count_distinct("d").alias("n_digests"), F.count_distinct("day").alias("n_days"))
    return g.filter("n > 1")


def passes_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Passes that one stream has and another hasn't."""
    names = {"video_frames": "frames", "ego_states": "ego", "obstacles": "obstacles", "risk_frames": "risk", "timing_reports": "timing"}
    all_ = None
    for table, label in names.items():
        one = read_table(spark, folder, table).select("pass_id", F.lit(label).alias("stream")).distinct()
        all_ = one if all_ is None else all_.unionAll(one)
    g = all_.groupBy("pass_id").agg(F.array_sort(F.collect_set("stream")).alias("has"))
    return g.filter(F.size("has") < len(names)).select("pass_id", F.concat_ws(",", "has").alias("has"))


def split_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Record ids filed under more than one split."""
    r = read_table(spark, folder, "raw_records").select("id", padded("split").alias("split")).filter("split IS NOT NULL")
    return r.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("k")).filter("k > 1").drop("k")


def swept_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Reachable clearances of the vehicle's components at each instant of an obstacle, with the nearest ego
    state of the pass, at most ``EGO_TOLERANCE_NS`` away (the earlier of two equally near); ``t_ns`` is the
    obstacle's.  The way is the fan's curve nearest to the state's.  Instants without such a state can't be swept and have no row."""
    k = G.curvature_of(F.col("yaw_rate_radps"), F.col("speed_mps"))
    fan = F.array_min(F.array(*[F.struct(F.abs(k - F.lit(c)).alias("d"), F.lit(c).alias("c")) for c in S.CURVATURES]))["c"]
    state = F.struct("t_ns", F.col("speed_mps").alias("speed"), fan.alias("curvature"))
    o = placed(spark, folder).filter("forall(extent, v -> v > 0 AND v < 50) AND size(extent) = 3")
    o = o.select("pass_id", "t_ns", F.col("id").alias("obstacle_id"), "x", "y", "z", *[F.expr(f"extent[{i}]").alias(f"s{c}") for i, c in enumerate("xyz")])
    e = nearest_in_time(o.select("pass_id", "t_ns").distinct(), _ego(spark, folder).select("pass_id", "t_ns", state.alias("state")), "pass_id", "t_ns", "state", tolerance=EGO_TOLERANCE_NS)
    e = e.filter("state IS NOT NULL").select("pass_id", "t_ns", "state.speed", "state.curvature")
    pairs = sweep.swept_pairs(e, o, sweep.component_table(spark))
    return sweep.reachable(pairs).withColumns({c: F.round(c, 6) for c in ("min_distance_m", "ttc_s", "t_closest_s")})


QUERIES = {q.__name__: q for q in (obstacle_violations, frame_violations, record_violations, id_repeats, passes_unmatched, split_leaks, swept_frames)}


def _union(table: str, row: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, {row} AS row_no FROM {table} WHERE {c}" for n, c in rules.items())


_D = "regexp_replace(regexp_replace(lower(trim(sha256)), '^(sha-?256\\W*)?(0x)?', ''), '[^0-9a-f]', '', 'g')"
_RD = f"(SELECT *, CASE WHEN length({_D}) >= 16 AND NOT regexp_matches({_D}, '^0+$') THEN substr({_D}, 1, 16) END AS d, CASE WHEN regexp_matches(date, '^\\d{{2}}\\.') THEN substr(date, 7, 4) || substr(date, 4, 2) || substr(date, 1, 2) ELSE replace(date, '-', '') END AS day FROM raw_records)"
_B = "regexp_replace(lower(alert_level), '[^a-z0-9]', '', 'g')"
ORACLES = {
    "obstacle_violations": _union("obstacles", "obs_row", {
        "no instant": "t_ns IS NULL", "negative instant": "t_ns < 0", "no kind": "kind IS NULL", "no centre": "center_veh IS NULL", "extent not positive": "len(list_filter(extent, lambda x: x <= 0)) > 0", "deviation not positive": "pos_sigma_m <= 0",
        "unknown kind": "kind NOT IN ('person', 'cyclist', 'vehicle', 'static_geom', 'unknown')", "centre not finite": "len(list_filter(center_veh, lambda x: NOT isfinite(x))) > 0",
    }),
    "frame_violations": _union("risk_frames", "risk_row", {
        "probability outside 0..1": "p_any_contact < 0 OR p_any_contact > 1", "negative damage": "expected_damage < 0", "negative time to contact": "len(list_filter(per_component, lambda c: c.ttc_s < 0)) > 0", "negative distance": "len(list_filter(per_component, lambda c: c.min_distance_m < 0)) > 0",
        "worst component not listed": "len(per_component) > 0 AND worst_component IS NOT NULL AND len(list_filter(per_component, lambda c: c.component = worst_component)) = 0", "unreadable level": f"alert_level IS NOT NULL AND NOT (regexp_matches({_B}, '^[0-3]$') OR (length({_B}) >= 1 AND {_B} NOT IN ('c') AND (starts_with('none', {_B}) OR starts_with('caution', {_B}) OR starts_with('warning', {_B}) OR starts_with('critical', {_B}))))",
        "component listed twice": "len(list_distinct(list_transform(per_component, lambda c: c.component))) < len(per_component)", "old schema": "schema_version < 2",
    }),
    "record_violations": _union(_RD, "rec_no", {
        "no digest": "d IS NULL", "no date": "date IS NULL", "date not iso": "NOT regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$')", "unknown split": "lower(trim(split)) NOT IN ('dev', 'val', 'test')", "no backup": "coalesce(len(backups), 0) <= 0", "not verified": "NOT verified", "no size": "coalesce(size_bytes, 0) <= 0",
    }),
    "id_repeats": f"SELECT id, count(*) AS n, min(rec_no) AS first_rec_no, count(DISTINCT d) AS n_digests, count(DISTINCT day) AS n_days FROM {_RD} GROUP BY 1 HAVING count(*) > 1",
    "passes_unmatched": "SELECT pass_id, string_agg(s, ',' ORDER BY s) AS has FROM (SELECT DISTINCT pass_id, 'frames' AS s FROM video_frames UNION SELECT DISTINCT pass_id, 'ego' FROM ego_states UNION SELECT DISTINCT pass_id, 'obstacles' FROM obstacles UNION SELECT DISTINCT pass_id, 'risk' FROM risk_frames UNION SELECT DISTINCT pass_id, 'timing' FROM timing_reports) GROUP BY 1 HAVING count(*) < 5",
    "split_leaks": "SELECT id, string_agg(DISTINCT lower(trim(split)), ',' ORDER BY lower(trim(split))) AS splits FROM raw_records WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1",
}
