"""Queries over risk frames: severity, grading, aggregation, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import settings as S
from wayfold.operators import risk as R
from wayfold.operators.levels import LEVELS, level_rank
from wayfold.sources.tables import read_table


def distinct_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Risk frames with set ``t_ns``, one per pass and instant: the row that arrived first (smallest number)."""
    frames = read_table(spark, folder, "risk_frames").filter("t_ns IS NOT NULL")
    cols = ["risk_row", "rig_id", "ego_speed_mps", "per_component", "p_any_contact", "expected_damage", "worst_component", "alert_level"]
    return frames.groupBy("pass_id", "t_ns").agg(F.min_by(F.struct(*cols), "risk_row").alias("r")).select("pass_id", "t_ns", "r.*")


def _risks(spark: SparkSession, folder: str, keep_empty: bool = False) -> DataFrame:
    return R.component_risks(R.exploded(distinct_frames(spark, folder), keep_empty), R.obstacle_kinds(read_table(spark, folder, "obstacles")))


def risk_components(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["pass_id", "t_ns", "ord", "component", "kind", F.round("new_severity", 6).alias("severity"), F.round("factor", 6).alias("factor"), F.round("new_risk", 6).alias("risk")]
    return _risks(spark, folder).select(*cols)


def risk_frames_summary(spark: SparkSession, folder: str) -> DataFrame:
    f = R.frame_risks(_risks(spark, folder, keep_empty=True))
    return f.select("pass_id", "t_ns", F.round("p_any", 6).alias("p_any"), F.round("damage", 6).alias("damage"), "worst", F.round("first_ttc", 6).alias("first_ttc"), "level", "release", "n")


def risk_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Components of each frame by risk, then distance, then place."""
    order = "ROW_NUMBER() OVER (PARTITION BY pass_id, t_ns ORDER BY new_risk DESC, min_distance_m, ord)"
    return _risks(spark, folder).select("pass_id", "t_ns", "component", F.expr(order).alias("place"))


def risk_by_component(spark: SparkSession, folder: str) -> DataFrame:
    """Per component over all frames: rows, contacts, nearest approach, mean graded level."""
    c = R.exploded(distinct_frames(spark, folder))
    level = R.graded(F.col("min_distance_m"), F.col("ttc_s"), F.col("t_closest_s"))
    return c.groupBy("component").agg(F.count("*").alias("n"), F.count("ttc_s").alias("n_contacts"), F.round(F.min("min_distance_m"), 6).alias("nearest"), F.round(F.avg(level), 6).alias("mean_level"), F.count_if(level == 3).alias("n_critical"))


def risk_probability_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Frames by level when probabilities grade too."""
    c = R.exploded(distinct_frames(spark, folder), keep_empty=True)
    level = R.graded(F.col("min_distance_m"), F.col("ttc_s"), F.col("t_closest_s"), F.col("p_contact"))
    return c.groupBy("pass_id", "t_ns").agg(F.max(level).alias("level")).groupBy("level").agg(F.count("*").alias("n_frames"))


def risk_level_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Stated against recomputed level."""
    f = distinct_frames(spark, folder).select("pass_id", "t_ns", level_rank("alert_level").alias("stated"))
    g = R.frame_risks(_risks(spark, folder, keep_empty=True)).select("pass_id", "t_ns", "level")
    return f.join(g, ["pass_id", "t_ns"], "left").groupBy("stated", "level").agg(F.count("*").alias("n_frames"))


def risk_worst_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The worst component of each pass: the highest risk, the earliest among equals."""
    return (
        _risks(spark, folder)
        .groupBy("pass_id")
        .agg(F.min(F.struct((-F.col("new_risk")).alias("r"), "t_ns", "min_distance_m", "ord", "component")).alias("w"))
        .select("pass_id", F.round(-F.col("w.r"), 6).alias("risk"), F.col("w.t_ns").alias("t_ns"), F.col("w.component").alias("component"))
    )


def risk_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Frames scored without component weights and overrides, only by the kind's multiplier, from the contacts of
    the components; the reference's one box around them isn't swept."""
    c = R.exploded(distinct_frames(spark, folder), keep_empty=True).join(R.obstacle_kinds(read_table(spark, folder, "obstacles")), ["pass_id", "obstacle_id"], "left")
    s = R.severity_for(F.col("component"), F.col("kind"), {}, {}) * R.speed_factor(F.col("ego_speed_mps")) * R.p_contact(F.col("ttc_s"))
    s = F.when(F.col("ord").isNull(), 0.0).otherwise(s)
    return c.groupBy("pass_id", "t_ns").agg(F.round(F.max(s), 6).alias("box_risk"))


QUERIES = {q.__name__: q for q in (risk_components, risk_frames_summary, risk_ranked, risk_by_component, risk_probability_levels, risk_level_agreement, risk_worst_rows, risk_baseline)}


def _case(key: str, table: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


_FRAMES = "frames AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, t_ns ORDER BY risk_row) AS rn FROM risk_frames WHERE t_ns IS NOT NULL) WHERE rn = 1)"
_COMP = "comp AS (SELECT pass_id, t_ns, ego_speed_mps, i - 1 AS ord, c.component AS component, c.min_distance_m AS min_distance_m, c.ttc_s AS ttc_s, c.t_closest_s AS t_closest_s, c.p_contact AS p_contact, c.obstacle_id AS obstacle_id FROM (SELECT *, per_component[i] AS c FROM (SELECT *, unnest(range(1, len(per_component) + 1)) AS i FROM frames)))"
_KINDS = "kinds AS (SELECT pass_id, obstacle_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, obstacle_id ORDER BY n DESC, kind) AS rn FROM (SELECT pass_id, id AS obstacle_id, kind, count(*) AS n FROM obstacles WHERE kind IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn = 1)"
_BASE = _case("component", S.SEVERITY, str(S.DEFAULT_SEVERITY))
_MULT = _case("kind", S.KIND_MULTIPLIER, "1.0")
_OVER = "CASE component || '__' || kind " + " ".join(f"WHEN '{c}__{k}' THEN {v}" for (c, k), v in S.SEVERITY_OVERRIDE.items()) + f" ELSE ({_BASE}) * ({_MULT}) END"
_FACTOR = f"CASE WHEN ego_speed_mps IS NOT NULL THEN least(greatest(abs(ego_speed_mps) / {S.REFERENCE_SPEED}, {S.LEAST_FACTOR}), {S.MOST_FACTOR}) END"
_RISKS = f"risks AS (SELECT *, (CASE WHEN ttc_s IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) * severity * factor AS risk FROM (SELECT comp.*, kind, (CASE WHEN kind IS NULL THEN {_BASE} ELSE {_OVER} END)::DOUBLE AS severity, ({_FACTOR})::DOUBLE AS factor FROM comp LEFT JOIN kinds USING (pass_id, obstacle_id)))"


def _level(extra_d: float = 0.0, extra_t: float = 0.0, with_p: bool = False) -> str:
    parts = []
    for rank in (3, 2, 1):
        d, t, p = S.LADDER[LEVELS[rank]]
        hit = f"(CASE WHEN ttc_s IS NOT NULL THEN ttc_s < {t}::DOUBLE + {extra_t}::DOUBLE ELSE coalesce(min_distance_m < {d}::DOUBLE + {extra_d}::DOUBLE, false) AND (t_closest_s IS NULL OR t_closest_s < {t}::DOUBLE + {extra_t}::DOUBLE) END)"
        if with_p:
            hit = f"({hit} OR coalesce(p_contact > {p}::DOUBLE, false))"
        parts.append(f"WHEN {hit} THEN {rank}")
    return "CASE " + " ".join(parts) + " ELSE 0 END"


_RANK = """CASE WHEN regexp_matches(b, '^[0-3]$') THEN b::INT WHEN b = '' THEN NULL WHEN starts_with('none', b) THEN 0 WHEN length(b) >= 2 AND starts_with('caution', b) THEN 1
 WHEN starts_with('warning', b) THEN 2 WHEN length(b) >= 2 AND starts_with('critical', b) THEN 3 END"""
_WITH = f"WITH {_FRAMES}, {_COMP}, {_KINDS}, {_RISKS}"
_GROUPED = f"""SELECT pass_id, t_ns, 1 - coalesce(product(1.0::DOUBLE - CASE WHEN ttc_s IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 1) AS p_any, sum(risk) AS damage,
 first(component ORDER BY risk DESC, min_distance_m NULLS FIRST, ord) AS worst, min(ttc_s) AS first_ttc, max({_level()}) AS level, max({_level(S.DISTANCE_BAND, S.TTC_BAND)}) AS release, count(*) AS n FROM risks GROUP BY 1, 2"""
_SUMMARY = f"""SELECT pass_id, t_ns, round(coalesce(p_any, 0), 6) AS p_any, round(CASE WHEN n IS NULL THEN 0 ELSE damage END, 6) AS damage, worst, round(first_ttc, 6) AS first_ttc, coalesce(level, 0) AS level, coalesce(release, 0) AS release, coalesce(n, 0) AS n
 FROM frames LEFT JOIN ({_GROUPED}) USING (pass_id, t_ns)"""

ORACLES = {
    "risk_components": f"{_WITH} SELECT pass_id, t_ns, ord::INT AS ord, component, kind, round(severity, 6) AS severity, round(factor, 6) AS factor, round(risk, 6) AS risk FROM risks",
    "risk_frames_summary": f"{_WITH} {_SUMMARY}",
    "risk_ranked": f"{_WITH} SELECT pass_id, t_ns, component, row_number() OVER (PARTITION BY pass_id, t_ns ORDER BY risk DESC NULLS LAST, min_distance_m NULLS FIRST, ord)::INT AS place FROM risks",
    "risk_by_component": f"WITH {_FRAMES}, {_COMP} SELECT component, count(*) AS n, count(ttc_s) AS n_contacts, round(min(min_distance_m), 6) AS nearest, round(avg({_level()}), 6) AS mean_level, count_if(({_level()}) = 3) AS n_critical FROM comp GROUP BY 1",
    "risk_probability_levels": f"WITH {_FRAMES}, {_COMP} SELECT coalesce(level, 0) AS level, count(*) AS n_frames FROM frames LEFT JOIN (SELECT pass_id, t_ns, max({_level(with_p=True)}) AS level FROM comp GROUP BY 1, 2) USING (pass_id, t_ns) GROUP BY 1",
    "risk_level_agreement": f"{_WITH}, g AS ({_SUMMARY}), f AS (SELECT pass_id, t_ns, {_RANK} AS stated FROM (SELECT *, regexp_replace(lower(alert_level), '[^a-z0-9]', '', 'g') AS b FROM frames)) SELECT stated, level, count(*) AS n_frames FROM f LEFT JOIN g USING (pass_id, t_ns) GROUP BY 1, 2",
    "risk_worst_rows": f"{_WITH} SELECT pass_id, round(risk, 6) AS risk, t_ns, component FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY risk DESC NULLS FIRST, t_ns, min_distance_m NULLS FIRST, ord) AS rn FROM risks) WHERE rn = 1",
    "risk_baseline": f"WITH {_FRAMES}, {_COMP}, {_KINDS} SELECT pass_id, t_ns, CASE WHEN n IS NULL THEN 0 ELSE box_risk END AS box_risk FROM frames LEFT JOIN (SELECT pass_id, t_ns, count(*) AS n, round(max((CASE WHEN kind IS NULL THEN 1.0 ELSE {_MULT} END)::DOUBLE * ({_FACTOR})::DOUBLE * CASE WHEN ttc_s IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS box_risk FROM comp LEFT JOIN kinds USING (pass_id, obstacle_id) GROUP BY 1, 2) USING (pass_id, t_ns)",
}
