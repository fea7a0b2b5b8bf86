"""Component risks and their frames: severity, grading and aggregation, in long form
``(pass_id, t_ns, component)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import settings as S
from wayfold.operators.levels import LEVELS


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def severity_for(component: Column, kind: Column, components: dict[str, float] | None = None, overrides: dict | None = None) -> Column:
    """Severity of a contact of a component with a kind of obstacle.

    An override of the pair; else the component's weight (the default if unknown) times the kind's
    multiplier (1 if unknown); with a null kind the weight alone.  The tables have a fixed few entries,
    so they are literals of the expression rather than joins.
    """
    components = S.SEVERITY if components is None else components
    overrides = S.SEVERITY_OVERRIDE if overrides is None else overrides
    base = F.coalesce(_lookup(components, component), F.lit(S.DEFAULT_SEVERITY)) if components else F.lit(S.DEFAULT_SEVERITY)
    product = base * F.coalesce(_lookup(S.KIND_MULTIPLIER, kind), F.lit(1.0))
    if overrides:
        product = F.coalesce(_lookup({f"{c}__{k}": v for (c, k), v in overrides.items()}, F.concat(component, F.lit("__"), kind)), product)
    return F.when(kind.isNull(), base).otherwise(product)


def speed_factor(speed: Column) -> Column:
    """``|v|`` over the reference speed, clamped; null for null."""
    return F.when(speed.isNotNull(), F.least(F.greatest(F.abs(speed) / S.REFERENCE_SPEED, F.lit(S.LEAST_FACTOR)), F.lit(S.MOST_FACTOR)))


def p_contact(ttc: Column) -> Column:
    """1 where a contact is predicted, else 0."""
    return F.when(ttc.isNull(), 0.0).otherwise(1.0)


def exploded(frames: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per component of a frame, with its place ``ord`` in the list; frames without any are left out,
    or with ``keep_empty`` come as one row whose ``ord`` and component fields are null."""
    each = (F.posexplode_outer if keep_empty else F.posexplode)("per_component").alias("ord", "c")
    return frames.select("pass_id", "rig_id", "t_ns", "ego_speed_mps", each).select("pass_id", "rig_id", "t_ns", "ego_speed_mps", "ord", "c.*")


def graded(distance: Column, ttc: Column, closest: Column, p: Column | None = None, *, extra_distance: float = 0.0, extra_ttc: float = 0.0) -> Column:
    """Rank of the highest level a component meets.

    With a time to contact, below the level's time; else below its distance, and the closest approach,
    where known, below its time.  With ``p`` also above its probability.  Offsets widen the thresholds.
    """
    rank = F.lit(0)
    for i, name in enumerate(LEVELS[1:], 1):
        d, t, least_p = S.LADDER[name]
        hit = F.when(ttc.isNotNull(), ttc < t + extra_ttc).otherwise(F.coalesce(distance < d + extra_distance, F.lit(False)) & (closest.isNull() | (closest < t + extra_ttc)))
        if p is not None:
            hit = hit | F.coalesce(p > least_p, F.lit(False))
        rank = F.when(hit, i).otherwise(rank)
    return rank


def any_contact(p: Column) -> Column:
    """1 - prod(1 - p) over a group; 0 for an empty one.  A probability outside [0, 1] is an error."""
    checked = F.when(p.between(0.0, 1.0), 1.0 - p).otherwise(F.when(p.isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit("probability outside [0, 1]")).cast("double")))
    return 1.0 - F.coalesce(F.product(checked), F.lit(1.0))


def component_risks(components: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds ``kind``, ``new_severity``, ``factor`` and ``new_risk`` to exploded components; ``kinds`` maps
    ``(pass_id, obstacle_id)`` to a kind, once each."""
    joined = components.join(kinds, ["pass_id", "obstacle_id"], "left")
    out = joined.withColumn("new_severity", severity_for(F.col("component"), F.col("kind"))).withColumn("factor", speed_factor(F.col("ego_speed_mps")))
    return out.withColumn("new_risk", p_contact(F.col("ttc_s")) * F.col("new_severity") * F.col("factor"))


def obstacle_kinds(obstacles: DataFrame) -> DataFrame:
    """``pass_id, obstacle_id, kind``: the kind most rows of a track name, the first in order among equals."""
    counted = obstacles.filter(F.col("kind").isNotNull()).groupBy("pass_id", F.col("id").alias("obstacle_id"), "kind").agg(F.count("*").alias("n"))
    return counted.groupBy("pass_id", "obstacle_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind"))["kind"].alias("kind"))


def frame_risks(risks: DataFrame) -> DataFrame:
    """One row per frame: ``p_any, damage, worst, first_ttc, level, n``; the worst component is that of the
    highest risk, the nearest among equals, then the first listed.  A frame without components (exploded with
    ``keep_empty``) has chance, damage, levels and ``n`` 0, and neither worst nor first."""
    return risks.groupBy("pass_id", "t_ns").agg(
        any_contact(p_contact(F.col("ttc_s"))).alias("p_any"),
        F.sum(F.when(F.col("ord").isNull(), 0.0).otherwise(F.col("new_risk"))).alias("damage"),
        F.min(F.struct((-F.col("new_risk")).alias("r"), "min_distance_m", "ord", "component"))["component"].alias("worst"),
        F.min("ttc_s").alias("first_ttc"),
        F.max(graded(F.col("min_distance_m"), F.col("ttc_s"), F.col("t_closest_s"))).alias("level"),
        F.max(graded(F.col("min_distance_m"), F.col("ttc_s"), F.col("t_closest_s"), extra_distance=S.DISTANCE_BAND, extra_ttc=S.TTC_BAND)).alias("release"),
        F.count("ord").alias("n"),
    )
