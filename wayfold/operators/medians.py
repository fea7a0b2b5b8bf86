"""Exact quantiles per group, found by way of mergeable quantile sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.sources.checkpoints import cut, join_small

#: Size parameter of the sketches; rank error is about 0.0024.
SKETCH_K = 2048
#: Half widths, as ranks, of the brackets that are put around a quantile: the next one for groups that the one before missed.
BRACKETS = (0.005, 0.05, 1.0)


def _finite(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))


def context_sketches(df: DataFrame, source: list[str], context: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """``source..., context, sketch``: a mergeable quantile sketch of the finite values of each context.

    Null and non-finite values are passed over; a context without any has no row.
    """
    return _finite(df, value).groupBy(*source, context).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: list[str], ranks: dict[str, float]) -> DataFrame:
    """Merges sketches to the groups ``by`` and reads quantiles off them."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("_merged"))
    return merged.select(*by, *[F.kll_sketch_get_quantile_double("_merged", F.lit(float(r))).alias(n) for n, r in ranks.items()])


def _same(by: list[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{other}{i}")) for i, c in enumerate(by)])


def _within(values: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """``by..., _rank, _p, _value``: the quantile of each row of ``bounds`` (``_g0..., _rank, _p, _lo, _hi``); null where it lies outside."""
    met = join_small(values, bounds, _same(by, "_g"))
    # Values outside the bracket fall together to one row per side before they are shuffled.
    side = F.when(F.col("_v") < F.col("_lo"), F.lit(float("-inf"))).when(F.col("_v") > F.col("_hi"), F.lit(float("inf"))).otherwise(F.col("_v"))
    keys = [*by, "_rank", "_p"]
    counted = met.select(*keys, side.alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    over = "PARTITION BY " + ", ".join(f"`{c}`" for c in keys)
    placed = counted.withColumn("_to", F.expr(f"sum(_c) OVER ({over} ORDER BY _v)")).withColumn("_at", F.expr(f"_p * (sum(_c) OVER ({over}) - 1)"))
    holds = lambda place: (F.col("_to") > place) & (F.col("_to") - F.col("_c") <= place)
    two = placed.groupBy(*keys, "_at").agg(F.max(F.when(holds(F.floor("_at")), F.col("_v"))).alias("_a"), F.max(F.when(holds(F.ceil("_at")), F.col("_v"))).alias("_b"))
    value = F.col("_a") + (F.col("_at") - F.floor("_at")) * (F.col("_b") - F.col("_a"))
    inside = (F.abs("_a") < F.lit(float("inf"))) & (F.abs("_b") < F.lit(float("inf")))
    return two.select(*keys, F.when(inside, value).alias("_value"))


def exact_quantiles(df: DataFrame, by: list[str], context: str, value: str, ranks: dict[str, float], k: int = SKETCH_K) -> DataFrame:
    """``by...`` and one column per name in ``ranks``: the exact quantile at that rank (0 to 1) of the non-null
    finite values, linear between the two values around it.  Groups without any value have no row; null groups count as one.

    Sketches per (by, context) are merged to one per group, which brackets the quantile; values outside are
    only counted and the few inside are ordered, so no task holds a group's values.  A group whose bracket
    should miss is done again with a wider one, at last with the whole range.
    """
    values = _finite(df, value).select(*by, F.col(value).cast("double").alias("_v"))
    sketches = context_sketches(df.select(*by, context, F.col(value).cast("double").alias("_v")), by, context, "_v", k)
    merged = cut(sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("_merged")))
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]

    def bracket(p: float, width: float) -> tuple[Column, Column]:
        at = lambda rank: F.kll_sketch_get_quantile_double("_merged", F.lit(rank))
        return at(p - width) if p > width else F.lit(float("-inf")), at(p + width) if p + width < 1 else F.lit(float("inf"))

    done = left = None
    for width in BRACKETS:
        asked = [F.struct(F.lit(n).alias("_rank"), F.lit(float(p)).alias("_p"), *[c.alias(x) for x, c in zip(("_lo", "_hi"), bracket(float(p), width))]) for n, p in ranks.items()]
        bounds = merged.select(*groups, F.inline(F.array(*asked)))
        if left is not None:
            bounds = bounds.join(left, _same([f"_g{i}" for i in range(len(by))], "_m") & (F.col("_rank") == F.col("_mrank")), "left_semi")
        found = cut(_within(values, bounds, by))
        hit = found.filter("_value IS NOT NULL")
        done = hit if done is None else done.unionAll(hit)
        left = found.filter("_value IS NULL").select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(by)], F.col("_rank").alias("_mrank"))
        if not left.take(1):
            break
    return done.groupBy(*by).agg(*[F.max(F.when(F.col("_rank") == n, F.col("_value"))).alias(n) for n in ranks])


def exact_medians(df: DataFrame, source: list[str], context: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """``source..., median``: see :func:`exact_quantiles`."""
    return exact_quantiles(df, source, context, value, {"median": 0.5}, k)
