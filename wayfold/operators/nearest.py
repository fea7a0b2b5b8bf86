"""Matching of records by nearest time within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, t: str, right_id: str, *, tolerance: int) -> DataFrame:
    """``left`` with ``right_id`` and ``dt_ns`` of the row of ``right`` nearest in time for the same entity.

    Only differences up to ``tolerance`` count; of equals the smallest ``right_id`` is taken; both columns
    are null where there is none, where the entity or ``t`` is null, or ``right`` is empty.  Every row of
    ``left`` comes back once, repeated ones too; columns of ``left`` named like the two are replaced.

    Time falls into buckets of the tolerance's width, and rows meet on entity and bucket.  A row needs
    all instants of its own bucket but only the last one of the bucket before and the first one of the
    bucket after.  Rows of ``right`` at one instant fall together first, so a bucket holds as many
    entries as there are distinct instants of one entity in one tolerance, whatever is repeated.
    """
    tol = f"{int(tolerance)}L"
    instants = right.filter(F.col(t).isNotNull() & F.col(entity).isNotNull() & F.col(right_id).isNotNull()).groupBy(entity, t).agg(F.min(right_id).alias("_id"))
    own = instants.select(entity, F.expr(f"(`{t}` - pmod(`{t}`, {tol})) div {tol}").alias("_b"), F.col(t).alias("_t"), "_id")
    item = F.struct(F.col("_t").alias("t"), F.col("_id").alias("id"))
    cells = own.groupBy(entity, "_b").agg(F.collect_list(item).alias("_all"), F.min(item).alias("_first"), F.max(item).alias("_last"))
    # Each bucket's entries go to itself and, one each, to the two beside it.
    sent = cells.select(entity, F.inline(F.expr("array(struct(_b - 1 AS _b, array(_first) AS _items), struct(_b AS _b, _all AS _items), struct(_b + 1 AS _b, array(_last) AS _items))")))
    near = sent.groupBy(entity, "_b").agg(F.flatten(F.collect_list("_items")).alias("_items"))
    near = near.select(F.col(entity).alias("__near_entity"), F.col("_b").alias("__near_bucket"), F.col("_items").alias("__near_items"))
    bucket = F.expr(f"(`{t}` - pmod(`{t}`, {tol})) div {tol}")
    met = left.join(near, (F.col(entity) == F.col("__near_entity")) & (bucket == F.col("__near_bucket")), "left")
    best = F.expr(f"array_min(filter(transform(__near_items, x -> struct(abs(x.t - `{t}`) AS d, x.id AS id)), x -> x.d <= {tol}))")
    kept = [c for c in left.columns if c not in (right_id, "dt_ns")]
    return met.withColumn("__near_best", best).select(*kept, F.col("__near_best.id").alias(right_id), F.col("__near_best.d").alias("dt_ns"))
