"""Runs of equal consecutive events, each collapsed into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.sequence import BLOCK, BLOCK_NS, neighbours, with_block


def collapse_runs(df: DataFrame, key: str, t: str, rank: str, *, gap_ns: int, block: int = BLOCK_NS) -> DataFrame:
    """``key, run, rank, first_t_ns, last_t_ns, n_events, n_rows, duration_s``: one row per maximal run.

    Events of a key follow each other by ``t``; a run ends where ``rank`` changes or two successive events
    are more than ``gap_ns`` apart.  Rows at one ``t`` are one event (``n_rows`` counts them all); should
    they differ, the highest rank holds.  Rows with a null rank or ``t`` are passed over; null keys form
    one sequence.  Empty input gives no rows.

    Each event is compared with its predecessor, changes are flagged and summed up to run numbers; the
    sum runs inside time blocks, with the total of the blocks before it added, so that a key of any
    length is spread over tasks.
    """
    given = df.filter(F.col(t).isNotNull() & F.col(rank).isNotNull())
    events = given.groupBy(key, t).agg(F.max(rank).alias("rank"), F.count("*").alias("n_rows")).withColumn("event", F.struct(F.col(t).alias("t"), "rank"))
    seen = neighbours(with_block(events, t, block), [key], t, {"event": 1})
    before = F.get("event__prev", F.lit(0))
    starts = before.isNull() | (before["rank"] != F.col("rank")) | (F.col(t) - before["t"] > gap_ns)
    flagged = seen.select(key, BLOCK, t, "rank", "n_rows", starts.cast("int").alias("_new"))
    numbered = flagged.withColumn("_run", F.expr(f"sum(_new) OVER (PARTITION BY `{key}`, {BLOCK} ORDER BY `{t}`)"))
    totals = flagged.groupBy(F.col(key).alias("_key"), F.col(BLOCK).alias("_of")).agg(F.sum("_new").alias("_news"))
    offsets = totals.withColumn("_offset", F.expr("sum(_news) OVER (PARTITION BY _key ORDER BY _of) - _news"))
    placed = numbered.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col(BLOCK) == F.col("_of")))
    return (
        placed.groupBy(key, (F.col("_run") + F.col("_offset")).alias("run"))
        .agg(F.max("rank").alias("rank"), F.min(t).alias("first_t_ns"), F.max(t).alias("last_t_ns"), F.count("*").alias("n_events"), F.sum("n_rows").alias("n_rows"))
        .withColumn("duration_s", (F.col("last_t_ns") - F.col("first_t_ns")) / 1e9)
    )
