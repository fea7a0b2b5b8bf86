"""The ladder of alert levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The level names in order of rank.
LEVELS = ["none", "caution", "warning", "critical"]


def level_rank(c: Column | str) -> Column:
    """Rank 0 to 3 of a level however it is written: any case, padding and punctuation, cut short as far
    as it stays the only name that begins so, or the rank itself; null for anything else."""
    bare = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    out = F.when(bare.rlike("^[0-3]$"), bare.cast("int"))
    for rank, name in enumerate(LEVELS):
        least = next(n for n in range(1, len(name) + 1) if sum(x.startswith(name[:n]) for x in LEVELS) == 1)
        out = out.when((F.length(bare) >= least) & F.startswith(F.lit(name), bare), rank)
    return out
