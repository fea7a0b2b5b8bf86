"""Ordered-sequence context that never needs a whole sequence in one task.

A sequence (all rows of one key) is cut into time blocks.  Windows run inside a block; what a row
needs from the blocks around it travels as a few edge values per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = "_block"
#: Ten minutes of nanoseconds.  A block is the most of one key that one task sorts.
BLOCK_NS = 600_000_000_000


def with_block(df: DataFrame, order: str, block: int = BLOCK_NS) -> DataFrame:
    """Adds the block number of each row: ``floor(order / block)``, exact for any bigint."""
    return df.withColumn(BLOCK, F.expr(f"(`{order}` - pmod(`{order}`, {block}L)) div {block}L"))


def _over(keys: list[str], order: str | None, call: str) -> Column:
    by = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"{call} OVER (PARTITION BY {by}" + (f" ORDER BY `{order}`)" if order else ")"))


def neighbours(df: DataFrame, keys: list[str], order: str, fields: dict[str, int]) -> DataFrame:
    """For each field and its reach ``k``, adds ``<field>__prev`` and ``<field>__next``: arrays of the
    up to ``k`` nearest non-null values before and after the row, nearest first.

    ``df`` carries :data:`BLOCK`, which must not fall as ``order`` rises within a key, and should hold
    each ``order`` of a key once (equal ones follow each other in no defined order).  Values are found
    across blocks, also across blocks that hold none.  Null field values are passed over; NaN is a
    value.  Rows of a null key form one sequence, as in any window.

    The keys travel as one struct (a single struct is taken as it is, and as it is partitioned), so that
    null keys meet by plain equality and the rows, wide with their neighbours by then, stay where the
    window left them when the edges are joined.
    """
    others = [c for c in df.columns if c not in keys]
    ready = len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, StructType)
    given = df.select((F.col(keys[0]) if ready else F.struct(*keys)).alias("_key"), *others)
    inner = ["_key", BLOCK]
    counted = given.withColumns({f"_upto_{f}": _over(inner, order, f"count(`{f}`)") for f in fields} | {f"_of_{f}": _over(inner, None, f"count(`{f}`)") for f in fields})

    # The first and last k values of each block, for the blocks beside it.
    head = {f: F.col(f).isNotNull() & (F.col(f"_upto_{f}") <= k) for f, k in fields.items()}
    tail = {f: F.col(f).isNotNull() & (F.col(f"_upto_{f}") > F.col(f"_of_{f}") - k) for f, k in fields.items()}
    wanted = F.lit(False)
    for f in fields:
        wanted = wanted | head[f] | tail[f]
    gathered = []
    for f in fields:
        item = F.struct(F.col(order).alias("o"), F.col(f).alias("v"))
        for side, where in (("head", head[f]), ("tail", tail[f])):
            gathered.append(F.sort_array(F.collect_list(F.when(where, item)), asc=side == "head").alias(f"_{side}_{f}"))
    edges = counted.filter(wanted).groupBy(*inner).agg(*gathered)
    values = [F.expr(f"if(size(`_{side}_{f}`) > 0, transform(`_{side}_{f}`, x -> x.v), null)").alias(f"_{side}_{f}") for f in fields for side in ("head", "tail")]
    edges = edges.select(*inner, *values)
    taken = []
    for f, k in fields.items():
        for side, call, name in (("tail", "lag", "before"), ("head", "lead", "after")):
            taken.append(F.array_compact(F.array(*[_over(["_key"], BLOCK, f"{call}(`_{side}_{f}`, {j}) IGNORE NULLS") for j in range(1, k + 1)])).alias(f"_{name}_{f}"))
    beyond = " OR ".join(f"size(`_{name}_{f}`) > 0" for f in fields for name in ("before", "after"))
    edges = edges.select(*inner, *taken).filter(beyond)

    # The same values inside the block, completed by those from beyond it.
    near = given.withColumns(
        {
            f"{f}__{name}": F.array_compact(F.array(*[_over(inner, order, f"{call}(`{f}`, {j}) IGNORE NULLS") for j in range(1, k + 1)]))
            for f, k in fields.items()
            for call, name in (("lag", "prev"), ("lead", "next"))
        }
    )
    out = near.join(edges, inner, "left")
    whole = {f"{f}__{name}": F.expr(f"if(size(`{f}__{name}`) = {k} OR `_{side}_{f}` IS NULL, `{f}__{name}`, slice(concat(`{f}__{name}`, flatten(`_{side}_{f}`)), 1, {k}))") for f, k in fields.items() for name, side in (("prev", "before"), ("next", "after"))}
    return out.select(*([F.col("_key").alias(keys[0])] if ready else [F.col(f"_key.{k}").alias(k) for k in keys]), *others, *[c.alias(n) for n, c in whole.items()])
