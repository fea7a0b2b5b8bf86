"""Splits that keep related records together, balanced by largest differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.components import connected_components
from wayfold.sources.checkpoints import cut, join_small
from wayfold.sources.shipping import ship_package

#: Bins of equal weight that each stratum is differenced into; a bin is the grain of the allocation.
BINS = 40
#: Hash buckets in which equally heavy sets are numbered.
BUCKETS = 1024
#: Sweeps over the strata in which bins may change their split, and the parts of a sweep; strata of one part move at once.
SWEEPS, COLOURS = 3, 3


def linked_sets(df: DataFrame, row_id: str, links: dict[str, Column]) -> DataFrame:
    """``row_id, first_id``: the smallest ``row_id`` of all rows tied to this one, by an equal value of any
    of ``links``, also through other rows.  Null values tie nothing; ``row_id`` is unique and not null.

    Each link value is stood for by its smallest row, so the graph has as many edges as there are
    distinct combinations of such rows, not as many as rows share a value.
    """
    rows = df.select(F.col(row_id).alias("row_id"), *[c.alias(f"_{n}") for n, c in links.items()])
    for n in links:
        least = rows.filter(F.col(f"_{n}").isNotNull()).groupBy(F.col(f"_{n}").alias(f"_k_{n}")).agg(F.min("row_id").alias(f"_m_{n}"))
        rows = rows.join(least, F.col(f"_{n}") == F.col(f"_k_{n}"), "left")
    names = [f"_m_{n}" for n in links]
    rows = rows.select("row_id", *names)
    edges = rows.select(F.coalesce(*names).alias("u"), F.explode(F.array(*names)).alias("v"))
    roots = connected_components(edges, "u", "v")
    held = rows.select("row_id", F.coalesce(*names, F.col("row_id")).alias("_held"))
    return held.join(roots, F.col("_held") == F.col("node"), "left").select(F.col("row_id"), F.coalesce("root", "_held").alias("first_id"))


def difference_into_bins(weights: np.ndarray, bins: int) -> np.ndarray:
    """Bin number of each weight, by multiway largest differencing.

    Every weight starts as its own list of ``bins`` sums; again and again the two lists of the widest
    spread are added up, the largest sums of one onto the smallest of the other.
    """
    n = len(weights)
    where = np.zeros(n, dtype=np.int64)
    if n == 0:
        return where
    # A node is (spread, tie, sums ascending, slots); a slot is a tree of the weights in it.
    heap = []
    for i in np.argsort(-weights, kind="stable"):
        w = float(weights[i])
        heap.append((-w, int(i), [0.0] * (bins - 1) + [w], [None] * (bins - 1) + [int(i)]))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, slots_a = heapq.heappop(heap)
        _, _, b, slots_b = heapq.heappop(heap)
        merged = []
        for x, s, y, r in zip(a, slots_a, reversed(b), reversed(slots_b), strict=True):
            merged.append((x + y, r if s is None else s if r is None else (s, r)))
        merged.sort(key=lambda m: m[0])
        sums = [m[0] for m in merged]
        heapq.heappush(heap, (sums[0] - sums[-1], tie, sums, [m[1] for m in merged]))
        tie += 1
    for number, slot in enumerate(heap[0][3]):
        stack = [] if slot is None else [slot]
        while stack:
            top = stack.pop()
            if isinstance(top, tuple):
                stack.extend(top)
            else:
                where[top] = number
    return where


def _differenced(bins: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True], ignore_index=True)
        return pdf.assign(bin=difference_into_bins(pdf["weight"].to_numpy(dtype=float), bins))

    return run


def balanced_bins(items: DataFrame, group: str, item: str, weight: str, *, bins: int = BINS) -> DataFrame:
    """``group, item, weight, bin``: the items of each group differenced into ``bins`` bins of near equal weight.

    ``bins`` equally heavy items together are a list without spread, so they are dealt out at once; only the
    remainders, fewer than ``bins`` of each weight, are differenced: first those of each power of two,
    then the bins so gained, some tens of lists.  The steps are the same whatever the number of items.
    """
    ship_package(items.sparkSession)
    given = items.select(F.col(group).cast("string").alias("group"), F.col(item).cast("string").alias("item"), F.col(weight).cast("bigint").alias("weight"))
    given = given.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(BUCKETS)))
    counts = given.groupBy(F.col("group").alias("_g"), F.col("weight").alias("_w"), F.col("bucket").alias("_b")).agg(F.count("*").alias("_c"))
    counts = counts.select("*", F.expr("sum(_c) OVER (PARTITION BY _g, _w ORDER BY _b) - _c AS _before"), F.expr("sum(_c) OVER (PARTITION BY _g, _w) AS _all"))
    numbered = given.join(counts, F.expr("group <=> _g AND weight = _w AND bucket = _b"))
    numbered = numbered.withColumn("no", F.expr("_before + row_number() OVER (PARTITION BY group, weight, bucket ORDER BY item) - 1"))
    even = F.col("no") < F.expr(f"(_all div {bins}) * {bins}")
    dealt = numbered.filter(even).select("group", "item", "weight", F.pmod("no", F.lit(bins)).alias("bin"))

    schema = "group string, item string, weight bigint, class int, bin bigint"
    rest = numbered.filter(~even).select("group", "item", "weight", F.floor(F.log2(F.greatest("weight", F.lit(1)))).cast("int").alias("class"))
    first = cut(rest.groupBy("group", "class").applyInPandas(_differenced(bins), schema))
    parts = first.groupBy("group", "class", "bin").agg(F.sum("weight").alias("weight")).select("group", F.concat_ws("/", "class", "bin").alias("item"), "weight", F.lit(0).alias("class"))
    second = parts.groupBy("group").applyInPandas(_differenced(bins), schema)
    second = second.select(F.col("group").alias("_g"), F.col("item").alias("_part"), F.col("bin").alias("_bin"))
    placed = first.join(second, F.expr("group <=> _g AND concat_ws('/', class, bin) = _part")).select("group", "item", "weight", F.col("_bin").alias("bin"))
    return dealt.unionAll(placed)


def settle(m: np.ndarray, of: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Moves or swaps single bins between splits while that lessens the sum of ``gap``'s squares.

    ``m`` says what each bin (row) holds of each stratum (column), ``of`` the split of each bin, and
    ``gap`` by how much each split (row) has too much of each stratum.
    """
    of, gap = of.copy(), gap.copy()
    own = (m * m).sum(1)
    for _ in range(20 * len(m)):
        lean = m @ gap.T  # of each bin towards each split
        here = lean[np.arange(len(m)), of]
        move = 2 * (lean - here[:, None]) + 2 * own[:, None]
        move[np.arange(len(m)), of] = 0.0
        swap = 2 * (lean[:, of] - here[:, None])  # i to the split of j
        swap = swap + swap.T + 2 * (own[:, None] + own[None, :] - 2 * m @ m.T)
        swap[of[:, None] == of[None, :]] = 0.0
        i, k = np.unravel_index(move.argmin(), move.shape)
        j, q = np.unravel_index(swap.argmin(), swap.shape)
        if min(move[i, k], swap[j, q]) >= -1e-12:
            break
        steps = [(i, k)] if move[i, k] <= swap[j, q] else [(j, of[q]), (q, of[j])]
        for b, to in steps:
            gap[of[b]] -= m[b]
            gap[to] += m[b]
            of[b] = to
    return of


def _first_splits(shares: list[float]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "bin"], ascending=[False, True], ignore_index=True)
        goal = np.array(shares) * pdf["weight"].sum()
        of = []
        for w in pdf["weight"].to_numpy(dtype=float):
            of.append(int(goal.argmax()))
            goal[of[-1]] -= w
        return pdf[["group", "bin"]].assign(split=np.array(of, dtype=np.int64))

    return run


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    held = pdf.pivot_table(index="bin", columns="column", values="part", aggfunc="sum", fill_value=0.0).sort_index()
    of = pdf.groupby("bin")["split"].first().sort_index().to_numpy()
    gap = np.stack(pdf.groupby("column")["gap"].first().reindex(held.columns).to_list(), axis=1)
    return pd.DataFrame({"group": pdf["group"].iloc[0], "bin": held.index.to_numpy(), "split": settle(held.to_numpy(dtype=float), of, gap)})


def allocated_bins(held: DataFrame, shares: list[float]) -> DataFrame:
    """``group, bin, split`` (number of the share): whole bins to splits, so that each split's part of every
    stratum and of all rows comes near to its share.

    ``held`` has ``group, bin, stratum, n``: what each bin holds of each stratum.  The bins of a group are
    first dealt out by themselves; then groups move or swap single bins (:func:`settle`) by what the splits
    have too much or too little of each stratum, some groups at a time.  Every step is one task a group.
    """
    # A bin's part of each stratum, and of all rows together, which count double.
    whole = held.groupBy("stratum").agg(F.sum("n").alias("_n"))
    all_rows = held.agg(F.sum("n").alias("_n"))
    parts = held.join(whole, "stratum").select("group", "bin", F.concat(F.lit("s"), "stratum").alias("column"), (F.col("n") / F.col("_n")).alias("part"))
    sums = held.groupBy("group", "bin").agg(F.sum("n").alias("weight"))
    parts = cut(parts.unionAll(sums.crossJoin(F.broadcast(all_rows)).select("group", "bin", F.lit("all").alias("column"), (2 * F.col("weight") / F.col("_n")).alias("part"))))
    out = "group string, bin bigint, split bigint"
    now = cut(sums.groupBy("group").applyInPandas(_first_splits(shares), out))
    goal = F.when(F.col("column") == "all", 2.0).otherwise(1.0)
    for step in range(SWEEPS * COLOURS):
        placed = parts.join(now, ["group", "bin"])
        gaps = placed.groupBy("column").agg(*[(F.sum(F.when(F.col("split") == k, F.col("part")).otherwise(0.0)) - F.lit(x) * goal).alias(f"g{k}") for k, x in enumerate(shares)])
        gaps = gaps.select("column", F.array(*[f"g{k}" for k in range(len(shares))]).alias("gap"))
        turn = F.pmod(F.xxhash64("group"), F.lit(COLOURS)) == step % COLOURS
        moved = placed.filter(turn).join(gaps, "column").groupBy("group").applyInPandas(_settled, out)
        now = cut(now.filter(~turn).unionAll(moved))
    return now


def grouped_splits(df: DataFrame, row_id: str, links: dict[str, Column], stratum: Column, shares: dict[str, float], *, bins: int = BINS) -> DataFrame:
    """``row_id, first_id, stratum, split``: every row in one split, all rows of a linked set in the same.

    Linked sets are weighted by their rows and filed under the stratum that most of their rows have (the
    first in order among equals); those of each stratum are differenced into ``bins`` equal bins, and whole
    bins are allocated to the splits by ``shares``, per stratum and overall (:func:`allocated_bins`).  A null stratum
    is a stratum.  A set larger than a bin fills one alone, so shares are met as near as such sets allow.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.coalesce(stratum, F.lit("")).alias("stratum"), *[c.alias(n) for n, c in links.items()])
    sets = linked_sets(rows, "row_id", {n: F.col(n) for n in links})
    placed = rows.select("row_id", "stratum").join(sets, "row_id")
    by_stratum = placed.groupBy("first_id", "stratum").agg(F.count("*").alias("n"))
    whole = by_stratum.groupBy("first_id").agg(F.sum("n").alias("weight"), F.min(F.struct((-F.col("n")).alias("n"), "stratum"))["stratum"].alias("main"))
    by_stratum, whole = cut(by_stratum), cut(whole)
    binned = cut(balanced_bins(whole, "main", "first_id", "weight", bins=bins))
    held = binned.select("group", "bin", F.col("item").alias("_item")).join(by_stratum.withColumn("_item", F.col("first_id").cast("string")), "_item")
    chosen = allocated_bins(held.groupBy("group", "bin", "stratum").agg(F.sum("n").alias("n")), list(shares.values()))
    names = F.array(*[F.lit(n) for n in shares])
    of_set = join_small(binned, chosen, ["group", "bin"]).select(F.col("item").alias("_set"), F.get(names, F.col("split").cast("int")).alias("split"))
    return placed.join(of_set, F.col("first_id").cast("string") == F.col("_set")).select("row_id", "first_id", "stratum", "split")
