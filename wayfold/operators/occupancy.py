"""Cells, clusters and neighbours on a ground grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import settings as S
from wayfold.operators.components import connected_components


def cells(points: DataFrame, x: str, y: str, cell: float = S.CELL, size: float = S.GRID_SIZE) -> DataFrame:
    """Adds the grid cell ``ci, cj`` of each point and whether it lies ``inside`` the square grid around the origin."""
    n = round(size / cell)
    ci, cj = (F.floor((F.col(c) + size / 2) / cell) for c in (x, y))
    return points.withColumn("ci", ci).withColumn("cj", cj).withColumn("inside", (F.col("ci") >= 0) & (F.col("ci") < n) & (F.col("cj") >= 0) & (F.col("cj") < n))


def height_map(points: DataFrame, key: str, t: str, z: str, persist_s: float = S.PERSIST_S) -> DataFrame:
    """``key, ci, cj, height, last_seen``: for each cell the greatest height within the band at the instant it
    was last hit, and when; cells not hit for longer than ``persist_s`` before the key's last instant are gone."""
    low, high = S.HEIGHT_BAND
    hit = points.filter(F.col("inside") & F.col(z).between(low, high))
    last = hit.groupBy(key, "ci", "cj", t).agg(F.max(z).alias("height")).groupBy(key, "ci", "cj").agg(F.max(F.struct(F.col(t).alias("t"), "height")).alias("m"))
    ends = points.groupBy(F.col(key).alias("_key")).agg(F.max(t).alias("_end"))
    out = last.select(key, "ci", "cj", F.col("m.height").alias("height"), F.col("m.t").alias("last_seen"))
    return out.join(ends, F.col(key) == F.col("_key")).filter(F.col("_end") - F.col("last_seen") <= int(persist_s * 1e9)).drop("_key", "_end")


def accumulated_map(points: DataFrame, key: str, t: str, z: str, seen: Column | None = None, persist_s: float = S.PERSIST_S) -> DataFrame:
    """``key, ci, cj, height, last_seen``: for each cell the greatest height within the band over its hits, the last of which ends a
    stretch without a pause over ``persist_s``; cells not hit for so long before the key's last instant are gone.

    With ``seen``, whether a cell (``ci, cj``) is in view throughout, such cells hold what the key's last instant shows:
    those not hit then are cleared.
    """
    low, high = S.HEIGHT_BAND
    hit = points.filter(F.col("inside") & F.col(z).between(low, high)).groupBy(key, "ci", "cj", F.col(t).alias("_t")).agg(F.max(z).alias("_z"))
    ends = points.groupBy(F.col(key).alias("_key")).agg(F.max(t).alias("_end"))
    over = f"OVER (PARTITION BY `{key}`, ci, cj ORDER BY _t)"
    new = hit.withColumn("_new", F.expr(f"CASE WHEN _t - lag(_t) {over} <= {int(persist_s * 1e9)} THEN 0 ELSE 1 END"))
    stretch = new.withColumn("_n", F.expr(f"sum(_new) {over}")).groupBy(key, "ci", "cj", "_n").agg(F.max("_z").alias("height"), F.max("_t").alias("last_seen"))
    last = stretch.groupBy(key, "ci", "cj").agg(F.max(F.struct("_n", "height", "last_seen")).alias("m")).select(key, "ci", "cj", "m.height", "m.last_seen")
    kept = last.join(ends, F.col(key) == F.col("_key"))
    if seen is not None:
        now = hit.select(F.col(key).alias("_k"), F.col("ci").alias("_i"), F.col("cj").alias("_j"), "_t", "_z")
        kept = kept.withColumn("_seen", F.coalesce(seen, F.lit(False))).join(now, F.expr(f"_seen AND `{key}` = _k AND ci = _i AND cj = _j AND last_seen = _t"), "left")
        kept = kept.filter("NOT _seen OR last_seen = _end").withColumn("height", F.coalesce("_z", "height"))
    return kept.filter(F.col("_end") - F.col("last_seen") <= int(persist_s * 1e9)).select(key, "ci", "cj", "height", "last_seen")


def cell_clusters(occupied: DataFrame, key: str) -> DataFrame:
    """``key, ci, cj, cluster``: 8-connected groups of cells of one key, named by their least ``(ci, cj)``.

    Each cell meets the four neighbours after it by equality, and the components of those edges are found
    in Spark, whatever the size of a group.
    """
    node = occupied.select(key, "ci", "cj", F.struct(F.col(key).alias("k"), "ci", "cj").alias("node"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = node.select(F.col("node").alias("u"), F.explode(steps).alias("s"), key, "ci", "cj").select("u", F.struct(F.col(key).alias("k"), (F.col("ci") + F.col("s.a")).alias("ci"), (F.col("cj") + F.col("s.b")).alias("cj")).alias("v"))
    edges = ahead.join(node.select(F.col("node").alias("v")), "v", "left_semi")
    roots = connected_components(edges, "u", "v")
    named = node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.select(key, "ci", "cj", F.format_string("%d:%d", F.col("root.ci"), F.col("root.cj")).alias("cluster"))


def cluster_boxes(clustered: DataFrame, key: str, height: str, cell: float = S.CELL, size: float = S.GRID_SIZE) -> DataFrame:
    """One box per cluster: centre and extent in metres, top, number of cells."""
    g = clustered.groupBy(key, "cluster").agg(*[f(c).alias(f"{n}_{c}") for c in ("ci", "cj") for n, f in (("lo", F.min), ("hi", F.max))], F.max(height).alias("top"), F.count("*").alias("n_cells"))
    mid = {c: (F.col(f"lo_{c}") + F.col(f"hi_{c}") + 1) * cell / 2 - size / 2 for c in ("ci", "cj")}
    wide = {c: (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1) * cell for c in ("ci", "cj")}
    return g.select(key, "cluster", mid["ci"].alias("x"), mid["cj"].alias("y"), wide["ci"].alias("size_x"), wide["cj"].alias("size_y"), "top", "n_cells")


def within_radius(left: DataFrame, right: DataFrame, keys: list[str], xyz: list[str], radius: float, left_id: str, right_id: str) -> DataFrame:
    """``left_id, right_id, distance``: pairs of rows with equal ``keys`` at most ``radius`` apart.

    Space is cut into cells of the radius's width; the right rows go to their own and all adjoining cells,
    and rows meet by equality of cell.  Rows with a null or non-finite coordinate or key pair with nothing.
    """
    cell = [F.floor(F.col(c) / radius).cast("bigint") for c in xyz]
    finite = F.expr(" AND ".join(f"abs(`{c}`) < 1e15D" for c in xyz))
    a = left.filter(finite).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_id), *[F.col(c).alias(f"_a{i}") for i, c in enumerate(xyz)], *[c.alias(f"_c{i}") for i, c in enumerate(cell)])
    b = right.filter(finite).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_id), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(xyz)], *[c.alias(f"_d{i}") for i, c in enumerate(cell)])
    for i in range(len(xyz)):
        b = b.withColumn(f"_c{i}", F.explode(F.sequence(F.col(f"_d{i}") - 1, F.col(f"_d{i}") + 1)))
    on = [f"_k{i}" for i in range(len(keys))] + [f"_c{i}" for i in range(len(xyz))]
    d = F.sqrt(sum((F.pow(F.col(f"_a{i}") - F.col(f"_b{i}"), 2) for i in range(1, len(xyz))), F.pow(F.col("_a0") - F.col("_b0"), 2)))
    return a.join(b, on).withColumn("distance", d).filter(F.col("distance") <= radius).select(left_id, right_id, "distance")
