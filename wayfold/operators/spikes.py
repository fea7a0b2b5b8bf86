"""Implausible spikes, frozen values and impossible readings, per source.

Readings of one series follow each other in time.  What is usual is learnt per source from mergeable
quantile sketches kept per hour of recording: the median step between successive readings, and
interquartile fences.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.medians import context_sketches, exact_medians, merged_quantiles
from wayfold.operators.sequence import BLOCK, BLOCK_NS, with_block
from wayfold.sources.checkpoints import cut, join_small, written

HOUR_NS = 3_600_000_000_000
INF = float("inf")


@dataclass(frozen=True)
class Measure:
    """One measured field: its coordinates, and what value is impossible or may stand still.

    ``parts`` are SQL expressions of doubles; a reading with a null part counts as a null reading.
    ``impossible`` and ``still`` take the parts as columns; non-finite readings are impossible anyway.
    """

    name: str
    parts: list[str]
    impossible: object = field(default=lambda *_: F.lit(False))
    still: object = field(default=lambda *_: F.lit(False))


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def _all(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out & c
    return out


def _item(m: Measure, t: str) -> Column:
    """A reading as ``t, x0, x1, ...``; null if any part is."""
    whole = " AND ".join(f"({p}) IS NOT NULL" for p in m.parts)
    fields = ", ".join(f"'x{i}', cast({p} AS double)" for i, p in enumerate(m.parts))
    return F.expr(f"if({whole}, named_struct('t', `{t}`, {fields}), null)")


def gathered(df: DataFrame, source: str, keys: list[str], t: str, measures: list[Measure], block: int = BLOCK_NS) -> DataFrame:
    """One row per series (source and keys, as ``_key``) and time block (:data:`BLOCK`), with each measure's distinct
    non-null readings in order of time: a block bounds them, and repeated rows fall together before they are shuffled.

    ``q_<measure>`` is an array of ``t, x0, x1, ...``; ``f_<measure>`` has its finite readings where some aren't, else null.
    Rows without ``t`` are passed over.
    """
    given = df.filter(F.col(t).isNotNull()).select(F.struct(F.col(source).alias("_source"), *keys).alias("_key"), t, *[_item(m, t).alias(f"q_{m.name}") for m in measures])
    sets = with_block(given, t, block).groupBy("_key", BLOCK).agg(*[F.sort_array(F.collect_set(f"q_{m.name}")).alias(f"q_{m.name}") for m in measures])
    finite = {}
    for m in measures:
        good = " AND ".join(f"abs(e.x{i}) < double('inf')" for i in range(len(m.parts)))
        finite[f"f_{m.name}"] = F.expr(f"if(exists(q_{m.name}, e -> NOT ({good})), filter(q_{m.name}, e -> {good}), null)")
    return sets.withColumns(finite)


#: Finite readings on either side whose median is taken.
SIDE = 3


def _seams(blocks: DataFrame, measures: list[Measure], frozen_run: int) -> DataFrame:
    """The ends of each block that has readings beyond it, and those: per measure ``a_v_`` and ``z_v_`` (its first and last
    readings, as many as a run needs less one), ``b_v_`` and ``c_v_`` (as many before and after the block, also from further
    blocks), ``n_v_`` (its number); the same with ``f`` for finite readings, of which six at each end and three beyond.
    ``a`` and ``c`` begin with the first reading, ``z`` and ``b`` with the last.
    """
    ends, beyond = {}, {}
    for m in measures:
        for kind, own, reach, values in (("v", frozen_run - 1, frozen_run - 1, f"q_{m.name}"), ("f", 2 * SIDE, SIDE, f"coalesce(f_{m.name}, q_{m.name})")):
            name = f"{kind}_{m.name}"
            head, tail = f"slice({values}, 1, {own})", f"reverse(slice({values}, greatest(size({values}) - {own}, 0) + 1, {own}))"
            ends |= {f"n_{name}": f"size({values})", f"a_{name}": f"if(size({values}) > 0, {head}, null)", f"z_{name}": f"if(size({values}) > 0, {tail}, null)"}
            for to, of, call in (("b", "z", "lag"), ("c", "a", "lead")):
                far = ", ".join(f"{call}(`{of}_{name}`, {j}) IGNORE NULLS OVER (PARTITION BY _key ORDER BY `{BLOCK}`)" for j in range(1, reach + 1))
                beyond[f"{to}_{name}"] = (f"array({far})", reach)
    edges = blocks.select("_key", BLOCK, *[F.expr(e).alias(n) for n, e in ends.items()])
    edges = edges.withColumns({n: F.expr(e) for n, (e, _) in beyond.items()}).filter(" OR ".join(f"`{n}`[0] IS NOT NULL" for n in beyond))
    edges = edges.withColumns({n: F.slice(F.flatten(F.array_compact(n)), 1, reach) for n, (_, reach) in beyond.items()})
    none = lambda n: F.slice(f"b{n[1:]}", 1, 0)
    return edges.withColumns({n: F.coalesce(F.col(n), none(n)) for n in ends if n[0] in "az"})


def _seam_rows(seams: DataFrame, name: str, own: int, least: int) -> DataFrame:
    """``_key, seq, lo, hi``: successive readings around either end of a block (one row for both where it has at most ``least``),
    and the places of those of the block that aren't judged inside it."""
    a, z, b, c = (f"`{x}_{name}`" for x in "azbc")
    whole = f"array(named_struct('seq', concat(reverse({b}), {a}, {c}), 'lo', size({b}), 'hi', size({b}) + size({a})))"
    two = f"array(named_struct('seq', concat(reverse({b}), {a}), 'lo', size({b}), 'hi', size({b}) + {own}), named_struct('seq', concat(reverse({z}), {c}), 'lo', {least - own}, 'hi', {least}))"
    return seams.select("_key", F.inline(F.expr(f"if(`n_{name}` <= {least}, {whole}, {two})")))


def _places(seqs: DataFrame, *keep: str) -> DataFrame:
    """Each reading ``r`` of ``seq`` with its place ``p``; ``seq`` itself stays beside it."""
    return seqs.select("_key", "seq", *keep, F.posexplode("seq").alias("p", "r"))


def _steps(blocks: DataFrame, seams: DataFrame, m: Measure) -> DataFrame:
    """``_key, hour, part, step``: changes from the finite reading before."""
    q = f"f_{m.name}"
    inside = _places(blocks.select("_key", F.expr(f"coalesce(f_{m.name}, q_{m.name})").alias("seq"))).select("_key", "r", F.expr("get(seq, p - 1)").alias("o"))
    first = seams.select("_key", F.expr(f"get(a_{q}, 0)").alias("r"), F.expr(f"get(b_{q}, 0)").alias("o"))
    changes = F.array(*[F.struct(F.lit(f"{m.name}_{i}").alias("part"), F.expr(f"abs(r.x{i} - o.x{i})").alias("step")) for i in range(len(m.parts))])
    return inside.unionAll(first).select("_key", F.floor(F.col("r.t") / HOUR_NS).alias("hour"), F.inline(changes)).filter("step > 0")


def _median3(x: str, y: str, z: str) -> str:
    return f"greatest(least({x}, {y}), least(greatest({x}, {y}), {z}))"


def _spikes(seqs: DataFrame, m: Measure, spike_steps: float) -> DataFrame:
    """Readings at places ``lo`` to ``hi`` of finite ones that are spikes in a part; ``usual_<i>`` are the usual steps."""
    # Part by part over plain arrays: code that looks at all parts at once outgrows what the JVM compiles.
    parts = F.array(*[F.struct(F.col(f"seq.x{i}").alias("xs"), F.col(f"usual_{i}").alias("usual")) for i in range(len(m.parts))])
    each = seqs.select("_key", "seq", "lo", "hi", F.inline(parts)).filter("usual IS NOT NULL")
    each = each.select("_key", "seq", "lo", "hi", "xs", "usual", F.posexplode("xs").alias("p", "x")).filter(f"p >= lo AND p < hi AND p >= {SIDE} AND p < size(xs) - {SIDE}")
    before, after = (_median3(*[f"get(xs, p {sign} {j})" for j in range(1, SIDE + 1)]) for sign in "-+")
    beyond = F.greatest(F.expr(f"x - greatest({before}, {after})"), F.expr(f"least({before}, {after}) - x"))
    return each.filter(beyond > F.expr(f"{spike_steps}D * usual")).select("_key", F.expr("get(seq, p)").alias("r"), F.lit(False).alias("impossible"), F.lit(False).alias("frozen"), F.lit(True).alias("spike"))


def _marked(seqs: DataFrame, m: Measure, frozen_run: int) -> DataFrame:
    """Impossible readings of ``seq``, and those of its runs of ``frozen_run`` and more (they may come several times)."""
    xs = [F.col(f"r.x{i}") for i in range(len(m.parts))]
    wrong = F.coalesce(~_all([_finite(x) for x in xs]) | m.impossible(*xs), F.lit(False))
    same = " AND ".join(f"r.x{i} = get(seq, p + {j}).x{i}" for j in range(1, frozen_run) for i in range(len(m.parts)))
    begins = F.coalesce(F.expr(same or "true") & ~m.still(*xs), F.lit(False))
    each = _places(seqs).select("_key", "seq", "p", wrong.alias("wrong"), begins.alias("begins")).filter("wrong OR begins")
    run = each.select("_key", "wrong", "begins", F.posexplode(F.expr(f"slice(seq, p + 1, if(begins, {frozen_run}, 1))")).alias("k", "r"))
    return run.select("_key", "r", F.expr("wrong AND k = 0").alias("impossible"), F.col("begins").alias("frozen"), F.lit(False).alias("spike"))


def _hashes(key: list[Column], t: Column, parts: list[Column]) -> tuple[Column, Column]:
    """Of a reading's series and instant, and of all that makes it up: together its name, in narrow rows."""
    return F.xxhash64(F.lit(1), *key, t), F.xxhash64(F.lit(2), *key, t, *parts)


def flag_rows(df: DataFrame, row_id: str, source: str, keys: list[str], t: str, measures: list[Measure], *, frozen_run: int = 6, spike_steps: float = 9.0, block: int = BLOCK_NS) -> DataFrame:
    """``row_id, field, impossible, frozen, spike`` of every row with a flagged reading, one row per measure;
    repeated rows of a flagged reading all come back.

    - impossible: not finite, or the measure says so;
    - frozen: one of at least ``frozen_run`` successive readings equal in all parts, unless ``still``;
    - spike, in any part: above both or below both of the medians of the three finite readings before
      and the three after, and more than ``spike_steps`` usual steps from each.  The usual step of a
      source is its exact median absolute change between successive finite readings of a series,
      unchanged ones left out; a source without any change has no spikes.

    A series has one source and one value of each key.  Null readings and rows without ``t`` are passed over; null
    sources and series of null keys count as one each; readings that differ at one ``t`` of a series all count, in no
    defined order.  Empty input gives no rows.
    """
    # Readings are gathered into ordered arrays once and written down; all passes look around in these by place.
    blocks = written(gathered(df, source, keys, t, measures, block))
    seams = cut(_seams(blocks, measures, frozen_run))
    steps = reduce(DataFrame.unionAll, [_steps(blocks, seams, m) for m in measures])
    usual = exact_medians(steps.select(F.col("_key._source").alias("_source"), "hour", "part", "step"), ["_source", "part"], "hour", "step")
    parts = [(f"{m.name}_{i}", f"usual_{m.name}_{i}") for m in measures for i in range(len(m.parts))]
    usual = cut(usual.groupBy("_source").agg(*[F.max(F.when(F.col("part") == p, F.col("median"))).alias(u) for p, u in parts]))

    found = []
    for m in measures:
        steps_of = [F.col(f"usual_{m.name}_{i}").alias(f"usual_{i}") for i in range(len(m.parts))]
        finite = blocks.select("_key", F.expr(f"coalesce(f_{m.name}, q_{m.name})").alias("seq")).select("*", F.lit(0).alias("lo"), F.size("seq").alias("hi"))
        finite = finite.unionAll(_seam_rows(seams, f"f_{m.name}", SIDE, 2 * SIDE))
        judged = join_small(finite, usual.select("_source", *steps_of), F.expr("_key._source <=> _source"))
        whole = blocks.select("_key", F.col(f"q_{m.name}").alias("seq")).unionAll(_seam_rows(seams, f"v_{m.name}", frozen_run - 1, frozen_run - 1).select("_key", "seq"))
        for flagged in (_spikes(judged, m, spike_steps), _marked(whole, m, frozen_run)):
            h, n = _hashes([F.col("_key._source"), *[F.col(f"_key.{k}") for k in keys]], F.col("r.t"), [F.col(f"r.x{i}") for i in range(len(m.parts))])
            found.append(flagged.select(h.alias("_h"), n.alias("_n"), F.lit(m.name).alias("field"), "impossible", "frozen", "spike"))
    flags = reduce(DataFrame.unionAll, found).groupBy("_h", "_n", "field").agg(*[F.bool_or(c).alias(c) for c in ("impossible", "frozen", "spike")])

    key = [F.col(source), *[F.col(k) for k in keys]]
    names = {m.name: _hashes(key, F.col(t), [F.expr(p).cast("double") for p in m.parts]) for m in measures}
    rows = df.filter(F.col(t).isNotNull()).select(F.col(row_id), names[measures[0].name][0].alias("_h"), *[n.alias(f"_n_{m}") for m, (_, n) in names.items()])
    of_field = reduce(lambda a, b: a | b, [(F.col("field") == m) & (F.col("_n") == F.col(f"_n_{m}")) for m in names])
    return join_small(rows, flags, ["_h"]).filter(of_field).select(row_id, "field", "impossible", "frozen", "spike")


def fence_rows(df: DataFrame, row_id: str, source: str, t: str, value: str, *, widen: float = 3.0, context: int = HOUR_NS, least: int = 30) -> DataFrame:
    """``row_id, source, hour, value, low, high``: finite readings outside ``[q1 - widen * iqr, q3 + widen * iqr]``.

    Quantiles come from sketches per source and hour; an hour with under ``least`` readings is judged
    by the source's merged sketch.  Null ``t`` or value and non-finite values are passed over; null sources count as one.
    """
    at = df.filter(F.col(t).isNotNull() & F.col(value).isNotNull()).select(row_id, source, F.floor(F.col(t) / context).alias("hour"), F.col(value).cast("double").alias("value"))
    sketches = context_sketches(at, [source], "hour", "value")
    per_hour = sketches.filter(F.kll_sketch_get_n_double("sketch") >= least).select(
        source, "hour", F.kll_sketch_get_quantile_double("sketch", F.lit(0.25)).alias("_h1"), F.kll_sketch_get_quantile_double("sketch", F.lit(0.75)).alias("_h3")
    )
    whole = merged_quantiles(sketches, [source], {"_s1": 0.25, "_s3": 0.75})
    whole = whole.withColumnRenamed(source, "_source")
    per_hour = per_hour.withColumnsRenamed({source: "_hour_source", "hour": "_hour"})
    both = join_small(at.filter(_finite(F.col("value"))), whole, F.col(source).eqNullSafe(F.col("_source")))
    both = both.join(per_hour, F.col(source).eqNullSafe(F.col("_hour_source")) & (F.col("hour") == F.col("_hour")), "left")
    q1, q3 = F.coalesce("_h1", "_s1"), F.coalesce("_h3", "_s3")
    fenced = both.withColumn("low", q1 - widen * (q3 - q1)).withColumn("high", q3 + widen * (q3 - q1))
    return fenced.filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).select(row_id, source, "hour", "value", "low", "high")
