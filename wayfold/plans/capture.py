"""Queries over recordings: timing, alignment, resampling, record ids and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import settings as S
from wayfold.functions.text import day, digest16, padded
from wayfold.operators import timing as T
from wayfold.sources.tables import read_table


def _ego(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """One reading per pass and instant: of repeated rows the smallest number.  Rows count where each of
    ``fields`` (speed and yaw rate unless given) is set, finite and under 100; the others may be anything."""
    usable = " AND ".join(f"NOT isnan({c}) AND abs({c}) < 100" for c in fields or ("speed_mps", "yaw_rate_radps"))
    e = read_table(spark, folder, "ego_states").filter(f"t_ns IS NOT NULL AND {usable}")
    return e.groupBy("pass_id", "t_ns").agg(F.min_by(F.struct("rig_id", "speed_mps", "yaw_rate_radps"), "ego_row").alias("r")).select("pass_id", "t_ns", "r.*")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def timing_reports_made(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(T.timing_report(read_table(spark, folder, "video_frames"), "pass_id", "t_ns"), "duration_s", "mean_fps", "jitter_ratio")


def timing_reports_compared(spark: SparkSession, folder: str) -> DataFrame:
    """How stated and recomputed reports differ per pass (repeated statements each by themselves)."""
    made = T.timing_report(read_table(spark, folder, "video_frames"), "pass_id", "t_ns").select("pass_id", F.col("n_frames").alias("made"), F.size("gap_indices").alias("made_gaps"))
    stated = read_table(spark, folder, "timing_reports").select("pass_id", F.col("n_frames").alias("stated"), F.size("gap_indices").alias("stated_gaps"))
    joined = made.join(stated, "pass_id", "full")
    status = F.when(F.col("stated").isNull() & F.col("made").isNotNull(), "missing").when(F.col("made").isNull(), "no frames").when(F.col("made") != F.col("stated"), "frames differ").when(F.col("stated_gaps").isNull() | (F.col("stated_gaps") < 0), "gaps unknown").when(F.col("made_gaps") != F.col("stated_gaps"), "gaps differ").otherwise("agrees")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def stream_checks(spark: SparkSession, folder: str) -> DataFrame:
    return T.stream_faults(read_table(spark, folder, "video_frames"), "pass_id", "t_ns", "frame_row")


def speed_at_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Ego speed interpolated at the instants of the frames of the same pass."""
    grid = read_table(spark, folder, "video_frames").filter("t_ns > 0").select("pass_id", "t_ns").distinct()
    return _rounded(T.interpolated(_ego(spark, folder, "speed_mps"), grid, "pass_id", "t_ns", "speed_mps"), "speed_mps")


def _searches(spark: SparkSession, folder: str) -> DataFrame:
    """``pass_id, cell_ns, most``: the cell of a pass by its rig's ``resample_hz``, and the most cells of lag by its
    ``max_offset_s``; 5 a second and 2 s where the rig states none."""
    rigs = read_table(spark, folder, "ego_states").groupBy("pass_id").agg(F.min("rig_id").alias("rig_id"))
    sync = read_table(spark, folder, "rig_sync").groupBy("rig_id").agg(F.max("resample_hz").alias("hz"), F.max("max_offset_s").alias("s"))
    hz, most_s = F.coalesce(F.when(F.col("hz") > 0, F.col("hz")), F.lit(5.0)), F.coalesce(F.when(F.col("s") > 0, F.col("s")), F.lit(2.0))
    return rigs.join(sync, "rig_id", "left").select("pass_id", F.round(1e9 / hz).cast("bigint").alias("cell_ns"), F.round(most_s * hz).cast("int").alias("most"))


def _cell_grid(df: DataFrame, value: str, searches: DataFrame) -> DataFrame:
    """Mean of a value per pass and cell, counted from the pass's first."""
    start = df.groupBy("pass_id").agg(F.min("t_ns").alias("_t0")).join(searches, "pass_id")
    cells = df.join(start, "pass_id").select("pass_id", "most", F.expr("(t_ns - _t0) div cell_ns").cast("int").alias("i"), F.col(value).alias("v"))
    return cells.groupBy("pass_id", "most", "i").agg(F.round(F.avg("v"), 9).alias("v"))


def clock_lags(spark: SparkSession, folder: str) -> DataFrame:
    """Lag at which the speed in ego states and in risk frames of a pass correlate best: in cells of its rig's
    resampling, within its rig's largest offset, and refined in seconds; ``trusted`` by the least correlation of a sync."""
    searches = _searches(spark, folder)
    frames = read_table(spark, folder, "risk_frames").filter("t_ns IS NOT NULL AND ego_speed_mps IS NOT NULL").groupBy("pass_id", "t_ns").agg(F.min("ego_speed_mps").alias("v"))
    ego = _cell_grid(_ego(spark, folder, "speed_mps"), "speed_mps", searches)
    corr = T.lag_correlations(ego, _cell_grid(frames, "v", searches), "pass_id", "i", "v", "most").withColumn("corr", F.round("corr", 6))
    best = T.best_lag(corr, "pass_id").join(searches.select("pass_id", "cell_ns"), "pass_id").withColumn("trusted", F.col("corr") >= S.TRUSTED_CORRELATION)
    return _rounded(best.withColumn("lag_s", F.col("lag_refined") * F.col("cell_ns") / 1e9).drop("cell_ns"), "lag_refined", "lag_s")


def yaw_turned(spark: SparkSession, folder: str) -> DataFrame:
    """Heading change of each pass by its yaw rates."""
    turned = T.trapezoid(_ego(spark, folder, "yaw_rate_radps"), "pass_id", "t_ns", "yaw_rate_radps")
    return turned.groupBy("pass_id").agg(F.count("*").alias("n"), F.round(F.max_by("turned", "t_ns"), 5).alias("turned"))


def dead_reckoning(spark: SparkSession, folder: str) -> DataFrame:
    """End of each pass's path from speed and yaw rate: chained planar steps, each along the heading before it."""
    over = "OVER (PARTITION BY pass_id ORDER BY t_ns)"
    s = _ego(spark, folder).select("pass_id", "t_ns", "speed_mps", "yaw_rate_radps", F.expr(f"coalesce((lead(t_ns) {over} - t_ns) / 1e9D, 0D)").alias("dt"))
    h = s.withColumn("heading", F.expr("coalesce(sum(yaw_rate_radps * dt) OVER (PARTITION BY pass_id ORDER BY t_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"))
    d = F.col("speed_mps") * F.col("dt")
    return h.groupBy("pass_id").agg(F.round(F.sum(d * F.cos("heading")), 4).alias("x"), F.round(F.sum(d * F.sin("heading")), 4).alias("y"), F.round(F.sum(F.abs(d)), 4).alias("driven_m"))


def record_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids, strata and hash splits made anew for every record; without a date that can be read the id is null."""
    r = read_table(spark, folder, "raw_records")
    made_on = F.to_date(F.try_to_timestamp(day("date"), F.lit("yyyyMMdd")))
    made = T.raw_id(F.col("kind"), F.regexp_replace("source_name", r"\.[^.]*$", ""), made_on, F.col("rec_no") % 100)
    stratum = T.inferred_stratum(F.col("id"))
    return r.select("rec_no", F.when(made_on.isNotNull(), made).alias("made_id"), stratum.alias("made_stratum"), T.assigned_split(F.col("id"), stratum).alias("made_split"))


def digest_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Digests that several records carry."""
    r = read_table(spark, folder, "raw_records").select("rec_no", digest16("sha256").alias("digest")).filter("digest IS NOT NULL")
    return r.groupBy("digest").agg(F.count("*").alias("n"), F.min("rec_no").alias("first_rec_no")).filter("n > 1")


def split_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records, size and duration per split and stratum."""
    r = read_table(spark, folder, "raw_records")
    return r.groupBy(padded("split").alias("split"), padded("stratum").alias("stratum")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.round(F.sum("duration_s"), 3).alias("duration_s"), F.count_if("verified").alias("n_verified"))


def rig_sync_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets in seconds with whether to trust them, and the frames that hang on them."""
    s = read_table(spark, folder, "rig_sync")
    f = read_table(spark, folder, "video_frames").groupBy("rig_id").agg(F.count("*").alias("n_frames"))
    trusted = F.coalesce(F.col("correlation") >= S.TRUSTED_CORRELATION, F.lit(False))
    return s.join(f, "rig_id", "left").select("rig_id", F.round(F.col("offset_ns") / 1e9, 6).alias("offset_s"), trusted.alias("trusted"), F.coalesce("n_frames", F.lit(0).cast("bigint")).alias("n_frames"))


def preflight(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of each pass: NO-GO if a check fails, CHECK if one warns, else GO."""
    t = T.timing_report(read_table(spark, folder, "video_frames"), "pass_id", "t_ns").select("pass_id", "n_frames", "duration_s", "is_vfr", F.size("gap_indices").alias("gaps"))
    failed = (F.col("n_frames") < 10).cast("int") + (F.col("duration_s") < 1).cast("int")
    warned = (F.col("gaps") > 0).cast("int") + F.col("is_vfr").cast("int")
    return t.select("pass_id", failed.alias("failed"), warned.alias("warned"), F.when(failed > 0, "NO-GO").when(warned > 0, "CHECK").otherwise("GO").alias("verdict"))


QUERIES = {
    q.__name__: q
    for q in (timing_reports_made, timing_reports_compared, stream_checks, speed_at_frames, clock_lags, yaw_turned, dead_reckoning, record_ids, digest_copies, split_report, rig_sync_quality, preflight)
}

_STEPS = "s AS (SELECT pass_id, t_ns, row_number() OVER (PARTITION BY pass_id ORDER BY t_ns) - 1 AS i, t_ns - lag(t_ns) OVER (PARTITION BY pass_id ORDER BY t_ns) AS dt FROM (SELECT DISTINCT pass_id, t_ns FROM video_frames WHERE t_ns IS NOT NULL AND t_ns <> 0))"
_REPORT = f"""{_STEPS}, m AS (SELECT pass_id, count(*) AS n_frames, max(t_ns) - min(t_ns) AS span, trunc(median(dt))::BIGINT AS median_dt_ns, min(dt) AS min_dt_ns, max(dt) AS max_dt_ns FROM s GROUP BY 1),
 r AS (SELECT pass_id, n_frames, span::DOUBLE / 1e9 AS duration_s, CASE WHEN span > 0 THEN (n_frames - 1) * 1e9::DOUBLE / span END AS mean_fps, median_dt_ns, min_dt_ns, max_dt_ns,
 coalesce((max_dt_ns - min_dt_ns)::DOUBLE / nullif(median_dt_ns, 0), 0) AS jitter_ratio, (SELECT coalesce(list(i ORDER BY i), []) FROM s WHERE s.pass_id = m.pass_id AND s.dt > {S.GAP_FACTOR}::DOUBLE * m.median_dt_ns) AS gap_indices FROM m)"""


def _ego_sql(*fields: str) -> str:
    usable = " AND ".join(f"isfinite({c}) AND abs({c}) < 100" for c in fields or ("speed_mps", "yaw_rate_radps"))
    return f"ego AS (SELECT * FROM (SELECT pass_id, t_ns, rig_id, speed_mps, yaw_rate_radps, row_number() OVER (PARTITION BY pass_id, t_ns ORDER BY ego_row) AS rn FROM ego_states WHERE t_ns IS NOT NULL AND {usable}) WHERE rn = 1)"


_EGO = _ego_sql()
_D16 = "CASE WHEN length(d) >= 16 AND NOT regexp_matches(d, '^0+$') THEN substr(d, 1, 16) END"
_DIGEST = f"dig AS (SELECT *, {_D16} AS digest FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(sha256)), '^(sha-?256\\W*)?(0x)?', ''), '[^0-9a-f]', '', 'g') AS d FROM raw_records))"
_SLUG = r"lower(regexp_replace(regexp_replace(regexp_replace(source_name, '\.[^.]*$', ''), '[^\p{L}\p{N}]', '_', 'g'), '^_+|_+$', '', 'g'))"
_STRATUM = "CASE WHEN lower(id) LIKE '%pole%' THEN 'pole' WHEN lower(id) LIKE '%curb%' OR lower(id) LIKE '%kerb%' THEN 'curb' WHEN lower(id) LIKE '%box%' OR lower(id) LIKE '%cone%' THEN 'box' ELSE 'mixed' END"

ORACLES = {
    "timing_reports_made": f"WITH {_REPORT} SELECT pass_id, n_frames, round(duration_s, 6) AS duration_s, round(mean_fps, 6) AS mean_fps, median_dt_ns, min_dt_ns, max_dt_ns, round(jitter_ratio, 6) AS jitter_ratio, jitter_ratio > {S.VFR_JITTER} AS is_vfr, gap_indices FROM r",
    "timing_reports_compared": f"""WITH {_REPORT} SELECT CASE WHEN t.pass_id IS NULL THEN 'missing' WHEN r.pass_id IS NULL THEN 'no frames' WHEN t.n_frames IS NULL THEN 'missing' WHEN r.n_frames <> t.n_frames THEN 'frames differ' WHEN t.gap_indices IS NULL THEN 'gaps unknown'
 WHEN len(r.gap_indices) <> len(t.gap_indices) THEN 'gaps differ' ELSE 'agrees' END AS status, count(*) AS n FROM r FULL JOIN timing_reports t USING (pass_id) GROUP BY 1""",
    "stream_checks": """SELECT *, CASE WHEN n_not_rising > 0 THEN 'not increasing' WHEN span_ns < 1000000 THEN 'too short' ELSE 'ok' END AS verdict FROM (SELECT pass_id, count(*) AS n, count_if(dt <= 0) AS n_not_rising, max(t_ns) - min(t_ns) AS span_ns
 FROM (SELECT pass_id, t_ns, t_ns - lag(t_ns) OVER (PARTITION BY pass_id ORDER BY frame_row) AS dt FROM video_frames WHERE t_ns IS NOT NULL AND t_ns <> 0) GROUP BY 1)""",
    "speed_at_frames": f"""WITH {_ego_sql("speed_mps")}, g AS (SELECT DISTINCT pass_id, t_ns FROM video_frames WHERE t_ns > 0), p AS (SELECT g.pass_id, g.t_ns, e.t_ns AS t0, e.speed_mps AS v0 FROM g ASOF LEFT JOIN ego e ON g.pass_id = e.pass_id AND g.t_ns >= e.t_ns),
 q AS (SELECT g.pass_id, g.t_ns, e.t_ns AS t1, e.speed_mps AS v1 FROM g ASOF LEFT JOIN ego e ON g.pass_id = e.pass_id AND g.t_ns <= e.t_ns)
 SELECT pass_id, t_ns, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * ((t_ns - t0)::DOUBLE / (t1 - t0)) END, 6) AS speed_mps FROM p JOIN q USING (pass_id, t_ns)""",
    "clock_lags": f"""WITH {_ego_sql("speed_mps")}, f AS (SELECT pass_id, t_ns, min(ego_speed_mps) AS v FROM risk_frames WHERE t_ns IS NOT NULL AND ego_speed_mps IS NOT NULL GROUP BY 1, 2),
 sr AS (SELECT pass_id, round(1e9::DOUBLE / hz)::BIGINT AS cell_ns, round(s * hz)::INT AS most FROM (SELECT pass_id, coalesce(CASE WHEN hz > 0 THEN hz END, 5::DOUBLE) AS hz, coalesce(CASE WHEN s > 0 THEN s END, 2::DOUBLE) AS s
 FROM (SELECT pass_id, min(rig_id) AS rig_id FROM ego_states GROUP BY 1) LEFT JOIN (SELECT rig_id, max(resample_hz) AS hz, max(max_offset_s) AS s FROM rig_sync GROUP BY 1) USING (rig_id))),
 ga AS (SELECT pass_id, most, i, round(avg(v), 9) AS v FROM (SELECT pass_id, most, ((t_ns - min(t_ns) OVER (PARTITION BY pass_id)) // cell_ns)::INT AS i, speed_mps AS v FROM ego JOIN sr USING (pass_id)) GROUP BY 1, 2, 3),
 gb AS (SELECT pass_id, i, round(avg(v), 9) AS v FROM (SELECT pass_id, ((t_ns - min(t_ns) OVER (PARTITION BY pass_id)) // cell_ns)::INT AS i, v FROM f JOIN sr USING (pass_id)) GROUP BY 1, 2),
 za AS (SELECT pass_id, i, n, unnest(range(-most, most + 1)) AS lag, CASE WHEN s < 1e-12 THEN 0 ELSE (v - m) / s END AS z FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(*) OVER w AS n FROM ga WINDOW w AS (PARTITION BY pass_id))),
 zb AS (SELECT pass_id, i, CASE WHEN s < 1e-12 THEN 0 ELSE (v - m) / s END AS z FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM gb WINDOW w AS (PARTITION BY pass_id))),
 c AS (SELECT za.pass_id, lag, round(sum(za.z * zb.z) / max(n), 6) AS corr FROM za JOIN zb ON zb.pass_id = za.pass_id AND zb.i = za.i - za.lag GROUP BY 1, 2),
 n AS (SELECT pass_id, lag, corr, lag(corr) OVER w AS y0, lead(corr) OVER w AS y2, row_number() OVER (PARTITION BY pass_id ORDER BY corr DESC, lag) AS rn FROM c WINDOW w AS (PARTITION BY pass_id ORDER BY lag)),
 r AS (SELECT pass_id, lag::INT AS lag, corr, lag + coalesce(CASE WHEN abs(y0 - 2 * corr + y2) > 1e-12 THEN greatest(-0.5, least(0.5, 0.5 * (y0 - y2) / (y0 - 2 * corr + y2))) ELSE 0 END, 0) AS refined FROM n WHERE rn = 1)
 SELECT pass_id, lag, corr, round(refined, 6) AS lag_refined, corr >= {S.TRUSTED_CORRELATION} AS trusted, round(refined * cell_ns / 1e9::DOUBLE, 6) AS lag_s FROM r JOIN sr USING (pass_id)""",
    "yaw_turned": f"""WITH {_ego_sql("yaw_rate_radps")} SELECT pass_id, count(*) AS n, round(sum(part), 5) AS turned FROM (SELECT pass_id, coalesce((yaw_rate_radps + lag(yaw_rate_radps) OVER w) / 2 * ((t_ns - lag(t_ns) OVER w) / 1e9::DOUBLE), 0) AS part FROM ego WINDOW w AS (PARTITION BY pass_id ORDER BY t_ns)) GROUP BY 1""",
    "dead_reckoning": f"""WITH {_EGO}, s AS (SELECT *, coalesce((lead(t_ns) OVER (PARTITION BY pass_id ORDER BY t_ns) - t_ns) / 1e9::DOUBLE, 0) AS dt FROM ego), h AS (SELECT *, coalesce(sum(yaw_rate_radps * dt) OVER (PARTITION BY pass_id ORDER BY t_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heading FROM s)
 SELECT pass_id, round(sum(speed_mps * dt * cos(heading)), 4) AS x, round(sum(speed_mps * dt * sin(heading)), 4) AS y, round(sum(abs(speed_mps * dt)), 4) AS driven_m FROM h GROUP BY 1""",
    "record_ids": f"""SELECT rec_no, CASE WHEN made_on IS NOT NULL THEN concat_ws('_', kind, strftime(made_on, '%Y%m%d'), {_SLUG}, lpad((rec_no % 100)::VARCHAR, 2, '0')) END AS made_id, made_stratum,
 CASE WHEN ('0x' || substr(sha256('{S.SPLIT_SEED}|' || made_stratum || '|' || id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < {S.SPLIT_RATIO} THEN 'dev' WHEN id IS NOT NULL THEN 'test' END AS made_split
 FROM (SELECT *, {_STRATUM} AS made_stratum, try_strptime(CASE WHEN regexp_matches(trim(date), '^[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{4}}$') THEN substr(trim(date), 7, 4) || substr(trim(date), 4, 2) || substr(trim(date), 1, 2) ELSE regexp_replace(trim(date), '[-/.]', '', 'g') END, '%Y%m%d') AS made_on FROM raw_records)""",
    "digest_copies": f"WITH {_DIGEST} SELECT digest, count(*) AS n, min(rec_no) AS first_rec_no FROM dig WHERE digest IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "split_report": "SELECT nullif(lower(trim(split)), '') AS split, nullif(lower(trim(stratum)), '') AS stratum, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, round(sum(duration_s), 3) AS duration_s, count_if(verified) AS n_verified FROM raw_records GROUP BY 1, 2",
    "rig_sync_quality": f"SELECT s.rig_id, round(offset_ns / 1e9::DOUBLE, 6) AS offset_s, coalesce(correlation >= {S.TRUSTED_CORRELATION}, false) AS trusted, (SELECT count(*) FROM video_frames v WHERE v.rig_id = s.rig_id) AS n_frames FROM rig_sync s",
    "preflight": f"""WITH {_REPORT} SELECT pass_id, failed, warned, CASE WHEN failed > 0 THEN 'NO-GO' WHEN warned > 0 THEN 'CHECK' ELSE 'GO' END AS verdict FROM (SELECT pass_id, (n_frames < 10)::INT + (duration_s < 1)::INT AS failed, (len(gap_indices) > 0)::INT + (jitter_ratio > {S.VFR_JITTER})::INT AS warned FROM r)""",
}
