"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.encoding import decode_corpus, encode_corpus
from wayfold.llm.mixing import mix_sources, mixed_shares
from wayfold.llm.nearest import nearest_in_time
from wayfold.llm.overlap import overlaps
from wayfold.llm.runs import collapse_runs
from wayfold.llm.spans import shared_parts, shared_spans
from wayfold.llm.splits import grouped_splits, linked_sets
from wayfold.functions.text import day, padded
from wayfold.operators.levels import LEVELS, level_rank
from wayfold.sources.tables import read_table


def split_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps(read_table(spark, folder, "raw_records"), "rec_no", "split", "sha256", "description", ["rig_id"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlaps(spark, folder).select(F.least("train_id", "eval_id").alias("rec_a"), F.greatest("train_id", "eval_id").alias("rec_b"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping pairs per evaluation split and rig."""
    return (
        split_overlaps(spark, folder)
        .groupBy(F.col("eval_split").alias("split"), "rig_id")
        .agg(F.count("*").alias("n_pairs"), F.count_if("by_digest").alias("n_by_digest"), F.count_if("by_text").alias("n_by_text"), F.count_distinct("eval_id").alias("n_rows"))
    )


def alert_runs(spark: SparkSession, folder: str) -> DataFrame:
    frames = read_table(spark, folder, "risk_frames").select("pass_id", "t_ns", level_rank("alert_level").alias("rank"))
    return collapse_runs(frames, "pass_id", "t_ns", "rank", gap_ns=2_000_000_000)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return alert_runs(spark, folder).filter("n_events >= 2").select("pass_id", "first_t_ns", "last_t_ns")


def p3_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run, single frames too, with its level, count and duration."""
    names = F.array(*[F.lit(x) for x in LEVELS])
    return alert_runs(spark, folder).select("pass_id", F.get(names, F.col("rank")).alias("level"), "first_t_ns", "last_t_ns", "n_events", "n_rows", F.round("duration_s", 6).alias("duration_s"))


def nearest_ego(spark: SparkSession, folder: str) -> DataFrame:
    rows = [
        read_table(spark, folder, table).filter("t_ns IS NOT NULL AND t_ns != 0").select(F.lit(table).alias("tbl"), F.col(row).alias("row_no"), "rig_id", "t_ns")
        for table, row in (("video_frames", "frame_row"), ("obstacles", "obs_row"))
    ]
    ego = read_table(spark, folder, "ego_states").filter("t_ns != 0").select("ego_row", "rig_id", "t_ns")
    return nearest_in_time(rows[0].unionAll(rows[1]), ego, "rig_id", "t_ns", "ego_row", tolerance=60_000_000)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_ego(spark, folder).filter("ego_row IS NOT NULL").select("tbl", "row_no", "ego_row")


def p5_paired(spark: SparkSession, folder: str) -> DataFrame:
    """Every row, also those without an ego state near enough."""
    return nearest_ego(spark, folder).select("tbl", "row_no", "ego_row", "dt_ns")


SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def _ties() -> dict:
    """Rows are tied by one vehicle, or by one session: the same site on the same date."""
    both = padded("site").isNotNull() & day("date").isNotNull()
    return {"vehicle": padded("vehicle"), "session": F.when(both, F.concat_ws("|", padded("site"), day("date")))}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    sets = linked_sets(read_table(spark, folder, "raw_records"), "rec_no", _ties())
    several = sets.groupBy("first_id").agg(F.count("*").alias("n")).filter("n >= 2").select("first_id")
    return sets.join(several, "first_id").select(F.col("row_id").alias("rec_no"), F.col("first_id").alias("first_rec_no"))


def record_splits(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_splits(read_table(spark, folder, "raw_records"), "rec_no", _ties(), padded("stratum"), SHARES)


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its split."""
    return record_splits(spark, folder).select(F.col("row_id").alias("rec_no"), F.col("first_id").alias("first_rec_no"), "split")


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and share of each split, per stratum."""
    counted = record_splits(spark, folder).groupBy("stratum", "split").agg(F.count("*").alias("n_rows"))
    return counted.withColumn("share", F.round(F.col("n_rows") / F.expr("sum(n_rows) OVER (PARTITION BY stratum)"), 4))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(read_table(spark, folder, "documents"), "text", ["doc_id"])


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each text comes back from its ids, and how many characters do."""
    encoded = encode_corpus(read_table(spark, folder, "documents"), "text", ["doc_id", "text"])
    back = decode_corpus(encoded.withColumnRenamed("text", "given"), "ids", ["doc_id", "given"])
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), (F.coalesce("given", F.lit("")) == F.col("text")).alias("same"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document stands in the mix."""
    return mix_sources(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"), "doc_id", "source", "text", ["repo", "kernel", "lang"])


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixed_shares(p8_mix(spark, folder), read_table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(read_table(spark, folder, "documents"), "doc_id", "text")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each text that stands in others."""
    return shared_parts(read_table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_shares": p9_shares, "p6_found": p6_found, "p6_splits": p6_splits, "p6_shares": p6_shares, "p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_runs": p3_runs, "p5_found": p5_found, "p5_paired": p5_paired}
_SIDES = """recs AS (SELECT rec_no, rig_id, lower(trim(split)) AS split, CASE WHEN length(d) >= 16 AND NOT regexp_matches(d, '^0+$') THEN substr(d, 1, 16) END AS digest, list_sort(list_distinct(regexp_extract_all(lower(description), '[a-z0-9]+'))) AS w
 FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(sha256)), '^(sha-?256\\W*)?(0x)?', ''), '[^0-9a-f]', '', 'g') AS d FROM raw_records))"""
_PAIRS = f"""{_SIDES}, dev AS (SELECT * FROM recs WHERE split = 'dev'), ev AS (SELECT * FROM recs WHERE split IN ('val', 'test')),
 words AS (SELECT rec_no, split, len(w) AS n, unnest(w) AS word FROM recs WHERE len(w) >= 10 AND split IN ('dev', 'val', 'test')),
 near AS (SELECT a.rec_no AS train_id, b.rec_no AS eval_id FROM words a JOIN words b USING (word) WHERE a.split = 'dev' AND b.split <> 'dev' GROUP BY a.rec_no, b.rec_no HAVING count(*) >= 0.7 * (max(a.n) + max(b.n) - count(*)) - 1e-9),
 pairs AS (SELECT train_id, eval_id, max(d) AS d, max(t) AS t FROM (SELECT dev.rec_no AS train_id, ev.rec_no AS eval_id, 1 AS d, 0 AS t FROM dev JOIN ev USING (digest) UNION ALL SELECT train_id, eval_id, 0, 1 FROM near) GROUP BY 1, 2)"""
_RANKED = """lv AS (SELECT pass_id, t_ns, max(rank) AS rank, count(*) AS n_rows FROM (SELECT pass_id, t_ns, CASE WHEN regexp_matches(b, '^[0-3]$') THEN b::INT WHEN b = '' THEN NULL WHEN starts_with('none', b) THEN 0 WHEN length(b) >= 2 AND starts_with('caution', b) THEN 1
 WHEN starts_with('warning', b) THEN 2 WHEN length(b) >= 2 AND starts_with('critical', b) THEN 3 END AS rank FROM (SELECT *, regexp_replace(lower(alert_level), '[^a-z0-9]', '', 'g') AS b FROM risk_frames)) WHERE rank IS NOT NULL AND t_ns IS NOT NULL GROUP BY 1, 2),
 runs AS (SELECT pass_id, max(rank) AS rank, min(t_ns) AS first_t_ns, max(t_ns) AS last_t_ns, count(*) AS n_events, sum(n_rows)::BIGINT AS n_rows FROM (SELECT *, sum(new) OVER (PARTITION BY pass_id ORDER BY t_ns) AS run FROM
 (SELECT *, CASE WHEN rank = lag(rank) OVER w AND t_ns - lag(t_ns) OVER w <= 2000000000 THEN 0 ELSE 1 END AS new FROM lv WINDOW w AS (PARTITION BY pass_id ORDER BY t_ns))) GROUP BY pass_id, run)"""
_NEAREST = """rows AS (SELECT 'video_frames' AS tbl, frame_row AS row_no, rig_id, t_ns FROM video_frames WHERE t_ns IS NOT NULL AND t_ns <> 0 UNION ALL SELECT 'obstacles', obs_row, rig_id, t_ns FROM obstacles WHERE t_ns IS NOT NULL AND t_ns <> 0),
 met AS (SELECT r.tbl, r.row_no, e.ego_row, abs(e.t_ns - r.t_ns) AS dt_ns, row_number() OVER (PARTITION BY r.tbl, r.row_no ORDER BY abs(e.t_ns - r.t_ns), e.ego_row) AS k FROM rows r JOIN ego_states e ON e.rig_id = r.rig_id AND e.t_ns BETWEEN r.t_ns - 60000000 AND r.t_ns + 60000000 WHERE e.t_ns <> 0)"""
_SETS = """n AS (SELECT rec_no, nullif(lower(trim(vehicle)), '') AS v, nullif(lower(trim(site)), '') || '|' || CASE WHEN regexp_matches(date, '^[0-9]{2}\\.') THEN substr(date, 7, 4) || substr(date, 4, 2) || substr(date, 1, 2) ELSE replace(date, '-', '') END AS s FROM raw_records),
 keys AS (SELECT rec_no, 'v' || v AS k FROM n WHERE v IS NOT NULL UNION ALL SELECT rec_no, 's' || s FROM n WHERE s IS NOT NULL), reps AS (SELECT k, min(rec_no) AS m FROM keys GROUP BY 1), e AS (SELECT rec_no AS a, m AS b FROM keys JOIN reps USING (k) UNION SELECT m, rec_no FROM keys JOIN reps USING (k)),
 walk(a, b) AS (SELECT rec_no, rec_no FROM raw_records UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a), sets AS (SELECT a AS rec_no, min(b) AS first_rec_no, count(*) AS size FROM walk GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_PAIRS} SELECT least(train_id, eval_id) AS rec_a, greatest(train_id, eval_id) AS rec_b FROM pairs",
    "p1_report": f"WITH {_PAIRS} SELECT r.split, r.rig_id, count(*) AS n_pairs, sum(d)::BIGINT AS n_by_digest, sum(t)::BIGINT AS n_by_text, count(DISTINCT eval_id) AS n_rows FROM pairs JOIN recs r ON r.rec_no = eval_id GROUP BY 1, 2",
    "p3_found": f"WITH {_RANKED} SELECT pass_id, first_t_ns, last_t_ns FROM runs WHERE n_events >= 2",
    "p3_runs": f"WITH {_RANKED} SELECT pass_id, ['none', 'caution', 'warning', 'critical'][rank + 1] AS level, first_t_ns, last_t_ns, n_events, n_rows, round((last_t_ns - first_t_ns) / 1e9::DOUBLE, 6) AS duration_s FROM runs",
    "p5_found": f"WITH {_NEAREST} SELECT tbl, row_no, ego_row FROM met WHERE k = 1",
    "p5_paired": f"WITH {_NEAREST} SELECT rows.tbl, rows.row_no, ego_row, dt_ns FROM rows LEFT JOIN (SELECT * FROM met WHERE k = 1) USING (tbl, row_no)",
    "p7_roundtrip": "SELECT doc_id, coalesce(length(text), 0) AS n_chars, true AS same FROM documents",
    "p6_found": f"WITH RECURSIVE {_SETS} SELECT rec_no, first_rec_no FROM sets WHERE size >= 2",
}
