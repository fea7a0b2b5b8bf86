"""Long exact spans shared between records: winnowed anchors as seeds, extended as far as texts agree."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.sources.checkpoints import cut
from wayfold.sources.shipping import ship_package

#: A seed is half a span; a window of a whole span holds ``span - seed + 1`` of them.
SEED_SHARE = 0.5
#: Window positions worked on at a time, so that a very long text needs no more memory than this.
SEGMENT = 1 << 19
#: Odd multipliers of the rolling and mixing steps.
BASE, MIX_A, MIX_B, MIX_C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))

_ANCHORS = "doc_id bigint, start bigint, last bigint, anchor bigint, context bigint"
_GRAMS = "doc_id bigint, anchor bigint, context bigint, several boolean, at bigint, gram bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * MIX_A
    x ^= x >> np.uint64(29)
    x *= MIX_B
    x ^= x >> np.uint64(32)
    return x


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    both = []
    for base in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        both.append(np.cumprod(out, dtype=np.uint64))
    return both[0], both[1]


class Rolling:
    """Hashes of any stretch of a text, each from two prefix sums."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        up, self.down = _powers(1 << max(12, n.bit_length()))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(points.astype(np.uint64) + MIX_C) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` successive values, from running minima of blocks of ``w``."""
    m = len(h)
    blocks = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:m] = h
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: m - w + 1], left[w - 1 : m])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def anchors_of(text: str, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``start, last, anchor, context`` of a text: for each run of window positions ``start`` to ``last``
    that pick the same seed hash, that hash and the hash of all the text those windows cover."""
    points, seed = _code_points(text), max(1, int(span * SEED_SHARE))
    found = []
    for a in range(0, len(points) - span + 1, SEGMENT):
        part = points[a : a + SEGMENT + span - 1]
        rolling = Rolling(part)
        picked = _window_minima(rolling.grams(seed), span - seed + 1)
        start = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
        last = np.append(start[1:], len(picked)) - 1
        found.append((start + a, last + a, picked[start], rolling.of(start, last + span)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, dtype=np.uint64) for _ in range(4))


def _anchor_batches(span: int):
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if text is None or len(text) < span or not ids[i].is_valid:
                    continue
                start, last, anchor, context = anchors_of(text, span)
                rows.append((np.full(len(start), ids[i].as_py(), dtype=np.int64), start.astype(np.int64), last.astype(np.int64), anchor.view(np.int64), context.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["doc_id", "start", "last", "anchor", "context"])

    return run


def _gram_batches(span: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                points = _code_points(row["text"])
                out: list[tuple] = []
                for place in row["places"]:
                    start, last = place["start"], place["last"]
                    grams = Rolling(points[start : last + span]).grams(span)
                    n = len(grams)
                    fill = lambda v, kind, n=n: np.full(n, v, dtype=kind)
                    out.append((fill(row["doc_id"], np.int64), fill(place["anchor"], np.int64), fill(place["context"], np.int64), fill(place["several"], bool), np.arange(n, dtype=np.int64), grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["doc_id", "anchor", "context", "several", "at", "gram"])

    return run


def shared_spans(df: DataFrame, doc_id: str, text: str, *, span: int = 200) -> DataFrame:
    """``doc_id, start_char, end_char``: the maximal stretches of each text of which every character lies in
    a span of at least ``span`` characters that stands verbatim in the text of another ``doc_id``.

    Positions are code points from 0, end excluded; nothing is normalised.  Null and short texts and null
    ids have no stretches; rows of one ``doc_id`` are one record; repeated texts under different ids share all.

    Each window of ``span`` characters picks the least of the seed hashes in it, the same one in every
    text, so windows that agree meet on that anchor.  An anchor is extended both ways over all windows
    that picked it; occurrences whose whole extent agrees fall into one class, and a class held by two
    documents is shared in full.  For classes held by one document the windows themselves meet, one
    representative of each class of the same anchor standing for all of its copies.  No pairs are made,
    and a hot passage is a few classes however many documents hold it.
    """
    ship_package(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    anchors = docs.mapInArrow(_anchor_batches(span), _ANCHORS)
    in_two = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b").select("anchor")
    seeds = cut(anchors.join(in_two, "anchor", "left_semi"))

    classes = seeds.groupBy("anchor", "context").agg((F.min("doc_id") != F.max("doc_id")).alias("several"), F.min(F.struct("doc_id", "start", "last")).alias("rep"))
    whole = seeds.join(classes.filter("several").select("anchor", "context"), ["anchor", "context"]).select("doc_id", "start", "last")

    open_anchors = classes.filter("NOT several").select("anchor").distinct()
    places = classes.join(open_anchors, "anchor", "left_semi").select("rep.doc_id", F.struct("anchor", "context", "several", "rep.start", "rep.last").alias("place"))
    by_doc = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    grams = docs.filter(F.length("text") >= span).join(by_doc, "doc_id").select("doc_id", "text", "places").mapInArrow(_gram_batches(span), _GRAMS)
    met = grams.groupBy("anchor", "gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("several").alias("s")).filter("a != b OR s").select("anchor", "gram")
    covered = grams.filter("NOT several").join(met, ["anchor", "gram"], "left_semi").select("anchor", "context", "at")
    islands = covered.withColumn("island", F.expr("at - row_number() OVER (PARTITION BY anchor, context ORDER BY at)")).groupBy("anchor", "context", "island").agg(F.min("at").alias("from"), F.max("at").alias("to"))
    part = seeds.join(islands, ["anchor", "context"]).select("doc_id", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("last"))

    stretches = whole.unionAll(part).select("doc_id", F.col("start").alias("a"), (F.col("last") + span).alias("b"))
    reached = "max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    opened = stretches.withColumn("new", F.expr(f"CASE WHEN a <= {reached} THEN 0 ELSE 1 END"))
    numbered = opened.withColumn("n", F.expr("sum(new) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING)"))
    return numbered.groupBy("doc_id", "n").agg(F.min("a").alias("start_char"), F.max("b").alias("end_char")).drop("n")


def shared_parts(df: DataFrame, doc_id: str, text: str, *, span: int = 200) -> DataFrame:
    """``doc_id, n_chars, n_spans, n_shared, share``: how much of each text stands elsewhere; share 0 for
    an empty or null text, one row per document."""
    sums = shared_spans(df, doc_id, text, span=span).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))
    sizes = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    joined = sizes.join(sums, "doc_id", "left")
    return joined.select("doc_id", "n_chars", F.coalesce("spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("chars", F.lit(0).cast("bigint")).alias("n_shared"), F.round(F.coalesce(F.try_divide("chars", "n_chars"), F.lit(0.0)), 6).alias("share"))
