"""Records of evaluation splits that also stand, exactly or almost, in the training split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import digest16, padded, words
from wayfold.sources.checkpoints import cut, join_small, written

#: Sets of more words than this meet on single words rather than pairs, whose number grows with the square of the set.
PAIRED = 80


def word_classes(records: DataFrame, side: str, text_words: str) -> DataFrame:
    """``class, no, words, n, has_train, has_eval, bits``: one row per distinct word set, numbered, its words
    ordered from rare to frequent over all classes; ``bits`` is a 64-bit picture of the set."""
    one = records.filter("class IS NOT NULL").groupBy("class").agg(F.first(text_words).alias("words"), F.max(F.col(side) == "train").alias("has_train"), F.max(F.col(side) == "eval").alias("has_eval"))
    one = cut(one.withColumn("no", F.monotonically_increasing_id()))  # the cut keeps the numbers as they are
    listed = one.select("no", F.explode("words").alias("word"))
    counts = listed.groupBy("word").agg(F.count("*").alias("df"))
    ranked = join_small(listed, counts, "word").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
    bits = F.expr("aggregate(words, 0L, (s, w) -> s | shiftleft(1L, cast(pmod(xxhash64(w), 64) AS int)))")
    return one.drop("words").join(ranked.select("no", F.col("ranked.word").alias("words")), "no").select("class", "no", "words", F.size("words").alias("n"), "has_train", "has_eval", bits.alias("bits"))


def _meeting_keys(threshold: float) -> Column:
    """``key, k, p`` of each place at which a set may meet another: its pairs (``k`` 2) or single words (1) of
    its prefix, with the place ``p`` of the last word."""
    spare = f"n - cast(ceil({threshold}D * n - 1e-9D) AS int)"
    pairs = "flatten(transform(slice(words, 1, m), (a, i) -> transform(slice(words, i + 2, greatest(m - i - 1, 0)), (b, j) -> struct(xxhash64(a, b) AS key, 2 AS k, i + j + 2 AS p))))".replace("m)", f"{spare} + 2)").replace("m -", f"{spare} + 2 -")
    single = f"transform(slice(words, 1, {spare} + 1), (a, i) -> struct(xxhash64(a) AS key, 1 AS k, i + 1 AS p))"
    none = "cast(array() AS array<struct<key: bigint, k: int, p: int>>)"
    return F.expr(f"concat(if(n * {threshold}D <= {PAIRED} + 1e-9D, {pairs}, {none}), if(n > {PAIRED}, {single}, {none}))")


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """``train_class, eval_class``: all pairs of classes, one held by training and one by evaluation rows,
    that share at least ``threshold`` of the words of the two together; also a class with itself.

    Two sets as similar as that share ``k`` words among the first ``n - ceil(threshold * n) + k`` of each, words
    ordered from rare to frequent.  Sets meet on the pairs of these words (of more than ``PAIRED`` words on single
    ones), so that meetings thin out with the square of the vocabulary.  Only numbers, sizes, places and bits
    travel to the meetings; where these leave room for the threshold, the words themselves are compared, once.
    """
    keyed = classes.select("no", "n", "bits", "has_train", "has_eval", F.inline(_meeting_keys(threshold)))
    sides = [keyed.filter(f"has_{s}").select(*[F.col(c).alias(f"{s}_{c}") for c in ("no", "n", "bits", "key", "k", "p")]) for s in ("train", "eval")]
    need = f"ceil(({threshold}D * (train_n + eval_n) - 1e-9D) / {1 + threshold}D)"
    room = f"train_k + least(train_n - train_p, eval_n - eval_p) >= {need} AND bit_count(train_bits ^ eval_bits) <= train_n + eval_n - 2 * {need}"
    alike = f"train_n >= {threshold}D * eval_n - 1e-9D AND eval_n >= {threshold}D * train_n - 1e-9D AND train_no != eval_no"
    met = sides[0].join(sides[1], F.expr(f"train_key = eval_key AND train_k = eval_k AND {alike} AND {room}")).select("train_no", "eval_no").distinct()
    for s in ("train", "eval"):
        met = met.join(classes.select(F.col("no").alias(f"{s}_no"), F.col("class").alias(f"{s}_class"), F.col("words").alias(f"{s}_words")), f"{s}_no")
    shared, both = F.size(F.array_intersect("train_words", "eval_words")), F.size("train_words") + F.size("eval_words")
    near = met.filter(shared >= threshold * (both - shared) - 1e-9).select("train_class", "eval_class")
    same = classes.filter("has_train AND has_eval").select(F.col("class").alias("train_class"), F.col("class").alias("eval_class"))
    return near.unionAll(same)


def overlaps(df: DataFrame, row_id: str, split: str, digest: str, text: str, keep: list[str], *, train=("dev",), evaluation=("val", "test"), threshold: float = 0.7, least_words: int = 10) -> DataFrame:
    """``train_id, eval_id, by_digest, by_text``, and of the evaluation row its ``eval_split`` and ``keep``.

    One row per pair of a training and an evaluation row that have the same digest (first 16 hex digits)
    or whose texts both have at least ``least_words`` distinct words and share at least ``threshold`` of
    them.  Rows in no known split, null or void digests, and null, empty or short texts match nothing;
    repeated rows all count.  Empty input gives no rows.

    Texts are canonicalised to their sorted words and hashed; each distinct word set is compared once
    (:func:`similar_classes`) and its rows are joined to the result.
    """
    name = padded(split)
    side = F.when(name.isin(*train), "train").when(name.isin(*evaluation), "eval")
    kept = [f"_keep{i}" for i in range(len(keep))]
    given = df.select(F.col(row_id).alias("id"), side.alias("side"), name.alias("split"), digest16(digest).alias("digest"), words(text).alias("words"), *[F.col(c).alias(k) for c, k in zip(keep, kept)]).filter(F.col("side").isNotNull())
    given = written(given.withColumn("class", F.when(F.size("words") >= least_words, F.unhex(F.md5(F.array_join("words", " "))))))
    train_rows = given.filter("side = 'train'").select(F.col("id").alias("train_id"), F.col("digest").alias("train_digest"), F.col("class").alias("train_class"))
    eval_rows = given.filter("side = 'eval'").select(F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), *kept, F.col("digest").alias("eval_digest"), F.col("class").alias("eval_class"))

    by_digest = train_rows.join(eval_rows, F.col("train_digest") == F.col("eval_digest")).select("train_id", "eval_id", "eval_split", *kept, F.lit(1).alias("digest"), F.lit(0).alias("text"))
    pairs = similar_classes(cut(word_classes(given, "side", "words")), threshold)
    by_text = pairs.join(train_rows.select("train_id", "train_class"), "train_class").join(eval_rows.drop("eval_digest"), "eval_class").select("train_id", "eval_id", "eval_split", *kept, F.lit(0).alias("digest"), F.lit(1).alias("text"))
    found = by_digest.unionAll(by_text).groupBy("train_id", "eval_id", "eval_split", *kept).agg((F.max("digest") == 1).alias("by_digest"), (F.max("text") == 1).alias("by_text"))
    return found.select("train_id", "eval_id", "eval_split", *[F.col(k).alias(c) for k, c in zip(kept, keep)], "by_digest", "by_text")
