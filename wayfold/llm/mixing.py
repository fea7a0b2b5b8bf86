"""Mixing sources to target weights, with soft membership of documents in sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.encoding import VOCABULARY, count_tokens
from wayfold.sources.checkpoints import cut, join_small, written
from wayfold.sources.shipping import ship_package

#: Labelled rows the classifier is fitted on: about so many at most, drawn by a hash of their id.
TRAIN_ROWS = 20_000
#: Hashed features of the classifier.
FEATURES = 1 << 14
#: Share of the total by which expected totals may miss their targets when the fit ends; it also ends when
#: a step moves them by under a tenth of it, or after ``STEPS``, and :func:`mixed_shares` shows what is missed.
TOLERANCE, STEPS = 1e-4, 60
#: Posteriors are rounded to steps of this size and brought back to sum 1, so that documents alike share one row of the fit.
GRAIN = 0.02
#: Places along the order of a domain's documents that one look at it tells apart, and how often it is looked at.
PLACES, LOOKS = 4096, 2


def sized_documents(df: DataFrame, doc_id: str, source: str, text: str, extra: list[str], *, train_rows: int = TRAIN_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens, terms``: one pass over the texts, written down.

    ``terms`` are the hashed distinct words of the whole text and the values of ``extra`` columns, for rows
    without a source and for about ``train_rows`` labelled ones at most, drawn by a hash of the id; else null.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    marks = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in extra]
    terms = F.array_distinct(F.transform(F.concat(words, F.array(*marks).cast("array<string>")), lambda x: F.hash(x)))
    labelled = df.filter(F.col(source).isNotNull()).count()
    drawn = F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < int(min(1.0, train_rows / max(1, labelled)) * (1 << 30))
    given = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.when(F.col(source).isNull() | drawn, terms).alias("terms"), F.col(text).alias("text"))
    return written(count_tokens(given, "text", ["doc_id", "source", "terms"], vocabulary=vocabulary))


def domain_posteriors(sized: DataFrame) -> DataFrame:
    """``doc_id, domains, posterior``: for each document of :func:`sized_documents` without a source the
    probability of each label, by a naive Bayes classifier fitted on the labelled rows that have terms.
    Without any labelled row the result is empty."""
    sample = sized.filter("source IS NOT NULL AND terms IS NOT NULL").select(F.col("source").alias("label"), "terms")
    unlabelled = sized.filter("source IS NULL").select("doc_id", "terms")
    if not sample.take(1):
        return unlabelled.select("doc_id", F.array().cast("array<string>").alias("domains"), F.array().cast("array<double>").alias("posterior")).limit(0)
    tf = HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True)
    model = Pipeline(stages=[StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc", handleInvalid="keep"), tf, NaiveBayes(featuresCol="features", labelCol="index")]).fit(sample)
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    scored = model.stages[2].transform(tf.transform(unlabelled))
    return scored.select("doc_id", labels.alias("domains"), F.slice(vector_to_array("probability"), 1, len(model.stages[0].labels)).alias("posterior"))


def _rate(steps: list[list[float]]):
    """The rate that gradient steps give a document: each adds its membership-weighted step and is
    projected back to [0, cap]."""
    table = "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in s) + ")" for s in steps) + ")"
    move = "aggregate(zip_with(p, g, (a, b) -> a * b), 0D, (s, x) -> s + x)"
    return F.expr(f"aggregate({table}, 0D, (r, g) -> greatest(0D, least(cap, r + {move})))")


def _fit(profiles: DataFrame, shares: list[float], total_tokens: float | None) -> list[list[float]]:
    """Gradient steps until expected totals meet ``shares`` of the total, or stand still (targets that caps put
    out of reach).  ``profiles`` has one row per membership ``p``, ``cap`` and number ``k`` of the domain."""

    def totals(rate):
        return [float(x or 0) for x in profiles.agg(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(k)) * rate) for k in range(len(shares))]).first()]

    held = totals(F.lit(1.0))
    if total_tokens is None:
        own = profiles.filter("k >= 0").groupBy("k").agg(F.sum(F.col("n_tokens") * F.get("p", F.col("k")) * F.col("cap")).alias("most")).collect()
        total_tokens = min([r["most"] / shares[r["k"]] for r in own if r["most"] > 0], default=0.0)
    history: list[list[float]] = []
    before, now = None, [0.0] * len(shares)
    for _ in range(STEPS):
        lack = [s * total_tokens - x if h > 0 else 0.0 for s, x, h in zip(shares, now, held)]
        still = before is not None and max(abs(a - b) for a, b in zip(now, before)) <= TOLERANCE / 10 * total_tokens
        if max(map(abs, lack), default=0.0) <= TOLERANCE * total_tokens or still:
            break
        history.append([x / h if h > 0 else 0.0 for x, h in zip(lack, held)])
        before, now = now, totals(_rate(history))
    return history or [[0.0] * len(shares)]


def rounded_copies(rated: DataFrame) -> DataFrame:
    """``rated`` (``doc_id, domain, n_tokens, cap, rate``, with one row per ``doc_id``) with ``copies``: rates
    rounded so that in each domain the copies' tokens fall short of the rates' by less than any document that
    could still be used once more.

    All get the whole part of their rate.  Those with a fraction left stand in order of a hash of their id over
    that fraction, and the first ones get one copy more while their tokens fit: counted per place of
    the order, then within the place at which they no longer do.  What is left is filled with the largest documents
    that fit, by size.  Only sums per place and counts per size are gathered, however large a domain is.
    """
    ship_package(rated.sparkSession)
    key = ((F.shiftrightunsigned(F.xxhash64(F.lit(8), "doc_id"), 11).cast("double") + 1) / float(1 << 53))
    docs = rated.withColumns({"_base": F.floor(F.col("rate") + 1e-9), "_frac": F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + 1e-9))})
    docs = cut(docs.withColumn("_s", F.when((F.col("_frac") > 1e-9) & (F.col("_base") < F.col("cap")), F.least(key / F.col("_frac"), F.lit(2.0)))))
    # Per domain: how many tokens are left to give, and the part of the order that is still open.
    state = docs.groupBy("domain").agg(F.sum(F.col("n_tokens") * (F.col("rate") - F.col("_base"))).alias("left")).select("domain", "left", F.lit(0.0).alias("low"), F.lit(2.0).alias("width"))
    for _ in range(LOOKS):
        state = cut(state.withColumn("width", F.col("width") / PLACES))
        open_ = join_small(docs.filter("_s IS NOT NULL").select("domain", "n_tokens", "_s"), state.select(F.col("domain").alias("_d"), "low", "width"), F.expr("domain <=> _d"))
        places = open_.withColumn("place", F.floor((F.col("_s") - F.col("low")) / F.col("width"))).filter(f"place >= 0 AND place < {PLACES}").groupBy("domain", "place").agg(F.sum("n_tokens").alias("n"))
        upto = places.withColumn("upto", F.expr("sum(n) OVER (PARTITION BY domain ORDER BY place)")).select(F.col("domain").alias("_d"), "place", "upto")
        fits = state.join(upto, F.expr("domain <=> _d AND upto <= left + 1e-6"), "left").groupBy("domain", "left", "low", "width").agg(F.max("place").alias("place"), F.max("upto").alias("given"))
        # Places that hold nothing are passed by up to the first that doesn't fit.
        nxt = upto.groupBy("_d").agg(F.collect_list(F.struct("place", "upto")).alias("all"))
        state = fits.join(nxt, F.expr("domain <=> _d"), "left").select(
            "domain", (F.col("left") - F.coalesce("given", F.lit(0))).alias("left"), "width",
            F.expr("low + width * coalesce(array_min(transform(filter(all, x -> x.upto > left + 1e-6), x -> x.place)), 0)").alias("low"),
        )
    state = cut(state)
    used = join_small(docs, state.select(F.col("domain").alias("_d"), "low"), F.expr("domain <=> _d"), "left").withColumn("copies", F.col("_base") + F.when(F.col("_s") < F.col("low"), 1).otherwise(0))
    used = cut(used.drop("_d", "low", "_s", "_frac", "_base"))
    # No more is left than one place holds.  Sizes that fit are taken from the largest down, as counts.
    spare = join_small(used.filter("copies < cap AND n_tokens > 0"), state.filter("left >= 1").select(F.col("domain").alias("_d"), "left"), F.expr("domain <=> _d AND n_tokens <= left"))
    sizes = spare.groupBy("domain", "n_tokens", "left").agg(F.count("*").alias("n"))
    taken = cut(sizes.groupBy("domain").applyInPandas(_largest_first, "domain string, n_tokens bigint, taken bigint"))
    most = taken.agg(F.max("taken")).first()[0]
    if most is None:
        return used
    of_size = join_small(spare.select("domain", "doc_id", "n_tokens"), taken.select(F.col("domain").alias("_d"), F.col("n_tokens").alias("_n"), "taken"), F.expr("domain <=> _d AND n_tokens = _n"))
    picked = of_size.withColumn("no", F.expr("row_number() OVER (PARTITION BY domain, n_tokens ORDER BY doc_id)")).filter(F.col("no") <= most).filter("no <= taken").select(F.col("doc_id").alias("_p"))
    return join_small(used, picked, F.expr("doc_id = _p"), "left").withColumn("copies", F.col("copies") + F.col("_p").isNotNull().cast("int")).drop("_p")


def _largest_first(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size fill what is left of one domain; one row in per distinct size."""
    pdf = pdf.sort_values("n_tokens", ascending=False, ignore_index=True)
    left, taken = float(pdf["left"].iloc[0]), []
    for size, n in zip(pdf["n_tokens"], pdf["n"]):
        taken.append(min(int(n), int((left + 1e-6) // size)))
        left -= taken[-1] * size
    return pdf[["domain", "n_tokens"]].assign(taken=np.array(taken, dtype=np.int64)).query("taken > 0")


def mix_sources(df: DataFrame, targets: DataFrame, doc_id: str, source: str, text: str, extra: list[str], *, total_tokens: float | None = None, train_rows: int = TRAIN_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, domain, n_tokens, rate, copies``: how often each document is used.

    ``targets`` is a small table ``source, target_share, max_repeats``.  A document belongs to its
    ``source``; one without belongs to the sources as the classifier's posteriors say (``domain`` is the
    likeliest, whose ``max_repeats`` holds).  Rates are fitted by projected gradient least squares on the
    sources' expected token totals: each step sums tokens by membership over all documents in Spark, and
    every rate moves by what its sources lack, within 0 and ``max_repeats``.  Documents of sources without
    a target get no copies, nor do empty and null texts matter (0 tokens).

    ``total_tokens`` is the size to mix to; by default the largest at which no source that has documents
    needs more than the repeats of these (those of which it is the ``domain``) allow.  A target without documents can't be met; its part stays unfilled.
    Rates are rounded to copies in tokens (:func:`rounded_copies`).
    """
    wanted = targets.filter(F.col("target_share") > 0).groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").collect()
    names, shares, caps = [r["source"] for r in wanted], [float(r["share"]) for r in wanted], [float(r["cap"]) for r in wanted]
    sized = sized_documents(df, doc_id, source, text, extra, train_rows=train_rows, vocabulary=vocabulary)
    soft = domain_posteriors(sized)
    steps = F.transform("posterior", lambda x: F.round(x / GRAIN) * GRAIN)
    whole = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    soft = soft.select("doc_id", "domains", "posterior", F.when(whole > 0, F.transform(steps, lambda x: x / whole)).otherwise(F.col("posterior")).alias("member"))

    def weight(name: str):
        return F.coalesce(F.get("member", F.array_position("domains", name).cast("int") - 1), F.lit(0.0))

    likeliest = F.get("domains", F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    columns = ["doc_id", "source", "n_tokens"]
    known = sized.filter("source IS NOT NULL").select(*columns, F.array(*[(F.col("source") == n).cast("double") for n in names]).cast("array<double>").alias("p"), F.col("source").alias("domain"))
    guessed = sized.filter("source IS NULL").select(*columns).join(soft, "doc_id", "left").select(*columns, F.array(*[weight(n) for n in names]).cast("array<double>").alias("p"), likeliest.alias("domain"))
    cap = F.create_map(*[x for n, c in zip(names, caps) for x in (F.lit(n), F.lit(c))]) if names else F.lit(None).cast("map<string,double>")
    docs = cut(known.unionAll(guessed).withColumn("cap", F.coalesce(F.try_element_at(cap, F.col("domain")), F.lit(0.0))))
    number = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("domain")).cast("int") - 1
    history = _fit(cut(docs.groupBy("p", "cap", F.coalesce(number, F.lit(-1)).alias("k")).agg(F.sum("n_tokens").alias("n_tokens"))), shares, total_tokens) if names else []
    rated = docs.select("doc_id", "source", "domain", "n_tokens", "cap", (_rate(history) if names else F.lit(0.0)).alias("rate"))
    return rounded_copies(rated).select("doc_id", "source", "domain", "n_tokens", F.round("rate", 9).alias("rate"), F.col("copies").cast("bigint").alias("copies"))


def mixed_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of either table what it adds to the mix.

    ``source, target_share, max_repeats, n_docs, n_used, most_copies``; ``expected_tokens`` by its documents' rates,
    ``n_tokens`` by their copies, ``residual`` (copies less rates), ``spare_tokens`` (the smallest document
    that could be used once more), ``share`` of the mix's tokens, ``filled`` (whether there is anything to meet the target with).
    """
    tokens = F.col("n_tokens") * F.col("copies")
    caps = F.broadcast(targets.groupBy(F.col("source").alias("_s")).agg(F.max("max_repeats").alias("_cap")))
    spare = F.when((F.col("copies") < F.col("_cap")) & (F.col("n_tokens") > 0), F.col("n_tokens"))
    used = mixed.join(caps, F.col("domain") == F.col("_s"), "left").groupBy(F.col("domain").alias("source")).agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("copies") > 0).alias("n_used"), F.max("copies").alias("most_copies"), F.sum(tokens).alias("n_tokens"), F.round(F.sum(F.col("n_tokens") * F.col("rate")), 3).alias("expected_tokens"), F.min(spare).alias("spare_tokens")
    )
    whole = mixed.agg(F.sum(tokens).alias("_all"))
    joined = targets.select("source", "target_share", "max_repeats").join(used, "source", "full").crossJoin(F.broadcast(whole))
    zero = F.lit(0).cast("bigint")
    counts = {c: F.coalesce(c, zero) for c in ("n_docs", "n_used", "most_copies", "n_tokens")}
    expected = F.coalesce("expected_tokens", F.lit(0.0))
    return joined.select(
        "source", "target_share", "max_repeats", *[c.alias(n) for n, c in counts.items()], expected.alias("expected_tokens"), F.round(counts["n_tokens"] - expected, 3).alias("residual"), "spare_tokens",
        F.round(F.coalesce(F.try_divide("n_tokens", "_all"), F.lit(0.0)), 6).alias("share"), F.coalesce(F.col("n_tokens") > 0, F.lit(False)).alias("filled"),
    )
