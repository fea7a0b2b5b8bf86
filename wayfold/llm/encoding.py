"""Token ids of a corpus by a public byte-level BPE vocabulary, and back."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.transducer import decode, machine_for, read_ranks
from wayfold.sources.shipping import ship_package

#: Where the public vocabulary files lie unless the caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _ids(ranks, count_only: bool):
    def run(batches):
        machine = machine_for(ranks.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            lengths, flat = machine.encode_many(texts.to_pylist())
            if count_only:
                out = pa.array(lengths)
            else:
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*kept, out], names=[*batch.schema.names[:-1], "ids"])

    return run


def _run(df: DataFrame, text: str, keep: list[str], vocabulary: str, count_only: bool) -> DataFrame:
    spark = df.sparkSession
    ship_package(spark)
    # One vocabulary file, under a megabyte whatever the corpus.
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    given = df.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    kinds = (kinds + ", " if kinds else "") + ("ids bigint" if count_only else "ids array<int>")
    return given.mapInArrow(_ids(ranks, count_only), kinds)


def encode_corpus(df: DataFrame, text: str, keep: list[str], *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep..., ids``: the token ids of each text, without special tokens; their strings are plain text.

    An empty and a null text both have the empty list.  One row for each row given, in one pass without
    a shuffle; a worker process keeps one lazily determinised machine (:mod:`.transducer`) for all its tasks.
    """
    return _run(df, text, keep, vocabulary, False)


def count_tokens(df: DataFrame, text: str, keep: list[str], *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep..., n_tokens``: as :func:`encode_corpus`, only the number of ids."""
    return _run(df, text, keep, vocabulary, True).withColumnRenamed("ids", "n_tokens")


def decode_corpus(df: DataFrame, ids: str, keep: list[str], *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep..., text``: the texts of lists of ids; empty for an empty list, null for null."""
    spark = df.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches):
        bytes_of = {rank: token for token, rank in read_ranks(ranks.value).items()}
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = [None if x is None else decode(bytes_of, x) for x in (lists[i].as_py() for i in range(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    given = df.select(*keep, F.col(ids).alias("_ids"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, kinds + "text string")
