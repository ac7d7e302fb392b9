"""Token streams and their figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types

from textloom.functions.text import EXTENDED, tokens, word_count


def token_stream(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, token``: a row per token. No shuffle; a text without tokens has no row."""
    keys = [key] if isinstance(key, str) else key
    return docs.select(*keys, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


#: Texts whose tokens are listed together.
TEXTS_AT_ONCE = 2048


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(lo, TEXTS_AT_ONCE)
            lists = part.column(1)
            words = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            pairs, times = np.unique(words.indices.to_numpy().astype(np.int64) << 32 | row, return_counts=True)
            begin = np.searchsorted(pairs >> 32, np.arange(len(words.dictionary) + 1))
            of = pa.StructArray.from_arrays([part.column(0).take(pa.array(pairs & 0xFFFFFFFF)), pa.array(times, pa.int64())], [part.schema.names[0], "n"])
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), of)], ["token", "held"])


def token_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``token, held``: of some texts at a time each token that differs, with the texts ``(key, n)`` that have it and how often.

    No shuffle. What is made of a token's letters, as forms and stems, is so made once for many texts. Rows that share a key count apart.
    """
    listed = docs.select(key, tokens(F.col(text)).alias("tokens"))
    held = types.ArrayType(types.StructType([listed.schema[key], types.StructField("n", types.LongType())]))
    return listed.mapInArrow(_listed, types.StructType([types.StructField("token", types.StringType()), types.StructField("held", held)]))


def token_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents, text bytes, tokens and their mean length in bytes and in base characters.

    Works on each text's array of tokens, so only counts are shuffled.
    """
    found = docs.select(F.octet_length(F.coalesce(text, F.lit(""))).alias("size"), tokens(F.col(text)).alias("t"))
    joined = F.array_join("t", "")
    marks = EXTENDED.replace(r"0-9A-Za-z\x{0400}-\x{052F}", "")
    per = found.select(
        "size",
        F.size("t").cast("long").alias("n"),
        F.octet_length(joined).cast("long").alias("bytes"),
        F.length(F.regexp_replace(joined, f"-|{marks}", "")).cast("long").alias("chars"),
    )
    total = F.sum("n")
    return per.agg(
        F.count("*").alias("docs"),
        F.sum("size").cast("long").alias("text_bytes"),
        F.coalesce(total, F.lit(0)).alias("tokens"),
        F.try_divide(F.sum("bytes"), total).alias("avg_token_bytes"),
        F.try_divide(F.sum("chars"), total).alias("avg_token_chars"),
    )


def with_word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("word_count", word_count(F.col(text)))


def long_enough(docs: DataFrame, min_words: int, text: str = "text") -> DataFrame:
    """Documents of at least ``min_words`` words by the crawler's rule."""
    return with_word_count(docs, text).filter(F.col("word_count") >= min_words)


def with_progress(docs: DataFrame, name: str = "progress", text: str = "text") -> tuple[DataFrame, Observation]:
    """The documents, and an observation of how many and how many bytes an action on them has read, with no pass of its own."""
    seen = Observation(name)
    return docs.observe(seen, F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length(text)).alias("text_bytes")), seen
