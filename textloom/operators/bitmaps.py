"""Sets of documents as bitmaps: a row has 64 ids, so set operations work on 64 documents at once.

A bitmap is a table of words ``word, bits``: bit b of word w stands for document ``64 * w + b``. Words without documents have no row, so a
rare term costs a row for each document and a common one a row for each 64. Words are spread over the cluster like any other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def word_of(doc_id: Column) -> Column:
    return F.shiftright(doc_id.cast("long"), 6)


def bit_of(doc_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), doc_id.cast("long").bitwiseAND(BITS - 1).cast("int"))


def bitmap(ids: DataFrame, *by: str) -> DataFrame:
    """``<by>, word, bits`` of the documents ``doc_id`` of each key; rows without an id are no documents."""
    known = ids.filter(F.col("doc_id").isNotNull())
    return known.groupBy(*by, word_of(F.col("doc_id")).alias("word")).agg(F.bit_or(bit_of(F.col("doc_id"))).alias("bits"))


def documents(words: DataFrame, *by: str) -> DataFrame:
    """``<by>, doc_id``: the documents of bitmaps."""
    places = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("bits", i) == 1)
    return words.select(*by, "word", F.explode(places).alias("bit")).select(*by, (F.col("word") * BITS + F.col("bit")).alias("doc_id"))


def count(words: DataFrame, *by: str) -> DataFrame:
    """``<by>, hits``: how many documents bitmaps have, without a row for each."""
    return words.groupBy(*by).agg(F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0).cast("long")).alias("hits"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents in both bitmaps."""
    met = a.join(b.withColumnRenamed("bits", "other"), "word")
    return met.select("word", F.col("bits").bitwiseAND(F.col("other")).alias("bits")).filter("bits <> 0")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents in at least one of two bitmaps."""
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of ``a`` that are not in ``b``; with all documents as ``a``, the complement."""
    met = a.join(b.withColumnRenamed("bits", "other"), "word", "left")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("other", F.lit(0).cast("long"))))
    return met.select("word", rest.alias("bits")).filter("bits <> 0")
