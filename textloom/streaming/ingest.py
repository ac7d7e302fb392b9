"""Structured Streaming around the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import ascii_lower
from textloom.operators.index import boolean_postings, forward
from textloom.operators.tokenize import token_stream


def append_to_index(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Adds each batch of a stream of new documents to the index below ``path``.

    A batch goes to a folder of its number, which a repeated batch overwrites, so each document is indexed
    once whatever fails. ``load`` such an index with ``spark.read.parquet(f"{path}/postings/*")``.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        boolean_postings(token_stream(batch)).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        forward(batch).write.mode("overwrite").parquet(f"{path}/forward/batch={number}")
        batch.unpersist()

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_term_counts(docs: DataFrame) -> DataFrame:
    """``term, freq`` over a stream of documents; complete or update mode."""
    return token_stream(docs).groupBy(ascii_lower(F.col("token")).alias("term")).agg(F.count("*").alias("freq"))


def fetches_by_window(fetches: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``start, source, outcome, n`` over a stream of fetches ``(ts, source, outcome)``; later ones than ``late`` are dropped."""
    per = fetches.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "source", "outcome")
    return per.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "source", "outcome", "n")
