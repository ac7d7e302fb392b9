"""Inverted and forward indexes.

The table of postings, a row per (term, document), is the primary form: it is spread over the cluster
whatever a term's document frequency is. The form with one array per term is derived on demand.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import ascii_lower, norm_boolean, norm_ranked, ranked_length_ok, stem_normalised
from textloom.functions.text import tokens as tokens_of
from textloom.functions.urls import title_from_url

IDS_A_BLOCK = 1 << 16
#: The layout of a written index.
VERSION = 1


def _opened(terms: DataFrame) -> DataFrame:
    """``term, ..., doc_id, tf`` of what streams have, a row for each time, or ``tokenize.token_lists``, a row for each text."""
    if "held" in terms.columns:
        return terms.select(*[c for c in terms.columns if c not in ("token", "held")], F.inline("held")).withColumnRenamed("n", "tf")
    return terms.drop("token", "pos").withColumn("tf", F.lit(1).cast("long"))


def boolean_postings(tokens: DataFrame, to_write: bool = False) -> DataFrame:
    """``term, doc_id, tf`` in the Boolean form of terms, of token streams or lists.

    ``to_write`` sorts each task's, of the one shuffle that counts them: by (term, doc_id), so that no term is one task's, and no pass
    over the texts is needed to find ranges.
    """
    rows = _opened(tokens.withColumn("term", norm_boolean(F.col("token"))))
    by = ["term", "doc_id"]
    dealt = rows.repartition(*by) if to_write else rows
    counted = dealt.groupBy(*by).agg(F.sum("tf").alias("tf"))
    return counted.sortWithinPartitions(*by) if to_write else counted


def _ranked_terms(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("term", norm_ranked(F.col("token"))).filter(ranked_length_ok(F.col("term")))


def word_postings(tokens: DataFrame, to_write: bool = False) -> DataFrame:
    """``term, stem, doc_id, tf``: the ranked form of terms, exact, each with its stem; ``to_write`` by (stem, term, doc_id)."""
    terms, stem = _ranked_terms(tokens), stem_normalised(F.col("term"))
    if not to_write:
        return _opened(terms).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")).select("term", stem.alias("stem"), "doc_id", "tf")
    by = ["stem", "term", "doc_id"]
    dealt = _opened(terms.withColumn("stem", stem)).repartition(*by)
    return dealt.groupBy(*by).agg(F.sum("tf").alias("tf")).select("term", "stem", "doc_id", "tf").sortWithinPartitions(*by)


def ranked_postings(tokens: DataFrame, stemmed: bool = True) -> DataFrame:
    """``term, doc_id, tf`` in the ranked form of terms, stemmed or exact.

    Stems are taken of what is left when equal terms of a document have been counted; of lists at once, which saves a shuffle.
    """
    if stemmed and "held" in tokens.columns:
        stems = _ranked_terms(tokens).select(stem_normalised(F.col("term")).alias("term"), "held")
        return _opened(stems).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    words = word_postings(tokens)
    return words.groupBy(F.col("stem").alias("term"), "doc_id").agg(F.sum("tf").alias("tf")) if stemmed else words.drop("stem")


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _in_blocks(pairs: DataFrame, ids_a_block: int) -> DataFrame:
    """Pairs are dealt before they are gathered: lists begun on both sides of a shuffle cost more than the rows they save."""
    rows = pairs.select("term", F.floor(F.col("doc_id") / ids_a_block).alias("block"), "doc_id").repartition("term", "block")
    held = F.array_sort(F.array_distinct(F.collect_list("doc_id")))
    return rows.groupBy("term", "block").agg(held.alias("postings")).select("term", "block", F.size("postings").cast("long").alias("df"), "postings")


def inverted(postings: DataFrame, ids_a_block: int = IDS_A_BLOCK) -> DataFrame:
    """``term, block, df, postings``: sorted arrays of a term's documents, one for each range of ids.

    Block n has the ids from ``n * ids_a_block``, so no array is longer than that, however frequent a term is.
    """
    return _in_blocks(postings.select("term", "doc_id"), ids_a_block)


def inverted_documents(docs: DataFrame, ids_a_block: int = IDS_A_BLOCK) -> DataFrame:
    """What ``inverted`` makes of the documents' Boolean postings, with one shuffle: a text's terms are made distinct where it is."""
    terms = F.array_distinct(tokens_of(ascii_lower(F.col("text"))))
    return _in_blocks(docs.select("doc_id", F.explode(terms).alias("term")), ids_a_block)


def forward(docs: DataFrame, url: Column | None = None) -> DataFrame:
    """``doc_id, url, title`` of all documents; without a URL the title is ``Document <id>``."""
    link = F.lit(None).cast("string") if url is None else url
    rows = docs.select("doc_id", F.coalesce(link, F.lit("")).alias("url"))
    named = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    return rows.withColumn("title", F.when(F.col("url") == "", named).otherwise(title_from_url(F.col("url"))))


def index_meta(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documents, tokens, terms, mean token bytes, and mean bytes over distinct terms. Rows may say in ``n`` how often they count."""
    terms = tokens.groupBy(norm_boolean(F.col("token")).alias("term")).agg(F.sum("n" if "n" in tokens.columns else F.lit(1)).alias("n"))
    size = F.octet_length("term")
    per_term = terms.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"),
        F.count("*").alias("unique_terms"),
        F.try_divide(F.sum(size * F.col("n")), F.sum("n")).alias("avg_token_bytes"),
        F.avg(size).alias("avg_term_bytes"),
    )
    return docs.agg(F.count("*").alias("docs_count")).join(F.broadcast(per_term))


def build_figures(meta: DataFrame, milliseconds: float) -> DataFrame:
    """``index_meta`` with ``ms, tokens_per_s, ms_per_doc``; rates without tokens, time or documents are 0."""
    took = F.lit(float(milliseconds))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return meta.select("*", took.alias("ms"), rate(F.col("total_tokens") * 1000.0, took).alias("tokens_per_s"), rate(took, F.col("docs_count")).alias("ms_per_doc"))


def save_index(tokens: DataFrame, docs: DataFrame, path: str, url: Column | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write postings, forward table and meta row below ``path``; returns ``build_figures``. Postings are sorted by term
    within files, so a filter on terms skips pages."""
    began = time.perf_counter()
    spark = docs.sparkSession
    boolean_postings(tokens, to_write=True).write.mode(mode).parquet(f"{path}/postings")
    forward(docs, url).write.mode(mode).parquet(f"{path}/forward")
    counted = spark.read.parquet(f"{path}/postings").select(F.col("term").alias("token"), F.col("tf").alias("n"))
    index_meta(counted, docs).withColumn("version", F.lit(VERSION)).write.mode(mode).parquet(f"{path}/meta")
    return build_figures(spark.read.parquet(f"{path}/meta").drop("version"), (time.perf_counter() - began) * 1000)


def load_index(spark: SparkSession, path: str, check: bool = False) -> dict[str, DataFrame]:
    """The tables of an index. One of another version is refused, and with ``check`` one that is not sound."""
    index = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "forward", "meta")}
    version = index["meta"].first()["version"]
    if version != VERSION:
        raise ValueError(f"{path} has version {version}, not {VERSION}")
    if check:
        bad = [f"{r['check']}: {r['bad']}" for r in validate_index(index).collect() if r["bad"]]
        if bad:
            raise ValueError(f"{path}: {', '.join(bad)}")
    return index


def validate_index(index: dict[str, DataFrame]) -> DataFrame:
    """``check, bad``: the number of rows that break each rule of an index; all 0 if it is sound."""
    postings, known = index["postings"], index["forward"].select("doc_id")
    # numbers meet instead of terms; only postings whose number comes again are compared themselves
    number = F.xxhash64("term", "doc_id").alias("number")
    again = postings.select(number).groupBy("number").count().filter("count > 1").select("number")
    twice = postings.select("term", "doc_id", number).join(again, "number", "left_semi").groupBy("term", "doc_id").count().filter("count > 1")
    strange = postings.select("doc_id").distinct().join(known, "doc_id", "left_anti")
    empty = postings.filter(F.col("term").isNull() | (F.col("term") == "") | (F.col("tf") < 1))
    count = index["meta"].select("docs_count").join(F.broadcast(known.agg(F.count("*").alias("n")))).filter("docs_count <> n")
    parts = {"repeated posting": twice, "posting without document": strange, "empty posting": empty, "document count": count}
    out = None
    for name, bad in parts.items():
        row = bad.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad")
        out = row if out is None else out.unionByName(row)
    return out
