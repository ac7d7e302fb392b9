"""Ranked search that leaves out what cannot be among the best.

Documents lie in blocks of ids. For each term and block the index knows the greatest frequency there, which with the term's idf bounds what
it adds to any score of the block. A query's bounds are summed by block; the blocks with the highest are scored first and give it a
floor, the score of its k-th best document so far. Blocks whose bound is below the floor are not scored. All queries of a table take part in the
same joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.search import ROUND, idf, tf_weight
from textloom.plans.scratch import settle

DOCUMENTS_A_BLOCK = 64
#: Blocks of a query that are scored for its floor.
FIRST_BLOCKS = 4


def block_of(size: int = DOCUMENTS_A_BLOCK):
    return F.floor(F.col("doc_id") / size)


def word_blocks(words: DataFrame, size: int = DOCUMENTS_A_BLOCK) -> DataFrame:
    """``stem, term, block, most``: the greatest frequency of an exact term in a block."""
    return words.groupBy("stem", "term", block_of(size).alias("block")).agg(F.max("tf").alias("most"))


def stem_frequencies(words: DataFrame) -> DataFrame:
    """``stem, df``: documents with any form of a stem."""
    return words.select("stem", "doc_id").distinct().groupBy("stem").agg(F.count("*").alias("df"))


def of_stems(table: DataFrame, queried: DataFrame) -> DataFrame:
    """The rows of ``table`` whose stem ``queried`` has. A term's stem is that of its exact form, so the rows of its exact form are among these."""
    return table.join(queried.select("stem").distinct(), "stem", "left_semi").select(table.columns)


def _asked(queried: DataFrame, frequencies: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``query_no, stem, times, idf``: repeated terms of a query once, with how often."""
    own = queried.groupBy("query_no", "stem").agg(F.count("*").alias("times"))
    known = own.join(frequencies, "stem").join(F.broadcast(n_docs))  # one row
    return known.select("query_no", "stem", "times", idf(F.col("n"), F.col("df")).alias("idf"))


def bounds(asked: DataFrame, exact: DataFrame, blocks: DataFrame, bonus: float) -> DataFrame:
    """``query_no, block, bound``: no document of the block has a higher score for the query."""
    of_stem = blocks.groupBy("stem", "block").agg(F.sum("most").alias("most"))  # a document's forms of a stem are counted together
    added = asked.join(of_stem, "stem").select("query_no", "block", (F.col("times") * tf_weight(F.col("most")) * F.col("idf")).alias("part"))
    extra = exact.join(blocks.select("term", "block"), "term").select("query_no", "block", (F.col("times") * F.lit(float(bonus))).alias("part"), F.lit(True).alias("extra"))
    both = added.withColumn("extra", F.lit(False)).unionByName(extra)
    summed = both.groupBy("query_no", "block").agg(F.sum("part").alias("bound"), F.bool_and("extra").alias("only_extra"))
    return summed.filter(~F.col("only_extra")).drop("only_extra")


def _scores(pairs: DataFrame, asked: DataFrame, exact: DataFrame, summed: DataFrame, words: DataFrame, bonus: float, size: int) -> DataFrame:
    """``query_no, doc_id, score`` of the documents in ``pairs (query_no, block)``; ``summed`` has the words' sums by stem and document."""
    placed = words.withColumn("block", block_of(size))
    stems = pairs.join(asked, "query_no").join(summed, ["stem", "block"])
    added = stems.select("query_no", "doc_id", (F.col("times") * tf_weight(F.col("tf")) * F.col("idf")).alias("part"), F.lit(0.0).alias("extra"))
    forms = pairs.join(exact, "query_no").join(placed.select("term", "block", "doc_id"), ["term", "block"])
    forms = forms.select("query_no", "doc_id", F.lit(None).cast("double").alias("part"), (F.col("times") * F.lit(float(bonus))).alias("extra"))
    both = added.unionByName(forms).groupBy("query_no", "doc_id").agg(F.sum("part").alias("sum"), F.sum("extra").alias("extra"))
    return both.filter(F.col("sum").isNotNull()).select("query_no", "doc_id", F.round(F.col("sum") + F.col("extra"), ROUND).alias("score"))


def ranked_search_pruned(
    queried: DataFrame, words: DataFrame, blocks: DataFrame, frequencies: DataFrame, n_docs: DataFrame, topk: int = 10, bonus: float = 0.5,
    size: int = DOCUMENTS_A_BLOCK, first: int = FIRST_BLOCKS,
) -> tuple[DataFrame, DataFrame]:
    """``query_no, query, rank, doc_id, score`` as ``search.ranked_search`` gives it by stems, and ``query_no, blocks, scored``: how many
    blocks have any of a query's terms and how many of these were scored.

    ``queried`` is a table like that of ``search.query_terms``, of any length. Only rows of the stems that are asked for are shuffled.
    """
    topk = max(1, topk)
    queried = settle(queried, "query-terms")
    words, blocks = (of_stems(table, queried) for table in (words, blocks))
    asked = settle(_asked(queried, frequencies, n_docs), "asked-stems")
    exact = settle(queried.groupBy("query_no", F.col("exact").alias("term")).agg(F.count("*").alias("times")), "asked-terms")
    summed = settle(words.groupBy("stem", "doc_id").agg(F.sum("tf").alias("tf")).withColumn("block", block_of(size)), "stem-documents")
    all_bounds = settle(bounds(asked, exact, blocks, bonus), "bounds")
    best = Window.partitionBy("query_no").orderBy(F.col("bound").desc(), "block")
    chosen = settle(all_bounds.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= first).select("query_no", "block"), "first-blocks")
    scored = settle(_scores(chosen, asked, exact, summed, words, bonus, size), "first-scores")
    by_score = Window.partitionBy("query_no").orderBy(F.col("score").desc(), "doc_id")
    floors = scored.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == topk).select("query_no", F.col("score").alias("floor"))
    # scores are rounded, so a bound may be below a score by that much
    alive = all_bounds.join(floors, "query_no", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - F.lit(10.0**-ROUND)))
    rest = settle(alive.select("query_no", "block").join(chosen, ["query_no", "block"], "left_anti"), "further-blocks")
    every = scored.unionByName(_scores(rest, asked, exact, summed, words, bonus, size))
    ranked = every.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= topk)
    names = queried.select("query_no", "query").distinct()
    figures = all_bounds.groupBy("query_no").agg(F.count("*").alias("blocks"))
    done = chosen.unionByName(rest).groupBy("query_no").agg(F.count("*").alias("scored"))
    return ranked.join(names, "query_no").select("query_no", "query", "rank", "doc_id", "score"), figures.join(done, "query_no")
