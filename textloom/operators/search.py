"""Boolean and ranked search over postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import norm_ranked, ranked_length_ok, stem_normalised
from textloom.plans import boolean as B

ROUND = 6


def boolean_search(postings: DataFrame, universe: DataFrame, query: str, k: int = 0) -> DataFrame:
    """``doc_id`` of the documents that match, at most the ``k`` smallest ids of them; 0: all.

    Only postings of the query's terms are read and grouped. The table of all documents takes part only
    where the query also finds documents without any of its terms.
    """
    tree = B.parse(query)
    if tree is None:
        return universe.select("doc_id").limit(0)
    hits = _matches(postings, universe, {0: tree}).select("doc_id")
    return hits.orderBy("doc_id").limit(k) if k else hits


def _matches(postings: DataFrame, universe: DataFrame, trees: dict[int, B.Node]) -> DataFrame:
    """``query_no, doc_id`` for several queries in one pass over the postings of all their terms."""
    names = list(dict.fromkeys(t for tree in trees.values() for t in B.terms(tree)))
    found = postings.filter(F.col("term").isin(names)).groupBy("doc_id").agg(*B.flags(names))
    if any(B.needs_universe(tree) for tree in trees.values()):
        found = universe.select("doc_id").join(found, "doc_id", "left")
    flag = lambda t: F.coalesce(F.col(f"t{names.index(t)}"), F.lit(False))
    each = F.array_compact(F.array(*[F.when(B.condition(tree, flag), F.lit(n)) for n, tree in trees.items()]))
    return found.select(F.explode(each).alias("query_no"), "doc_id")


def boolean_batch(postings: DataFrame, universe: DataFrame, queries: Sequence[str], at_once: int = 64) -> DataFrame:
    """``query_no, query, error, doc_id``: hits of each query, numbered from 1 with blank ones counted.

    A query without hits, or with an error, has one row whose doc_id is null. Queries are worked on in groups, one pass
    over the postings for each. The list is the driver's; ``query_tables.answers`` takes a table of any length.
    """
    spark = postings.sparkSession
    rows, trees = [], {}
    for n, query in enumerate(queries, 1):
        if not query.strip():
            continue
        error = None
        try:
            if (tree := B.parse(query)) is not None:
                trees[n] = tree
        except B.QueryError as e:
            error = str(e)
        rows.append((n, query, error))
    listed = spark.createDataFrame(rows, "query_no int, query string, error string")
    numbers, hits = list(trees), spark.createDataFrame([], "query_no int, doc_id long")
    for lo in range(0, len(numbers), at_once):
        hits = hits.unionByName(_matches(postings, universe, {n: trees[n] for n in numbers[lo : lo + at_once]}))
    hits = hits.join(F.broadcast(listed), "query_no").select("query_no", "query", "error", "doc_id")  # the driver's list
    none = listed.join(hits.select("query_no").distinct(), "query_no", "left_anti").withColumn("doc_id", F.lit(None).cast("long"))
    return hits.unionByName(none)


def boolean_report(batch: DataFrame, forward: DataFrame, topres: int = 10) -> DataFrame:
    """``query_no, query, error, hits, rank, doc_id, title, url``: the first ``topres`` (1 at least) hits of each query."""
    by_doc = Window.partitionBy("query_no").orderBy("doc_id")
    counted = batch.groupBy("query_no").agg(F.count("doc_id").alias("hits"))
    ranked = batch.withColumn("rank", F.row_number().over(by_doc)).filter(F.col("rank") <= max(1, topres))
    return ranked.join(counted, "query_no").join(forward, "doc_id", "left").select(
        "query_no", "query", "error", "hits", F.when(F.col("doc_id").isNotNull(), F.col("rank")).alias("rank"), "doc_id", "title", "url"
    )


def with_titles(hits: DataFrame, forward: DataFrame) -> DataFrame:
    """Hits with titles and URLs; documents that the forward table lacks are left out."""
    return hits.join(forward, "doc_id")


def set_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_semi")


def set_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_not(universe: DataFrame, a: DataFrame) -> DataFrame:
    return universe.select("doc_id").join(a, "doc_id", "left_anti")


# ---- ranked ---------------------------------------------------------------------------------------


def tf_weight(tf: Column) -> Column:
    return 1 + F.log(tf.cast("double"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def query_terms(spark: SparkSession, queries: Sequence[str]) -> DataFrame:
    """``terms_of_queries`` of a list, numbered from 1 with blank ones counted."""
    rows = [(n, q) for n, q in enumerate(queries, 1) if q.strip()]
    return terms_of_queries(spark.createDataFrame(rows, "query_no int, query string"))


def terms_of_queries(listed: DataFrame) -> DataFrame:
    """``query_no, query, pos, exact, stem`` of ``listed (query_no, query)``: queries as bags of terms in the ranked form; repeats count."""
    words = listed.select("query_no", "query", F.posexplode(F.split(F.trim(F.regexp_replace("query", r"[ \t\r\n\f\x0B]+", " ")), " ")).alias("pos", "word"))
    kept = words.withColumn("exact", norm_ranked(F.col("word"))).filter(ranked_length_ok(F.col("exact")))
    return kept.select("query_no", "query", "pos", "exact", stem_normalised(F.col("exact")).alias("stem"))


def ranked_search(
    queried: DataFrame, words: DataFrame, n_docs: DataFrame, topk: int = 10, bonus: float = 0.5, look_up: str = "stem", form: str = "stem"
) -> DataFrame:
    """``query_no, query, rank, doc_id, score``: TF-IDF sums over the query's bag of terms.

    ``words`` is the table ``word_postings``; the index is its column ``form``, ``stem`` or ``term``, and ``look_up`` names
    the column of ``queried`` that is looked up there: ``stem`` or ``exact``. Each query term whose exact form is in a
    document with a score adds ``bonus``. Terms that repeat count twice. Scores are rounded to six digits before ties go
    to the smaller id, so that the order of sums does not decide. Weights and bonuses meet in one aggregate.
    """
    # a batch's terms come from the driver's list of queries
    terms = queried.select(F.col(look_up).alias("term"), "exact").collect()
    asked = F.broadcast(queried.select("query_no", "query", F.col(look_up).alias("term"), F.col("exact").alias("exact_term")))
    found = words.filter(F.col(form).isin(list({r["term"] for r in terms})))
    matched = found.groupBy(F.col(form).alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))
    df = matched.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.join(F.broadcast(n_docs)).select("term", idf(F.col("n"), F.col("df")).alias("idf"))
    scored = matched.join(F.broadcast(weights), "term").join(asked.select("query_no", "query", "term"), "term")
    scored = scored.select("query_no", "query", "doc_id", (tf_weight(F.col("tf")) * F.col("idf")).alias("part"), F.lit(0.0).alias("extra"))
    exact = words.filter(F.col("term").isin(list({r["exact"] for r in terms})))
    exact = exact.join(asked.select("query_no", "query", F.col("exact_term").alias("term")), "term")
    exact = exact.select("query_no", "query", "doc_id", F.lit(None).cast("double").alias("part"), F.lit(float(bonus)).alias("extra"))
    both = scored.unionByName(exact).groupBy("query_no", "query", "doc_id").agg(F.sum("part").alias("sum"), F.sum("extra").alias("extra"))
    scored = both.filter(F.col("sum").isNotNull()).select("query_no", "query", "doc_id", F.round(F.col("sum") + F.col("extra"), ROUND).alias("score"))
    best = Window.partitionBy("query_no").orderBy(F.col("score").desc(), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max(1, topk))
    return ranked.select("query_no", "query", "rank", "doc_id", "score")


def documents_with_terms(words: DataFrame) -> DataFrame:
    """One row ``n``: documents with at least one term that was kept."""
    return words.agg(F.count_distinct("doc_id").alias("n"))


def compare_stemming(queried: DataFrame, words: DataFrame, n_docs: DataFrame, topk: int = 10, bonus: float = 0.5) -> DataFrame:
    """``query_no, query, mode, rank, doc, score``: unstemmed terms (``no_stem``) and stems against the stemmed index."""
    out = None
    for mode, column in (("no_stem", "exact"), ("stem", "stem")):
        hits = ranked_search(queried, words, n_docs, topk, bonus, column)
        hits = hits.select("query_no", "query", F.lit(mode).alias("mode"), "rank", F.col("doc_id").alias("doc"), "score")
        out = hits if out is None else out.unionByName(hits)
    return out


# ---- reports --------------------------------------------------------------------------------------


def result_lines(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_no, rank, line``: ranked hits as they are shown; a query of ``queries (query_no)`` without any says so."""
    shown = F.concat(F.col("rank").cast("string"), F.lit(". doc="), F.col("doc_id").cast("string"), F.lit("\tscore="), F.format_string("%.6f", "score"))
    lines = queries.select("query_no").join(ranked, "query_no", "left")
    return lines.select("query_no", "rank", F.coalesce(shown, F.lit("(no results)")).alias("line"))


def slowest(timings: DataFrame, n: int = 10) -> DataFrame:
    """``rank, ms, query_no, hits, query``: the ``n`` slowest of timed queries; of equal ones the earlier query first."""
    by_time = Window.orderBy(F.col("ms").desc(), "query_no")
    top = timings.orderBy(F.col("ms").desc(), "query_no").limit(n)
    return top.select(F.row_number().over(by_time).alias("rank"), "ms", "query_no", "hits", "query")
