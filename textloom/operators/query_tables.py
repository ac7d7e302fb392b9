"""Boolean queries as data: a table of any number of queries, answered by one plan.

Queries are compiled to rows: the tree in postfix order, as an array of terms and signs. A query that documents without any of its terms
match is turned into its complement first, so that each compiled query only matches documents that have one of
some few terms.

Words (of 64 documents, see ``bitmaps``) are dealt into shards of bounded size, with the bitmaps of the terms that any query has. Each shard meets
all queries, which pass it as a stream, and folds a query's postfix array over its bitmaps, for all its documents at once. So what is shuffled
are the postings of the terms asked for and the queries once a shard; pairs of a query and a document that it finds are never shuffled or kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import bitmaps as M
from textloom.plans import boolean as B
from textloom.plans.scratch import settle

SIGNS = {"not": "!", "and": "&", "or": "|"}
#: Words of 64 documents in a shard, about, and in one that is made to use all cores; queries and parts of the terms that are one row, as
#: rows cost more than what they hold; and hits that a task holds before it hands them on.
SHARD_WORDS = 512
LEAST_WORDS = 32
QUERIES_A_ROW = 512
TERM_PARTS = 64
HITS_AT_ONCE = 1 << 19
UNIVERSE, TERM, QUERY = range(3)


def postfix(node: B.Node) -> list[str]:
    """A tree's terms and signs, operands first. Terms never hold a sign's character."""
    if node.kind == "term":
        return [node.term]
    return [x for part in node.parts for x in postfix(part)] + [SIGNS[node.kind]]


def cheapest_cover(items: Sequence[str], frequency: dict[str, int]) -> list[str]:
    """Terms of which each match of a compiled query has at least one: those with the fewest documents in all.

    For each operand the cover of its matches is kept and that of what does not match it; none (null) where documents without terms are among them.
    """

    def least(a, b):
        return b if a is None else a if b is None else min(a, b)

    def sum_(a, b):
        return None if a is None or b is None else (a[0] + b[0], sorted({*a[1], *b[1]}))

    stack: list[tuple] = []
    for item in items:
        if item == "!":
            yes, no = stack.pop()
            stack.append((no, yes))
        elif item in "&|":
            (yes2, no2), (yes1, no1) = stack.pop(), stack.pop()
            stack.append((least(yes1, yes2), sum_(no1, no2)) if item == "&" else (sum_(yes1, yes2), least(no1, no2)))
        else:
            stack.append(((frequency.get(item, 0), [item]), None))
    return stack[0][0][1]


def _compiled(queries: pd.Series) -> pd.DataFrame:
    rows = []
    for query in queries:
        try:
            tree = B.parse(query)
        except B.QueryError as e:
            rows.append((str(e), None, None, False))
            continue
        if tree is None:
            rows.append((None, None, None, False))
            continue
        complement = B.needs_universe(tree)
        items = postfix(tree) + ["!"] * complement
        rows.append((None, items, cheapest_cover(items, {}), complement))
    return pd.DataFrame(rows, columns=["error", "items", "cover", "complement"])


def compiled(queries: DataFrame) -> DataFrame:
    """``query_no, query, error, items, cover, complement`` of ``queries (query_no, query)``; blank and null ones are left out."""
    read = F.pandas_udf(_compiled, "error string, items array<string>, cover array<string>, complement boolean")
    asked = queries.filter(F.regexp_replace("query", r"\s+", "") != "")
    return asked.select("query_no", "query", read("query").alias("c")).select("query_no", "query", "c.*")


class Shard:
    """The bitmaps of a shard: a place for each word, and the words of each term."""

    def __init__(self, universe: list[pa.RecordBatch], terms: list[pa.RecordBatch]):
        column = lambda rows, name: np.concatenate([np.zeros(0, np.int64), *[x.column(name).to_numpy() for x in rows]]).astype(np.int64)
        every, word, bits = column(universe, "word"), column(terms, "word"), column(terms, "bits")
        self.words = np.unique(np.concatenate([every, word]))
        self.whole = np.zeros(len(self.words), np.int64)
        self.whole[np.searchsorted(self.words, every)] = column(universe, "bits")
        self.documents = (self.words[:, None] * M.BITS + np.arange(M.BITS)).ravel()
        names = pc.dictionary_encode(pa.chunked_array([x.column("term") for x in terms], pa.string()).combine_chunks())
        by = np.argsort(code := names.indices.to_numpy(), kind="stable")
        cuts = np.searchsorted(code[by], np.arange(len(names.dictionary) + 1)).tolist()
        self.place, self.bits = np.searchsorted(self.words, word[by]), bits[by]
        self.at = {t: slice(*x) for t, x in zip(names.dictionary.to_pylist(), zip(cuts[:-1], cuts[1:], strict=True), strict=True)}

    def of_term(self, term: str) -> np.ndarray | None:
        if (at := self.at.get(term)) is None:
            return None
        out = np.zeros(len(self.words), np.int64)
        out[self.place[at]] = self.bits[at]
        return out

    def matches(self, items: Sequence[str], cover: Sequence[str], complement: bool) -> np.ndarray | None:
        """The words that a compiled query finds; null: none. Each sign takes its operands off a stack, on which null has no document."""
        if not any(t in self.at for t in cover):
            return self.whole if complement else None
        stack: list[np.ndarray | None] = []
        for item in items:
            if item == "!":
                x = stack.pop()
                stack.append(np.full(len(self.words), -1, np.int64) if x is None else ~x)
            elif item in ("&", "|"):
                y, x = stack.pop(), stack.pop()
                if x is None or y is None:
                    stack.append(None if item == "&" else y if x is None else x)
                else:
                    stack.append(x & y if item == "&" else x | y)
            else:
                stack.append(self.of_term(item))
        found = stack[0]
        if complement:
            return self.whole if found is None else self.whole & ~found
        return found

    def hits(self, found: np.ndarray) -> np.ndarray:
        """The documents of words."""
        some = np.flatnonzero(found)
        byte = found[some].astype("<i8").view(np.uint8)
        bit = np.flatnonzero(np.unpackbits(byte, bitorder="little"))
        return self.documents[some[bit >> 6] * M.BITS + (bit & (M.BITS - 1))]


def _dealt(terms: DataFrame, universe: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of all documents, terms and compiled queries, by shard and in that order; each holds many."""
    asked = queries.filter(F.col("items").isNotNull())
    used = asked.select(F.explode(F.filter("items", lambda x: ~x.isin("!", "&", "|"))).alias("term")).distinct()
    n_words, n_queries = universe.count(), asked.count()
    cores = universe.sparkSession.sparkContext.defaultParallelism
    n_shards = max(1, -(-n_words // SHARD_WORDS), min(cores, -(-n_words // LEAST_WORDS)))
    shard = F.pmod(F.xxhash64("word"), F.lit(n_shards)).cast("int").alias("shard")
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).alias("part")
    every = universe.select(shard, F.lit(UNIVERSE).alias("kind"), part("word", 1), F.struct(F.lit("").alias("term"), "word", "bits").alias("t"))
    of_terms = terms.join(used, "term", "left_semi").select(shard, F.lit(TERM).alias("kind"), part("term", TERM_PARTS), F.struct("term", "word", "bits").alias("t"))
    each = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")
    query = F.struct("query_no", "query", "items", "cover", "complement").alias("q")
    passing = asked.select(each, F.lit(QUERY).alias("kind"), part("query_no", 1 + n_queries // QUERIES_A_ROW), query)
    rows = every.unionByName(of_terms).unionByName(passing, True).repartitionById(n_shards, F.col("shard"))
    held = rows.groupBy("shard", "kind", "part").agg(F.collect_list("t").alias("t"), F.collect_list("q").alias("q"))
    return held.select("shard", "kind", "t", "q").sortWithinPartitions("shard", "kind")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, pa.RecordBatch]]:
    """The queries that pass each shard, a row's at a time."""
    held: tuple[list, list] = ([], [])
    shard, number = None, None
    for batch in batches:
        for i, (own, kind) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
            if own != number:
                held, shard, number = ([], []), None, own
            rows = pa.RecordBatch.from_struct_array(batch.column("q" if kind == QUERY else "t").slice(i, 1).flatten())
            if kind != QUERY:
                held[kind].append(rows)
                continue
            if shard is None:
                shard, held = Shard(*held), ([], [])
            yield shard, rows


def _over_shards(rows: DataFrame, answer: Callable[[Shard, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, queries in _met(batches):
            yield from answer(shard, queries)

    return rows.mapInArrow(run, schema)


def _found(shard: Shard, queries: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The place and words of each query that finds any."""
    columns = (queries.column(c).to_pylist() for c in ("items", "cover", "complement"))
    for i, query in enumerate(zip(*columns, strict=True)):
        words = shard.matches(*query)
        if words is not None and words.any():
            yield i, words


def _documents(shard: Shard, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[int], hits: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, hits)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hits), pa.int64()))
        named = [queries.column(c).take(pa.array(rows)) for c in ("query_no", "query")]
        return pa.RecordBatch.from_arrays([*named, ids], ["query_no", "query", "ids"])

    rows, hits, many = [], [], 0
    for i, words in _found(shard, queries):
        rows.append(i)
        hits.append(shard.hits(words))
        many += len(hits[-1])
        if many >= HITS_AT_ONCE:
            yield batch(rows, hits)
            rows, hits, many = [], [], 0
    if rows:
        yield batch(rows, hits)


def _counts(shard: Shard, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    found = [(i, int(np.bitwise_count(words.view(np.uint64)).sum())) for i, words in _found(shard, queries)]
    if found:
        rows, hits = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([queries.column("query_no").take(pa.array(rows)), pa.array(hits, pa.int64())], ["query_no", "hits"])


def _hit_counts(terms: DataFrame, universe: DataFrame, known: DataFrame) -> DataFrame:
    """``query_no, hits`` of the compiled queries that find any document."""
    number = known.schema["query_no"].dataType.simpleString()
    return _over_shards(_dealt(terms, universe, known), _counts, f"query_no {number}, hits long").groupBy("query_no").agg(F.sum("hits").alias("hits"))


def answers(terms: DataFrame, universe: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_no, query, error, doc_id`` of ``queries (query_no, query)``: a row a hit, and a row without doc_id for a query that has none.

    Blank queries have no row. A query that cannot be read has its error, the others go on. Rows of hits leave the tasks that find them; which
    queries have none is found by counts.
    """
    known = settle(compiled(queries), "compiled-queries")
    number = known.schema["query_no"].dataType.simpleString()
    found = _over_shards(_dealt(terms, universe, known), _documents, f"query_no {number}, query string, ids array<long>")
    hits = found.select("query_no", "query", F.lit(None).cast("string").alias("error"), F.explode("ids").alias("doc_id"))
    some = settle(_hit_counts(terms, universe, known).select("query_no"), "queries-with-hits")
    none = known.join(some, "query_no", "left_anti").select("query_no", "query", "error", F.lit(None).cast("long").alias("doc_id"))
    return hits.unionByName(none)


def hit_counts(terms: DataFrame, universe: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_no, query, error, hits``: counts from bitmaps, without a row a hit."""
    known = settle(compiled(queries), "compiled-queries")
    counts = _hit_counts(terms, universe, known)
    return known.join(counts, "query_no", "left").select("query_no", "query", "error", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))
