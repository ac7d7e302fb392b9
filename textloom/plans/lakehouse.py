"""The whole way from documents to answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import bitmaps, index, pruned, query_tables, search, tokenize
from textloom.plans.scratch import scratch_path, settle


class Corpus:
    """Documents ``(doc_id, text)`` with the indexes that queries need, each built once when first used.

    Indexes are written to the shared folder, so later queries read tables instead of tokenising again. A table whose
    files are gone is built anew.
    """

    def __init__(self, docs: DataFrame, url: Column | None = None):
        self.docs, self._url, self._paths = docs, url, {}

    def _table(self, name: str, make) -> DataFrame:
        spark = self.docs.sparkSession
        if name in self._paths:
            try:
                return spark.read.parquet(self._paths[name])
            except AnalysisException:
                del self._paths[name]
        path = scratch_path(spark, name)
        make().write.parquet(path)
        self._paths[name] = path
        return spark.read.parquet(path)

    @property
    def tokens(self) -> DataFrame:
        return tokenize.token_stream(self.docs)

    @property
    def lists(self) -> DataFrame:
        return tokenize.token_lists(self.docs)

    @property
    def postings(self) -> DataFrame:
        """Boolean postings, each file's sorted by term."""
        return self._table("postings", lambda: index.boolean_postings(self.lists, to_write=True))

    @property
    def words(self) -> DataFrame:
        """Ranked postings, exact terms with their stems, each file's sorted by stem."""
        return self._table("words", lambda: index.word_postings(self.lists, to_write=True))

    @property
    def n_docs(self) -> DataFrame:
        return self._table("documents-with-terms", lambda: search.documents_with_terms(self.words))

    @property
    def forward(self) -> DataFrame:
        return self._table("forward", lambda: index.forward(self.docs, self._url))

    @property
    def term_words(self) -> DataFrame:
        """Bitmaps of the Boolean terms' documents, each file's sorted by term."""
        return self._table("term-words", lambda: bitmaps.bitmap(self.postings, "term").sortWithinPartitions("term", "word"))

    @property
    def universe(self) -> DataFrame:
        """The bitmap of all documents."""
        return self._table("universe", lambda: bitmaps.bitmap(self.docs))

    def bitmap_of(self, term: str) -> DataFrame:
        return self.term_words.filter(F.col("term") == term).select("word", "bits")

    def boolean(self, query: str, k: int = 0) -> DataFrame:
        return search.boolean_search(self.postings, self.docs, query, k)

    def boolean_batch(self, queries: Sequence[str]) -> DataFrame:
        return search.boolean_batch(self.postings, self.docs, queries)

    def boolean_many(self, queries: DataFrame) -> DataFrame:
        """Hits of a table of queries ``(query_no, query)``."""
        return query_tables.answers(self.term_words, self.universe, queries)

    def boolean_counts(self, queries: DataFrame) -> DataFrame:
        return query_tables.hit_counts(self.term_words, self.universe, queries)

    def ranked(self, queries: Sequence[str], topk: int = 10, bonus: float = 0.5, stem: bool = True) -> DataFrame:
        asked = search.query_terms(self.docs.sparkSession, queries)
        look_up, form = ("stem", "stem") if stem else ("exact", "term")
        return search.ranked_search(asked, self.words, self.n_docs, topk, bonus, look_up, form)

    def ranked_pruned(self, asked: DataFrame, topk: int = 10, bonus: float = 0.5) -> tuple[DataFrame, DataFrame]:
        """Hits of a table of query terms, as ``search.query_terms`` makes it, and how many blocks they took.

        Bounds and frequencies are made of the postings of the stems that are asked for, not of all.
        """
        asked = settle(asked, "asked")
        words = settle(pruned.of_stems(self.words, asked), "asked-words")
        return pruned.ranked_search_pruned(asked, words, pruned.word_blocks(words), pruned.stem_frequencies(words), self.n_docs, topk, bonus)

    def compare(self, queries: Sequence[str], topk: int = 10, bonus: float = 0.5) -> DataFrame:
        asked = search.query_terms(self.docs.sparkSession, queries)
        return search.compare_stemming(asked, self.words, self.n_docs, topk, bonus)
