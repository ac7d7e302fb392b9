"""What tasks hold and shuffle does not grow faster than the tables."""

import pyarrow as pa
from pyspark.sql import functions as F

from textloom import queries, state_queries
from textloom.functions import html as H
from textloom.operators import crawl, index, pruned, search, tokenize
from textloom.plans.lakehouse import Corpus


def test_pages_are_parsed_a_few_at_a_time(spark):
    source = [f"<p>page {i}" for i in range(100)] + [None]
    parts = list(H._pages(iter([pa.array(source)])))
    assert max(map(len, parts)) <= H.PAGES_AT_ONCE and sum(map(len, parts)) == 101
    rows = spark.createDataFrame(list(enumerate(source)), "i int, html string").coalesce(1)
    got = {r["i"]: r["s"] for r in rows.select("i", H.page(F.col("html"))["strings"]["text"].alias("s")).collect()}
    assert got == {i: ["page " + str(i)] for i in range(100)} | {100: []}


def test_exported_arrays_are_many_tasks(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(state_queries, "scratch_path", lambda *_: f"file://{tmp_path}/array")
    assert state_queries.export_array(spark, sf).count() == 200
    assert len(list((tmp_path / "array").glob("part-*"))) > 1


def test_categories_to_any_depth(spark):
    names = [f"Категория:{'Списки ' if i % 4 == 3 else ''}{i:02}" for i in range(12)]
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "parent string, child string")
    seeds = spark.createDataFrame([(names[0],)], "node string")
    done, frontier = crawl.discover_categories(edges, seeds, None)
    assert [(r["node"], r["depth"], r["place"]) for r in done.orderBy("place").collect()] == [(x, i, i + 1) for i, x in enumerate(names)]
    assert frontier.isEmpty()


def test_queries_of_documents_by_id(spark, sf):
    asked = queries._many_queries(spark, sf).collect()
    assert asked and all((r["query_no"] - 1) // 5 % 100 == 0 for r in asked)
    hits = queries.query_file(spark, sf)
    assert {r["query_no"] for r in hits.select("query_no").distinct().collect()} <= {1, 2}


def test_lists_count_as_streams_do(spark):
    rows = [(1, "The the lists, lists"), (1, "the List"), (2, None), (3, ""), (None, "the"), (4, "Списками списками x-y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    streams, lists = tokenize.token_stream(docs), tokenize.token_lists(docs)
    held = {r["token"]: len(r["held"]) for r in lists.collect()}
    assert held["the"] == 3 and held["lists"] == 1  # a row for all texts that have it
    for make in (index.boolean_postings, index.word_postings, index.ranked_postings, lambda t: index.ranked_postings(t, stemmed=False)):
        assert sorted(make(streams).collect(), key=repr) == sorted(make(lists).collect(), key=repr)
    for make in (index.boolean_postings, index.word_postings):
        dealt = make(lists, to_write=True)
        assert sorted(make(streams).collect(), key=repr) == sorted(dealt.collect(), key=repr)
        assert dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_repeated_postings_are_told_by_number(spark):
    rows = [("a", 1, 1), ("a", 1, 2), ("b", 1, 1), ("b", 2, 1)]
    tables = {
        "postings": spark.createDataFrame(rows, "term string, doc_id long, tf long"),
        "forward": spark.createDataFrame([(1,), (2,)], "doc_id long"),
        "meta": spark.createDataFrame([(2,)], "docs_count long"),
    }
    assert {r["check"]: r["bad"] for r in index.validate_index(tables).collect()}["repeated posting"] == 1


def test_pruned_search_reads_the_stems_asked_for(spark):
    docs = spark.createDataFrame([(i, f"goals goal team the w{i}") for i in range(300)], "doc_id long, text string")
    asked, corpus = search.query_terms(spark, ["goal the"]), Corpus(docs)
    found = {r["doc_id"]: r["rank"] for r in corpus.ranked_pruned(asked, topk=3)[0].collect()}
    assert found == {0: 1, 1: 2, 2: 3}
    assert set(corpus._paths) == {"words", "documents-with-terms"}  # no table of all terms' blocks
    kept = pruned.of_stems(corpus.words, asked)
    assert sorted({r["term"] for r in kept.collect()}) == ["goal", "goals", "the"] and kept.columns == corpus.words.columns
