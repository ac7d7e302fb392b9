import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import bitmaps, index, pruned, query_tables, search, tokenize
from textloom.plans import boolean as B
from textloom.plans.lakehouse import Corpus

DOCS = "doc_id long, text string"
NAMES = "abcdefg"


def formulas(depth):
    if depth == 0:
        return st.sampled_from(NAMES)
    part = formulas(depth - 1)
    return st.one_of(st.sampled_from(NAMES), part.map(lambda x: f"!({x})"), st.tuples(part, part).map(lambda x: f"({x[0]} || {x[1]})"), st.tuples(part, part).map(lambda x: f"({x[0]} {x[1]})"))


@settings(max_examples=300, deadline=None)
@given(formulas(4), st.sets(st.sampled_from(NAMES)), st.dictionaries(st.sampled_from(NAMES), st.integers(0, 9)))
def test_matches_have_a_term_of_the_cover(text, there, frequency):
    tree = B.parse(text)
    items = query_tables.postfix(tree) + ["!"] * B.needs_universe(tree)
    cover = query_tables.cheapest_cover(items, frequency)
    if B.evaluate(tree, there.__contains__) != B.needs_universe(tree):
        assert there & set(cover)


def test_the_cheaper_side_is_the_cover():
    assert query_tables.cheapest_cover(["a", "b", "&"], {"a": 9, "b": 2}) == ["b"]
    assert query_tables.cheapest_cover(["a", "b", "c", "|", "&"], {"a": 4, "b": 2, "c": 1}) == ["b", "c"]
    assert query_tables.cheapest_cover(["a", "!", "!", "b", "!", "&"], {"a": 4, "b": 1}) == ["a"]


def random_query(rnd, depth=3):
    if depth == 0 or rnd.random() < 0.3:
        return rnd.choice("abcdefgz")
    a, b = random_query(rnd, depth - 1), random_query(rnd, depth - 1)
    return rnd.choice([f"!({a})", f"({a} || {b})", f"{a} && ({b})", f"({a}) !({b})"])


@pytest.fixture(scope="module")
def small(spark):
    rnd = random.Random(11)
    rows = [(i * 7 - 300, " ".join(c for c in NAMES if rnd.random() < 0.1 + 0.1 * NAMES.index(c))) for i in range(200)]
    return rows, Corpus(spark.createDataFrame(rows, DOCS))


def test_a_table_of_queries(spark, small):
    rows, corpus = small
    rnd = random.Random(12)
    texts = [random_query(rnd) for _ in range(150)] + ["", " \t", "a &&", "(a", "a )", "!", "!z", "A b"]
    queries = spark.createDataFrame(list(enumerate(texts, 1)), "query_no long, query string")
    want, counts = [], []
    for n, text in enumerate(texts, 1):
        if not text.strip():
            continue
        try:
            tree, error = B.parse(text), None
        except B.QueryError as e:
            tree, error = None, str(e)
        hits = [i for i, t in rows if tree and B.evaluate(tree, t.split().__contains__)]
        want += [(n, text, error, i) for i in hits or [None]]
        counts.append((n, text, error, len(hits)))
    by_text = lambda found: sorted(map(str, found))
    assert by_text(map(tuple, corpus.boolean_many(queries).collect())) == by_text(want)
    assert by_text(map(tuple, corpus.boolean_counts(queries).collect())) == by_text(counts)
    assert by_text(map(tuple, corpus.boolean_batch(texts).collect())) == by_text(want)
    assert corpus.boolean_many(queries.limit(0)).count() == 0


def test_queries_pass_every_shard(spark, monkeypatch):
    for name, value in (("SHARD_WORDS", 2), ("QUERIES_A_ROW", 8), ("TERM_PARTS", 2), ("HITS_AT_ONCE", 3)):
        monkeypatch.setattr(query_tables, name, value)
    rnd = random.Random(14)
    rows = [(i * i * i * 1_000_003 - 10**12, " ".join(c for c in NAMES if rnd.random() < 0.3)) for i in range(120)]  # ids far apart
    corpus = Corpus(spark.createDataFrame(rows, DOCS))
    texts = [random_query(rnd) for _ in range(40)]
    queries = spark.createDataFrame(list(enumerate(texts, 1)), "query_no int, query string")
    want = {(n, i) for n, text in enumerate(texts, 1) for i, t in rows if B.evaluate(B.parse(text), t.split().__contains__)}
    many = corpus.boolean_many(queries)
    assert many.schema["query_no"].dataType.simpleString() == "int"
    hits = [(r["query_no"], r["doc_id"]) for r in many.collect()]
    assert len(hits) == len(set(hits)) and {x for x in hits if x[1] is not None} == want
    assert {n for n, i in hits if i is None} == set(range(1, 41)) - {n for n, _ in want}
    assert {r["query_no"]: r["hits"] for r in corpus.boolean_counts(queries).collect()} == {n: sum(x == n for x, _ in want) for n in range(1, 41)}


def test_pairs_of_queries_and_documents_are_not_shuffled(spark, small):
    queries = spark.createDataFrame([(n, f"{a} || !{b}") for n, (a, b) in enumerate(zip(NAMES * 30, NAMES[3:] * 60, strict=False), 1)], "query_no long, query string")
    known = query_tables.compiled(queries)
    dealt = query_tables._dealt(small[1].term_words, small[1].universe, known)
    # what is shuffled holds queries once a shard and no pair with a document
    shards = dealt.agg(F.max("shard") + 1).first()[0]
    assert dealt.agg(F.sum(F.size("q"))).first()[0] == queries.count() * shards
    plan = small[1].boolean_many(queries)._jdf.queryExecution().sparkPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in after and "Join" not in after.replace("BroadcastHashJoin", "")


def test_bitmaps_are_sets(spark):
    rnd = random.Random(13)
    a, b = ({rnd.randrange(-200, 200) for _ in range(90)} for _ in range(2))
    table = lambda ids: bitmaps.bitmap(spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "doc_id long"))
    ids = lambda words: sorted(r[0] for r in bitmaps.documents(words).collect())
    x, y = table(a), table(b)
    assert ids(bitmaps.both(x, y)) == sorted(a & b) and ids(bitmaps.either(x, y)) == sorted(a | b) and ids(bitmaps.without(x, y)) == sorted(a - b)
    assert bitmaps.count(x).first()[0] == len(a) and bitmaps.count(x.limit(0)).first()[0] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_search_finds_the_same(spark, seed):
    rnd = random.Random(seed)
    words = ["goal", "goals", "match", "matches", "the", "team", "played", "play"]
    rows = [(i, " ".join(rnd.choices(words, weights=[1, 1, 1, 1, 9, 2, 1, 1], k=rnd.randrange(1, 12) * (9 if i % 251 == 0 else 1)))) for i in range(2000)]
    postings = index.word_postings(tokenize.token_stream(spark.createDataFrame(rows, DOCS)))
    postings = postings.persist()
    asked = search.query_terms(spark, ["goals", "the team", "play the the match", "nothing", "", "matches goal"])
    n = search.documents_with_terms(postings)
    want = sorted(map(tuple, search.ranked_search(asked, postings, n, 5).collect()))
    found, figures = pruned.ranked_search_pruned(asked, postings, pruned.word_blocks(postings, 16), pruned.stem_frequencies(postings), n, 5, size=16)
    assert sorted(map(tuple, found.collect())) == want
    read = {r["query_no"]: (r["blocks"], r["scored"]) for r in figures.collect()}
    assert all(scored <= blocks for blocks, scored in read.values()) and sum(b for b, _ in read.values()) > sum(s for _, s in read.values())
    postings.unpersist()


def test_blocks_are_left_out_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    corpus = Corpus(docs)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").limit(20)
    listed = items.select(F.col("item_id").alias("query_no"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("query"))
    _, figures = corpus.ranked_pruned(search.terms_of_queries(listed))
    assert figures.agg(F.sum("blocks") - F.sum("scored")).first()[0] > 0
