import math
import random
import shutil
import statistics

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import index, search, tokenize, zipf
from textloom.plans import boolean as B
from textloom.plans.lakehouse import Corpus

TEXTS = {0: "a b", 1: "a c", 2: "b c d", 3: "", 4: None, 5: "A-b a"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def corpus(docs):
    return Corpus(docs)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("a b", [0]), ("a && b", [0]), ("a&b", [0]), ("A", [0, 1, 5]), ("a-b", [5]), ("a !b", [1, 5]), ("!!a", [0, 1, 5]),
        ("a || b c", [0, 1, 2, 5]), ("(a || b) c", [1, 2]), ("!(a b)", [1, 2, 3, 4, 5]), ("zz", []), ("!zz", [0, 1, 2, 3, 4, 5]),
        ("!", []), ("()", []), (")", []), ("&&", []), ("", []), ("a,", []),
    ],
)
def test_boolean(corpus, query, found):
    assert ids(corpus.boolean(query)) == found


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("a )", "Unmatched ')'"), ("( a", "Unmatched '('"), ("a &&", "Binary operator without 2 operands"),
        ("&& a", "Binary operator without 2 operands"), ("a !", "Binary operator without 2 operands"), ("(!) a", "NOT without operand"),
    ],
)
def test_errors(query, message):
    with pytest.raises(B.QueryError, match=message.replace("(", r"\(").replace(")", r"\)")):
        B.parse(query)


exprs = st.recursive(
    st.sampled_from("pqrs"),
    lambda x: st.one_of(x.map(lambda a: f"!({a})"), st.tuples(x, st.sampled_from(["&&", "||", " "]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})")),
    max_leaves=8,
)


def as_python(node):
    parts = [as_python(p) for p in node.parts]
    return node.term if node.kind == "term" else f"(not {parts[0]})" if node.kind == "not" else f"({f' {node.kind} '.join(parts)})"


@given(exprs, st.sets(st.sampled_from("pqrs")))
def test_trees_are_python_conditions(text, true):
    tree = B.parse(text)
    values = {c: c in true for c in "pqrs"}
    assert B.evaluate(tree, lambda t: t in true) == eval(as_python(tree), {}, values)
    python = text.replace("!", " not ").replace("&&", "and").replace("||", "or").replace("   ", " and ")
    assert B.evaluate(tree, lambda t: t in true) == eval(python, {}, values)


@given(exprs, exprs)
def test_laws(a, b):
    for left, right in ((f"({a}) && ({b})", f"({b}) && ({a})"), (f"!(({a}) || ({b}))", f"!({a}) && !({b})"), (f"!!({a})", a)):
        for true in (set(), {"p"}, {"q", "r"}, set("pqrs")):
            assert B.evaluate(B.parse(left), true.__contains__) == B.evaluate(B.parse(right), true.__contains__)


def test_batch_and_report(corpus):
    batch = corpus.boolean_batch(["a", "", "a )", "!zz"])
    rows = {(r["query_no"], r["doc_id"], r["error"]) for r in batch.collect()}
    assert rows == {(1, 0, None), (1, 1, None), (1, 5, None), (3, None, "Unmatched ')'"), *((4, i, None) for i in TEXTS)}
    report = {(r["query_no"], r["hits"], r["rank"], r["title"]) for r in search.boolean_report(batch, corpus.forward, 1).collect()}
    assert report == {(1, 3, 1, "Document 0"), (3, 0, None, None), (4, 6, 1, "Document 0")}


def test_set_operations(docs):
    a, b = docs.filter("doc_id < 3").select("doc_id"), docs.filter("doc_id > 1").select("doc_id")
    assert (ids(search.set_and(a, b)), ids(search.set_or(a, b)), ids(search.set_not(docs, a))) == ([2], [0, 1, 2, 3, 4, 5], [3, 4, 5])


def test_scores(spark):
    corpus = Corpus(spark.createDataFrame([(0, "goals goals xx"), (1, "yy zz")], "doc_id long, text string"))
    idf = math.log(3 / 2) + 1
    score = lambda q, **k: corpus.ranked([q], **k).first()["score"]
    assert score("xx") == pytest.approx(idf + 0.5, abs=1e-6)
    assert score("goal") == pytest.approx((1 + math.log(2)) * idf, abs=1e-6)
    assert score("xx xx") == pytest.approx(2 * (idf + 0.5), abs=1e-6)
    modes = {(r["mode"], r["doc"]) for r in corpus.compare(["goals"]).collect()}
    assert modes == {("stem", 0)}  # the unstemmed word is not in the stemmed index


def test_index_round_trip(spark, docs, tmp_path):
    tokens = tokenize.token_stream(docs)
    index.save_index(tokens, docs, f"{tmp_path}/i")
    loaded = index.load_index(spark, f"{tmp_path}/i")
    assert {r["check"]: r["bad"] for r in index.validate_index(loaded).collect()} == dict.fromkeys(
        ("repeated posting", "posting without document", "empty posting", "document count"), 0
    )
    assert ids(search.boolean_search(loaded["postings"], loaded["forward"], "a !b")) == [1, 5]
    assert {(r["term"], r["block"]): r["postings"] for r in index.inverted(loaded["postings"], 5).collect()}[("a", 1)] == [5]
    same = [sorted(map(tuple, x.collect())) for x in (index.inverted(loaded["postings"]), index.inverted_documents(docs))]
    assert same[0] == same[1] and {r[0]: r[3] for r in same[0]}["a"] == [0, 1, 5]


def test_unsound_and_other_indexes_are_refused(spark, docs, tmp_path):
    tokens, path = tokenize.token_stream(docs), f"{tmp_path}/i"
    took = index.save_index(tokens, docs, path).first()
    assert took["ms"] > 0 and took["ms_per_doc"] == pytest.approx(took["ms"] / 6)
    assert index.build_figures(index.index_meta(tokens.limit(0), docs.limit(0)), 0.0).first()["tokens_per_s"] == 0
    spark.createDataFrame([("a", 99, 1)], "term string, doc_id long, tf long").write.mode("append").parquet(f"{path}/postings")
    index.load_index(spark, path)
    with pytest.raises(ValueError, match="posting without document: 1"):
        index.load_index(spark, path, check=True)
    spark.read.parquet(f"{path}/meta").withColumn("version", F.lit(7)).write.parquet(f"{path}/next")
    spark.read.parquet(f"{path}/next").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError, match="version 7"):
        index.load_index(spark, path)


def test_lost_tables_are_built_anew(spark, docs):
    corpus = Corpus(docs)
    before = ids(corpus.boolean("a"))
    shutil.rmtree(corpus._paths["postings"].removeprefix("file://"))
    assert ids(corpus.boolean("a")) == before


@pytest.mark.parametrize("n", [1, 2, 9, 300, 301])
@pytest.mark.parametrize("s", [1.0, 0.37])
def test_median_of_ranges(spark, monkeypatch, n, s):
    monkeypatch.setattr(zipf, "FEW", 8)
    rnd = random.Random(n)
    freqs = sorted((rnd.choice([1, 1, 2, 3, 700, rnd.randrange(1, 5000)]) for _ in range(n)), reverse=True)
    df = spark.createDataFrame([(x,) for x in freqs], "freq long")
    ranges = zipf.frequency_ranges(df)
    got = zipf.median_level(ranges, s)
    assert got == pytest.approx(statistics.median(f * r**s for r, f in enumerate(freqs, 1)), rel=1e-12)
    assert zipf.median_level(ranges.limit(0), s) is None
    # many equal values
    same = spark.createDataFrame([(12, 1, 1), (6, 2, 2), (4, 3, 3), (3, 4, 4)] * 9, "freq long, first long, last long")
    assert zipf.median_level(same, 1.0) == 12.0


def test_result_lines_and_slowest(spark, corpus):
    listed = spark.createDataFrame([(1,), (2,)], "query_no int")
    lines = search.result_lines(corpus.ranked(["d-d c1c1 aa", "bb"]), listed).collect()
    assert [(r["query_no"], r["line"]) for r in lines if r["rank"] is None] == [(n, "(no results)") for n in (1, 2)]
    timed = spark.createDataFrame([(1, 2.0, 0, "x"), (2, 3.0, 1, "y"), (3, 2.0, 1, "z")], "query_no int, ms double, hits int, query string")
    assert [tuple(r)[:3] for r in search.slowest(timed, 2).collect()] == [(1, 3.0, 2), (2, 2.0, 1)]


def test_progress(docs):
    watched, seen = tokenize.with_progress(docs)
    assert tokenize.token_stream(watched).count() > 0 and seen.get == {"docs": 6, "text_bytes": 16}


@pytest.mark.parametrize("vocabulary", [0, 1, 5, 30])
def test_zipf_small(spark, vocabulary):
    rows = [(0, " ".join(f"w{i}" for i in range(vocabulary) for _ in range(vocabulary - i)))]
    freqs = zipf.term_frequencies(tokenize.token_stream(spark.createDataFrame(rows, "doc_id long, text string")))
    fit, table = zipf.zipf_fit(freqs).first(), zipf.zipf_table(freqs).collect()
    assert sorted(r["rank"] for r in table) == list(range(1, vocabulary + 1))
    if vocabulary == 30:
        assert (fit["r1"], fit["r2"]) == (10, 20)
    if vocabulary == 5:
        assert (fit["s"], fit["c"]) == (1.0, 5.0)
