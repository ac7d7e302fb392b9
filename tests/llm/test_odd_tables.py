"""Empty tables, columns with clashing names, and null and repeated ids, for each operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, mixing, near_dedup, personal_data, secret_scan, suffix_dedup, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
NAMES = "kind start end value row node h band bands label score bucket spans size kept group class_id hash n_bytes key anchor shard m c p part block v word bits features held_out toxic copy prefix need cut whole target".split()
TEXT = "password = 'Zx9kQ2mP7vL4' and mail joe@site.example about the long day at sea that we had "


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)


ROWS = [(i, f"{TEXT * (i % 3)}{i % 4} more words here now", f"s{i % 2}") for i in range(24)] + [(None, "x y", None), (5, TEXT, "s1"), (5, TEXT, "s1")]


def labels(spark, n=24):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)], LABELS)


def ranks():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


OPERATORS = {
    "secret_counts": lambda d: secret_scan.secret_counts(d),
    "find_secrets": lambda d: secret_scan.find_secrets(d),
    "remove_repeats": lambda d: suffix_dedup.remove_repeats(d),
    "encoding_digests": lambda d: bpe.encoding_digests(d, *ranks()),
    "personal_data": lambda d: personal_data.personal_data(d),
    "drop_near_copies": lambda d: near_dedup.drop_near_copies(d),
    "mix": lambda d: mixing.mix(d),
    "drop_toxic": lambda d: toxicity.drop_toxic(d, labels(d.sparkSession)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_empty_tables(spark, name):
    table = docs(spark, ROWS)
    clashing = table.withColumns({c: F.lit(f"{c}!") for c in NAMES})
    plain, odd = OPERATORS[name](table), OPERATORS[name](clashing)
    own = plain.columns if set(plain.columns) != set(table.columns) else table.columns
    found = [sorted(map(str, map(tuple, df.select(*own).collect()))) for df in (plain, odd)]
    assert found[0] == found[1] and found[0]
    assert OPERATORS[name](table.limit(0)).count() == 0
    assert OPERATORS[name](clashing.limit(0)).count() == 0


def test_vectors_with_clashing_columns_and_none(spark):
    rows = [(i, [float(i % 7), 1.0, -float(i)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clashing = table.withColumns({c: F.lit("x") for c in ("v", "p", "part", "block", "query_id", "score", "rank", "floor", "to", "of")})
    want, got = (sorted(map(tuple, topk.top_k(x, 3).collect())) for x in (table, clashing))
    assert want == got and len(want) == 9
    assert topk.top_k(table.limit(0)).count() == 0


def test_pages_with_clashing_columns_and_none(spark):
    rows = [(i, "http://h/", "x" * (i % 3) * 60) for i in range(12)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    clashing = table.withColumns({c: F.lit("x") for c in ("payload", "digest", "file", "offset", "length", "record_type", "refers_to", "date")})
    want, got = (sorted(map(str, map(tuple, warc.round_trip(x).select("page_id", "payload_digest", "record_type", "refers_to").collect()))) for x in (table, clashing))
    assert want == got and len(want) == 12
    assert warc.round_trip(table.limit(0)).count() == 0


def test_mix_takes_repeated_rows_and_null_ids_together(spark):
    rows = [(7, "a b c", "s"), (7, "a b c", "s"), (None, "d e", "s"), (None, "d e", "s"), (8, "f", "s")]
    got = [(r["doc_id"], r["size"], r["taken"] / r["size"]) for r in mixing.mix(docs(spark, rows)).collect()]
    assert len(got) == 5 and len(set(got)) == 3 and all(times in (1, 2) for _, _, times in got)
