import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import crawl
from textloom.operators.numbering import numbered, numbered_as_read, until_total, with_running_total
from textloom.sources import json_array, paged


class Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, n):
        self.at = n

    def read(self, n):
        part = self.data[self.at : self.at + n]
        self.at += n
        return part

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_ranges_may_begin_anywhere(monkeypatch):
    rnd = random.Random(1)
    text = lambda: "".join(rnd.choice('x"\\{}[],é\n') for _ in range(rnd.randrange(8)))
    for _ in range(500):
        objects = [{"a": text(), "b": [{"c": text()}] * rnd.randrange(2)} for _ in range(rnd.randrange(5))]
        data = json.dumps(objects, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5).encode()
        size = rnd.randrange(1, 20)
        monkeypatch.setattr(json_array, "_open", lambda _, data=data: Bytes(data))
        monkeypatch.setattr(json_array, "MORE_BYTES", rnd.randrange(1, 9))
        state, depth, found = json_array.OUTSIDE, 0, []
        for start in range(0, len(data), size):
            part = data[start : start + size]
            found += [json.loads(x) for _, x in json_array._records("f", start, len(part), state, depth)]
            after, more = json_array._effect(part, state)
            state, depth = after, depth + more
        assert found == objects and (state, depth) == (json_array.OUTSIDE, 0)


def test_json_arrays_in_ranges(spark, tmp_path):
    rows = [(i, '"}],[{\\ ' * (i % 5) + f"é{i}", None if i % 3 else "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    json_array.write_json_array(docs.repartition(2), f"{tmp_path}/a")
    (tmp_path / "a" / "odd.txt").write_text('[1, "{", [{"no": 1}], {"doc_id": -1, "text": "last"}]')
    (tmp_path / "a" / "none.txt").write_text("")
    read = json_array.json_array(spark, f"file://{tmp_path}/a", 777)
    got = read.select(F.from_json("value", "doc_id long, text string, more string").alias("d")).select("d.*")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*rows, (-1, "last", None)], key=str)
    assert read.rdd.getNumPartitions() > 4


def test_numbers(spark):
    rows = [(i % 3 if i % 7 else None, i) for i in range(1000)]
    table = spark.createDataFrame(rows, "a int, b int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(map(tuple, numbered(table, "a", "b").collect()), key=lambda r: r[2]) == [(*r, n) for n, r in enumerate(order, 1)]
    total, want = 0, {}
    for a, b in order:
        total += a or 0
        want[b] = total
    assert {r["b"]: r["total"] for r in with_running_total(table, "a", "a", "b").collect()} == want
    cut = [b for a, b in order if want[b] - (a or 0) < 50]
    assert sorted(r["b"] for r in until_total(table, "a", 50, ["a", "b"]).collect()) == sorted(cut)
    assert numbered(table.limit(0), "a").count() == 0


def test_lines_are_numbered_as_they_stand(spark, tmp_path):
    lines = [f"line {i}" if i % 9 else "" for i in range(3000)]
    (tmp_path / "q.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        scan = spark.read.text(str(tmp_path / "q.txt")).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        got = {r["ordinal"]: r["value"] for r in numbered_as_read(scan, "file", "block").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got[i] for i in range(1, len(got) + 1)] == lines


def test_accepted_until_target(spark):
    rnd = random.Random(2)
    rows = [(listing, place, rnd.choice([True, False, None])) for listing in range(20) for place in range(30)]
    want, accepted = [], 0
    for listing in range(20):
        for row in [r for r in rows if r[0] == listing][:15]:
            if accepted < 25:
                want.append(row)
                accepted += bool(row[2])
    got = crawl.accepted_until_target(spark.createDataFrame(rows, "listing int, place int, accepted boolean").repartition(3), 25)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.fixture
def listing(spark, tmp_path):
    members = [(key, n // 3, n % 3, f"{key}{n}") for key, size in (("a", 10), ("b", 3), ("c", 1)) for n in range(size)]
    path = f"file://{tmp_path}/pages"
    paged.write_pages(spark.createDataFrame(members, "key string, page long, place int, member string"), path)
    return {m[3] for m in members}, paged.folder_pages(path)


def test_pages_go_on_from_a_token(spark, listing):
    members, get = listing
    source = paged.listing_source("listing", get, ["a", "b", "c", "none"])
    first = paged.listed(spark, source, pages=2)
    begun = [r["member"] for r in first.collect()]
    tokens = paged.next_tokens(first)
    assert tokens["a"] == "2" and tokens["b"] == tokens["c"] == paged.END
    rest = [r["member"] for r in paged.listed(spark, source, tokens).collect()]
    assert sorted(begun + rest) == sorted(members) and len(begun) == 10


def test_pages_as_a_stream(spark, tmp_path, listing):
    members, get = listing
    spark.dataSource.register(paged.listing_source("listing_stream", get, ["a", "b", "c"]))

    def run():
        stream = spark.readStream.format("listing_stream").option("pages", 1).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()

    run()
    found = spark.read.parquet(f"{tmp_path}/out")
    run()  # nothing is read again
    assert sorted(r["member"] for r in found.collect()) == sorted(members) and spark.read.parquet(f"{tmp_path}/out").count() == len(members)
