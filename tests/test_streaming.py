from textloom.streaming import ingest

DOCS = "doc_id long, text string"


def test_index_grows(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/index"
    for batch in ([(1, "a b")], [(2, "b c")]):
        spark.createDataFrame(batch, DOCS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DOCS).parquet(source)
        ingest.append_to_index(stream, out, f"{tmp_path}/check").awaitTermination(60)
    postings = spark.read.parquet(f"{out}/postings/*")
    assert {(r["term"], r["doc_id"]) for r in postings.collect()} == {("a", 1), ("b", 1), ("b", 2), ("c", 2)}


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "B")], DOCS).write.parquet(f"{tmp_path}/in")
    stream = ingest.running_term_counts(spark.readStream.schema(DOCS).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("terms").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("terms").collect()} == {("a", 1), ("b", 2)}
