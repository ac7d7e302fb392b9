import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from textloom.operators import crawl, ranges
from textloom.streaming import ingest, progress, queue

KEY = ["source", "url_norm"]


def test_other_ranges_are_not_touched(spark, tmp_path):
    path = str(tmp_path / "state")
    old = spark.range(300).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("url_norm"), F.col("id").alias("n"))
    ranges.write_state(old, path, KEY, 16)
    files = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    for f in files:
        os.utime(f, ns=(1, 1))
    changes = spark.createDataFrame([("s", "7", -7), ("s", "new", -1)], "source string, url_norm string, n long")

    def merge(old, new):
        both = old.join(new.withColumnRenamed("n", "m"), KEY, "full")
        return both.select(*KEY, F.coalesce("m", "n").alias("n"))

    touched = ranges.upsert(spark, path, changes, KEY, merge, 16)
    assert 1 <= len(touched) <= 2
    for f in Path(path).rglob("*.parquet"):
        rewritten = int(f.parent.name.partition("=")[2]) in touched
        assert (f.stat().st_mtime_ns == 1) != rewritten and (f in files) != rewritten
    got = {r["url_norm"]: r["n"] for r in ranges.read_state(spark, path).collect()}
    assert got == {str(i): i for i in range(300)} | {"7": -7, "new": -1}
    assert ranges.upsert(spark, path, changes.limit(0), KEY, merge, 16) == []


def events(spark, rows):
    """rows of (url, at, kind, further fields)"""
    names = [f.split()[0] for f in queue.EVENTS.split(", ")]
    from datetime import datetime, timezone

    full = []
    for url, at, kind, more in rows:
        given = {"source": "s", "part": 0, "ts": datetime.fromtimestamp(at, timezone.utc), "at": at, "kind": kind, "url_norm": url} | more
        full.append(tuple(given.get(n) for n in names))
    return spark.createDataFrame(full, queue.EVENTS)


def test_leases_run_out_and_the_stream_goes_on(spark, tmp_path):
    into, out, kept = (str(tmp_path / n) for n in ("in", "out", "kept"))

    def run(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(into)
        with queue.rocks(spark):
            queue.write_changes(spark.readStream.schema(queue.EVENTS).parquet(into), out, kept, "0 seconds").awaitTermination(300)
        changes = spark.read.schema(queue.CHANGES + ", batch int").parquet(out)
        return {r["url_norm"]: r for r in queue.latest_tasks(changes).collect()}

    claim = {"most": 2, "seconds": 50, "worker": "w"}
    got = run([("a", 10, "found", {"priority": 1}), ("b", 10, "found", {"priority": 5}), ("c", 11, "found", {"priority": 3}), (None, 20, "claim", claim)])
    assert {u: r["state"] for u, r in got.items()} == {"a": "queued", "b": "fetching", "c": "fetching"} and got["b"]["locked_until"] == 70
    # after a restart the state is there: one outcome, and one lease that runs out
    got = run([("b", 30, "outcome", {"outcome": "error", "detail": "down"}), ("x", 31, "outcome", {"outcome": "done"})])
    assert got["b"]["state"] == "error" and got["b"]["next_fetch_at"] == 60 and got["b"]["retries"] == 1 and "x" not in got
    got = run([("d", 100, "found", {})])
    got = run([(None, 101, "claim", claim | {"most": 9})])
    assert {u: r["state"] for u, r in got.items()} == dict.fromkeys("abcd", "fetching") and got["c"]["locked_until"] == 151


def test_progress_and_stop(spark, tmp_path):
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(40).select("id", (F.col("id") % 2).alias("source")).repartition(8).write.parquet(into)
    stream = spark.readStream.schema("id long, source long").option("maxFilesPerTrigger", 1).parquet(into)
    told = progress.Progress(spark)
    try:
        holder = []

        def slow(batch, number):
            if number == 1:
                told.stop_after_batch(holder[0])
            time.sleep(0.5)

        def start():
            return stream.writeStream.queryName("counted").foreachBatch(progress.counting(out, "source", then=slow)).option("checkpointLocation", f"{tmp_path}/kept")

        holder.append(start().start())
        assert holder[0].awaitTermination(120) and holder[0].exception() is None
        seen = progress.totals(spark, out, "source")
        batches = seen.agg(F.max("batches")).first()[0]
        assert 2 <= batches < 8
        rest = start().trigger(availableNow=True).start()
        rest.awaitTermination(120)
        assert {r["source"]: r["n"] for r in progress.totals(spark, out, "source").collect()} == {0: 20, 1: 20}
        deadline = time.monotonic() + 30
        while told.table().agg(F.sum("input_rows")).first()[0] != 40 and time.monotonic() < deadline:
            time.sleep(0.5)
        assert told.table().agg(F.sum("input_rows")).first()[0] == 40
    finally:
        told.close()


def test_windows_and_outcomes(spark, tmp_path):
    rows = [("2026-01-01 00:01:00", "s", "done"), ("2026-01-01 00:09:00", "s", "done"), ("2026-01-01 00:11:00", "s", "error")]
    spark.createDataFrame(rows, "ts string, source string, outcome string").select(F.to_timestamp("ts").alias("ts"), "source", "outcome").write.parquet(f"{tmp_path}/f")
    stream = ingest.fetches_by_window(spark.readStream.schema("ts timestamp, source string, outcome string").parquet(f"{tmp_path}/f"))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((str(r["start"]), r["outcome"], r["n"]) for r in spark.table("windows").collect()) == [("2026-01-01 00:00:00", "done", 2), ("2026-01-01 00:10:00", "error", 1)]
    assert crawl.KEY == KEY
