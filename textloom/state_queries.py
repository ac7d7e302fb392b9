"""Queries of running numbers, readers, kept state and streams over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import crawl, ranges, search
from textloom.operators.numbering import numbered
from textloom.plans.scratch import scratch_path, settle
from textloom.queries import _NORM, _RANKED, _RX, _TASK_SQL, ORACLES, QUERIES, _changed_documents, _corpus, _docs, _pages, _rank_sql, _sql_stem, _tasks, query
from textloom.sources import json_array, paged
from textloom.streaming import progress, queue

__all__ = ["ORACLES", "QUERIES"]


# ---- ranked, for a table of queries ---------------------------------------------------------------

_FROM_BENCHMARK = f"""bench AS (
        SELECT item_id AS query_no, list_slice(regexp_extract_all(coalesce(text, ''), '{_RX}'), 1, 5) AS w FROM benchmark),
    asked AS (SELECT query_no, array_to_string(w, ' ') AS query, unnest(w) AS token FROM bench),
    normal AS (SELECT query_no, query, {_NORM} AS exact FROM asked),
    q AS (SELECT query_no, query, exact, {_sql_stem('exact')} AS stem FROM normal WHERE strlen(exact) BETWEEN 2 AND 64),
    tfs AS """


@query(f"WITH {_RANKED}, " + _FROM_BENCHMARK + _rank_sql([], [], "stem", "stem", 10).split("tfs AS", 1)[1])
def ranked_pruned(spark, sf_dir):
    """The first five words of each benchmark item as a query; blocks of documents that cannot be among its best are left out."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = F.slice(T.tokens(F.col("text")), 1, 5)
    asked = search.terms_of_queries(items.select(F.col("item_id").alias("query_no"), F.array_join(words, " ").alias("query")))
    return _corpus(spark, sf_dir).ranked_pruned(asked)[0]


# ---- numbers and readers --------------------------------------------------------------------------


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS ordinal FROM documents")
def doc_ordinals(spark, sf_dir):
    return numbered(_docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def export_array(spark, sf_dir):
    """Documents as indented JSON arrays, written and read back in byte ranges."""
    path = scratch_path(spark, "array")
    json_array.write_json_array(_docs(spark, sf_dir).select("doc_id", "text"), path)
    read = json_array.json_array(spark, path, 1 << 20).select(F.from_json("value", "doc_id long, text string").alias("d"))
    return read.select("d.doc_id", T.content_hash(F.col("d.text")).alias("content_hash"))


_MEMBERS = """members AS (
    SELECT 'c' || CAST(page_id % 7 AS VARCHAR) AS key, url AS member, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1 AS n FROM pages)"""


@query(f"WITH {_MEMBERS} SELECT key, CASE WHEN n < 20 THEN '' ELSE CAST(n // 20 AS VARCHAR) END AS token, CAST(n % 20 AS INTEGER) AS place, member FROM members")
def category_members(spark, sf_dir):
    """Members of categories, twenty a page; the first two pages of each, and from the stored tokens the others."""
    path = scratch_path(spark, "members")
    in_key = _pages(spark, sf_dir).select(F.concat(F.lit("c"), (F.col("page_id") % 7).cast("string")).alias("key"), F.col("url").alias("member"), "page_id")
    ordered = numbered(in_key, "key", "page_id", name="n", start=0)
    first = ordered.groupBy("key").agg(F.min("n").alias("first"))
    n = F.col("n") - F.col("first")
    placed = ordered.join(first, "key").select("key", F.floor(n / 20).alias("page"), (n % 20).cast("int").alias("place"), "member")
    paged.write_pages(placed, path)
    source = paged.listing_source("members", paged.folder_pages(path), [f"c{i}" for i in range(7)])
    begun = settle(paged.listed(spark, source, pages=2), "first-pages")
    rest = paged.listed(spark, source, paged.next_tokens(begun))
    return begun.unionByName(rest).select("key", "token", "place", "member")


# ---- state ----------------------------------------------------------------------------------------


@query(ORACLES["doc_upsert_changed"])
def doc_upsert_ranges(spark, sf_dir):
    """The same upsert into a state in ranges of keys, of which only those with changes are written."""
    old, new = _changed_documents(spark, sf_dir)
    path = scratch_path(spark, "state")
    ranges.write_state(old, path, crawl.KEY, 16)
    ranges.upsert(spark, path, new, crawl.KEY, crawl.upsert_documents, 16)
    return ranges.read_state(spark, path).select(*crawl.KEY, "content_hash", "created_at", "updated_at", "fetched_at")


_CRAWLED = """crawled AS (
    SELECT page_id, page_id // 40 AS listing, page_id % 40 AS place, strlen(html) % 3 <> 0 AS accepted FROM pages),
    tried AS (SELECT * FROM crawled QUALIFY row_number() OVER (PARTITION BY listing ORDER BY place) <= 15),
    summed AS (SELECT *, sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (ORDER BY listing, place) AS total FROM tried)"""


@query(f"WITH {_CRAWLED} SELECT page_id, accepted FROM summed WHERE total - CASE WHEN accepted THEN 1 ELSE 0 END < 50")
def accepted_until_target(spark, sf_dir):
    """Listings of forty pages; fifteen of each are tried until fifty were accepted."""
    i = F.col("page_id")
    crawled = _pages(spark, sf_dir).select("page_id", F.floor(i / 40).alias("listing"), (i % 40).alias("place"), (F.octet_length("html") % 3 != 0).alias("accepted"))
    return crawl.accepted_until_target(crawled, 50).select("page_id", "accepted")


# ---- streams --------------------------------------------------------------------------------------


def _queue_events(spark, sf_dir):
    """Each task as it is, a claim for each (source, part), and outcomes of the tasks that were being fetched."""
    tasks = _tasks(spark, sf_dir).withColumn("part", (F.substring_index("url_norm", "|", -1).cast("long") % 4).cast("int"))
    names = F.array(*map(F.lit, ("done", "skipped", "not_modified", "alias", "error")))
    fetched = tasks.filter("state = 'fetching'")
    told = fetched.select("source", "part", "url_norm", F.element_at(names, F.col("priority") + 1).alias("outcome"), F.lit("d").alias("detail"))
    claims = tasks.select("source", "part").distinct().select("*", F.lit(3).alias("most"), F.lit(300).cast("long").alias("seconds"), F.lit("w1").alias("worker"))
    every = None
    for kind, at, rows in (("task", 1, tasks), ("outcome", 1000, told), ("claim", 1000, claims)):
        rows = rows.withColumns({"kind": F.lit(kind), "at": F.lit(at).cast("long"), "ts": F.timestamp_seconds(F.lit(at))})
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    wanted = [f.split() for f in queue.EVENTS.split(", ")]
    return every.select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted])


@query(
    f"""WITH {_TASK_SQL}, parts AS (SELECT *, CAST(regexp_extract(url_norm, '([0-9]+)$', 1) AS BIGINT) % 4 AS part FROM tasks), best AS (
        SELECT source, url_norm FROM parts WHERE state IN ('queued', 'error') AND next_fetch_at <= 1000 AND locked_until <= 1000
        QUALIFY row_number() OVER (PARTITION BY source, part ORDER BY priority DESC, next_fetch_at, created_at, url_norm) <= 3)
    SELECT t.source, t.url_norm, CASE WHEN b.url_norm IS NOT NULL THEN 'fetching' WHEN state = 'fetching' THEN CASE WHEN priority = 4 THEN 'error' ELSE 'done' END ELSE state END AS state,
           CAST(CASE WHEN b.url_norm IS NOT NULL THEN 1300 WHEN state = 'fetching' THEN 0 ELSE locked_until END AS BIGINT) AS locked_until,
           CASE WHEN b.url_norm IS NOT NULL THEN 'w1' ELSE '' END AS locked_by,
           CASE WHEN state <> 'fetching' THEN next_fetch_at WHEN priority < 4 THEN 1000 + 86400 WHEN retries + 1 >= 5 THEN 1000 + 3600
                ELSE 1000 + CAST(least(3600, 30 * pow(2, retries)) AS BIGINT) END AS next_fetch_at,
           CAST(retries + CASE WHEN state = 'fetching' AND priority = 4 THEN 1 ELSE 0 END AS INTEGER) AS retries,
           CASE WHEN state <> 'fetching' THEN '' ELSE ['d', 'skipped: d', '304 not modified', 'alias->canonical d', ''][priority + 1] END AS note,
           CASE WHEN state = 'fetching' AND priority = 4 THEN CASE WHEN retries + 1 >= 5 THEN 'max_retries reached: d' ELSE 'd' END ELSE '' END AS last_error
    FROM parts t LEFT JOIN best b ON t.source = b.source AND t.url_norm = b.url_norm"""
)
def claim_stream(spark, sf_dir):
    """Tasks, claims and outcomes as a stream; the tasks as its last changes left them."""
    into, out, kept = (scratch_path(spark, name) for name in ("queue-events", "queue-changes", "queue-checkpoint"))
    _queue_events(spark, sf_dir).write.parquet(into)
    with queue.rocks(spark):
        queue.write_changes(spark.readStream.schema(queue.EVENTS).parquet(into), out, kept).awaitTermination()
    tasks = queue.latest_tasks(spark.read.schema(queue.CHANGES + ", batch int").parquet(out))
    return tasks.select(*crawl.KEY, "state", "locked_until", "locked_by", "next_fetch_at", "retries", "note", "last_error")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def stream_progress(spark, sf_dir):
    """A stream over documents in four files, one a batch, counted as it goes."""
    into, out, kept = (scratch_path(spark, name) for name in ("progress-in", "progress-counts", "progress-checkpoint"))
    docs = _docs(spark, sf_dir).select("doc_id", "source", "lang")
    docs.repartition(4).write.parquet(into)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(into)
    step = progress.counting(out, "source", "lang")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    return progress.totals(spark, out, "source", "lang").select("source", "lang", "n")
