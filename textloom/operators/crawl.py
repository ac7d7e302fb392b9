"""The crawl's state as tables: tasks with leases, documents with change detection, discovery by rounds.

Parquet has no update in place, so each operator takes a snapshot and what happened since, and returns the
next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import retry_delay
from textloom.functions.urls import normalize_url
from textloom.operators.numbering import numbered, until_total
from textloom.operators.web import category_priority
from textloom.plans.scratch import settle

KEY = ["source", "url_norm"]
TASKS = (
    "source string, url_norm string, state string, priority int, retries int, next_fetch_at long, locked_until long,"
    " locked_by string, created_at long, started_at long, finished_at long, note string, last_error string,"
    " meta map<string,string>"
)


def ready(now: int) -> Column:
    return F.col("state").isin("queued", "error") & (F.col("next_fetch_at") <= now) & (F.col("locked_until") <= now)


def claim(tasks: DataFrame, now: int, ttl: int, worker: str, per_source: int = 1) -> DataFrame:
    """Tasks after the best ``per_source`` ready ones of each source were leased to ``worker``.

    Best is the highest priority, then the earliest due and created, then the URL. Each partition first cuts a
    source to that many rows, so a source that holds most tasks is not gathered.
    """
    order = Window.partitionBy("source").orderBy(F.col("priority").desc(), "next_fetch_at", "created_at", "url_norm")
    best = tasks.filter(ready(now)).select(*KEY, "priority", "next_fetch_at", "created_at")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_source)
    joined = tasks.join(best.select(*KEY, F.lit(True).alias("won")), KEY, "left")
    won = F.coalesce("won", F.lit(False))
    lease = {"state": F.lit("fetching"), "locked_until": F.lit(now + ttl).cast("long"), "locked_by": F.lit(worker), "started_at": F.lit(now).cast("long")}
    return joined.select(*[F.when(won, lease[c]).otherwise(F.col(c)).alias(c) if c in lease else c for c in tasks.columns])


def release_expired(tasks: DataFrame, now: int) -> DataFrame:
    """Leases that ran out go back to the queue."""
    lost = (F.col("state") == "fetching") & (F.col("locked_until") <= now)
    return tasks.withColumn("state", F.when(lost, "queued").otherwise(F.col("state"))).withColumn(
        "locked_by", F.when(lost, "").otherwise(F.col("locked_by"))
    )


def finish(
    tasks: DataFrame, outcomes: DataFrame, now: int, recrawl: int = 86400, base: int = 30, cap: int = 3600, max_retries: int = 5
) -> DataFrame:
    """Tasks after ``outcomes (source, url_norm, outcome, detail)``.

    ``outcome`` is ``done``, ``skipped``, ``not_modified``, ``alias`` or ``error``; ``detail`` is the note, reason,
    canonical URL or message. An error waits twice as long each time, and ``cap`` once its tries are used up.
    """
    told = outcomes.select(*KEY, "outcome", F.coalesce("detail", F.lit("")).alias("detail"))
    joined = tasks.join(told, KEY, "left")
    none, failed = F.col("outcome").isNull(), F.col("outcome") == "error"
    used_up = F.col("retries") + 1 >= max_retries
    wait = F.when(failed & used_up, F.lit(cap).cast("long")).when(failed, retry_delay(F.col("retries"), base, cap)).otherwise(F.lit(recrawl).cast("long"))
    note = (
        F.when(F.col("outcome") == "skipped", F.concat(F.lit("skipped: "), "detail"))
        .when(F.col("outcome") == "not_modified", "304 not modified")
        .when(F.col("outcome") == "alias", F.concat(F.lit("alias->canonical "), "detail"))
        .otherwise(F.col("detail"))
    )
    message = F.when(used_up, F.concat(F.lit("max_retries reached: "), "detail")).otherwise(F.col("detail"))
    new = {
        "state": F.when(failed, "error").otherwise("done"),
        "locked_until": F.lit(0).cast("long"),
        "locked_by": F.lit(""),
        "finished_at": F.lit(now).cast("long"),
        "next_fetch_at": F.lit(now) + wait,
        "retries": F.col("retries") + failed.cast("int"),
        "note": F.when(failed, F.col("note")).otherwise(note),
        "last_error": F.when(failed, F.substring(message, 1, 5000)).otherwise(F.col("last_error")),
    }
    return joined.select(*[F.when(none, F.col(c)).otherwise(new[c]).alias(c) if c in new else c for c in tasks.columns])


def canonical_finds(outcomes: DataFrame, now: int, priority: int = 0) -> DataFrame:
    """What ``upsert_tasks`` takes for the canonical pages that ``alias`` outcomes name: due now, one row a page."""
    found = outcomes.filter((F.col("outcome") == "alias") & (F.coalesce("detail", F.lit("")) != ""))
    rows = found.groupBy("source", normalize_url(F.col("detail")).alias("url_norm")).agg(F.min("url_norm").alias("alias"))
    return rows.select(
        "source", "url_norm", F.lit(now).cast("long").alias("next_fetch_at"), F.lit(priority).alias("priority"),
        F.create_map(F.lit("alias"), F.col("alias")).alias("meta"), F.lit(0).alias("seq"),
    )


def finish_and_follow(tasks: DataFrame, outcomes: DataFrame, now: int, **rules) -> DataFrame:
    """``finish``, and the canonical pages of aliases queued."""
    return upsert_tasks(finish(tasks, outcomes, now, **rules), canonical_finds(outcomes, now), now)


def upsert_tasks(tasks: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """Tasks after ``found (source, url_norm, next_fetch_at, priority, meta, seq)``; of several finds of a key the
    last by ``seq`` sets priority and meta, and the earliest due time stays."""
    latest = found.groupBy(*KEY).agg(
        F.min("next_fetch_at").alias("f_next"),
        F.max_by(F.struct("priority", "meta"), "seq").alias("f"),
    )
    joined = tasks.join(latest, KEY, "full")
    new, seen = F.col("created_at").isNull(), F.col("f_next").isNotNull()
    fresh = {"state": F.lit("queued"), "retries": F.lit(0), "locked_until": F.lit(0).cast("long"), "locked_by": F.lit(""), "created_at": F.lit(now).cast("long")}
    out = {c: F.when(new, v).otherwise(F.col(c)) for c, v in fresh.items()}
    out |= {c: F.when(seen, F.col(f"f.{c}")).otherwise(F.col(c)) for c in ("priority", "meta")}
    out["next_fetch_at"] = F.least("next_fetch_at", "f_next")
    return joined.select(*[out[c].alias(c) if c in out else c for c in tasks.columns])


def upsert_documents(docs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Documents after ``fetched (source, url_norm, parsed_text, content_hash, word_count, fetched_at, status_code)``.

    What a fetch says about itself is always stored; text, hash and time of change only where the hash differs.
    Status 304 leaves text and word count as they are. Keys in ``docs`` and in ``fetched`` are unique.
    """
    f = fetched.select(*KEY, *[F.col(c).alias(f"f_{c}") for c in fetched.columns if c not in KEY])
    joined = docs.join(f, KEY, "full")
    seen, new = F.col("f_fetched_at").isNotNull(), F.col("created_at").isNull()
    same_page = F.col("f_status_code") == 304
    changed = seen & ~same_page & ~F.col("content_hash").eqNullSafe(F.col("f_content_hash"))
    out = {
        "fetched_at": F.when(seen, F.col("f_fetched_at")).otherwise(F.col("fetched_at")),
        "status_code": F.when(seen, F.col("f_status_code")).otherwise(F.col("status_code")),
        "word_count": F.when(seen & ~same_page, F.col("f_word_count")).otherwise(F.col("word_count")),
        "created_at": F.when(new, F.col("f_fetched_at")).otherwise(F.col("created_at")),
        "updated_at": F.when(changed, F.col("f_fetched_at")).otherwise(F.col("updated_at")),
        "parsed_text": F.when(changed, F.col("f_parsed_text")).otherwise(F.col("parsed_text")),
        "content_hash": F.when(changed, F.col("f_content_hash")).otherwise(F.col("content_hash")),
    }
    return joined.select(*[out[c].alias(c) if c in out else c for c in docs.columns])


def crawl_counters(pages: DataFrame, min_words: int) -> DataFrame:
    """One row of what was fetched ``(raw_html, parsed_text, word_count)``: downloaded, accepted and skipped pages, and the bytes
    and words of both."""
    accepted = F.col("word_count") >= min_words
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    of_accepted = lambda c: total(F.when(accepted, c))
    return pages.agg(
        F.count("*").alias("downloaded"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(~F.coalesce(accepted, F.lit(False))).alias("skipped_short"),
        total(F.octet_length("raw_html")).alias("raw_bytes"),
        of_accepted(F.octet_length("raw_html")).alias("accepted_raw_bytes"),
        of_accepted(F.col("word_count")).alias("accepted_words"),
        of_accepted(F.octet_length("parsed_text")).alias("accepted_text_bytes"),
    )


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """Progress: rows by the columns, most first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *columns)


def crawl_averages(docs: DataFrame) -> DataFrame:
    """One row: documents and their mean bytes of html and text and mean words."""
    return docs.agg(
        F.count("*").alias("docs"),
        F.avg(F.octet_length("raw_html")).alias("avg_raw_bytes"),
        F.avg(F.octet_length("parsed_text")).alias("avg_text_bytes"),
        F.avg("word_count").alias("avg_words"),
    )


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``node, depth``: what ``edges (parent, child)`` lead to from ``seeds (node)``, at its least depth.

    Each round is one join of the last round's nodes, less all seen; rounds are written, so none is computed again.
    """
    edges = settle(edges.select("parent", "child"), "edges")
    seen = settle(seeds.select("node", F.lit(0).alias("depth")).distinct(), "bfs")
    front = seen
    for depth in range(1, max_depth + 1):
        reached = edges.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node"))
        front = settle(reached.distinct().join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


FRONTIER = "node string, priority int, depth int"


def discover_categories(
    edges: DataFrame, seeds: DataFrame | None, max_depth: int | None, most: int | None = None, done: DataFrame | None = None, frontier: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``done (node, priority, depth, place)`` and ``frontier (node, priority, depth)``: categories best first.

    In each round all open categories of the least (priority, depth) are taken, in the order of their titles, and
    their children that may be followed are opened, down to ``max_depth``; None: all. It ends when nothing is open or ``most`` are done; what was returned then
    goes on where it stopped when it is given again.
    """
    spark = edges.sparkSession
    edges = settle(edges.select("parent", "child").filter(category_priority(F.col("child")) < 999), "category-edges")
    if done is None:
        done = spark.createDataFrame([], FRONTIER + ", place long")
    if frontier is None:
        frontier = seeds.select("node", category_priority(F.col("node")).cast("int").alias("priority"), F.lit(0).alias("depth")).filter("priority < 999").distinct()
    done, frontier = settle(done, "done-categories"), settle(frontier, "frontier")
    count = done.count()
    while most is None or count < most:
        best = frontier.agg(F.min(F.struct("priority", "depth")).alias("b")).select("b.*").first()
        if best["priority"] is None:
            break
        now = frontier.filter((F.col("priority") == best["priority"]) & (F.col("depth") == best["depth"]))
        if most is not None:
            now = now.orderBy("node").limit(most - count)
        taken = settle(numbered(now, "node", name="place", start=count + 1), "taken")
        done = settle(done.unionByName(taken), "done-categories")
        reached = edges.join(taken.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        depth = best["depth"] + 1
        opened = reached.withColumn("priority", category_priority(F.col("node")).cast("int")).withColumn("depth", F.lit(depth))
        opened = opened if max_depth is None else opened.filter(F.col("depth") <= max_depth)
        every = frontier.unionByName(opened).join(done.select("node"), "node", "left_anti")
        frontier = settle(every.groupBy("node", "priority").agg(F.min("depth").alias("depth")), "frontier")
        count = done.count()
    return done, frontier


def listing_pages_read(pages: DataFrame, misses: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Of ``pages (page, status)``, of each listing ``by`` which they are told apart, those read before the crawl gives up: after
    ``misses`` 404s on consecutive page numbers.

    Each 404 speaks for the pages at which a run that it is in may end; the first page for which enough speak ends the
    listing. So no listing is sorted or held in one task.
    """
    gone = pages.filter(F.col("status") == 404).select(*by, "page").distinct()
    ends = gone.select(*by, F.explode(F.sequence("page", F.col("page") + misses - 1)).alias("end"))
    stops = ends.groupBy(*by, "end").agg(F.count("*").alias("n")).filter(F.col("n") == misses)
    stops = stops.groupBy(*by).agg(F.min("end").alias("end"))
    joined = pages.join(stops, list(by), "left") if by else pages.join(F.broadcast(stops))
    return joined.filter(F.col("end").isNull() | (F.col("page") <= F.col("end"))).drop("end")


def accepted_until_target(pages: DataFrame, target: int, most: int = 15) -> DataFrame:
    """Of ``pages (listing, place, accepted, ...)`` those that a crawl gets before it stops: of each listing the first ``most`` by
    place, listing after listing, until ``target`` of them were accepted.

    (listing, place) tells pages apart. Of a listing only ``most`` rows leave a partition; the running count goes over ranges of listings.
    """
    first = Window.partitionBy("listing").orderBy("place")
    tried = pages.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n")
    counted = tried.withColumn("_one", F.coalesce(F.col("accepted"), F.lit(False)).cast("long"))
    return until_total(counted, "_one", target, ["listing", "place"]).drop("_one")
