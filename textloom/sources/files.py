"""Reading and writing the files that the steps of a crawl and an index exchange."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered, numbered_as_read


def json_string_field(spark: SparkSession, path: str, field: str = "parsed_text", whole_files: bool = False) -> DataFrame:
    """``file, pos, value``: the string values of ``field`` at any depth, in order of appearance.

    Lines are read apart from each other, or whole files where objects span lines. Values that are no
    strings and strings with broken escapes are left out.
    """
    rows = spark.read.text(path, wholetext=whole_files).select("value", F.col("_metadata.file_path").alias("file"))
    quoted = rf'"{field}"\s*:\s*("(?:\\.|[^"\\])*+")'
    found = rows.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(quoted), F.lit(1))).alias("pos", "raw"))
    text = F.from_json(F.concat(F.lit('{"v":'), F.col("raw"), F.lit("}")), "v string")["v"]
    return found.select("file", "pos", text.alias("value")).filter(F.col("value").isNotNull())


def documents_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``source, url_norm, parsed_text, fetched_at, content_hash`` of a document export."""
    schema = "source string, url_norm string, parsed_text string, fetched_at long, content_hash string"
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def token_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, token`` of lines ``id token``; other lines, and ids that do not fit 32 bits without sign, are left out."""
    line = F.col("value")
    pair = r"^\s*(\d+)\s+(\S+)"
    rows = spark.read.text(path).filter(line.rlike(pair))
    rows = rows.select(F.regexp_extract(line, pair, 1).try_cast("long").alias("doc_id"), F.regexp_extract(line, pair, 2).alias("token"))
    return rows.filter(F.col("doc_id") < 1 << 32)


def signed_token_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, token`` of lines ``id token``, where ids may have a sign and must fit 32 bits; other lines are left out."""
    line = F.btrim(F.col("value"), F.lit(" \t\r\n\f\u000b"))
    pair = r"^([+-]?\d+)\s+(\S+)"
    rows = spark.read.text(path).filter(line.rlike(pair))
    rows = rows.select(F.regexp_extract(line, pair, 1).try_cast("int").cast("long").alias("doc_id"), F.regexp_extract(line, pair, 2).alias("token"))
    return rows.filter(F.col("doc_id").isNotNull())


def token_words(spark: SparkSession, path: str) -> DataFrame:
    """``token`` of lines of one word, trimmed; empty ones are left out."""
    word = F.btrim(F.col("value"), F.lit(" \t\r\n\f\u000b"))
    return spark.read.text(path).select(word.alias("token")).filter(F.col("token") != "")


def write_token_pairs(tokens: DataFrame, path: str, mode: str = "errorifexists") -> None:
    tokens.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "token").alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True) -> None:
    """Tab-separated, as rank tables and hits are."""
    df.write.mode(mode).option("sep", "\t").option("header", header).csv(path)


def write_zipf(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rank tables with six decimals."""
    write_table(table.withColumn("zipf_fit", F.format_string("%.6f", "zipf_fit")), path, mode)


def query_table(spark: SparkSession, path: str) -> DataFrame:
    """``query_no, query`` of a file of queries, one a line, numbered from 1 with blank ones counted."""
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = numbered_as_read(spark.read.text(path).select(F.col("value").alias("query"), *place), "file", "block", name="query_no")
    return lines.select("query_no", "query")


def append_records(records: DataFrame, path: str) -> None:
    """Adds records to a table of JSON lines."""
    records.write.mode("append").json(path)


def write_raw_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """``doc_id, raw_html`` of pages. A table instead of a file for each page, which no large store bears."""
    pages.select("doc_id", "raw_html").write.mode(mode).parquet(path)


def read_or_default(spark: SparkSession, path: str, schema: str, default: list[tuple] = ()) -> DataFrame:
    """A state written as JSON lines, or ``default`` where there is none yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame(list(default), schema)


def retry_sleep(attempt: int) -> float:
    """Seconds to wait after a failed attempt, numbered from 0."""
    return min(5.0, 0.5 * 2**attempt)


def with_due_times(urls: DataFrame, source: str, url: str, delay: float, name: str = "due") -> DataFrame:
    """``urls`` with the seconds after the start at which each may be asked for: those of a source are ``delay`` apart, in the order of
    their URLs. However the rows are dealt, a source gets no more requests in a time than one task would send it."""
    ordered = numbered(urls, source, url, name="_n")
    first = ordered.groupBy(source).agg(F.min("_n").alias("_first")).withColumnRenamed(source, "_source")
    joined = ordered.join(first, F.col(source).eqNullSafe(F.col("_source")))
    return joined.select(*urls.columns, ((F.col("_n") - F.col("_first")) * F.lit(float(delay))).alias(name))


def fetch(
    urls: DataFrame, get: Callable[[str], tuple[int, str]], url: str = "url", tries: int = 1, delay: float = 0.0, source: str | None = None,
    due: str | None = None, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """``url, status, body`` by a fetcher that executors call; after ``tries`` exceptions status is null and the body the last one's text.

    ``get`` is any function that can be sent to executors, a table look-up as well as a client. Between the requests of a task
    there are ``delay`` seconds or more; where ``source`` names a column, each source's requests are one task's, so
    that the delay holds for the source. Where ``due`` names a column, as ``with_due_times`` makes it, a request waits until so many
    seconds after now, so that a source's requests can be several tasks'.
    """
    began = time.time()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for batch in batches:
            rows = []
            for link, after in zip(batch["url"], batch["due"], strict=True):
                if (wait := began + after - time.time()) > 0:
                    sleep(wait)
                for attempt in range(tries):
                    if (wait := free - time.monotonic()) > 0:
                        sleep(wait)
                    free = time.monotonic() + delay
                    try:
                        rows.append((link, *get(link)))
                        break
                    except Exception as e:  # noqa: BLE001  the fetcher's own errors are results here
                        if attempt == tries - 1:
                            rows.append((link, None, str(e)))
                        else:
                            sleep(retry_sleep(attempt))
            yield pd.DataFrame(rows, columns=["url", "status", "body"]).astype({"status": "Int64"})

    rows = urls if source is None else urls.repartition(source)
    after = F.lit(0.0) if due is None else F.col(due).cast("double")
    return rows.select(F.col(url).alias("url"), after.alias("due")).mapInPandas(run, "url string, status long, body string")
