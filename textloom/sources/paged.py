"""Listings that come page by page with a token for the next one, as a Spark data source for batches and streams.

``listing_source`` makes a source of a function that gets one page; any function that can be sent to executors will do, a client of
a service as well as a folder's reader. A key (a category) is a partition; its pages are read one after another where the
partition is, and tokens are what a reader goes on from.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: ``get(key, token)`` gives a page's members and the token of the next page, or none at the end; the first page's token is "".
Get = Callable[[str, str], tuple[Sequence[str], str | None]]
SCHEMA = "key string, token string, place int, member string, next_token string"
#: A key without further pages.
END = "\x00end"


class Pages(InputPartition):
    """Pages of a key from a token on, ``most`` of them at most, up to the one with token ``stop``."""

    def __init__(self, key: str, token: str, most: int, stop: str | None = None):
        super().__init__(key)
        self.key, self.token, self.most, self.stop = key, token, most, stop

    def rows(self, get: Get) -> Iterator[tuple]:
        token: str = self.token
        for _ in range(self.most):
            if token == END or token == self.stop:
                return
            members, further = get(self.key, token)
            follow = END if further is None else further
            for place, member in enumerate(members):
                yield self.key, token, place, member, follow
            token = follow


def listing_source(name: str, get: Get, keys: Sequence[str]) -> type[DataSource]:
    """A data source called ``name`` with columns ``key, token, place, member, next_token`` of the listings of ``keys``.

    Options: ``tokens``, JSON of where each key begins (a key that is not named: at its first page); ``pages``, how many pages of each
    key a batch read takes, or a stream's batch. A page without members gives no row.
    """

    class BatchReader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.tokens, self.most = json.loads(options.get("tokens", "{}")), int(options.get("pages", 1 << 30))

        def partitions(self) -> Sequence[InputPartition]:
            return [Pages(key, self.tokens.get(key, ""), self.most) for key in keys]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return partition.rows(get)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.tokens, self.most = json.loads(options.get("tokens", "{}")), int(options.get("pages", 1))
            self.told: dict[str, str] | None = None

        def initialOffset(self) -> dict:
            return {key: self.tokens.get(key, "") for key in keys}

        def latestOffset(self) -> dict:
            # only tokens are asked for here; executors get the members
            begun = self.told or self.initialOffset()
            self.told = {key: self._after(key, token) for key, token in begun.items()}
            return self.told

        def _after(self, key: str, token: str) -> str:
            for _ in range(self.most):
                if token == END:
                    break
                further = get(key, token)[1]
                token = END if further is None else further
            return token

        def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
            self.told = self.told or end
            return [Pages(key, start[key], 1 << 30, end[key]) for key in keys if start[key] != end[key]]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return partition.rows(get)

        def commit(self, end: dict) -> None:
            return None

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return BatchReader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self.options)

    return Listing


def write_pages(members: DataFrame, path: str) -> None:
    """``members (key, page, place, member)`` as a folder of pages: one JSON file for each key and page, as ``folder_pages`` reads them."""
    members.repartition("key", "page").sortWithinPartitions("key", "page", "place").write.partitionBy("key", "page").json(path)


def folder_pages(path: str) -> Get:
    """A getter over a folder that ``write_pages`` wrote; a page's token is its number."""

    def get(key: str, token: str) -> tuple[list[str], str | None]:
        store, root = fs.FileSystem.from_uri(path)
        page = int(token or 0)
        found = store.get_file_info(fs.FileSelector(f"{root}/key={key}/page={page}", allow_not_found=True))
        rows = []
        for file in sorted((f for f in found if f.base_name.endswith(".json")), key=lambda f: f.path):
            with store.open_input_stream(file.path) as source:
                rows += [json.loads(line) for line in source.read().splitlines()]
        rows.sort(key=lambda r: r["place"])
        more = store.get_file_info(f"{root}/key={key}/page={page + 1}").type == fs.FileType.Directory
        return [r["member"] for r in rows], str(page + 1) if more else None

    return get


def listed(spark: SparkSession, source: type[DataSource], tokens: dict[str, str] | None = None, pages: int | None = None) -> DataFrame:
    """A batch read of a listing source, registered for the session."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("tokens", json.dumps(tokens or {}))
    return (reader if pages is None else reader.option("pages", pages)).load()


def next_tokens(read: DataFrame) -> dict[str, str]:
    """Where each key goes on after the pages that were read: a token a key."""
    from pyspark.sql import functions as F

    # pages of a key are read in order, so the last place of the last page has the token; a row a key comes to the driver
    last = read.groupBy("key").agg(F.collect_set("token").alias("seen"), F.collect_set("next_token").alias("told"))
    rows = last.select("key", F.array_max(F.array_except("told", "seen")).alias("token")).collect()
    return {r["key"]: r["token"] for r in rows}
