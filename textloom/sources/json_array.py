"""Large JSON arrays, read in byte ranges.

A range may begin anywhere: within a string, or after a backslash. So each range is first read for what it does to each state it may be
entered in: the state in which it is left, and by how much the depth of brackets changes. These few numbers, a row a range, are
composed along a file, which tells every range its true state; then each reads its records. A record
belongs to the range in which it begins, which reads on to its end.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.scratch import settle

RANGE_BYTES = 32 << 20
MORE_BYTES = 1 << 20
RECORDS_A_BATCH = 256
#: States at a byte: outside of strings, in one, and in one after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_PART = re.compile(rb'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}\[\]]', re.DOTALL)
_REST_OF_STRING = re.compile(rb'(?:[^"\\]|\\.)*+(?:"|\\?\Z)', re.DOTALL)


def _after_string(data: bytes, end: int, begun: int) -> int:
    """The state after a string's part ``data[begun:end]`` that its pattern found."""
    part = data[begun:end]
    if end < len(data) or (part.endswith(b'"') and not _open_escape(part[:-1])):
        return OUTSIDE
    return ESCAPED if _open_escape(part) else INSIDE


def _open_escape(part: bytes) -> bool:
    """Whether an odd number of backslashes ends the part."""
    return (len(part) - len(part.rstrip(b"\\"))) % 2 == 1


def brackets(data: bytes, state: int) -> Iterator[tuple[int, int]]:
    """``(place, sign)`` of the brackets outside of strings, and last ``(-1, state)``, the state at the end."""
    at = 0
    if state != OUTSIDE:
        if state == ESCAPED and data:
            at = 1
        begun, end = at, _REST_OF_STRING.match(data, at).end()
        if state == ESCAPED and not data:
            yield -1, ESCAPED
            return
        state = _after_string(data, end, begun)
        at = end
    while state == OUTSIDE and (found := _PART.search(data, at)):
        at = found.end()
        sign = data[found.start()]
        if sign == 34:
            state = _after_string(data, at, found.start() + 1)
        else:
            yield found.start(), sign
    yield -1, state


def _effect(data: bytes, state: int) -> tuple[int, int]:
    """The state after ``data``, and the change of depth."""
    depth = 0
    for place, sign in brackets(data, state):
        if place < 0:
            return sign, depth
        depth += 1 if sign in b"{[" else -1
    raise AssertionError


def _open(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``file, number, start, length``: the ranges of all files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    cut = listed.filter("bytes > 0").select("file", "bytes", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("number", "start"))
    return cut.select("file", "number", "start", F.least(F.lit(size).cast("long"), F.col("bytes") - F.col("start")).alias("length"))


def _entered(effects: pd.DataFrame) -> pd.DataFrame:
    """All ranges of a file: the state and the depth in which each is entered."""
    state, depth, out = OUTSIDE, 0, []
    for row in effects.sort_values("number").itertuples():
        out.append((row.file, row.number, row.start, row.length, state, depth))
        depth += row.depths[state]
        state = row.states[state]
    return pd.DataFrame(out, columns=["file", "number", "start", "length", "state", "depth"])


def _records(file: str, start: int, length: int, state: int, depth: int) -> Iterator[tuple[int, str]]:
    """``(place, text)`` of the objects that begin in the range at depth 1."""
    with _open(file) as source:
        source.seek(start)
        data, base, begun = source.read(length), start, None
        while data:
            for place, sign in brackets(data, state):
                if place < 0:
                    state = sign
                    break
                if sign in b"{[":
                    if depth == 1 and sign == 123 and begun is None and base + place < start + length:
                        begun, held = base + place, []
                        cut = place
                    depth += 1
                else:
                    depth -= 1
                    if depth == 1 and begun is not None:
                        held.append(data[cut : place + 1])
                        yield begun, b"".join(held).decode("utf-8", "replace")
                        begun = None
                        if base + place >= start + length:
                            return
            if begun is None:
                return
            held.append(data[cut:])
            base, cut = base + len(data), 0
            data = source.read(MORE_BYTES)


def json_array(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, place, value``: the objects of the JSON arrays in files, as text, with the byte at which each begins.

    Arrays may be written in any way, on one line or with objects over many. Elements that are no objects are left out; an object that
    the file's end cuts is, too. A task reads one range of ``range_bytes`` at a time, or a record where that is longer; a row for each
    range of a file meets in one task.
    """

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["file"]) as source:
                    source.seek(row["start"])
                    data = source.read(row["length"])
                both = [_effect(data, state) for state in (OUTSIDE, INSIDE, ESCAPED)]
                out = row | {"states": [s for s, _ in both], "depths": [d for _, d in both]}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = row.pop("file")
                row.pop("number")
                for some in itertools.batched(_records(file, **row), RECORDS_A_BATCH):
                    places, texts = zip(*some, strict=True)
                    columns = [pa.array([file] * len(some)), pa.array(places, pa.int64()), pa.array(texts)]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "place", "value"])

    types = [("file", pa.string()), ("number", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    schema = pa.schema([*types, ("states", pa.list_(pa.int32())), ("depths", pa.list_(pa.int64()))])
    keys = "file string, number int, start long, length long"
    known = settle(_ranges(spark, path, range_bytes).repartition("file", "number"), "json-ranges")
    # one range a task where there are as many: each is much work behind a short row
    dealt = known.repartition(max(1, known.count()), "file", "number")
    found = dealt.mapInArrow(effects, keys + ", states array<int>, depths array<long>")
    entered = settle(found.groupBy("file").applyInPandas(_entered, keys + ", state int, depth long"), "json-ranges-entered")
    return entered.repartition(max(1, entered.count()), "file", "number").mapInArrow(records, "file string, place long, value string")


def write_json_array(rows: DataFrame, path: str, indent: int = 2, mode: str = "errorifexists") -> None:
    """Rows as one indented JSON array a file.

    Each task writes its own array; text files have what Spark's JSON writer gives for each row, so the array's lines are made of these.
    """
    numbered = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        last = None
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if last is not None:
                    yield pa.RecordBatch.from_pydict({"value": [last + ","]})
                last = json.dumps(json.loads(value), indent=indent, ensure_ascii=False)
        yield pa.RecordBatch.from_pydict({"value": ([last] if last is not None else []) + ["]"]})

    numbered.mapInArrow(lines, "value string").write.mode(mode).text(path)
