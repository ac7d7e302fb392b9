"""WARC archives: write them with an index, then read selected records by coalesced byte ranges.

Archives are ``.warc.gz`` files with one gzip member per record, so any record can be read alone. While
a task writes its file it notes offset, length, URL and digest of every record; these rows are the
index. Reading starts from the index: rows are sorted by file and offset, neighbouring ranges are joined
and each joined range is read with one request.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.scratch import scratch_path, settle

SMALLEST_REVISIT = 100
GAP_BYTES = 1 << 16
RANGE_BYTES = 8 << 20
ARCHIVE_BYTES = 1 << 30
NO_URL = "urn:page:none"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of archives that a reading task gets; a small collection is read by all cores, a megabyte each or more.
TASK_BYTES = 64 << 20
LEAST_TASK_BYTES = 1 << 20
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long,"
    " payload binary"
)


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(",")]


def _safe(url: str) -> str:
    """A URL that fits on one header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(row: dict, name: str, date: str) -> bytes:
    """A record; ``name`` is unique among all records, whatever the page ids are."""
    payload, url, page_id, refers_to = row["payload"], row["url"], row["page_id"], row["refers_to"]
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_safe(url) if url else NO_URL}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        first = row["refers_to_url"]
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_safe(first) if first else NO_URL}", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _parse(data: bytes) -> dict:
    """One record's fields; its block must have the length that its header states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: the record does not end where its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what its digest says")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("Page-ID"),
        "url": None if fields["WARC-Target-URI"] == NO_URL else fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": number("Refers-To-Page-ID"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def with_referrals(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, refers_to_url``: of equal payloads the smallest page_id is referred to.

    Only the digests that several rows share are joined back, so the html moves at most once. Null html is
    an empty payload. Payloads below ``smallest`` bytes refer to nothing; rows without an id refer to
    the smallest id there is; repeated rows of the smallest id are all responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.filter(F.octet_length("payload") >= smallest)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.min_by("url", F.struct("page_id", "url")).alias("refers_to_url"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    joined = rows.join(settle(shared, "shared-payloads"), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), "refers_to_url")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``with_referrals``' rows below ``folder`` and return the index, one row per record.

    Each task attempt writes files of its own names, and only the index rows of attempts that succeed
    are kept; an attempt that fails takes its open file away, and lost executors and speculative copies leave at
    most files that no index row names. Records are dated by the time of the call.
    """
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = packer.compress(_record(row, f"{name}/{at}", date)) + packer.flush()
                    out.write(member)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    index.append((row["page_id"], name, at, len(member), row["url"], row["digest"], kind))
                    at += len(member)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = list(zip(*index, strict=True)) or [[]] * len(kinds)
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, _names(INDEX))
        except Exception:
            if out is not None:
                out.close()
                store.delete_file(f"{root}/{name}")
            raise
        if out is not None:
            out.close()

    return settle(records.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, any part of them in any order: ``RECORD``.

    Rows are dealt by ranges of (file, offset), into as many tasks as the records' bytes ask for. Ranges closer than ``GAP_BYTES`` are read together, up
    to ``RANGE_BYTES`` at once; a single longer record is one range. Payloads are checked against
    their digests. Revisits have no payload. Without ``payloads`` that column stays null.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (
                    name != group[0][0]
                    or offset - (group[-1][1] + group[-1][2]) > GAP_BYTES
                    or offset + length - group[0][1] > RANGE_BYTES
                ):
                    yield group
                    group = []
                group.append((name, offset, length))
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        opened, source = "", None
        for group in ranges(batches):
            if group[0][0] != opened:
                if source is not None:
                    source.close()
                opened, source = group[0][0], store.open_input_file(f"{root}/{group[0][0]}")
            start = group[0][1]
            data = source.read_at(group[-1][1] + group[-1][2] - start, start)
            found = [_parse(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in group]
            if not payloads:
                found = [x | {"payload": None} for x in found]
            arrays = [pa.array([x[k] for x in found], t) for k, t in zip(_names(RECORD), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, _names(RECORD))
        if source is not None:
            source.close()

    total = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // TASK_BYTES), min(cores, total // LEAST_TASK_BYTES))
    rows = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset")
    return rows.sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive all ``pages`` and read every record back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``, all from the records' own headers.

    The folder must be one that all executors reach; by default it is a new one in the shared folder. Null html is
    an empty payload and a null url a name of its own; repeated rows are records each, and those of the smallest page_id are all responses. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = write_archives(with_referrals(pages), folder)
    return read_records(index, folder, payloads=False).drop("url", "payload")
