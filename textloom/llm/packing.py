"""Best-fit packing of documents into sequences of bounded length.

Bounded-space online best-fit: pieces arrive one after another, of each batch of rows the longest first, and each goes to
the open sequence that it fills up most. A
bitset tells which free spaces open sequences have, so the best one is the lowest bit at or above a piece's length. A fixed number of
sequences is open at a time; where one more is needed, the fullest closes.

Each task packs the documents that it reads, without a shuffle. The pieces of what it leaves open at its end, a bounded
number of sequences for a task, are packed once more with those of other tasks, the longest first, in bounded groups.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.workers import handing_back
from textloom.plans.scratch import settle

SEQUENCE = 2048
OPEN = 8192
#: Sequences left open that are packed again together.
GROUP = 8192
#: Words of which an encoder keeps the ids, in each of its two halves.
KEPT_WORDS = 1 << 17
KEPT_PIECES = 1 << 18
END = b"\0\0\0\0"


# ---- ids ------------------------------------------------------------------------------------------

# How the tokenizer's file splits lower-case text.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+").findall
_STOPS = frozenset(".,;:!?")
#: White space of Unicode; ``str.split`` also takes these four for it.
_NO_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it can be seen, else one from 256 on, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in seen]
    return {x: chr(x) for x in seen} | {x: chr(256 + i) for i, x in enumerate(hidden)}


class _Halves(dict):
    """What is asked for is kept in two halves; when the newer one is full, the older one goes."""

    def __init__(self, size: int, make):
        self.size, self.make, self.older = size, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of texts, as bytes of little-endian 32-bit numbers, by a tokenizer, given as its file's JSON.

    No token spans white space, so each word is encoded by itself and its ids are kept. Words of letters up to U+017F, whose
    normal form is their lower case, are split here and their parts go to the tokenizer's model; all others go to
    the tokenizer itself, as do special tokens, which are taken as such.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.part = _Halves(KEPT_PIECES, self._part).__getitem__
        self.word = _Halves(KEPT_WORDS, self._word).__getitem__

    def _part(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(self.letters)
        return _packed([x.id for x in self.model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        if not (word.isascii() or max(word) < "ƀ" and "İ" not in word) or "<|" in word:
            return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        word = word.lower()
        if word.isalpha():
            return self.part(word)
        if word[-1] in _STOPS and word[:-1].isalpha():
            return self.part(word[:-1]) + self.part(word[-1])
        return b"".join(map(self.part, _PARTS(word)))

    def ids(self, text: str) -> bytes:
        words = filter(None, _SPACE.split(text)) if _NO_SPACE.search(text) else text.split()
        return b"".join(map(self.word, words))


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if array("I", [1]).tobytes() != b"\1\0\0\0":
        out.byteswap()
    return out.tobytes()


@functools.lru_cache(1)
def _encoder(tokenizer: str) -> WordEncoder:
    """One a worker, which lives on for further tasks."""
    return WordEncoder(tokenizer)


# ---- packing --------------------------------------------------------------------------------------


class OpenBins:
    """At most ``limit`` open bins of ``size``, found by their free space; ``place`` gives a piece's bin and place there."""

    def __init__(self, size: int, limit: int, first: int = 0):
        self.size, self.limit, self.made, self.n = size, limit, first, 0
        self.spaces = 0  # bit f: some open bin has f free
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        held = self.bins[free]
        found = held.pop()
        if not held:
            self.spaces ^= 1 << free
        self.n -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        room = self.spaces >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            found = self._take(free)
        else:
            if self.n == self.limit:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            free, found = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(found)
            self.spaces |= 1 << left
            self.n += 1
        return found, self.size - free

    def still_open(self) -> list[int]:
        return [b for held in self.bins.values() for b in held]


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long"


def _placed(docs: DataFrame, tokenizer: str, size: int, limit: int) -> DataFrame:
    """Pieces with the bin of their task and their place there; without a piece: bins that are still open at the end."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n, _ in (x.split() for x in PLACED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        bins = OpenBins(size, limit, TaskContext.get().partitionId() << 32)
        for batch in batches:
            cut = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + END
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, size)):
                    end = min(start + size, n)
                    cut.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
            cut.sort(key=lambda x: -x[3])  # the longest of a batch come first
            out = [(*x, *bins.place(x[3])) for x in cut]
            yield _batch(out, schema)
        yield _batch([(None,) * 5 + (b, None) for b in bins.still_open()], schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(handing_back(run), PLACED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _together(size: int, limit: int):
    """Pieces of a group of open bins, the longest first, in new bins. A new bin has the number of an old one of its group."""

    def run(pieces: pa.Table) -> pa.Table:
        lengths, bins, places = (pieces.column(n).to_pylist() for n in ("length", "bin", "place"))
        packed, numbers, out = OpenBins(size, limit), list(dict.fromkeys(sorted(bins))), []
        rows = sorted(zip(lengths, bins, places, strict=True), key=lambda x: (-x[0], x[1], x[2]))
        placed = [(b, place, *packed.place(length)) for length, b, place in rows]
        if packed.made <= len(numbers):
            out = [(b, place, numbers[new], to) for b, place, new, to in placed]
        columns = zip(*out, strict=True) if out else ([],) * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("bin", "place", "into", "to"), columns, strict=True)})

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, limit: int = OPEN, group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: where each piece of each document goes.

    A document is its text's ids and then id 0, so that null and empty texts have one token. Longer ones than ``size`` are cut into
    pieces of that length, of which the last may be shorter; others stay whole. Offsets in a sequence have no gaps and start at 0. Repeated
    rows, and rows without an id, are documents of their own; equal lengths go in the order in which rows are read. An empty table gives an
    empty result; other columns are ignored.

    A task holds ``limit`` open sequences, and the pieces of about ``group`` of these are packed again in memory, by three numbers each;
    texts are never moved. Pieces are written before they are moved within sequences, so a task that is run again changes no other's.
    """
    placed = settle(_placed(docs, tokenizer, size, limit), "placed-pieces")
    still_open, pieces = placed.filter(F.col("piece").isNull()).select("bin"), placed.filter(F.col("piece").isNotNull())
    groups = max(1, -(-still_open.count() // group))
    again = pieces.select("bin", "place", "length").join(still_open.withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(groups))), "bin")
    moved = settle(again.groupBy("group").applyInArrow(_together(size, limit), "bin long, place long, into long, to long"), "moved-pieces")
    return pieces.join(moved, ["bin", "place"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"),
        F.coalesce("to", "place").alias("offset"),
    )
