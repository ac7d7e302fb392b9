"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

The BPE encoding of a byte string has a property that makes a left-to-right program possible: for each
prefix there is exactly one token with which the prefix's own encoding ends. It is the token ``t`` for
which the token before it, already known from a shorter prefix, and ``t`` are *compatible*: merging
their joined bytes gives these two tokens again. So one stored id per prefix is enough. Appending bytes
leaves all stored ids valid, and after an edit only the prefixes from there on are computed again,
up to where they agree with the old ones over the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from textloom.llm.links import free_names
from textloom.llm.workers import handing_back

#: Unicode's White_Space property, which the pattern's \s stands for; Python's \s has four controls more.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE_CACHE = 200_000
PAIR_CACHE = 400_000
STEM_CACHE = 300_000
LONG_PIECE = 200
NEVER = 1 << 62


class Vocabulary:
    """Ranks of a byte-level BPE, prepared for prefix encoding. ``lines``: a rank file's content."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.joins: dict[tuple[int, int], int] = {}
        self.reachable: dict[bytes, int] = {}
        #: For each token, the tokens along its left and right edge with the rank at which each is merged away.
        self.left_edge: dict[int, list[tuple[int, int]]] = {}
        self.right_edge: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.stems: dict[bytes, int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            self._admit(token, rank)

    def _admit(self, token: bytes, rank: int) -> None:
        """Tokens come in merge order, so the two halves that the last merge joins are known by then."""
        if len(token) == 1:
            halves = None
        else:
            ids = self.ids_of_prefixes(token)
            if len(ids) != 2:  # no merge makes it; it stands only for a whole piece
                return
            halves = ids
            self.joins[ids[0], ids[1]] = rank
        self.reachable[token] = rank
        for edge, side in ((self.left_edge, 0), (self.right_edge, 1)):
            below = [] if halves is None else [*edge[halves[side]][:-1], (halves[side], rank)]
            edge[rank] = [*below, (rank, NEVER)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and then ``b`` leaves these two tokens.

        It does unless, at some moment, the token at a's right edge and the one at b's left edge are
        joined by a merge that comes before the merges in which each takes part. Of equal ranks the
        leftmost merge is first.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        right, left = self.right_edge[a], self.left_edge[b]
        i = j = 0
        ok = True
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            rank = self.joins.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:
                ok = False
                break
            if x_until == NEVER and y_until == NEVER:
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def extend(self, data: bytes, last: list[int]) -> None:
        """``last[n]``: the last token of the encoding of ``data[:n]``; fills in what is missing at its end."""
        find, compatible, longest, bytes_of = self.reachable.get, self.compatible, self.longest, self.bytes_of
        for end in range(len(last), len(data) + 1):
            start = end - longest if end > longest else 0
            while True:
                token = find(data[start:end])
                if token is not None and (start == 0 or compatible(last[start], token)):
                    last.append(token)
                    break
                start += 1
                if start >= end:
                    raise ValueError(f"no token ends at byte {end}: the ranks lack {bytes_of.get(data[end - 1])}")

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        ids.reverse()
        return ids

    def ids_of_prefixes(self, data: bytes) -> list[int]:
        last = [-1]
        self.extend(data, last)
        return self.tokens(data, last)

    def last_token(self, prefix: bytes) -> int:
        """The last token of the encoding of ``prefix``, asking only for the prefixes that it needs.

        What is found is kept for the next piece that begins alike. Long tokens come first, as they
        are likelier.
        """
        find, known, stems, end = self.reachable.get, self.pairs.get, self.stems, len(prefix)
        start = end - self.longest if end > self.longest else 0
        while True:
            token = find(prefix[start:])
            if token is not None:
                if start == 0:
                    break
                stem = prefix[:start]
                before = stems.get(stem)
                if before is None:
                    before = self.last_token(stem)
                fits = known(before << 32 | token)
                if fits or fits is None and self.compatible(before, token):
                    break
            start += 1
        if len(stems) >= STEM_CACHE:
            stems.clear()
        stems[prefix] = token
        return token

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > LONG_PIECE:  # too deep for asking back
            return self.ids_of_prefixes(data)
        ids, stems, bytes_of = [], self.stems, self.bytes_of
        while data:
            token = stems.get(data)
            if token is None:
                token = self.last_token(data)
            ids.append(token)
            data = data[: -len(bytes_of[token])]
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixEncoding:
    """The encoding of one piece of bytes that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, [-1]
        vocabulary.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of ``data[start:stop]``. Returns how many prefixes were computed again."""
        old, shift, longest = self.last, len(new) - (stop - start), self.vocabulary.longest
        data = self.data[:start] + new + self.data[stop:]
        last, same = old[: start + 1], 0
        while len(last) <= len(data):
            self.vocabulary.extend(data[: len(last)], last)
            at = len(last) - 1
            before = at - shift
            same = same + 1 if before > stop and at > start + len(new) and last[at] == old[before] else 0
            if same >= longest:
                last += old[before + 1 :]
                self.data, self.last = data, last
                return at - start
        self.data, self.last = data, last
        return len(data) - start

    @property
    def ids(self) -> list[int]:
        return self.vocabulary.tokens(self.data, self.last)


@lru_cache(maxsize=2)
def _vocabulary(lines: bytes) -> Vocabulary:
    return Vocabulary(lines)


def _spell_out(pattern: str) -> str:
    """The pattern for texts in Latin-1, its Unicode properties spelled out: the plain engine is faster."""

    def members(name: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if regex.match(rf"\p{{{name}}}", chr(c)))

    def in_class(found: re.Match) -> str:
        return re.sub(r"\\p\{(\w)\}", lambda m: members(m[1]), found[0])

    pattern = re.sub(r"\[[^\]]*\]", in_class, pattern)
    return re.sub(r"\\p\{(\w)\}", lambda m: f"[{members(m[1])}]", pattern)


class Encoder:
    """Encodes and decodes whole texts, each match of the pattern separately."""

    def __init__(self, lines: bytes, pattern: str):
        self.vocabulary = _vocabulary(lines)
        spaced = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]")
        spaced = spaced.replace(r"\s", f"[{WHITE_SPACE}]")
        self.pieces = regex.compile(spaced).findall
        self.latin_pieces = re.compile(_spell_out(spaced)).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        add = ids.extend
        try:
            text.encode("latin-1")
            pieces = self.latin_pieces(text)
        except UnicodeEncodeError:
            pieces = self.pieces(text)
        for piece in pieces:
            found = known.get(piece)
            if found is None:
                found = tuple(self.vocabulary.encode_piece(piece.encode("utf-8")))
                if len(known) < PIECE_CACHE and len(piece) < 64:
                    known[piece] = found
            add(found)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.vocabulary.decode(ids)


@lru_cache(maxsize=2)
def _encoder(lines: bytes, pattern: str) -> Encoder:
    return Encoder(lines, pattern)


def _rank_file(df: DataFrame, ranks_path: str):
    """The file's content as a broadcast; a vocabulary's size does not depend on the corpus."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``token_ids ARRAY<INT>`` for the column ``text`` added as the last column.

    Where there is such a column already, the new one's name ends in an underscore. A null text counts as empty and has no
    tokens. Rows stay in their partitions.
    """
    name = free_names(df.columns, "token_ids")[0]
    lines, at = _rank_file(df, ranks_path), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(lines.value, pattern)
        for batch in batches:
            ids = pa.array([coder.encode(x.as_py() or "") for x in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    return df.mapInArrow(handing_back(run), StructType([*df.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Each whole text is encoded and its ids are decoded again. A null or empty text has no tokens and
    the digests of the empty string; an empty table gives an empty result; repeated rows give repeated
    results; other columns are ignored, whatever their names.
    """
    lines = _rank_file(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(lines.value, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for x in batch.column(1):
                ids = coder.encode(x.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(handing_back(run), kinds)
