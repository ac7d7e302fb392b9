"""De-duplication of repeated passages with suffix arrays.

Texts are dealt into shards of bounded size. Each shard sorts its suffixes by Larsson and Sadakane's
refinement, which doubles the sorted prefix and only touches groups that are not yet single, and gets
common prefixes by Kasai's observation that the next suffix shares at most one byte less. Strings of
``LENGTH`` bytes that the shard holds several times are settled there: they stay in the document with the smallest
id alone. What a shard keeps is then compared across shards. The bytes are not sent for that: every string
of ``LENGTH`` bytes has a smallest hashed k-gram, its anchor. Shards first exchange the hashes of their
anchors, and then only the strings around anchors that two shards have. A bucket of anchors merges the
shards' sorted keys pairwise by binary search and compares the bytes behind equal keys. Strings around an anchor
that very many shards have, as those of a licence line, do not meet in one bucket: the smallest owner of each is an
aggregate that every partition begins, and copies of its row go to the shards that ask.

Long documents are cut into pieces that overlap by ``LENGTH - 1`` bytes, so that each string starts in
exactly one piece, whatever a text's length. The texts are shuffled once; the three steps on shards read the
same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.scratch import settle
from textloom.llm.words import BASE, U64, mix

LENGTH = 50
ANCHOR_BYTES = 20
SHARD_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
SEPARATOR = 0xFF  # in no UTF-8 text
LAST_ID = (1 << 63) - 1
#: An anchor of more shards is hot; and the copies of a hot string's answer. An occurrence of an anchor has 31 strings at most, some 800
#: bytes with their keys, owners and places: 26 MB from so many shards, which a bucket can hold. Hot strings are rows of their own,
#: whose answers are copied, so an anchor is only hot beyond that.
HOT_SHARDS = 1 << 15
SALTS = 64
SHORT_BYTES = 5
_BLOCK = 1 << 19
_value = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


# ---- one shard ------------------------------------------------------------------------------------


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from each place on; as many as there are whole ones."""
    n = max(0, len(data) - k + 1)
    out = np.empty(n, U64)
    power = np.cumprod(np.full(min(n, _BLOCK) + k, BASE, dtype=U64))
    inverse = np.cumprod(np.full(min(n, _BLOCK), pow(BASE, -1, 1 << 64), dtype=U64))
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        part = _value[data[lo : hi + k - 1]]
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(part * power[: len(part)])])
        out[lo:hi] = mix((sums[k:] - sums[:-k]) * inverse[: hi - lo])
    return out


def anchors(data: np.ndarray, length: int = LENGTH, k: int = ANCHOR_BYTES) -> np.ndarray:
    """For each string of ``length`` bytes the smallest hash of its k-grams."""
    low = kgram_hashes(data, k)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (width - span)], low[width - span :]) if width > span else low


def _first_eight(data: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), U64)
    for j in range(8):
        key |= padded[j : j + len(data)].astype(U64) << U64(56 - 8 * j)
    return key


def suffix_array(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their suffixes' first ``length`` bytes or more, each place's first eight, and which
    places of the order may share ``length`` bytes with the one before: those that share half of it."""
    n, key = len(data), _first_eight(data)
    order = np.argsort(key).astype(np.int32)
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    del sorted_key
    active = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))  # in groups of more than one
    close = ~fresh if length >= 8 else np.arange(n) > 0
    h = 8
    while len(active) and h < length:
        at = order[active]
        pair = rank[at].astype(np.int64) << 32 | (rank[np.minimum(at.astype(np.int64) + h, n)].astype(np.int64) + 1)
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[active] = at
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[at] = active[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if 2 * h <= length:
            close = np.zeros(n, bool)
            close[active[~new]] = True
        active = active[~new | ~np.append(new[1:], True)]
        h *= 2
    # what is equal so far goes by place, so that a repeated passage's places follow each other in step
    at = order[active]
    order[active] = at[np.argsort(rank[at].astype(np.int64) << 32 | at)]
    return order, key, close


def common_prefixes(
    data: np.ndarray, order: np.ndarray, key: np.ndarray, close: np.ndarray, length: int = LENGTH
) -> np.ndarray:
    """For each place the bytes that its suffix shares with the one before it in ``order``.

    Where the bytes before both are equal, the value is that of the place before less one (Kasai); only the
    other places compare bytes, eight at a time, and the few that share more one by one. Values of
    ``length`` or more are exact; below, they may be too small, as places that are not ``close`` count as 0
    and bytes beyond the last eight equal ones are not counted.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    near = np.flatnonzero(close)
    before[order[near]] = order[near - 1]
    near = np.flatnonzero(before >= 0)
    own = (near == 0) | (before[near] == 0) | (data[near - 1] != data[before[near] - 1]) | (before[near - 1] != before[near] - 1)
    at = near[own]
    shared = np.zeros(n, np.int64)
    shared[near[~own]] = -1
    todo, other, done = at, before[at], 0
    while len(todo) and done < length + 8:
        end = np.maximum(todo, other) + done
        live = end < n
        todo, other = todo[live], other[live]
        x = key[todo + done] ^ key[other + done]
        whole = (x == 0) & (np.maximum(todo, other) + done + 8 <= n)
        part = np.where(x == 0, 8, 0)
        if done + 8 > length:
            for j in range(1, 8):
                part += (x != 0) & ((x >> U64(64 - 8 * j)) == 0)
        shared[todo] = done + np.minimum(part, n - (np.maximum(todo, other) + done))
        todo, other = todo[whole], other[whole]
        done += 8
    for a, b in zip(todo.tolist(), other.tolist(), strict=True):
        same, room = done, n - max(a, b)
        while same < room:
            step = min(4096, room - same)
            differ = data[a + same : a + same + step] != data[b + same : b + same + step]
            first = int(differ.argmax())
            if differ[first]:
                same += first
                break
            same += step
        shared[a] = same
    # places that compare nothing lose one byte a place since the last one that did
    last = np.maximum.accumulate(np.where(shared >= 0, np.arange(n), 0))
    return np.maximum(0, shared[last] - (np.arange(n) - last))


class Shard:
    """The pieces of a shard end to end, in an order that does not depend on how they arrived."""

    def __init__(self, rows: pa.Table, dropped: set[tuple[int, int]], length: int):
        ids = [LAST_ID if x is None else x for x in rows.column("doc_id").to_pylist()]
        parts = rows.column("bytes").to_pylist()
        start = rows.column("start").to_pylist()
        self.rows = sorted(range(len(ids)), key=lambda i: (ids[i], start[i], parts[i]))
        hashes = rows.column("h").to_pylist()
        self.gone = [(ids[i], hashes[i]) in dropped for i in self.rows]
        self.parts = [b"" if gone else parts[i] for i, gone in zip(self.rows, self.gone, strict=True)]
        self.ids = np.array([ids[i] for i in self.rows], np.int64)
        sizes = np.array([len(p) for p in self.parts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.data = np.frombuffer(b"".join(p + b"\xff" for p in self.parts), np.uint8)
        self.piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        #: Whether a whole string starts at each place.
        self.starts = np.arange(len(self.data)) + length <= (self.at[1:] - 1)[self.piece]

    def first_and_later(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose string is in no document of this shard with a smaller id, and those whose string is."""
        n = len(self.data)
        order, key, close = suffix_array(self.data, length)
        shared = common_prefixes(self.data, order, key, close, length)
        del key, close
        new = shared[order] < length
        new[:1] = True
        group = np.flatnonzero(new)
        owner = self.ids[self.piece[order]]
        least = np.minimum.reduceat(owner, group) if n else owner
        later = np.zeros(n, bool)
        later[order] = owner > least[np.cumsum(new) - 1]
        return self.starts & ~later, self.starts & later


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


ROUTED = "to_key int, kind int, shard int, a binary, b binary, c binary, d binary"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
_NAMES = ["to_key", "kind", "shard", "a", "b", "c", "d"]
DROPPED, SHARED, MARKS, STRINGS, HOT_STRINGS = range(5)


def _routed(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.table([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _dropped(side: pa.Table) -> set[tuple[int, int]]:
    out: set[tuple[int, int]] = set()
    for kind, a, b in zip(*(side.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
        if kind == DROPPED:
            out |= set(zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist(), strict=True))
    return out


def _short(found: np.ndarray) -> np.ndarray:
    """The upper 40 bits of anchors: what shards tell each other. Two anchors that share them only cost strings that are sent in vain."""
    return found >> U64(64 - 8 * SHORT_BYTES)


def _written(short: np.ndarray) -> bytes:
    return short.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - SHORT_BYTES :].tobytes()


def _read(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // SHORT_BYTES, 8), np.uint8)
    wide[:, 8 - SHORT_BYTES :] = np.frombuffer(blob, np.uint8).reshape(-1, SHORT_BYTES)
    return wide.view(">u8").ravel().astype(U64)


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _segments(begin: np.ndarray, count: np.ndarray, owner: np.ndarray, strings: bytes) -> tuple[bytes, bytes, bytes, bytes]:
    """The columns a to d of strings around anchors."""
    return begin.astype(np.int32).tobytes(), _squeezed(count.astype(np.int32).tobytes()), _squeezed(owner.astype(np.int64).tobytes()), _squeezed(strings)


def _segments_of(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    begin = np.frombuffer(row["a"], np.int32)
    full = lambda x, size: pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True)
    count = np.frombuffer(full(row["b"], 4 * len(begin)), np.int32)
    owner = np.frombuffer(full(row["c"], 8 * len(begin)), np.int64)
    return begin, count, owner, full(row["d"], int(count.sum()) + len(begin) * (length - 1))


def _marks(place: np.ndarray) -> tuple[bytes, bytes]:
    """Marked places as runs: the columns a and b."""
    place = np.unique(place)
    new = np.flatnonzero(np.concatenate([[True], np.diff(place) > 1])) if len(place) else np.zeros(0, np.int64)
    return place[new].astype(np.int32).tobytes(), np.diff(np.append(new, len(place))).astype(np.int32).tobytes()


def _blobs(side: pa.Table, kind: int, column: str, dtype: type) -> np.ndarray:
    found = [np.frombuffer(x, dtype) for k, x in zip(side.column("kind").to_pylist(), side.column(column).to_pylist(), strict=True) if k == kind]
    return np.concatenate(found) if found else np.zeros(0, dtype)


def _number(rows: pa.Table, side: pa.Table) -> int:
    return (rows.column("shard") if rows.num_rows else side.column("to_key"))[0].as_py()


# ---- several shards -------------------------------------------------------------------------------


def merge_sorted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two runs of distinct sorted keys with a value each as one; of equal keys the smaller value stays."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    if not len(b[0]):
        return a
    at = np.searchsorted(a[0], b[0])
    equal = a[0][np.minimum(at, len(a[0]) - 1)] == b[0]
    values = a[1].copy()
    values[at[equal]] = np.minimum(values[at[equal]], b[1][equal])
    return np.insert(a[0], at[~equal], b[0][~equal]), np.insert(values, at[~equal], b[1][~equal])


def merge_all(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    while len(runs) > 1:
        runs = [merge_sorted(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _least_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.minimum.reduceat(values, first)


def later_strings(runs: list[tuple[np.ndarray, np.ndarray, bytes]], length: int) -> list[np.ndarray]:
    """For each shard's run ``(owner of each segment, number of strings in it, bytes)`` a mask over its strings:
    whether the string is also in a segment of a smaller owner, in any run."""
    expanded = []
    for owner, count, text in runs:
        data = np.frombuffer(text, np.uint8)
        begin = np.concatenate([[0], np.cumsum(count.astype(np.int64) + length - 1)])[:-1]
        place = np.repeat(begin - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
        expanded.append((kgram_hashes(data, length)[place], np.repeat(owner, count), place, data))
    keys, least = merge_all([_least_by_key(k, o) for k, o, _, _ in expanded])
    places = [np.searchsorted(keys, key) for key, _, _, _ in expanded]
    masks = [owner > least[at] for (_, owner, _, _), at in zip(expanded, places, strict=True)]
    # only what would go needs proof: its bytes must be those that the smallest owner has under this key
    asked = np.zeros(len(keys), bool)
    for at, mask in zip(places, masks, strict=True):
        asked[at[mask]] = True
    row = np.cumsum(asked) - 1
    sample = np.empty((int(asked.sum()), length), np.uint8)
    doubt: set[int] = set()
    for prove in (False, True):
        for (_, _, place, data), at, mask in zip(expanded, places, masks, strict=True):
            chosen = np.flatnonzero(mask if prove else ~mask & asked[at])
            for lo in range(0, len(chosen), 1 << 17):
                part = chosen[lo : lo + (1 << 17)]
                strings = np.lib.stride_tricks.sliding_window_view(data, length)[place[part]]
                if prove:
                    wrong = (sample[row[at[part]]] != strings).any(axis=1)
                    doubt |= set(at[part[wrong]].tolist())
                else:
                    sample[row[at[part]]] = strings
    if doubt:  # different strings with one key: these few by their bytes
        by_bytes: dict[bytes, int] = {}
        for again in (False, True):
            for (key, owner, place, data), mask in zip(expanded, masks, strict=True):
                for i in np.flatnonzero(np.isin(key, keys[sorted(doubt)])):
                    string, own = data[place[i] : place[i] + length].tobytes(), int(owner[i])
                    if again:
                        mask[i] = own > by_bytes[string]
                    else:
                        by_bytes[string] = min(own, by_bytes.get(string, own))
    return masks


# ---- the job --------------------------------------------------------------------------------------


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, piece_bytes: int = PIECE_BYTES, hot_shards: int = HOT_SHARDS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Every byte goes that is covered by a string of ``length`` bytes which also starts in a document with a
    smaller doc_id; all strings are judged on the input. Null texts are empty. A null id counts as the
    largest number of 64 bits, and rows with one id do not take from each other. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    k = min(ANCHOR_BYTES, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order_id = F.coalesce("doc_id", F.lit(LAST_ID))

    # exact copies of a text with a smaller id are removed whole, and take no part in the rest
    skinny = settle(
        rows.select(order_id.alias("id"), F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")),
        "passage-rows",
    )
    total, longest = (x or 0 for x in skinny.agg(F.sum("n_bytes"), F.max("n_bytes")).first())
    n_shards = max(1, -(-total // shard_bytes))
    n_buckets = max(32, n_shards // 4)
    least = settle(skinny.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("most > least").drop("most"), "copied-texts")
    copies = skinny.filter(F.col("n_bytes") >= length).join(least, "sha").filter(F.col("id") > F.col("least"))

    def shard_of(some_id: Column, piece: Column) -> Column:
        return F.pmod(F.xxhash64(some_id) + piece, F.lit(n_shards)).cast("int")

    last_piece = F.floor(F.greatest(F.col("n_bytes") - length, F.lit(0)) / piece_bytes).cast("int")
    dropped = (
        copies.select("id", "h", F.explode(F.sequence(F.lit(0), last_piece)).alias("piece"))
        .select(shard_of(F.col("id"), F.col("piece")).alias("to_key"), "id", "h")
        .distinct()
    )

    def packed(side: pa.Table) -> pa.Table:
        columns = [side.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "h")]
        return _routed([(side.column("to_key")[0].as_py(), DROPPED, -1, *columns, None, None)])

    dropped = settle(dropped.groupBy("to_key").applyInArrow(packed, ROUTED), "dropped-copies")

    pieces = rows.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("whole"))
    pieces = pieces.select("doc_id", "h", "n_bytes", F.posexplode(F.expr(
        f"transform(sequence(0, cast(greatest(n_bytes - {length}, 0) div {piece_bytes} as int)),"
        f" i -> substring(whole, i * {piece_bytes} + 1, {piece_bytes + length - 1}))")).alias("piece", "bytes"))  # fmt: skip
    pieces = pieces.select(shard_of(order_id, F.col("piece")).alias("shard"), "doc_id", "h", "n_bytes", (F.col("piece").cast("long") * piece_bytes).alias("start"), "bytes")
    sharded = pieces.groupBy("shard")

    def tell_anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _routed([])
        shard, me = Shard(left, _dropped(right), length), _number(left, right)
        found = anchors(shard.data, length, k)
        found = np.unique(_short(found[shard.starts[: len(found)]]))
        bucket = (found % U64(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        return _routed([(b, SHARED, me, _written(found[by[x:y]]), None, None, None) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x])

    def find_shared(side: pa.Table) -> pa.Table:
        shards = side.column("shard").to_pylist()
        runs = [_read(x) for x in side.column("a").to_pylist()]
        every, shards_of = np.unique(np.concatenate(runs), return_counts=True)
        several, hot = every[shards_of > 1], every[shards_of > hot_shards]
        if not len(several):
            return _routed([])
        out = []
        for shard, run in zip(shards, runs, strict=True):
            at = np.minimum(np.searchsorted(several, run), len(several) - 1)
            mine = run[several[at] == run]
            if len(mine):
                out.append((shard, SHARED, shard, _written(mine), _written(np.intersect1d(mine, hot)), None, None))
        return _routed(out)

    def tell_strings(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _routed([])
        shard, me = Shard(left, _dropped(right), length), _number(left, right)
        first, later = shard.first_and_later(length)
        at, count = _runs(later)
        # its marks travel by way of some bucket, as buckets' answers do
        out = [(me % n_buckets, MARKS, me, at.astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), None, None)]
        wanted, hot = (np.sort(_read(_blobs(right, SHARED, c, np.uint8).tobytes())) for c in "ab")
        found = _short(anchors(shard.data, length, k))
        if len(wanted) and len(found):
            hit = first[: len(found)] & (wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found)
            new = hit.copy()
            new[1:] &= ~hit[:-1] | (found[1:] != found[:-1])
            begin = np.flatnonzero(new)
            inside = np.flatnonzero(hit)
            count = np.diff(np.append(np.searchsorted(inside, begin), len(inside)))
            owner = shard.ids[shard.piece[begin]]
            bucket = (found[begin] % U64(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            whole = shard.data.tobytes()
            is_hot = np.isin(found[begin[by]], hot)
            parts = [(b, kind, by[x:y][is_hot[x:y] == (kind == HOT_STRINGS)]) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) for kind in (STRINGS, HOT_STRINGS)]
            for b, kind, own in parts:
                if len(own):
                    strings = b"".join([whole[s : s + c + length - 1] for s, c in zip(begin[own].tolist(), count[own].tolist(), strict=True)])
                    out.append((b, kind, me, *_segments(begin[own], count[own], owner[own], strings)))
        return _routed(out)

    def settle_strings(side: pa.Table) -> pa.Table:
        rows = side.to_pylist()
        out = [(r["shard"], MARKS, r["shard"], r["a"], r["b"], None, None) for r in rows if r["kind"] == MARKS]
        rows = [r for r in rows if r["kind"] == STRINGS]
        read = [_segments_of(r, length) for r in rows]
        masks = later_strings([(owner, count, text) for _, count, owner, text in read], length) if rows else []
        for r, (begin, count, _, _), mask in zip(rows, read, masks, strict=True):
            if mask.any():
                place = np.repeat(begin - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
                out.append((r["shard"], MARKS, r["shard"], *_marks(place[mask]), None, None))
        return _routed(out)

    def hot_strings(side: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        for r in side.filter(pc.equal(side.column("kind"), HOT_STRINGS)).to_pylist():
            begin, count, owners, text = _segments_of(r, length)
            at = np.concatenate([[0], np.cumsum(count + length - 1)])
            for k, (owner, place, n) in enumerate(zip(owners.tolist(), begin.tolist(), count.tolist(), strict=True)):
                for i in range(n):
                    values = (text[at[k] + i : at[k] + i + length], owner, r["shard"], place + i)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["string", "owner", "shard", "place"])

    def packed_marks(side: pa.Table) -> pa.Table:
        place = side.column("place").to_numpy()
        shard = side.column("shard")[0].as_py()
        return _routed([(shard, MARKS, shard, *_marks(place), None, None)])

    def settle_hot(strings: DataFrame) -> DataFrame:
        hot = strings.groupBy("to_key").applyInArrow(hot_strings, "string binary, owner long, shard int, place int")
        least = hot.groupBy("string").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("most > least")
        least = least.select("string", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        asked = hot.withColumn("salt", F.pmod("shard", F.lit(SALTS))).join(least, ["string", "salt"]).filter(F.col("owner") > F.col("least"))
        return asked.select("shard", "place").groupBy("shard").applyInArrow(packed_marks, ROUTED)

    result = "doc_id long, h long, n_bytes long, start long, n_removed long, n_spans long, kept_sha256 string, cut binary"

    def take_out(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in _RESULT], names=_RESULT_NAMES)
        shard = Shard(left, _dropped(right), length)
        step = np.zeros(len(shard.data) + 1, np.int32)
        at, count = _blobs(right, MARKS, "a", np.int32), _blobs(right, MARKS, "b", np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, at + count + (length - 1), -1)
        gone = np.cumsum(step[:-1]) > 0
        removed, spans, digests, cuts = [], [], [], []
        sizes, parts = left.column("n_bytes").to_pylist(), left.column("bytes").to_pylist()
        for i, row in enumerate(shard.rows):
            whole = len(parts[row]) == sizes[row]
            if shard.gone[i]:
                begin, many, kept = np.zeros(1, np.int64), np.array([len(parts[row])]), b""
            else:
                mask = gone[shard.at[i] : shard.at[i + 1] - 1]
                begin, many = _runs(mask)
                data = shard.data[shard.at[i] : shard.at[i + 1] - 1]
                kept = data[~mask].tobytes() if len(begin) else parts[row]
            removed.append(int(many.sum()))
            spans.append(len(begin))
            digests.append(hashlib.sha256(kept).hexdigest() if whole else None)
            cuts.append(None if whole else np.stack([begin, many]).astype(np.int64).tobytes())
        took = [left.column(c).take(pa.array(shard.rows)) for c in ("doc_id", "h", "n_bytes", "start")]
        columns = [*took, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(cuts, pa.binary())]
        return pa.table(columns, names=_RESULT_NAMES)

    told = sharded.cogroup(dropped.groupBy("to_key")).applyInArrow(tell_anchors, ROUTED)
    shared = told.groupBy("to_key").applyInArrow(find_shared, ROUTED)
    strings = sharded.cogroup(shared.unionByName(dropped).groupBy("to_key")).applyInArrow(tell_strings, ROUTED)
    marks = strings.groupBy("to_key").applyInArrow(settle_strings, ROUTED)
    if n_shards > hot_shards:  # else no anchor can be hot
        marks = marks.unionByName(settle_hot(strings))
    out = sharded.cogroup(marks.unionByName(dropped).groupBy("to_key")).applyInArrow(take_out, result)
    final = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if longest <= piece_bytes + length - 1:
        return out.select(*final)
    out = settle(out, "passage-pieces")
    return out.filter("cut is null").select(*final).unionByName(_long_documents(rows, out.filter("cut is not null"), piece_bytes, length).select(*final))


_RESULT = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_RESULT_NAMES = ["doc_id", "h", "n_bytes", "start", "n_removed", "n_spans", "kept_sha256", "cut"]


def _long_documents(rows: DataFrame, cuts: DataFrame, piece_bytes: int, length: int) -> DataFrame:
    """Documents of several pieces: their pieces' cuts are applied to the whole text.

    Repeated rows have equal cuts, which are listed once and used for each.
    """
    listed = cuts.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "cut"))).alias("cuts"))
    listed = settle(listed, "long-cuts")
    a = rows.filter(F.octet_length("text") > piece_bytes).select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("whole")).alias("a")
    b = listed.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["whole"], np.uint8)
                mask = np.zeros(len(data), bool)
                for part in row["cuts"]:
                    for x, y in np.frombuffer(part["cut"], np.int64).reshape(2, -1).T.tolist():
                        mask[part["start"] + x : part["start"] + x + y] = True
                columns = [[row["doc_id"]], [len(data)], [int(mask.sum())], [len(_runs(mask)[0])], [hashlib.sha256(data[~mask].tobytes()).hexdigest()]]
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.select("a.doc_id", "a.whole", "b.cuts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
