"""Near-duplicates by ProbMinHash over word shingles, with banding and verification.

Each distinct shingle of five words is an element. All have the same weight, as the similarity that decides
is that of the sets, however often a text repeats a passage; with ``repeats`` a shingle weighs as often as it occurs, for
the signatures and for the decision alike: its n-th occurrence is then an element of its own. An element arrives at the signature's places
in a Poisson process whose rate is the weight; a place keeps the element that arrives first. An element
stops as soon as its next arrival is later than the latest one kept, so a text costs little more than one
arrival per shingle. The share of places in which two signatures agree estimates their probability
Jaccard similarity. Texts with an equal band of the signature share a bucket and become candidates, and the
similarity that decides is computed exactly on the shingle sets.

Every text of a bucket is first compared with one leader, so that many near copies become one component at
the cost of one comparison each. Buckets whose texts are still in different components are then settled
whole: each pair of such texts is compared. The largest component of a bucket only meets the bucket's
other texts, which are fewer; both are cut into blocks, and each two blocks meet in a task of their own, which
returns no more links than it takes to join the components. So each pair of candidates is in one component
or was compared, whatever the size of its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.links import components, rows_that_stay
from textloom.plans.scratch import settle
from textloom.llm.words import NOT_SPACE, U64, bytes_of, mix, shingles, slices, word_hashes
from textloom.llm.workers import handing_back

SHINGLE_WORDS = 5
SIMILAR = 0.8
BANDS = 20
BAND_ROWS = 4
#: Texts in a block of a large bucket, and shingles in one, on average; and texts that meet a copy of their leader.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
SALTED = 256
#: Cells of the matrices by which two blocks are compared.
CELLS = 1 << 21
_SALT = np.random.default_rng(5).integers(1, 1 << 63, 4, dtype=np.uint64)


def shingle_sets(column: pa.Array, size: int, repeats: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``elements, rows``: the distinct shingles of each row, or with ``repeats`` each row's shingles with the number of the occurrence."""
    data, at = bytes_of(column, lower=True)
    words, counts = word_hashes(data, at, NOT_SPACE)
    found, row = shingles(words, counts, size)
    if not len(found):
        return found, row
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (row[1:] != row[:-1])]))
    if not repeats:
        return found[first], row[first]
    number = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
    return np.where(number > 0, mix(found ^ mix(number.astype(U64) + _SALT[1])), found), row


def prob_min_hash(elements: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int, places: int) -> np.ndarray:
    """Signatures, one row of ``places`` elements for each of ``n_rows`` weighted sets; 0 for empty ones."""
    first = np.full(n_rows * places, np.inf)
    kept = np.zeros(n_rows * places, U64)
    latest = np.full(n_rows, np.inf)
    time = np.zeros(len(elements))
    active = np.arange(len(elements))
    arrival = 0
    while len(active):
        element, row = elements[active], rows[active]
        turn = np.array([(int(_SALT[0]) + arrival * int(_SALT[1])) % (1 << 64)], dtype=U64)
        x = mix(element ^ mix(turn))
        time[active] -= np.log(((x >> U64(11)).astype(float) + 0.5) * 2.0**-53) / weights[active]
        now = time[active]
        place = row * places + (mix(x ^ _SALT[2]) % U64(places)).astype(np.int64)
        np.minimum.at(first, place, now)
        won = first[place] == now
        kept[place[won]] = element[won]
        latest = first.reshape(n_rows, places).max(axis=1)
        active = active[now < latest[row]]
        arrival += 1
    return kept.reshape(n_rows, places)


def _fingerprints(elements: np.ndarray, rows: np.ndarray, n_rows: int) -> list[bytes]:
    """16 bytes per set, equal for equal sets."""
    out = np.zeros((n_rows, 2), U64)
    np.add.at(out[:, 0], rows, mix(elements ^ _SALT[2]))
    np.add.at(out[:, 1], rows, mix(elements ^ _SALT[3]))
    return [x.tobytes() for x in out]


def signatures(
    docs: DataFrame, size: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS, repeats: bool = False
) -> DataFrame:
    """``row, doc_id, h, node, size, bands`` per row: ``node`` names the shingle set, ``h`` the text; no words: null.

    ``size`` counts the distinct shingles.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in slices(batch.column(3)):
                part = batch.slice(lo, n)
                elements, rows = shingle_sets(part.column(3), size, repeats)
                signs = prob_min_hash(elements, rows, np.ones(len(elements)), n, bands * band_rows)
                key = np.zeros((n, bands), U64)
                for k in range(band_rows):
                    key = mix(key * U64(31) + signs[:, k::band_rows] + U64(k))
                key = mix(key + np.arange(bands, dtype=U64)[None, :] * _SALT[0]).astype(np.int64)
                held = np.bincount(rows, minlength=n).astype(np.int32)
                node = pa.array(_fingerprints(elements, rows, n), pa.binary(), mask=held == 0)
                keys = pa.ListArray.from_arrays(np.arange(0, (n + 1) * bands, bands, dtype=np.int32), key.ravel())
                columns = [*part.columns[:3], node, pa.array(held), keys]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "h", "node", "size", "bands"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(handing_back(run), f"row long, doc_id {kind}, h long, node binary, size int, bands array<long>")


def _sets(texts: DataFrame, size: int, repeats: bool) -> DataFrame:
    """``node, elements`` for rows of ``text``: 64-bit hashes of the elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in slices(batch.column(0)):
                elements, rows = shingle_sets(batch.column(0).slice(lo, n), size, repeats)
                at = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(at, elements.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(_fingerprints(elements, rows, n), pa.binary()), lists], ["node", "elements"])

    return texts.mapInArrow(handing_back(run), "node binary, elements array<long>")


def _salted(pairs: DataFrame) -> DataFrame:
    """``a, b, salt`` for ``pairs (a, b, n)``, where at most ``n`` pairs have one ``a``; a salt has about ``SALTED`` of them."""
    salts = F.ceil(F.max("n") / SALTED)
    return pairs.groupBy("a", "b").agg(salts.alias("n")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"))


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The ``pairs (a, b, salt)`` whose sets have a Jaccard similarity of ``similar`` or more.

    A leader ``a`` of many texts is copied to each of its salts, so that no key has more than a block of rows.
    """
    b = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    a = pairs.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    both = F.size(F.array_intersect("ea", "eb"))
    return b.join(a, ["a", "salt"]).filter(both >= (F.size("ea") + F.size("eb") - both) * F.lit(similar)).select("a", "b")


def _split_buckets(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``members`` with labels, and the buckets whose texts have different ones:
    ``band, n, label, head, main, rest``.

    ``label`` is the one that most texts have and ``head`` one of these; ``main`` and ``rest`` are the numbers of
    blocks into which they and the others are cut.
    """
    known = members.join(labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label"))
    known = settle(known, "labelled-members")
    per = known.groupBy("band", "label").agg(
        F.count("*").alias("n"), F.sum("size").alias("w"), F.min(F.struct(F.xxhash64("node", "band"), "node")).alias("head")
    )
    whole = per.groupBy("band").agg(
        F.max(F.struct("n", "label", "w", "head")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("labels")
    )
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    split = whole.filter("labels > 1").select(
        "band",
        "n",
        "top.label",
        F.col("top.head.node").alias("head"),
        blocks(F.col("top.n"), F.col("top.w")).alias("main"),
        blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("rest"),
    )
    return known, settle(split, "split-buckets")


def _with_heads(known: DataFrame, split: DataFrame) -> DataFrame:
    """``a, b, salt``: in buckets of more than a block, texts outside of the largest component with one of its texts."""
    large = split.filter(F.col("n") > BLOCK).select("band", "n", F.col("label").alias("main_label"), "head")
    pairs = known.join(large, "band").filter(F.col("label") != F.col("main_label"))
    return _salted(pairs.select(F.col("head").alias("a"), F.col("node").alias("b"), "n"))


def _similar_in_group(sizes: np.ndarray, flat: np.ndarray, label: np.ndarray, late: np.ndarray, similar: float) -> np.ndarray:
    """Pairs of rows, of different labels, whose sets are similar: early rows with late ones, or all if none is late.

    ``flat`` has the sets end to end. How much two sets share is counted by products of matrices of ones, a row
    a set and a column a shingle that several sets have; some columns at a time.
    """
    n = len(sizes)
    left, right = (np.flatnonzero(late == 0), np.flatnonzero(late == 1)) if late.any() else (np.arange(n), np.arange(n))
    low, high = np.minimum.outer(sizes[left], sizes[right]), np.maximum.outer(sizes[left], sizes[right])
    # only then can they be similar
    may = (low >= similar * high - 1e-9) & (label[left][:, None] != label[right][None, :])
    if not late.any():
        may &= left[:, None] < right[None, :]
    if not may.any():
        return np.zeros((0, 2), np.int64)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    use = count[code] > 1
    row, column = np.repeat(np.arange(n), sizes)[use], place[code[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros(may.shape, np.float32)
    step = max(64, CELLS // n)
    for first in range(0, int((count > 1).sum()), step):
        lo, hi = np.searchsorted(column, (first, first + step))
        ones = np.zeros((n, step), np.float32)
        ones[row[lo:hi], column[lo:hi] - first] = 1
        shared += ones[left] @ ones[right].T
    may &= shared >= similar * (sizes[left][:, None] + sizes[right][None, :] - shared.astype(float)) - 1e-9
    x, y = np.nonzero(may)
    return np.stack([left[x], right[y]], axis=1)


def _forest(found: np.ndarray, label: np.ndarray) -> list[int]:
    """Which of the pairs ``found`` it takes to join the labels that they all join."""
    _, first = np.unique(np.stack([label[found[:, 0]], label[found[:, 1]]], axis=1), axis=0, return_index=True)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for i in first.tolist():
        a, b = (top(int(label[k])) for k in found[i])
        if a != b:
            root[a] = b
            kept.append(i)
    return kept


def _links_in_blocks(rows: pa.Table, similar: float) -> Iterator[pa.RecordBatch]:
    """Links ``(x, y)`` within the whole groups (band, kind, i, j) that ``rows`` has in order."""
    starts = _starts(rows)
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    late, elements = rows.column("late").to_numpy(), rows.column("elements").combine_chunks()
    at, flat = elements.offsets.to_numpy(), elements.values.to_numpy()
    node = rows.column("node").combine_chunks()
    for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
        found = _similar_in_group(np.diff(at[lo : hi + 1]), flat[at[lo] : at[hi]], label[lo:hi], late[lo:hi], similar)
        if len(found):
            x, y = (found[_forest(found, label[lo:hi])] + lo).T
            yield pa.RecordBatch.from_arrays([node.take(pa.array(x)), node.take(pa.array(y))], ["x", "y"])


def _starts(rows: pa.Table) -> list[int]:
    """Where the groups begin."""
    keys = [rows.column(c).to_numpy() for c in ("band", "kind", "i", "j")]
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new).tolist()


def _apart(known: DataFrame, split: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links ``(a, b)`` that join what is similar and in different components, of all pairs that share a bucket."""
    rows = known.join(split.select("band", F.col("label").alias("main_label"), "main", "rest"), "band")
    is_main = F.col("label") == F.col("main_label")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("main")).otherwise(F.col("rest"))).cast("int")
    rows = rows.withColumn("is_main", is_main).withColumn("own", own)
    group = lambda kind, i, j, late: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), late.cast("int").alias("late")
    )
    of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("own")
    meets = F.when(F.col("is_main"), F.transform(of("rest"), lambda j: group(0, mine, j, F.lit(0)))).otherwise(
        F.concat(
            F.transform(of("main"), lambda i: group(0, i, mine, F.lit(1))),
            F.transform(of("rest"), lambda o: group(1, F.least(mine, o), F.greatest(mine, o), mine > o)),
        )
    )
    rows = rows.join(sets, "node").select("band", "node", "label", "elements", F.explode(meets).alias("g"))
    rows = rows.select("band", "g.*", "node", "label", "elements")
    rows = rows.repartition("band", "kind", "i", "j").sortWithinPartitions("band", "kind", "i", "j", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            whole = _starts(held)[-1]
            if whole:
                yield from _links_in_blocks(held.slice(0, whole), similar)
                held = held.slice(whole)
        if held is not None and len(held):
            yield from _links_in_blocks(held, similar)

    found = rows.mapInArrow(handing_back(run), "x binary, y binary")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_classes(
    docs: DataFrame, similar: float = SIMILAR, size: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS, repeats: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, h, class_id, kept``.

    A class is all texts that chains of links join, a link being a similarity of ``similar`` or more of
    the sets of ``size``-word shingles (words are what white space separates, without case; a text of
    fewer words is one shingle), or with ``repeats`` of the shingles as often as they occur. ``class_id`` is the class's smallest doc_id, and one row of that id is
    kept. Rows with equal sets are in one class without comparison. Null texts are empty ones; a text
    without words is a class of its own, and so is a row whose id is null unless others are in its class.
    An empty table gives an empty result; other columns are ignored.
    """
    sign = settle(signatures(docs, size, bands, band_rows, repeats), "signatures")
    nodes = sign.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "row")).alias("rep"), F.min(F.struct("size", "bands")).alias("s")
    ).select("node", "rep", "s.size", "s.bands")
    nodes = settle(nodes, "nodes")
    banded = nodes.select("node", "size", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n"))
    buckets = settle(buckets.filter("n > 1"), "buckets")
    members = settle(banded.join(buckets, "band"), "members")
    pairs = members.filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b"), "n")
    pairs = settle(_salted(pairs), "pairs")

    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    wanted = settle(wanted.select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h")), "wanted")
    a, b = docs.alias("a"), wanted.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (_text_hash() == F.col("b.h"))
    # both sides grow with the corpus, so they are merged at every size
    texts = a.join(b.hint("merge"), same, "left_semi").select(F.coalesce(F.col("a.text").cast("string"), F.lit("")).alias("text"))
    # repeated rows of an id are one set
    sets = settle(_sets(texts.distinct(), size, repeats), "sets")

    links = settle(_verified(pairs, sets, similar), "links")
    labels = components(links)
    known, split = _split_buckets(members, labels)
    if not split.filter(F.col("n") > BLOCK).isEmpty():
        more = settle(_verified(settle(_with_heads(known, split), "pairs-with-heads"), sets, similar), "more-links")
        links = settle(links.unionByName(more), "all-links")
        labels = components(links)
        known, split = _split_buckets(members, labels)
    more = settle(_apart(known, split, sets, similar), "last-links")
    labels = components(settle(links.unionByName(more), "all-links"))

    named = labels.join(nodes.select("node", "rep"), "node")
    heads = settle(named.groupBy("label").agg(F.min("rep").alias("head")), "heads")
    classes = settle(labels.join(heads, "label").select("node", "head"), "classes")
    of_node = nodes.select("node", "rep").join(classes, "node", "left")
    of_node = settle(of_node.select("node", F.coalesce("head", "rep").alias("head")), "node-classes")
    rows = sign.select("row", "doc_id", "h", "node").join(of_node, "node", "left")
    lone = F.col("head").isNull()
    return rows.select(
        "doc_id",
        "h",
        F.when(lone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        (lone | (F.col("row") == F.col("head.row"))).alias("kept"),
    )


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("a.text").cast("string"), F.lit("")))


def drop_near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that ``near_classes`` keeps, one of each class, with their columns as they are, whatever their names.

    Null and empty texts are classes of their own and stay; of repeated rows one stays, and where their other columns differ the
    one whose JSON sorts first. An empty table gives an empty result.
    """
    verdicts = settle(near_classes(docs, similar), "near-verdicts")
    return rows_that_stay(docs, verdicts, "h", _text_hash())
