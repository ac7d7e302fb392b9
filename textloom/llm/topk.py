"""Exact top-k search by inner product with segment statistics.

A vector is described by the mean and the deviation of each of its segments, at several resolutions.
For a query q and a candidate c, a segment of m components adds at most
``m * (mean_q * mean_c + dev_q * dev_c)`` to their inner product; the sum over segments is an upper bound
of the score, that is a lower bound of the distance ``const - score``. Bounds are taken from coarse to fine; each
resolution only looks at the pairs that the coarser ones could not rule out, and the scores of the
survivors are computed exactly, in integers.

Vectors are dealt into groups of like statistics, around a bounded number of sampled ones. Each query first searches its own
group, which gives it a floor. What the descriptions of a group's vectors range over bounds the scores of the
whole group, so a query then only goes to the groups that can pass its floor, and whole vectors are only sent
where blocks of such queries go.
"""

from __future__ import annotations

from collections.abc import Iterator

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.scratch import settle

SCALE = 64
TOP = 20
QUERY_EVERY = 20
CANDIDATES_A_GROUP = 8192
QUERIES_A_BLOCK = 4096
#: Bound on the sampled vectors around which groups form, whatever the table's size; larger groups are split by hash.
PIVOTS = 1024
RESOLUTIONS = (1, 4, 16)
QUERIES_AT_ONCE = 256
EXACT_IN_DOUBLE = float(1 << 53)
#: Scores of at least this size may be cut to 64 bits, and are not told apart by bounds.
NEARLY_CUT = 9.2e18


def quantised(embedding: Column) -> Column:
    """``floor(64 * x)`` of each component as LONG; null where the vector is null, has no components, or
    holds null or non-finite ones."""
    usable = embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.when(usable, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows; shorter ones are filled with zeros, which add nothing."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _describe(x: np.ndarray, parts: int) -> np.ndarray:
    """Per row and segment sqrt(m) times the mean and the deviation; the inner product is the bound."""
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    both = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mean = x[:, a:b].mean(axis=1)
        both += [mean * np.sqrt(b - a), np.sqrt(np.maximum(0, (x[:, a:b] ** 2).mean(axis=1) - mean**2) * (b - a))]
    return np.stack(both, axis=1)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these hold every partial sum. Beyond 64 bits: the nearest such number."""
    most = _largest(q) * _largest(c) * q.shape[1]
    if most < EXACT_IN_DOUBLE:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [[max(low, min(high, sum(map(operator.mul, u, v)))) for v in c.tolist()] for u in q.tolist()]
    return np.array(rows, dtype=np.int64).reshape(len(q), len(c))


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(float)).max(initial=0))


def _slack(largest_q: float, largest_c: float, width: int) -> float:
    """More than what rounding can take from a bound."""
    return 1e-9 * (1 + largest_q * largest_c * width)


def _cut(floor: np.ndarray) -> np.ndarray:
    return np.where(floor < -NEARLY_CUT, -np.inf, np.minimum(floor, NEARLY_CUT))


def _search(
    qid: np.ndarray, q: np.ndarray, floors: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int
) -> tuple[list, list, list]:
    """For each query the best ``k`` of the candidates other than itself, by score and then smaller id, as far as
    they are not below the query's floor."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    cf, levels = c.astype(float), [_describe(c.astype(float), n) for n in RESOLUTIONS]
    largest = _largest(c)
    out_q, out_c, out_s = [], [], []
    for lo in range(0, len(q), QUERIES_AT_ONCE):
        ids, block = qid[lo : lo + QUERIES_AT_ONCE], q[lo : lo + QUERIES_AT_ONCE]
        sides = [_describe(block.astype(float), n) for n in RESOLUTIONS]
        slack = _slack(_largest(block), largest, q.shape[1])
        bound = sides[0] @ levels[0].T
        # the scores of the candidates with the highest coarse bounds give each query a floor
        some = min(4 * k, len(c))
        likely = np.argpartition(-bound, some - 1, axis=1)[:, :some]
        scores = np.where(cid[likely] == ids[:, None], -np.inf, np.einsum("qd,qcd->qc", block.astype(float), cf[likely]))
        floor = np.partition(scores, -k, axis=1)[:, -k] if some > k else np.full(len(block), -np.inf)
        floor = _cut(np.maximum(floor, floors[lo : lo + QUERIES_AT_ONCE]))
        alive = (bound >= floor[:, None] - slack) & (cid[None, :] != ids[:, None])
        some = np.flatnonzero(alive.any(axis=0))
        for side, level in zip(sides[1:], levels[1:], strict=True):
            alive = alive[:, some] if len(some) < alive.shape[1] else alive
            alive &= side @ level[some].T >= floor[:, None] - slack
            keep = alive.any(axis=0)
            some, alive = some[keep], alive[:, keep]
        exact = _exact(block, c[some])
        for i in range(len(block)):
            at = np.flatnonzero(alive[i])
            if len(at) > k:
                at = at[exact[i, at] >= np.partition(exact[i, at], -k)[-k]]
            values = exact[i, at]
            best = np.lexsort((cid[some[at]], ~values))[:k]
            out_q += [int(ids[i])] * len(best)
            out_c += cid[some[at[best]]].tolist()
            out_s += values[best].tolist()
    return out_q, out_c, out_s


FOUND = "query_id long, vec_id long, score long"


def _found(parts: tuple[list, list, list]) -> pa.Table:
    return pa.table({n: pa.array(f, pa.int64()) for n, f in zip(("query_id", "vec_id", "score"), parts, strict=True)})


def _near_pivots(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``rows`` with the number ``p`` of the pivot whose description is nearest."""
    shared = rows.sparkSession.sparkContext.broadcast(_describe(pivots.astype(float), RESOLUTIONS[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        for batch in batches:
            own = _describe(_matrix(batch.column(1), width).astype(float), RESOLUTIONS[-1])
            far = (centre**2).sum(axis=1)[None, :] - 2 * own @ centre.T
            p = far.argmin(axis=1) if len(own) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.int32())], ["vec_id", "v", "p"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, p int")


def _ranges(rows: DataFrame, n_pivots: int, width: int) -> np.ndarray:
    """For each pivot the least and the greatest of its vectors' descriptions; without vectors: no numbers.

    A task returns a row for a pivot at most, and one row a pivot comes to the driver.
    """
    size = _describe(np.zeros((1, width)), RESOLUTIONS[-1]).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((n_pivots, size), np.inf), np.full((n_pivots, size), -np.inf)
        for batch in batches:
            own, p = _describe(_matrix(batch.column(1), width).astype(float), RESOLUTIONS[-1]), batch.column(2).to_numpy()
            np.minimum.at(low, p, own)
            np.maximum.at(high, p, own)
        there = np.flatnonzero(np.isfinite(low[:, 0]))
        both = pa.array(list(np.concatenate([low, high], axis=1)[there]), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), both], ["p", "both"])

    ends = [F.min(F.get("both", F.lit(i))) for i in range(size)] + [F.max(F.get("both", F.lit(size + i))) for i in range(size)]
    out = np.full((n_pivots, 2 * size), np.nan)
    for row in rows.mapInArrow(run, "p int, both array<double>").groupBy("p").agg(*ends).collect():
        out[row[0]] = row[1:]
    return out.reshape(n_pivots, 2, size)


def _reachable(queries: DataFrame, ranges: np.ndarray, largest: float, width: int) -> DataFrame:
    """``queries (query_id, v, floor, p, ...)`` with each pivot ``to`` whose vectors can pass the floor."""
    shared = queries.sparkSession.sparkContext.broadcast(ranges)
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = shared.value[:, 0], shared.value[:, 1]
        there = np.flatnonzero(~np.isnan(low[:, 0]))
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(lo, QUERIES_AT_ONCE)
                q = _matrix(part.column(1), width)
                own = _describe(q.astype(float), RESOLUTIONS[-1])
                up, down = np.maximum(own, 0), np.minimum(own, 0)
                bound = up @ high[there].T + down @ low[there].T
                floor = _cut(part.column(2).to_numpy())
                row, at = np.nonzero(bound >= floor[:, None] - _slack(_largest(q), largest, width))
                columns = [c.take(pa.array(row)) for c in part.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(there[at], pa.int32())], [*names, "to"])

    return queries.mapInArrow(run, "query_id long, v array<long>, floor double, p int, part int, block int, to int")


def top_k(
    vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY, group: int = CANDIDATES_A_GROUP, block: int = QUERIES_A_BLOCK, pivots: int = PIVOTS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k`` best others.

    Scores are exact integer inner products of the quantised vectors, ties go to the smaller id, and a query
    with fewer than ``k`` others gets all. A component or score beyond 64 bits counts as the nearest 64-bit number. Vectors
    that are null, empty, or hold null or non-finite components take no part, nor do rows without an id; vectors of
    different lengths are compared as if filled with zeros; several rows with one id are one candidate each but for
    queries of that id. An empty table gives an empty result; other columns are ignored.

    No task holds more than a group of candidates, of ``group`` on average, and a block of queries; however many vectors are alike,
    their group is split. A task returns ``k`` rows for a query, and these few are ranked at the end.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    rows = settle(rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()), "quantised")
    highest = F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(highest)).first()
    width, largest = width or 1, largest or 0.0
    n_pivots = max(1, min(pivots, -(-n // group)))
    spread = F.xxhash64("vec_id", "v")
    some = rows.filter(F.pmod(F.xxhash64("v"), F.lit(max(1, n // (64 * n_pivots)))) == 0)
    sample = [r["v"] for r in some.select("v").distinct().orderBy(F.xxhash64("v")).limit(n_pivots).collect()]
    centre = np.zeros((max(1, len(sample)), width), np.int64)
    for i, v in enumerate(sample):
        centre[i, : len(v)] = v
    near = settle(_near_pivots(rows, centre, width), "near-pivots")
    # one row a pivot
    parts = near.groupBy("p").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"), F.ceil(F.count("*") / (every * block)).cast("int").alias("blocks"))
    parts = settle(parts, "parts-of-pivots")
    part, own_block = F.pmod(spread, F.col("parts")).cast("int"), F.pmod(F.shiftright(spread, 16), F.col("blocks")).cast("int")
    dealt = near.join(F.broadcast(parts), "p").select("vec_id", "v", "p", part.alias("part"), own_block.alias("block"))
    is_query = F.col("vec_id") % every == 0

    def own_group(both: pa.Table) -> pa.Table:
        ids, x = both.column("vec_id").to_numpy(), _matrix(both.column("v").combine_chunks(), width)
        asks = ids % every == 0
        return _found(_search(ids[asks], x[asks], np.full(int(asks.sum()), -np.inf), ids, x, k))

    def other_group(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _found(([], [], []))
        x = [_matrix(t.column("v").combine_chunks(), width) for t in (left, right)]
        ids = [left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()]
        return _found(_search(ids[0], x[0], left.column("floor").to_numpy(), ids[1], x[1], k))

    found = dealt.select("p", "part", "vec_id", "v").groupBy("p", "part").applyInArrow(own_group, FOUND)
    groups = parts.agg(F.sum("parts")).first()[0] or 0
    if groups > 1:
        found = settle(found, "own-groups")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        floors = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
        asking = dealt.filter(is_query).withColumnRenamed("vec_id", "query_id").join(floors, "query_id", "left")
        asking = asking.select("query_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "p", "part", "block")
        sent = _reachable(asking, _ranges(near, len(centre), width), largest, width)
        to_parts = parts.select(F.col("p").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part"))
        sent = sent.join(to_parts, "to").filter((F.col("to") != F.col("p")) | (F.col("to_part") != F.col("part")))
        sent = settle(sent.select("to", "to_part", "p", "block", "query_id", "v", "floor"), "queries-sent")
        wanted = sent.select("to", "to_part", F.col("p").alias("of"), F.col("block").alias("of_block")).distinct()
        held = dealt.select(F.col("p").alias("to"), F.col("part").alias("to_part"), "vec_id", "v").join(wanted, ["to", "to_part"])
        asked = sent.groupBy("to", "to_part", "p", "block")
        met = asked.cogroup(held.groupBy("to", "to_part", "of", "of_block")).applyInArrow(other_group, FOUND)
        found = found.unionByName(met)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
