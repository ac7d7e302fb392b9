"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a fixed 60-bit hash of its id. A source's budget is met by taking the documents
whose hash lies below a threshold. The threshold is found by summing sizes per (source, hash bucket),
locating the bucket in which the budget ends and looking closer at that bucket alone, ten bits at a
time. No document is sorted, and a larger budget always takes a superset of a smaller one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.links import free_names
from textloom.plans.scratch import settle

WEIGHTS = (3, 1, 2)
HASH_BITS = 60
STEP_BITS = 10
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits of MD5 of the id as text; a null id counts as the empty text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_repeat: float = 2.0
) -> DataFrame:
    """``source, source_size, target``: one row per source.

    The weights repeat over the sources in code point order, null last. A target stops at
    ``max_repeat`` times its source's size and the excess goes to the others by weight; that is the
    level at which ``min(cap, level * weight)`` sums up to the budget. The windows here run over one
    row per source, not per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")
    per = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(table, at))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    )
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    per = per.withColumn("capped", before + F.col("cap") / F.col("weight") * after <= F.col("budget"))
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    level = (F.col("budget") - spent) / open_weight
    return per.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"),
    )


def thresholds(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_repeat: float = 2.0
) -> DataFrame:
    """``source, source_size, target, whole, cut``: take each document ``whole`` times, and once more
    where its hash is below ``cut``.

    The cut is the one whose sum is nearest to the target; of two equally near, the lower sum stays
    if the boundary hash would overshoot. Documents with equal hashes are taken together.
    """
    targets = source_targets(sized, weights, share, max_repeat)
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    state = targets.select(
        "source",
        "source_size",
        "target",
        whole.alias("whole"),
        (F.col("target") - whole * size).alias("need"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(False).alias("settled"),
        F.lit(0).cast("long").alias("cut"),
    )
    state = settle(state, "mix-state")
    rows = sized.select("source", "size", "hash")
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        looking = state.filter(~F.col("settled")).select(F.col("source").alias("s"), "prefix", "need")
        inside = rows.join(looking, F.col("source").eqNullSafe(F.col("s"))).filter(
            F.shiftright("hash", shift + STEP_BITS) == F.col("prefix")
        )
        if shift < HASH_BITS - STEP_BITS:  # finer levels only read the boundary buckets
            inside = settle(inside, "boundary-buckets")
            rows = inside.select("source", "size", "hash")
        hist = inside.groupBy("s", "need", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("sum"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        run = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("sum").over(run))
        ends = (
            hist.filter(F.col("upto") > F.col("need"))
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "upto", "sum", "low", "high")).alias("b"))
            .select("s", "b.*")
        )
        rest = F.col("need") - (F.col("upto") - F.col("sum"))
        single = F.col("low") == F.col("high")
        takes = F.col("sum") <= 2 * rest
        joined = state.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
        none = F.col("bucket").isNull()
        state = joined.select(
            "source",
            "source_size",
            "target",
            "whole",
            F.when(F.col("settled") | none, F.col("need")).otherwise(rest).alias("need"),
            F.when(F.col("settled") | none, F.col("prefix")).otherwise(F.col("bucket")).alias("prefix"),
            (F.col("settled") | none | single).alias("settled"),
            F.when(F.col("settled"), F.col("cut"))
            .when(none, F.shiftleft(F.col("prefix") + 1, shift + STEP_BITS))
            .otherwise(F.col("low") + F.when(takes, 1).otherwise(0))
            .alias("cut"),
        )
        state = settle(state, "mix-state")
        if state.filter("not settled").isEmpty():
            break
    return state.select("source", "source_size", "target", "whole", "cut")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "mix_source")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("hash"))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_repeat: float = 2.0
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    ``taken`` is the words that the mix takes, repeats counted; whole documents are taken, so a
    source's sum differs from its target by half of the size at the boundary hash at most. Null or
    empty texts have size 0; a null source is a source like others; repeated rows are taken together;
    an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    sized = settle(_sized(docs), "mix-sizes")
    plan = thresholds(sized, weights, share, max_repeat)
    extra = F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)
    return _with_plan(sized, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + extra)).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_repeat: float = 2.0
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, ``max_repeat`` times at most, with their columns as they are, whatever
    their names. Null and empty texts and null sources are as in ``mix``; an empty table gives an empty result."""
    source, whole, cut, copy = free_names(docs.columns, "mix_source", "mix_whole", "mix_cut", "mix_copy")
    sized = settle(_sized(docs), "mix-sizes")
    plan = thresholds(sized, weights, share, max_repeat).toDF(source, "source_size", "target", whole, cut).select(source, whole, cut)
    a = docs.alias("a")
    times = F.col(whole) + F.when(doc_hash(F.col("a.doc_id")) < F.col(cut), 1).otherwise(0)
    times = F.least(times, F.lit(int(max_repeat)).cast("long"))  # texts of size 0 would come once more where nothing is needed
    joined = a.join(plan, F.col("a.source").eqNullSafe(F.col(source)))
    taken = joined.filter(times > 0).select("a.*", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(copy))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
