"""Running numbers and totals over tables of any size, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.scratch import settle

_PLACE_BITS = 33  # of ``monotonically_increasing_id``: a task's rows count up from its number times 2^33


def _offsets(settled: DataFrame, amount: Column) -> DataFrame:
    """``part, before``: what all earlier parts have in all. One row a task that wrote, so one task adds them up."""
    per = settled.groupBy(F.shiftright("row_id", _PLACE_BITS).alias("part")).agg(F.sum(amount).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("before"))


def numbered(rows: DataFrame, *order: str | Column, name: str = "ordinal", start: int = 1) -> DataFrame:
    """``rows`` with their number in the given order.

    Rows are dealt and sorted in ranges, and written with their place in their range; the sizes of the ranges, one row each, give
    what is to be added. Rows that are equal in all of ``order`` are numbered in an order of their own, which the written table fixes.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    settled = settle(ranged.withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    place = F.col("row_id") - F.shiftleft("part", _PLACE_BITS)
    joined = settled.withColumn("part", F.shiftright("row_id", _PLACE_BITS)).join(F.broadcast(_offsets(settled, F.lit(1))), "part")
    return joined.select(*rows.columns, (F.col("before") + place + start).alias(name))


def with_running_total(rows: DataFrame, amount: str, *order: str | Column, name: str = "total") -> DataFrame:
    """``rows`` with the sum of ``amount`` up to and with each row, in the given order; nulls add nothing.

    Within a range a window adds up; as a range is what one task sorts, no task gets more than that.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    settled = settle(ranged.withColumn("row_id", F.monotonically_increasing_id()), "running-total")
    within = Window.partitionBy("part").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = settled.withColumn("part", F.shiftright("row_id", _PLACE_BITS)).withColumn("own", F.sum(F.coalesce(F.col(amount), F.lit(0)).cast("long")).over(within))
    joined = parts.join(F.broadcast(_offsets(settled, F.coalesce(F.col(amount), F.lit(0)))), "part")
    return joined.select(*rows.columns, (F.col("before") + F.col("own")).alias(name))


def numbered_as_read(scan: DataFrame, file: str, block: str, name: str = "ordinal", start: int = 1) -> DataFrame:
    """Rows of a file scan with their number: by file, then block of the file, then as they stand in it.

    ``scan`` is the reader's output with ``file`` and ``block`` (where the block starts) as columns, not filtered. A block's rows are one
    task's, one after another, so a row's place is its distance from the block's first.
    """
    settled = settle(scan.withColumn("row_id", F.monotonically_increasing_id()), "numbered-lines")
    blocks = settled.groupBy(file, block).agg(F.min("row_id").alias("first_id"), F.count("*").alias("n"))
    earlier = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long"))
    joined = settled.join(blocks.drop("n"), [file, block])
    return joined.select(*scan.columns, (F.col("before") + F.col("row_id") - F.col("first_id") + start).alias(name))


def until_total(rows: DataFrame, amount: str, target: int, order: Sequence[str]) -> DataFrame:
    """``rows`` in the given order up to and with the one that brings the running total of ``amount`` to ``target``; all, if none does.

    ``order`` tells rows apart. A row that adds something comes while the total before it is below the target.
    """
    totals = with_running_total(rows, amount, *order)
    return totals.filter(F.col("total") - F.coalesce(F.col(amount), F.lit(0)) < target).drop("total")
