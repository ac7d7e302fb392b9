"""State kept in ranges of hashed keys, so that a change rewrites only the ranges that it falls into."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.scratch import settle

RANGE = "key_range"
RANGES = 64


def range_of(key: Sequence[str], ranges: int = RANGES) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(ranges)).cast("int")


def write_state(state: DataFrame, path: str, key: Sequence[str], ranges: int = RANGES) -> None:
    """A new state below ``path``: a folder a range, its rows sorted by key."""
    placed = state.withColumn(RANGE, range_of(key, ranges)).repartition(RANGE).sortWithinPartitions(RANGE, *key)
    placed.write.mode("overwrite").partitionBy(RANGE).parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(RANGE)


def upsert(
    spark: SparkSession, path: str, changes: DataFrame, key: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], ranges: int = RANGES
) -> list[int]:
    """The state below ``path`` after ``merge(old, changes)``; returns the ranges that were read and written.

    Other ranges are neither read nor written. The new ranges are made in the scratch folder first and then take the old
    ones' places, so that a failure while they are made leaves the state as it was, and one while they are moved is mended by
    moving them again. ``ranges`` must be the state's own; a change is in the range of its key, and ``merge`` must keep keys.
    """
    placed = settle(changes.withColumn(RANGE, range_of(key, ranges)), "changes")
    touched = sorted(r[0] for r in placed.select(RANGE).distinct().collect())  # at most ``ranges`` numbers
    if not touched:
        return []
    stored = spark.read.parquet(path)
    old = stored.filter(F.col(RANGE).isin(touched)).drop(RANGE)
    new = settle(merge(old, placed.drop(RANGE)).withColumn(RANGE, range_of(key, ranges)), "new-ranges")
    ordered = new.select(*stored.columns).repartition(RANGE).sortWithinPartitions(RANGE, *key)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path)
    return touched
