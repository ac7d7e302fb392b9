"""Connected components, and leaving out rows by verdicts, as DataFrame programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.scratch import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: for each node of ``edges (a, b)`` the smallest node that links lead to.

    In each round a node takes the smallest label among its own and its neighbours', and then the label
    of that label, so that the distance to go halves. Each round is written and rests on no earlier one.
    Only a count comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both.filter(F.col("a") != F.col("b")), "edges")
    labels = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        heard = settle(heard.withColumnRenamed("a", "node"), "heard")
        near = labels.join(heard, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label")
        )
        near = settle(near, "near-labels")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        far = near.join(up, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        far = settle(far, "labels")
        labels = far.select("node", "label")
        if far.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The ``wanted`` column names, with as many underscores as it takes to differ from all that are ``taken``."""
    there, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def rows_that_stay(docs: DataFrame, verdicts: DataFrame, key: str, key_of: Column) -> DataFrame:
    """The rows of ``docs`` for which ``verdicts (doc_id, <key>, kept)`` says so, their columns as they are.

    ``key_of`` is the verdicts' key as an expression over ``docs`` under the alias ``a``; with the id it tells rows apart. Of
    repeated rows, which share both, as many stay as are kept: one. Of these, where other columns
    differ, the row whose JSON sorts first stays.
    """
    told = verdicts.groupBy("doc_id", key).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    told = settle(told.filter(~F.col("stays") | (F.col("n") > 1)), "leaving-rows")
    a, b = docs.alias("a"), told.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (key_of == F.col(f"b.{key}"))
    kept = a.join(b, same, "left_anti")
    repeated = told.filter("stays")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"a.`{c}`") for c in docs.columns])
    # as JSON, since not all types have an order
    one = (
        a.join(repeated.alias("b"), same, "left_semi")
        .groupBy(F.col("a.doc_id").alias("k1"), key_of.alias("k2"))
        .agg(F.min_by(whole, F.to_json(whole)).alias("row"))
        .select("row.*")
    )
    return kept.unionByName(one)
