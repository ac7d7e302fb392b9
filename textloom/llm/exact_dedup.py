"""Exact de-duplication by deterministic block naming, with DataFrame functions only.

Each text is cut into blocks of a fixed number of bytes. Equal blocks get equal integer names and
different blocks get different ones; then adjacent names are paired and each pair is named anew,
until a document has one name left. With the text's length, that name is its identity: no two
different texts share it, whatever their hashes are.

A name is ``bucket << 23 | rank``. The bucket is 40 bits of a hash, and the rank is the value's place
among the *sorted distinct values* of its bucket. Nearly all buckets hold one distinct value, whose
rank is 0; ``min = max`` over a bucket proves that by comparing contents, with partial aggregates that
collapse copies before the shuffle. Only buckets with several values are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.links import rows_that_stay
from textloom.plans.scratch import settle

BLOCK_BYTES = 4096
RANK_BITS = 23
BUCKET_BITS = 40


def name_values(df: DataFrame, value: str, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Replace the column ``value`` by ``name``: a LONG that is equal exactly where values are equal."""
    keyed = df.withColumn("bucket", F.shiftrightunsigned(F.xxhash64(value), 64 - bucket_bits))
    mixed = (
        keyed.groupBy("bucket")
        .agg(F.min(value).alias("low"), F.max(value).alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("bucket")
    )
    mixed = settle(mixed, "mixed-buckets")
    name = F.shiftleft("bucket", RANK_BITS)
    if mixed.isEmpty():
        return keyed.withColumn("name", name).drop("bucket", value)
    ranks = (
        keyed.join(mixed, "bucket", "left_semi")
        .select("bucket", value)
        .distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(value)) - 1)
    )
    ranks = settle(ranks, "ranked-values")
    named = keyed.join(ranks, ["bucket", value], "left")
    too_many = F.raise_error("a bucket holds more distinct values than its rank bits can count")
    rank = F.when(F.col("rank") >= 1 << RANK_BITS, too_many.cast("long")).otherwise(F.coalesce("rank", F.lit(0)))
    return named.withColumn("name", name + rank).drop("bucket", "rank", value)


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """``doc_id, sha, n_bytes, copies, identity``: one row per distinct (doc_id, text).

    ``(n_bytes, identity)`` is equal exactly where texts are equal. ``copies`` counts repeated rows
    with the same id and the same text. A null text counts as empty; a null id is an id like others.
    """
    rows = docs.select("doc_id", _text().alias("text")).select(
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.col("text").cast("binary").alias("bytes"),
    )
    cut = F.expr(
        f"transform(sequence(0, cast(greatest(n_bytes - 1, 0) div {block_bytes} as int)),"
        f" i -> substring(bytes, i * {block_bytes} + 1, {block_bytes}))"
    )
    blocks = rows.select("doc_id", "sha", "n_bytes", F.posexplode(cut).alias("pos", "block"))
    level = settle(
        name_values(blocks, "block", bucket_bits)
        .groupBy("doc_id", "sha", "n_bytes", "pos")
        .agg(F.max("name").alias("name"), F.count("*").alias("copies")),
        "block-names",
    )
    longest = level.agg(F.max("n_bytes")).first()[0] or 0
    done, span = [], block_bytes
    key = ["doc_id", "sha", "n_bytes", "copies"]
    while True:
        done.append(level.filter(F.col("n_bytes") <= span).select(*key, F.col("name").alias("identity")))
        if longest <= span:
            break
        even = F.col("pos") % 2 == 0
        pairs = (
            level.filter(F.col("n_bytes") > span)
            .groupBy(*key, F.shiftright("pos", 1).alias("next"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            )
            .select(*key, F.col("next").alias("pos"), F.struct("left", "right").alias("pair"))
        )
        level = settle(name_values(pairs, "pair", bucket_bits), "pair-names")
        span *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of rows with equal texts the one with the largest id stays. Null texts are empty texts. Repeated
    rows (same id, same text) all count in ``group_size`` and one of them is kept. Rows without an id
    stay only where no row of their group has one. An empty table gives an empty result. Other columns
    of ``docs`` are ignored, whatever their names.
    """
    ids = settle(identities(docs, block_bytes, bucket_bits), "identities")
    groups = (
        ids.groupBy("n_bytes", "identity")
        .agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("members"))
        .filter("members > 1")
        .drop("members")
    )
    joined = ids.join(settle(groups, "groups"), ["n_bytes", "identity"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "copies").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their columns as they are, whatever their names.

    Null texts equal empty ones; a row without an id stays only where no row of its text has one. Of repeated rows one stays,
    and where their other columns differ the one whose JSON sorts first. An empty table gives an empty result.
    """
    verdicts = settle(exact_dedup(docs), "copies")
    return rows_that_stay(docs, verdicts, "text_sha256", F.sha2(_text("a.text"), 256))
