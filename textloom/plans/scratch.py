"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where it is unset and all work is local, as in tests, a temporary one."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} names no folder, and this machine's own are not shared by the cluster")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="textloom-")
            spark.sparkContext.setCheckpointDir(_own[app])
        found = _own[app]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage with a committed table, so a lost executor costs a re-read and no
    re-computation, and it gives the planner the table's true size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table with no more bytes for each core is dealt anew; Spark itself cuts files no smaller.
SMALL_BYTES = 4 << 20


def read_dealt(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, with as many tasks as there are cores where it is small.

    A small file is one task, however much work its rows are. So a table of few bytes is dealt to all cores; a larger one is read as it
    lies. Filters and the choice of columns still reach the files. The bytes come from the files' listing.
    """
    table, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
    return table.repartition(cores) if size <= cores * SMALL_BYTES else table
