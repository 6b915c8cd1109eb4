"""What the operators of this subpackage share: tables in the folder that the whole cluster sees, and words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast of the operators holds at most so many rows (of a few numbers each); beyond it they join by shuffle.
BROADCAST_ROWS = 200_000
#: Tasks that share the rows of one group where its join shuffles.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a session on one machine (as in tests) gets a temporary folder that goes
    with the process; on a cluster, where the executors would not see it, that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="shared-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return f"file://{_made[0]}"


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to hold at most so many rows, else as it is. df should be a stored table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def about(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """About so many rows of df (all, if it has no more), those whose key's hash is low: a bounded sample without a sort or shuffle,
    the same each time. df's rows are counted first, which for a table of files reads no column."""
    n = df.count()
    return df if n <= rows else df.where(F.shiftright(F.xxhash64(key), 1) < int((rows / n * 2 - 1) * (1 << 62)))


def with_group(rows: DataFrame, groups: DataFrame, key: str, by: tuple[str, ...], limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows left-joined with groups (stored, a row for each key): as a broadcast where it is counted to be small, else by key and a
    hash of `by`, so that a key of very many rows is shared by SALTS tasks. groups is copied SALTS times there; it should hold only groups of two or more."""
    if groups.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(groups), key, "left")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [key, "salt"], "left").drop("salt")
