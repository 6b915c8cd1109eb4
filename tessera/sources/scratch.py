"""Folders that the driver and all executors see, and files there with names of their own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset a session on one machine gets a temporary one that goes with the process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        if not _made:
            _made.append(tempfile.mkdtemp(prefix="scratch-"))
            atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
        top = f"file://{_made[0]}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a new folder: made once, however often it is read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(df: DataFrame, by: list[str], path: str, name: str) -> None:
    """A TSV file with a header, its lines sorted, for each value of `by`, at path/name with the columns' values put in. Nothing is quoted."""
    spark, columns, parts = df.sparkSession, [c for c in df.columns if c not in by], f"{path}-parts"
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    heads = df.select(*by).distinct().select(*by, F.lit(0).alias("_at"), F.lit("\t".join(columns)).alias("value"))
    lines = df.select(*by, F.lit(1).alias("_at"), line.alias("value")).unionByName(heads)
    lines.repartition(*by).sortWithinPartitions(*by, "_at", "value").drop("_at").write.partitionBy(*by).text(parts)
    java = spark._jvm.org.apache.hadoop.fs
    root = java.Path(parts)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in store.globStatus(java.Path(f"{parts}/{'/'.join(f'{c}=*' for c in by)}/part-*")):
        at = f.getPath()
        values = dict(p.split("=", 1) for p in at.toString().split("/") if "=" in p)
        to = java.Path(f"{path}/{name.format(**values)}")
        store.mkdirs(to.getParent())
        store.rename(at, to)
    store.delete(root, True)
