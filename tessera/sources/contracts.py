"""Contracts between steps: JSON results with required keys, and the sinks that write them; settings; text out of HTML."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import json_safe


def read_contract(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A row for each file: the contract's fields and the hash of its bytes. A missing required key is an error before any row is given out;
    keys are counted where the files are read."""
    text = spark.read.text(path, wholetext=True)
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    found = text.agg(F.count("*").alias("files"), *(F.count_if(~F.array_contains(keys, k)).alias(f"lacks_{i}") for i, k in enumerate(required))).first()
    if not found["files"]:
        raise ValueError(f"no contract at {path}")
    missing = [k for i, k in enumerate(required) if found[f"lacks_{i}"]]
    if missing:
        raise ValueError(f"contract lacks {', '.join(missing)}")
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("c"), F.sha2("value", 256).alias("contract_hash")).select("c.*", "contract_hash")


def write_contract(sections: dict[str, DataFrame], path: str, metadata: DataFrame) -> None:
    """Each section as Parquet under its name, and one row of metadata with the time of writing; doubles are made safe for JSON."""
    for name, df in (sections | {"metadata": metadata.withColumn("written_at", F.current_timestamp())}).items():
        safe = {f.name: json_safe(F.col(f.name)).alias(f.name) for f in df.schema if f.dataType.typeName() in ("double", "float")}
        df.withColumns(safe).write.mode("overwrite").parquet(f"{path}/{name}")


def as_json(df: DataFrame) -> DataFrame:
    """One column `value`: each row as JSON, for text sinks."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_null_tables(df: DataFrame, path: str) -> None:
    """Null distributions, by language and length, so that a lookup reads one folder."""
    df.write.mode("overwrite").partitionBy("lang", "len").parquet(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A table at `path`, made and written if it isn't there. The path should name a hash of what the table is made from."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(store, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pool_hash(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """A hash over a pool's strings, whatever their order: sums of two hashes, so that no list of a pool is held."""
    h = F.xxhash64(text)
    return df.groupBy(*by).agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))), 256).alias("pool_hash"))


@dataclass(frozen=True)
class Settings:
    """What runs are set by; unknown keys are an error, as is anything but a mapping."""

    alpha: float = 0.05
    min_sign_frequency: int = 15
    bootstrap: int = 1000
    min_suffix_frequency: int = 3
    min_suffix_stems: int = 2
    max_suffix_length: int = 3
    segmentation_method: str = "suffix_strip"
    clustering_method: str = "spectral"
    bias_correction: str = "none"
    fixed_threshold: float = 0.2
    variable_threshold: float = 0.05
    match_threshold: float = 0.5
    min_stratum_size: int = 5
    seed: int = 1234


def settings(values: dict) -> Settings:
    if not isinstance(values, dict):
        raise ValueError("settings are a mapping")
    unknown = set(values) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    found = Settings(**values)
    if found.segmentation_method not in ("suffix_strip", "bpe") or found.clustering_method not in ("spectral", "agglomerative") or found.bias_correction not in ("none", "freq_norm", "grid_prior"):
        raise ValueError("unknown method")
    return found


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags; white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
