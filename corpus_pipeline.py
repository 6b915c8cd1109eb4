"""From raw documents to packed sequences: each stage reads what the last one kept, written as Parquet in between.

All stages but the last return the columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, pii, simhash, toxicity
from tessera.llm.queries import vocabulary
from tessera.llm.shared import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the segments' model calls toxic, above the score that it chose on documents outside its fit. It learns
    from the labels whose fold is not 0."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(fold != 0))
    return toxicity.score(docs, model).where(F.col("score") <= model.cut).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id."""
    return simhash.one_of_each(docs, radius=3, width=3)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in angle brackets."""
    found = pii.with_spans(docs, pii.fit(docs.select("doc_id", "text")))
    found = found.select("row", pii.redacted("spans").alias("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=1)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("pii", redact), ("mixing", mix_sources), ("packing", pack)]
#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
