"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as sorted-string-table shards and read back."""
    from tessera.llm.sstable import read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the verdict by the frequency of lines within their source."""
    from tessera.llm.quality import LineLimits, line_quality

    return line_quality(table(spark, sf_dir, "documents"), LineLimits(documents=10, share=0.001, left=0.5, words=20))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    from tessera.llm.packing import Limits, pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1, limits=Limits(2048, 256, 2048))


def op4_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and group of near-duplicates."""
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=3, width=3)


def op5_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 200 bytes that start anywhere else."""
    from tessera.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged; a labelled page (by its number) is bad if its quality is 0."""
    from tessera.llm.reputation import Prior, Rule, judge

    rules = [Rule("com", "/en/", False), Rule("example.com", "/en/7", True), Rule("net", "/de/", True), Rule("example.net", "/de/8", False), Rule("org", "/es/", False)]
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", "CASE WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 0 END AS bad")
    return judge(table(spark, sf_dir, "pages"), labels, rules, Prior(z=1.645, threshold=0.5))


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: the base rules' spans and those that boosted trees add."""
    from tessera.llm.pii import Boost, fit, joined, with_spans

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, fit(docs, Boost(docs=12_000)))
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model learned from labels whose fold is not 0."""
    from tessera.llm.toxicity import Fit, score, train

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(fold != 0), Fit(docs=20_000))
    rows = score(docs, model).select("row.doc_id", "score", "predicted", "passages", "best_segment")
    return rows.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted", "passages", "best_segment")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2 by source."""
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op10_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links of cosine 0.95 or more and their group."""
    from tessera.llm.ego import similar_vectors

    return similar_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of which is made periodic by rule, with their runs: number, the one of most periods, and digests."""
    from tessera.llm.periodic import periodic_runs

    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("words"), F.expr("CAST(floor(crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) / 10) AS BIGINT)").alias("g"))
    docs = docs.withColumns({"n": F.size("words"), "a": F.col("g") % F.greatest(F.size("words"), F.lit(1))})
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(sequence(0, n - 1), i -> words[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    found = periodic_runs(docs.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text")))
    best = F.expr("reduce(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_onebit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for each one whose id is divisible by 20."""
    from tessera.llm.onebit import nearest_vectors

    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight towards the benchmark's features, and the quarter drawn by it."""
    from tessera.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, share=(25, 100), least_words=20, seed=7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
