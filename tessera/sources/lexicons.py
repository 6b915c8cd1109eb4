"""Tables of words in TSV: candidate lexicons, glosses, results of other runs, results to check against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import sound_classes

LEXICON = "Word string, IPA string, SCA string, Source string, Concept_ID string, Cognate_Set_ID string"


def lexicons(spark: SparkSession, path: str, most: int = 0, seed: str = "sample") -> DataFrame:
    """{lang}.tsv files -> lang, word, ipa, sca, gloss, source. Rows without word or IPA go; of one IPA the first row stays; at most
    `most` a language (0: all), by hash."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="").select("*", F.regexp_extract("_metadata.file_name", r"^(.*)\.tsv$", 1).alias("lang"), F.monotonically_increasing_id().alias("_row"))
    for name in ("Word", "IPA", "Source", "Concept_ID"):
        rows = rows.withColumn(name, F.trim(name)) if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.where("Word <> '' AND IPA <> ''")
    first = F.row_number().over(Window.partitionBy("lang", "IPA").orderBy("_row"))
    rows = rows.withColumn("_first", first).where("_first = 1")
    if most:
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "IPA")), "IPA"))).where(F.col("_rank") <= most)
    gloss = F.when(~F.coalesce("Concept_ID", F.lit("")).isin("", "-"), F.lower("Concept_ID"))
    return rows.select("lang", F.col("Word").alias("word"), F.col("IPA").alias("ipa"), sound_classes(F.col("IPA")).alias("sca"), gloss.alias("gloss"), F.col("Source").alias("source"))


def glosses(spark: SparkSession, path: str) -> DataFrame:
    """Commented TSV files named for their language -> lang, word, translation; the last row of a word counts."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", quote="").select("word", "translation", F.regexp_extract("_metadata.file_name", r"([a-z]+)_glosses\.tsv$", 1).alias("lang"), F.monotonically_increasing_id().alias("_row"))
    return rows.where("word IS NOT NULL").groupBy("lang", "word").agg(F.max_by("translation", "_row").alias("translation"))


def top_matches(text):
    """'word (score); word (score)' -> an array of structs; pieces without a number go."""
    pieces = F.transform(F.split(text, ";"), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.*)\(([^)]+)\)\s*$", 1)).alias("word"), F.regexp_extract(p, r"\(([^)]+)\)\s*$", 1).try_cast("double").alias("score")))
    return F.filter(pieces, lambda p: p["score"].isNotNull())


def fleet_results(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """Files of matches by language -> lang, signs, ipa, matched_word, score, per_char, top3; rows with a bad score go."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="").select("*", F.regexp_extract("_metadata.file_name", r"_vs_(.+)_clean\.tsv$", 1).alias("lang"))
    rows = rows.where(F.col("lang").isin(languages)) if languages is not None else rows
    rows = rows.withColumn("score", F.col("score").try_cast("double")).withColumn("ipa_length", F.col("ipa_length").try_cast("int")).where("score IS NOT NULL")
    per_char = F.when(F.col("ipa_length") > 0, F.col("score") / F.col("ipa_length")).otherwise(F.col("score"))
    return rows.select("lang", F.col("linear_a_signs").alias("signs"), F.col("linear_a_ipa").alias("ipa"), "matched_word", "score", per_char.alias("per_char"), top_matches(F.col("top3_matches")).alias("top3"))


def result_pairs(spark: SparkSession, path: str) -> DataFrame:
    """cognate_list.tsv files below machine/.../pair folders -> pair, lost, known, score; of several machines the last counts."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "cognate_list.tsv").csv(path, sep="\t", header=True, quote="")
    rows = rows.select("*", F.split("_metadata.file_path", "/").alias("_at")).withColumn("pair", F.element_at("_at", -2)).withColumn("machine", F.element_at("_at", -5))
    last = rows.groupBy("pair").agg(F.max("machine").alias("_last"))  # a row a pair, so that no pair lies in one task
    rows = rows.join(F.broadcast(last), "pair", "left").where("machine = _last OR machine IS NULL")
    return rows.select("pair", "lost", F.col("top1_known").alias("known"), F.col("score").try_cast("double").alias("score"))
