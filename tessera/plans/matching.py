"""Kept tables of the nearest strings. They are built without common table expressions, as what is kept is found again by its plan, and
the numbers of those expressions differ from one query's plan to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.similarity import draw, nearest
from tessera.plans.vocabulary import ALPHABET, CLASSES, FIXED_SAMPLES, LETTERS, READINGS, SAMPLES


def _coded(words: DataFrame) -> DataFrame:
    """lang, word, sca, len of the plain words of word_table."""
    plain = words.where("n >= 2").where(F.col("word").rlike("^[a-z]+$"))
    return plain.select("lang", "word", F.translate("word", LETTERS, CLASSES).alias("sca")).withColumn("len", F.length("sca").cast("long"))


def queries_of(words: DataFrame) -> DataFrame:
    """sca, len: English class strings of four signs or more."""
    return _coded(words).where("lang = 'en' AND len >= 4").select("sca", "len").distinct()


def pool_of(words: DataFrame, cap: int | None = None) -> DataFrame:
    """lang, sca, len: the other languages' class strings; cap: at most so many of a language and length, those of least hash."""
    rows = _coded(words).where("lang <> 'en' AND len >= 2").select("lang", "sca", "len").distinct()
    if cap is None:
        return rows
    order = Window.partitionBy("lang", "len").orderBy(F.md5(F.col("sca").cast("binary")), "sca")
    return rows.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= cap).drop("rk")


def match_table(words: DataFrame, cap: int | None = None, most: int = 5) -> DataFrame:
    return nearest(queries_of(words), pool_of(words, cap), most)


def null_strings(lengths: DataFrame, samples: int, fixed: bool = False) -> DataFrame:
    """lengths: len -> len, r, fixed, sca: random strings of each length, their signs drawn by hash; fixed: with each class in turn first."""
    sign = lambda p: F.substring(F.lit(ALPHABET), (draw("null", F.col("len"), F.col("r"), p) % len(ALPHABET) + 1).cast("int"), F.lit(1))
    rows = lengths.select("len", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("r"))
    rows = rows.withColumn("sca", F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("len")), sign), ""))
    if not fixed:
        return rows.select("len", "r", F.lit(None).cast("string").alias("fixed"), "sca")
    rows = rows.withColumn("fixed", F.explode(F.array(*map(F.lit, ALPHABET))))
    return rows.select("len", "r", "fixed", F.concat("fixed", F.substring("sca", 2, 1 << 30)).alias("sca"))


def null_table(words: DataFrame, cap: int, fixed: bool = False) -> DataFrame:
    """lang, len, r, fixed, ned: how near each random string comes to a language's pool."""
    strings = null_strings(queries_of(words).select("len").distinct(), FIXED_SAMPLES if fixed else SAMPLES, fixed)
    found = nearest(strings.select("sca", "len").distinct(), pool_of(words, cap), most=1).select(F.col("q").alias("sca"), "lang", "ned")
    return strings.join(found, "sca").select("lang", "len", "r", "fixed", "ned")


def reading_table(words: DataFrame) -> DataFrame:
    """q, lang, ned: for the class string of every reading of an English word with unknown signs the nearest string of each language."""
    rows = words.where("lang = 'en' AND n >= 4").where(F.col("word").rlike("^[a-z]+$") & F.col("word").rlike("[wy]")).select(F.col("word").alias("reading"))
    for sign, readings in READINGS.items():
        options = F.when(F.contains("reading", F.lit(sign)), F.array(*map(F.lit, readings))).otherwise(F.array(F.lit(sign)))
        rows = rows.select("reading", F.explode(options).alias("to")).select(F.replace("reading", F.lit(sign), F.col("to")).alias("reading"))
    strings = rows.select(F.translate("reading", LETTERS, CLASSES).alias("sca")).distinct().withColumn("len", F.length("sca").cast("long"))
    return nearest(strings, pool_of(words), most=1).select("q", "lang", "ned")
