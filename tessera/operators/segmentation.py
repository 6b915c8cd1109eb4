"""Words into stem and suffix: the longest suffix that enough stems share and whose boundary is not a pair of signs that belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequences import ngrams, splits


def suffixes(words: DataFrame, longest: int = 3) -> DataFrame:
    """lang, suffix, stems, freq over every split of distinct words (lang, word, freq)."""
    return splits(words, "word", longest).groupBy("lang", "suffix").agg(F.count_distinct("stem").alias("stems"), F.sum("freq").alias("freq"))


def bound_pairs(words: DataFrame, times: float = 10.0) -> DataFrame:
    """lang, x, y: neighbouring signs seen more than `times` as often as chance has it."""
    letters = words.select("lang", "freq", F.filter(F.split("word", ""), lambda c: c != "").alias("letters"))
    pairs = ngrams(letters, "letters", 2).select("lang", F.col("gram")[0].alias("x"), F.col("gram")[1].alias("y"), "freq")
    pairs = pairs.groupBy("lang", "x", "y").agg(F.sum("freq").cast("double").alias("k"))
    total = lambda *by: F.sum("k").over(Window.partitionBy(*by))  # noqa: E731  at most the pairs of an alphabet
    often = F.col("k") * total("lang") > times * total("lang", "x") * total("lang", "y")
    return pairs.select("lang", "x", "y", often.alias("often")).where("often").drop("often")


def segment(words: DataFrame, longest: int = 3, least_freq: int = 3, least_stems: int = 2) -> DataFrame:
    """lang, word, freq, stem, suffix ('' where none is valid) for distinct words of two signs or more."""
    valid = suffixes(words, longest).where((F.col("freq") >= least_freq) & (F.col("stems") >= least_stems)).select("lang", "suffix")
    cuts = splits(words, "word", longest).join(valid, ["lang", "suffix"], "left_semi")
    edge = cuts.withColumn("x", F.substring("stem", -1, 1)).withColumn("y", F.substring("suffix", 1, 1))
    legal = edge.join(bound_pairs(words), ["lang", "x", "y"], "left_anti")
    best = legal.groupBy("lang", "word").agg(F.max_by(F.struct("stem", "suffix"), "k").alias("cut"))
    return words.join(best, ["lang", "word"], "left").select("lang", "word", "freq", F.coalesce("cut.stem", "word").alias("stem"), F.coalesce("cut.suffix", F.lit("")).alias("suffix"))
