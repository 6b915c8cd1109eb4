"""How well labels agree with a known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def agreement(pairs: DataFrame, by: list[str], label: str, truth: str) -> DataFrame:
    """pairs: a row for each item with both -> a row for each label of each group: items, majority (the commonest truth, the first in order among equals),
    agreeing, rate, classes (truths in it; it merges them if over one), split (of these, how many stand under other labels too) and
    ari, the group's adjusted Rand index (0 where it is not defined). Rows without a label or truth are left out."""
    pairs = pairs.where(F.col(label).isNotNull() & F.col(truth).isNotNull())
    cells = pairs.groupBy(*by, label, truth).agg(F.count("*").alias("n"))
    group, of_truth = Window.partitionBy(*by), Window.partitionBy(*by, truth)
    cells = cells.withColumn("labels", F.count("*").over(of_truth)).withColumn("of_truth", F.sum("n").over(of_truth)).withColumn("of_label", F.sum("n").over(Window.partitionBy(*by, label)))
    two = lambda n: F.col(n) * (F.col(n) - 1) / 2
    # a marginal's pairs once: its share of each of its cells adds up to it
    once = lambda total: F.sum(two(total) * F.col("n") / F.col(total)).over(group)
    cells = cells.withColumns({"both": F.sum(two("n")).over(group), "a": once("of_label"), "b": once("of_truth"), "items": F.sum("n").over(group)})
    expected, most = F.col("a") * F.col("b") / F.greatest(two("items"), F.lit(1)), (F.col("a") + F.col("b")) / 2
    cells = cells.withColumn("ari", F.when(F.abs(most - expected) < 1e-12, 0.0).otherwise((F.col("both") - expected) / (most - expected)))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(truth).alias("truth")))
    found = cells.groupBy(*by, label).agg(F.sum("n").alias("items"), best.alias("best"), F.count("*").alias("classes"), F.count_if(F.col("labels") > 1).alias("split"), F.max("ari").alias("ari"))
    agreeing = -F.col("best.k")
    return found.select(*by, label, "items", F.col("best.truth").alias("majority"), agreeing.alias("agreeing"), F.round(agreeing / F.col("items"), 6).alias("rate"), "classes", (F.col("classes") > 1).alias("merged"), "split", F.round("ari", 6).alias("ari"))


def bridge(inventory: DataFrame, anchors: DataFrame) -> DataFrame:
    """inventory: reading, codes (an array); anchors: reading, value, nth -> code, value, reading, readings, contested: what an inventory's
    codes stand for, by way of the readings that are known.

    A code of several known readings takes the last one's value (the greatest nth, among equals the greatest reading); contested says
    that their values differ. Codes without a known reading, null codes and null readings have no row."""
    coded = inventory.where("reading IS NOT NULL").select("reading", F.explode("codes").alias("code")).where("code IS NOT NULL").distinct()
    known = coded.join(anchors.where("value IS NOT NULL"), "reading")
    last = F.max(F.struct("nth", "reading", "value"))
    found = known.groupBy("code").agg(last.alias("last"), F.countDistinct("reading").alias("readings"), F.countDistinct("value").alias("values"))
    return found.select("code", F.col("last.value").alias("value"), F.col("last.reading").alias("reading"), "readings", (F.col("values") > 1).alias("contested"))
