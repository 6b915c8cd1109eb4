"""Exact tails and other statistics as column expressions, without any Python at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.dialect import SPARK


def binomial_upper(k: str, n: str, p: str) -> Column:
    """P(X >= k); the arguments are SQL expressions."""
    return F.expr(SPARK.binom_upper(k, n, p))


def binomial_lower(k: str, n: str, p: str) -> Column:
    return F.expr(SPARK.binom_lower(k, n, p))


def binomial_two_sided(k: str, n: str) -> Column:
    """Against one half."""
    return F.expr(SPARK.binom_two_sided_half(k, n))


def poisson_upper(k: str, rate: str) -> Column:
    return F.expr(SPARK.poisson_upper(k, rate))


def fisher_greater(a: str, row: str, col: str, n: str) -> Column:
    """One-sided exact test of a table with a in the corner and the two margins."""
    low, high = SPARK.fisher_range(a, row, col, n)
    term = SPARK.fisher_term("i", row, col, n)
    return F.expr(f"CASE WHEN ({a}) <= 0 THEN 1D WHEN ({high}) < ({low}) THEN 0D ELSE least(1D, aggregate(sequence({low}, {high}), 0D, (s, i) -> s + {term})) END")


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds q_value: within `by`, the least p * m / rank from a row's rank up, at most 1. keys break ties of p."""
    by = by or []
    up = Window.partitionBy(*by).orderBy(F.col(p), *keys)
    down = Window.partitionBy(*by).orderBy(F.col(p).desc(), *(F.col(k).desc() for k in keys)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumn("_rank", F.row_number().over(up)).withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    return ranked.withColumn("q_value", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the index of two label columns, from their counts; 0 where it is undefined."""
    pairs = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("i"), F.sum("n").alias("t"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("rb"))
    one = both.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))  # one row each
    chance = F.col("ra") * F.col("rb") / pairs(F.col("t"))
    middle = (F.col("ra") + F.col("rb")) / 2
    return one.select(F.coalesce(F.when(middle != chance, (F.col("i") - chance) / (middle - chance)), F.lit(0.0)).alias("ari"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: n1, n2, u and z (normal, uncorrected) of the rows where `first` holds against the others; ties share ranks."""
    w = Window.orderBy(value)
    rank = F.rank().over(w) + (F.count("*").over(Window.partitionBy(value)) - 1) / 2
    r = df.select(first.alias("f"), rank.alias("r"))
    agg = r.agg(F.count_if("f").alias("n1"), F.count_if(~F.col("f")).alias("n2"), F.sum(F.when(F.col("f"), F.col("r"))).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n1, n2 = F.col("n1"), F.col("n2")
    return agg.select("n1", "n2", u.alias("u"), ((u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"))


def cohens_d(within: Column, value: Column) -> Column:
    """An aggregate: difference of means over the pooled population deviation."""
    inside, outside = F.when(within, value), F.when(~within, value)
    return (F.avg(outside) - F.avg(inside)) / F.sqrt((F.var_pop(inside) + F.var_pop(outside)) / 2)
