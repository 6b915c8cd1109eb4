"""Operators over sequences of signs: n-grams, contexts, runs, pattern search, splits, chains. All are DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ngrams(df: DataFrame, signs: str, n: int = 2) -> DataFrame:
    """A row for each run of n neighbours in an array: its offset and `gram`."""
    runs = F.when(F.size(signs) >= n, F.transform(F.sequence(F.lit(1), F.size(signs) - n + 1), lambda i: F.slice(signs, i, n)))
    return df.select("*", F.posexplode(runs).alias("offset", "gram"))


def contexts(df: DataFrame, item: str, by: list[str], order: str) -> DataFrame:
    """Left and right neighbours within a container, with sentinels at its ends."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("left", F.coalesce(F.lag(item).over(w), F.lit("<BOS>"))).withColumn("right", F.coalesce(F.lead(item).over(w), F.lit("<EOS>")))


def neighbour_counts(words: DataFrame, by: list[str]) -> DataFrame:
    """Of distinct words (by, word, freq): by, sign, c, v: how often a sign has which neighbour, as 'L:' or 'R:' and the sign or sentinel.

    A word's letters stay one array, so neighbours cost neither a sort nor a shuffle; only the counts are dealt by key."""
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    rows = words.select(*by, "freq", letters.alias("s")).where(F.size("s") > 0).withColumn("p", F.concat(F.array(F.lit("<BOS>")), "s", F.array(F.lit("<EOS>"))))
    near = F.transform("s", lambda x, i: F.array(F.struct(x.alias("sign"), F.concat(F.lit("L:"), F.col("p")[i]).alias("c")), F.struct(x.alias("sign"), F.concat(F.lit("R:"), F.col("p")[i + 2]).alias("c"))))
    return rows.select(*by, "freq", F.explode(F.flatten(near)).alias("n")).groupBy(*by, "n.sign", "n.c").agg(F.sum("freq").cast("double").alias("v"))


def runs(df: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Contiguous positions as one row: first, last, n, the sum of the values that are known (null if none is) and whether one is not.
    Rows are those that belong to runs."""
    island = F.col(position) - F.row_number().over(Window.partitionBy(*by).orderBy(position))
    grouped = df.withColumn("_island", island).groupBy(*by, "_island")
    return grouped.agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"), F.sum(value).alias("total"), F.bool_or(F.col(value).isNull()).alias("unparsed")).drop("_island")


def find_all(signs: Column, target: Column) -> Column:
    """0-based offsets at which an array holds another as a contiguous run; none for an empty target."""
    n = F.size(target)
    places = F.sequence(F.lit(0), F.size(signs) - n)
    return F.when((n > 0) & (F.size(signs) >= n), F.filter(places, lambda i: F.slice(signs, i + 1, n) == target)).otherwise(F.array().cast("array<int>"))


def splits(df: DataFrame, word: str, longest: int = 3) -> DataFrame:
    """Every split of a word into stem and suffix of one to `longest` signs; the stem keeps at least one."""
    n = F.length(word)
    out = df.where(n >= 2).select("*", F.explode(F.sequence(F.lit(1), F.least(n - 1, F.lit(longest)))).alias("k"))
    n, k = F.length(word), F.col("k")
    return out.withColumn("stem", F.substring(F.col(word), F.lit(1), n - k)).withColumn("suffix", F.substring(F.col(word), n - k + 1, k))


def cut_where(signs: Column, joined: Column) -> Column:
    """An array cut between neighbours whose pair ('a b') is not in the array `joined`: an array of arrays."""
    empty = F.array().cast("array<array<string>>")

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        together = (F.size(done) > 0) & F.array_contains(joined, F.concat(F.element_at(last, -1), F.lit(" "), s))
        return F.when(F.size(done) == 0, F.array(F.array(s))).when(together, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.array(s))))).otherwise(F.concat(done, F.array(F.array(s))))

    return F.aggregate(signs, empty, step)


def chains(df: DataFrame, key: str, by: list[str], shortest: int = 1) -> DataFrame:
    """Adds root: the shortest key of the same group that begins this one (itself at the least). One join, no recursion."""
    keys = df.select(*by, F.col(key).alias("_root")).distinct()
    prefixes = df.select(*by, key).distinct().where(F.length(key) >= shortest)
    prefixes = prefixes.select(*by, key, F.explode(F.transform(F.sequence(F.lit(shortest), F.length(key)), lambda i: F.substring(F.col(key), F.lit(1), i))).alias("_root"))
    roots = prefixes.join(keys, [*by, "_root"]).groupBy(*by, key).agg(F.min_by("_root", F.length("_root")).alias("root"))
    return df.join(roots, [*by, key])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; Catalyst limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def min_max(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds scaled: 0 to 1 within a group; a single row 1, no spread one half."""
    w = Window.partitionBy(*by)
    lo, hi, n = F.min(value).over(w), F.max(value).over(w), F.count("*").over(w)
    return df.withColumn("scaled", F.when(n == 1, 1.0).when(hi == lo, 0.5).otherwise((F.col(value) - lo) / (hi - lo)))


def cumulative_min(df: DataFrame, value: str, order: list[Column], by: list[str]) -> DataFrame:
    return df.withColumn("running_min", F.min(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
