"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, a cut at the exact budget.

Only DataFrame functions. The random key is uniform, so equal ranges of it are equal shares of a source: a source of n rows
has about sqrt(n) ranges of about sqrt(n) rows. Sums of the ranges, added up within their source, give each range its start;
a window within one range gives each row its own. No task holds a source, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import small_or_not, stored

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, size -> and target: share of all words, dealt by weight; no source above `most` times its size.

    Weights are dealt in turn to the sources in code point order, null last. What a source can't take is dealt again among the
    rest until none is above: then every source has the lesser of its most and one rate times its weight. With sources in
    order of most/weight the rate is found by running sums: those before are full, those from there on share what is left.
    """
    cap, all_rows = F.col("size") * F.lit(float(most)), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    df = sizes.withColumn("weight", w).withColumn("cap", cap).withColumn("full_at", cap / w)
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"full": F.sum("cap").over(order) - F.col("cap"), "spent": F.sum("weight").over(order) - F.col("weight"), "budget": F.lit(float(share)) * F.sum("size").over(all_rows), "weights": F.sum("weight").over(all_rows)})
    df = df.withColumn("rate_here", (F.col("budget") - F.col("full")) / (F.col("weights") - F.col("spent")))
    rate = F.max(F.when(F.col("rate_here") <= F.col("full_at"), F.col("rate_here"))).over(all_rows)
    return df.withColumn("rate", rate).select("source", "size", F.least("cap", F.coalesce(F.col("rate") * F.col("weight"), F.col("cap"))).alias("target"), "n_rows")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the row in the mix, repeats counted), a row for each row of docs.

    Each source takes its target rounded to a whole number: as many full rounds as fit, then a last round in hash-random order
    that ends within a document if need be. A null text has size 0; a null source is a source; rows with one id share a key
    and are then ordered by size, so rows that differ in nothing else may swap. The same input gives the same result.
    """
    text = F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key")), "mix-sizes")
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n_rows")), weights, share, most).withColumnRenamed("size", "source_size"), "mix-sources")

    ranges = F.ceil(F.sqrt(F.col("n_rows").cast("double"))).cast("long")
    of = sources.select(F.col("source").alias("s"), "source_size", "target", ranges.alias("ranges"))
    rows = rows.join(small_or_not(of), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = rows.withColumn("at", F.shiftright(F.shiftright("key", 28) * F.col("ranges"), 32))

    sums = rows.groupBy("source", "at").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = stored(sums.select(F.col("source").alias("s"), F.col("at").alias("a"), (F.sum("range_size").over(ahead) - F.col("range_size")).alias("range_start")), "mix-ranges")
    rows = rows.join(small_or_not(sums), F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")))

    within = Window.partitionBy("source", "at").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("range_start") + F.sum("size").over(within) - F.col("size")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    last = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), budget - rounds * F.col("source_size") - F.col("start")))
    return rows.withColumn("start", start).select("doc_id", "size", "source_size", "target", (rounds * F.col("size") + last).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text, source and any others) as often as the mix takes them; a last copy may be a text's first words.

    A row is known by its id and size; rows that agree in both share what they take evenly, the rest of the division going to some of
    them, a word each. n_chars follows the text.
    """
    taken = stored(mix(docs, **options).groupBy("doc_id", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).where("taken > 0"), "mix-taken")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), n_words(F.col("text")).alias("words"), F.col("text").alias("whole"))
    rows = rows.join(taken, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size")))
    alike = taken.where("n > 1")
    if alike.limit(1).count():  # only such rows are numbered
        nth = F.row_number().over(Window.partitionBy("id", "words").orderBy(F.xxhash64("whole")))
        rows = rows.where("n = 1").withColumn("nth", F.lit(1)).unionByName(rows.where("n > 1").withColumn("nth", nth))
    else:
        rows = rows.withColumn("nth", F.lit(1))
    share = F.floor(F.col("taken") / F.col("n")) + F.when(F.col("nth") <= F.col("taken") % F.col("n"), 1).otherwise(0)
    rows = rows.withColumn("share", share.cast("long")).where("share > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("share") / F.col("size")).cast("int"))))
    left = F.col("share") - (F.col("copy") - 1) * F.col("size")
    words = F.regexp_extract_all("whole", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    rows = rows.withColumn("cut", F.when(left >= F.col("size"), F.col("whole")).otherwise(F.array_join(F.slice(words, 1, left.cast("int")), "")))
    own = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return rows.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
