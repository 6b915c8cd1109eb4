"""Importance resampling towards a target distribution, over hashed runs of one and two words.

Identical texts are collapsed by grouping the full text: features are computed once a text, its counts are multiplied by the
number of its copies, and its weight is computed once and joined back before each document gets noise of its own. The draw is
the top of all scores (weight plus Gumbel noise), ranked by ranges of the sorted scores, so no task ranks all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import small_or_not, stored

#: Words of texts whose letters A-Z are lower-cased: what is neither ASCII nor a digit or small letter separates nothing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A text of more copies meets its documents by broadcast (if such texts are counted to be few), so that its key is in no one task.
MANY = 500


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int" if buckets > 1 << 15 else "smallint")


def text_features(docs: DataFrame, buckets: int, text_col: str = "text") -> DataFrame:
    """digest, copies, n_words and buckets (one for each run of one or two words), a stored row for each different text; null is empty."""
    texts = docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("t")).agg(F.count("*").alias("copies"))
    words = F.regexp_extract_all(F.translate("t", _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    texts = texts.select(F.unhex(F.sha2("t", 256)).alias("digest"), "copies", words.alias("words"))
    less = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, less), F.slice("words", 2, less), lambda a, b: bucket(F.concat_ws(" ", a, b), buckets))
    own = F.concat(F.transform("words", lambda w: bucket(w, buckets)), pairs)
    return stored(texts.select("digest", "copies", F.size("words").cast("long").alias("n_words"), own.alias("buckets")), "importance-features")


def _counts(features: DataFrame) -> DataFrame:
    return features.select(F.explode("buckets").alias("bucket"), "copies").groupBy("bucket").agg(F.sum("copies").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> np.ndarray:
    """For each bucket the floored, scaled log-ratio of its smoothed shares in the target's and the source's features. What comes
    to the driver is two counts a bucket, whatever the input."""
    held = np.zeros((2, buckets), np.int64)
    for side, features in enumerate((source, target)):
        for b, n in _counts(features).collect():
            held[side, b] = n
    (s, t), (s_all, t_all) = held.astype(float), held.sum(axis=1).astype(float)
    return np.floor(scale * np.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))).astype(np.int64)


def text_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, copies, n_words, n_features and weight (floored mean of the gains; 0 for a text without words)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["buckets"]
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch["digest"], batch["copies"], batch["n_words"], pa.array(n), pa.array(weight)], names=["digest", "copies", "n_words", "n_features", "weight"])

    return stored(features.mapInArrow(weigh, "digest binary, copies long, n_words long, n_features long, weight long"), "importance-weights")


def noise(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """Scaled, floored Gumbel noise from a hash of seed and id; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _weighed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows (id, digest) with their text's n_words, n_features and weight. Texts of many copies, of which there are at most the
    documents through MANY, go by broadcast if counted to be few; the rest, at most MANY rows a key, by the digest."""
    columns = ["n_words", "n_features", "weight"]
    many = weights.where(F.col("copies") > MANY).select("digest", *columns)
    marked = rows.join(small_or_not(many), "digest", "left")
    rest = marked.where("weight IS NULL").drop(*columns).join(weights.where(F.col("copies") <= MANY).select("digest", *columns), "digest")
    return marked.where("weight IS NOT NULL").unionByName(rest).drop("digest")


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with place, from 1 on, by score (highest first), id, weight and n_features. Rows are sorted by ranges over all tasks;
    a range's rows start after those of the ranges before, of which there are as many as tasks."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    ranged = stored(ranged.select("*", F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("at")), "importance-ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    ahead = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("ahead"))
    return ranged.join(F.broadcast(ahead), "part").select("id", "n_features", "weight", "score", (F.col("ahead") + F.col("at") + 1).alias("place"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, share: tuple[int, int] = (25, 100), least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank, a row for each row of docs; rank is null where the row isn't drawn.

    Of the rows with least_words words, share (a fraction, floored) of highest score is drawn, ties to the smaller id. A null text
    is empty: no features, weight 0. A null id is hashed as an empty one and comes last among ties; rows that repeat an id share its
    noise, and among ties the higher weight, then more features come first, so rows that agree in all may swap.
    An empty target gives each bucket its smoothed share alone; an empty docs an empty result.
    """
    features = text_features(docs, buckets, text_col)
    weights = text_weights(features, gains(features, text_features(target, buckets, target_col), buckets))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    rows = _weighed(rows, weights).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    rows = stored(rows, "importance-scores")
    eligible = rows.where(F.col("n_words") >= least_words)
    drawn = share[0] * eligible.count() // share[1]
    out = ["id AS doc_id", "n_features", "weight", "score"]
    ranks = _ranked(eligible).selectExpr(*out, f"CASE WHEN place <= {drawn} THEN place END AS rank")
    return ranks.unionByName(rows.where(F.col("n_words") < least_words).selectExpr(*out, "CAST(NULL AS BIGINT) AS rank"))
