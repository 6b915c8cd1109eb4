"""An extension beyond the batch queries: signs and events counted as they arrive, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sign_counts(words: DataFrame, time: str, word: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Occurrences of letters by place in tumbling windows; works on a stream and on a table alike."""
    letters = F.filter(F.split(F.col(word), ""), lambda x: x != "")
    rows = words.withWatermark(time, late).select(F.window(time, window).alias("window"), F.size(letters).alias("n"), F.posexplode(letters).alias("p", "sign"))
    place = F.when(F.col("p") == 0, "initial").when(F.col("p") == F.col("n") - 1, "final").otherwise("medial")
    return rows.groupBy("window", "sign", place.alias("place")).count()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of each type and their values in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
