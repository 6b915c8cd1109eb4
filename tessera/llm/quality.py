"""Quality rules: cross-document line frequency, after base rules on single texts.

Lines are normalised (A-Z lower-cased, digits as 0, white space as one space, none at the ends) and hashed; for every host the
distinct documents of each line are counted; lines in too many are taken out, and documents left with too little are rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import small_or_not, stored

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIGIT = re.compile(r"[0-9]")
_UPPER_TO_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: What the contract calls white space between words.
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


@dataclass(frozen=True)
class LineLimits:
    """A line is taken out if at least `documents` of a host have it, and at least so `share` of the host's documents; a
    document is rejected if less than `left` of its words are left, or fewer than `words`."""

    documents: int = 10
    share: float = 0.001
    left: float = 0.5
    words: int = 20


def words_of(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


def repeated_words(words: list[str]) -> int:
    """Words within three-word windows that occur at least twice in the text, the first time included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, total, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def normal_line(line: str) -> str:
    return " ".join(words_of(_DIGIT.sub("0", line.translate(_UPPER_TO_LOWER))))


_BASE = "doc_id long, host string, doc_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,n:long>>"


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch, cols = whole.slice(at, 500), ([], [], [], [], [], [])
            for text in batch["text"].to_pylist():
                text = text or ""
                lines = [(s, ws) for s in text.split("\n") if (ws := words_of(s))]
                words = [w for _, ws in lines for w in ws]
                n_by_line: dict[int, int] = {}
                for s, ws in lines:
                    h = xxhash.xxh64_intdigest(normal_line(s)) - (1 << 63)
                    n_by_line[h] = n_by_line.get(h, 0) + len(ws)
                values = len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len({s for s, _ in lines}), repeated_words(words)
                for c, v in zip(cols, (*values, [{"h": h, "n": n} for h, n in n_by_line.items()]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "host", "doc_key")), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], kind)], names=[c.split()[0] for c in _BASE.split(", ")])


def line_quality(docs: DataFrame, limits: LineLimits | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, and words_left after the frequent lines are taken out.

    A null text has no words and fails; a null host is a host. Rows that repeat id, host and text are one document in the
    counts and each get its result. Lines are counted with partial sums in each task, so a line that every document has is
    no hot key; the (few) frequent lines are broadcast if counted to be few, else joined by shuffle.
    """
    limits = limits or LineLimits()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    rows = rows.withColumn("doc_key", F.xxhash64("doc_id", "host", "text"))
    base = stored(rows.mapInArrow(_base, _BASE), "line-base")

    one = base.select("host", "doc_key", "lines", "n_words")
    per_host = one.groupBy("host").agg(F.count_distinct("doc_key").alias("n_docs"))
    lines = one.select("host", "doc_key", F.explode("lines").alias("line")).select("host", "doc_key", "line.h", "line.n")
    # a hash kept from each document's key tells a line of one repeated document from one of several
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("rows"), F.min("doc_key").alias("a"), F.max("doc_key").alias("b"))
    often = stored(counts.where((F.col("rows") >= limits.documents) & (F.col("a") != F.col("b"))).select("host", "h"), "line-candidates")
    hit = stored(_on_line(lines, small_or_not(often)).select("host", "h", "doc_key", "n").distinct(), "line-hits")
    frequent = hit.groupBy("host", "h").agg(F.count("*").alias("n_line"))
    small_hosts = small_or_not(stored(per_host.withColumnRenamed("host", "of_host"), "line-hosts"))
    frequent = frequent.join(small_hosts, F.col("host").eqNullSafe(F.col("of_host"))).where((F.col("n_line") >= limits.documents) & (F.col("n_line") >= F.col("n_docs") * limits.share))
    taken = _on_line(hit, small_or_not(stored(frequent.select("host", "h"), "line-frequent"))).groupBy("doc_key").agg(F.sum("n").alias("taken"))

    left = F.col("n_words") - F.coalesce(F.col("taken"), F.lit(0))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    depleted = (left < F.col("n_words") * limits.left) | (left < limits.words)
    return base.drop("lines").join(taken, "doc_key", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), left.cast("long").alias("words_left"))


def _on_line(lines: DataFrame, which: DataFrame) -> DataFrame:
    which = which.select(F.col("host").alias("w_host"), F.col("h").alias("w_h"))
    return lines.join(which, F.col("host").eqNullSafe(F.col("w_host")) & (F.col("h") == F.col("w_h"))).drop("w_host", "w_h")
