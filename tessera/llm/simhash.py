"""SimHash near-duplicates through covering locality-sensitive hashing.

For radius r every bit position i gets a vector m(i) of r + 1 bits, and every non-zero vector v of r + 1 bits makes a mask of the
positions where <v, m(i)> is odd. Whatever r positions two fingerprints differ in, some v is orthogonal to all of their m(i):
under that mask they are equal. So each pair within the radius meets in at least one of 2^(r+1) - 1 tables; none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import small_or_not, stored, with_group

RADIUS = 3
#: Fingerprints of one bucket that a task takes together; a larger bucket is split, each pair of its parts a task's group.
PART = 4096


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks as unsigned numbers; the vectors m(i) are dealt in turn, so masks have about half the bits."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if (v & (i % n + 1)).bit_count() & 1) for v in range(1, n + 1)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned; a bit is set if it is in over half the shingles' XXH64 (seed 42)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and exactly the contract's white space
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - width + 1)
    stops = ends[width - 1 :].tolist() if len(words) >= width else [len(line)]
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n], stops, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep_hash: bool = False) -> DataFrame:
    """doc_id and fp (the unsigned fingerprint's bits as a long), a row for each row of docs; null and wordless texts have 0.

    keep_hash: also th, a hash of the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(fps)], names=["doc_id", "th", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    found = rows.mapInArrow(make, "doc_id long, th long, fp long")
    return found if keep_hash else found.drop("th")


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; as unsigned numbers, for those of a negative one are counted by its absolute value."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of at most `radius` differing bits connect: each fingerprint to its group's smallest."""
    a, b, left = [], [], fps
    while len(left):
        group, waiting, left = [left[0]], [left[0]], left[1:]
        while waiting and len(left):
            near = _differ(left, waiting.pop()) <= radius
            if near.any():
                group += list(left[near])
                waiting += list(left[near])
                left = left[~near]
        if len(group) > 1:
            least = min(group)
            a += [x for x in group if x != least]
            b += [least] * (len(group) - 1)
    return np.array(a, np.int64), np.array(b, np.int64)


def near_edges(distinct: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """distinct: fp -> edges a, b of a graph with the same components as all links within the radius.

    Buckets of one fingerprint drop out by a count. A bucket of more than `part` is dealt into parts by a hash, and every pair
    of parts is a group of its own: exact, and no task holds more than about two parts. Within a group each fingerprint that
    gets connected leaves the search, and only a star is emitted, never all pairs.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)))
    rows = distinct.select("fp", F.explode(keys).alias("at")).select("fp", "at.t", "at.k")
    buckets = stored(rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    rows = rows.join(small_or_not(buckets), ["t", "k"]).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.where("parts = 1 OR other <> mine OR parts = 2 AND mine = 0").select("t", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    group = ["t", "k", "i", "j"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                now = np.column_stack([batch[c].to_numpy().astype(np.int64) for c in (*group, "fp")]) if batch.num_rows else np.empty((0, 5), np.int64)
                held = now if held is None else np.concatenate([held, now])
            if held is None or not len(held):
                continue
            cuts = np.flatnonzero((held[1:, :4] != held[:-1, :4]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), len(held)]
            whole = len(bounds) - 1 if batch is None else len(bounds) - 2  # the last group may go on
            fps, a, b = held[:, 4], [], []
            for x, y in zip(bounds[:whole], bounds[1 : whole + 1], strict=True):
                if y - x == 2:
                    if _differ(fps[x : x + 1], fps[x + 1 : x + 2])[0] <= radius:
                        a.append(fps[x : x + 1])
                        b.append(fps[x + 1 : x + 2])
                elif y - x > 2:
                    p, q = stars(fps[x:y], radius)
                    a.append(p)
                    b.append(q)
            held = held[bounds[whole] :]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(link, "a long, b long").distinct()


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _grouped(fps: DataFrame, radius: int) -> DataFrame:
    """fps: doc_id, fp, ... (stored) -> fp, root (one fingerprint of the group) and component_id."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(near_edges(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    named = stored(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    groups = stored(named.groupBy("root").agg(F.min("least").alias("c"), F.count("*").alias("n")).where("n > 1"), "simhash-least")
    of_group = F.when(F.col("n").isNotNull(), F.col("c")).otherwise(F.col("least"))
    return with_group(named, groups, "root", ("fp",)).select("fp", "root", of_group.alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable by links), a row for each row of docs.

    Copies share a fingerprint and are linked through it; only distinct fingerprints are searched. Null ids are never a
    component's name unless all of its ids are null.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    return fps.join(_grouped(fps, radius).drop("root"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = 3) -> DataFrame:
    """The rows of docs (doc_id, text and any others), of each group of near-duplicates the one of least id.

    A null id comes last; among rows of one id a hash of the text decides, and of rows that agree in both one stays. What goes
    is known by id and hash, and is broadcast if counted to be few; the texts themselves are not shuffled then.
    """
    fps = fingerprints(docs.select("doc_id", "text"), width=width, keep_hash=True)
    fps = stored(fps, "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("th"))
    roots = stored(_grouped(fps, radius).select("fp", "root"), "simhash-groups")
    rows = stored(fps.join(roots, "fp").groupBy("root", "doc_id", "th").agg(F.count("*").alias("n")), "simhash-rows")
    best = stored(rows.groupBy("root").agg(F.min(first).alias("best"), F.count("*").alias("rows")).where("rows > 1"), "simhash-best")
    stays = F.when(F.col("rows").isNotNull(), first.eqNullSafe(F.col("best"))).otherwise(True)
    judged = stored(with_group(rows, best, "root", ("doc_id", "th")).select("doc_id", "th", "n", stays.alias("stays")), "simhash-judged")
    gone = judged.where("NOT stays OR n > 1").select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), "stays")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    same = F.col("id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th"))
    marked = rows.join(small_or_not(gone), same, "left")
    once = marked.where("stays").dropDuplicates(["id", "th"])  # rows that repeat id and text
    return marked.where("stays IS NULL").select("row").unionByName(once.select("row")).select("row.*")
