"""Removal of long repeated passages by an enhanced suffix array that is sampled, sorted and scanned in parallel.

Anchors. A rolling hash of k bytes is taken at every place; the least hash of every window of length - k + 1 places marks an anchor.
Two equal strings of `length` bytes hold an anchor at the same offset, so every repeat is found from a pair of anchors with one hash,
and anchors whose hash occurs once (nearly all) drop out by a count.

Suffix array. The rest carry their context: what precedes the anchor, reversed, and the `length` bytes from it on. Sorted by hash and
then by those bytes they are the part of the text's suffix array that lies at anchors; the common prefixes of neighbours are its
second table. A stack scan yields the interval tree: intervals of suffixes with a common prefix l. Left extensions are compared
within each interval: suffixes whose left contexts agree in at least length - l bytes, and further in some number of bytes, are a
repeat group with all its occurrences, maximal on both sides. Each occurrence gives a run of bytes that the repeat covers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import small_or_not, stored

#: Bytes that are hashed at once; contexts of one hash that a task scans together, beyond which its windows are counted one by one.
_CHUNK, GROUP = 1 << 20, 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_table = _powers(1 << 12)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Of every k bytes of data (uint8) a 64-bit hash of their content."""
    n = len(data)
    if n < k:
        return np.empty(0, np.uint64)
    global _table
    if n > len(_table[0]):
        _table = _powers(1 << int(n).bit_length())
    up, down = _table
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by doubling."""
    done, out = 1, h
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of one text."""
    places, hashes, w = [], [], length - k + 1
    for at in range(0, max(1, len(data) - length + 1), _CHUNK):
        h = gram_hashes(data[at : at + _CHUNK + length - 1], k)
        if len(h) < w:
            break
        least = window_least(h, w)
        # the least of the windows that start at i - w + 1 .. i: a place is an anchor if one of them has its hash as least
        most = np.zeros(len(h), np.uint64)
        top = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        most = ~window_least(~top, w)
        here = np.flatnonzero(most[: len(h)] == h)
        places.append(here + at)
        hashes.append(h[here])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    p, first = np.unique(p, return_index=True)
    return p, h[first].view(np.int64)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def repeat_runs(right: list[bytes], left: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Contexts of one anchor hash, sorted by right: for each, runs (from, to) of the bytes about its anchor that repeats cover.

    left holds what precedes the anchor, reversed.
    """
    n = len(right)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    prefix = [_common(right[i], right[i + 1]) for i in range(n - 1)]

    def maximal(i: int, j: int, shared: int) -> None:
        """The suffixes i..j share `shared` bytes: find those whose left contexts make it up to `length`."""
        need = length - shared
        if need > 0:
            order = sorted(range(i, j + 1), key=left.__getitem__)
            back = [_common(left[a], left[b]) for a, b in zip(order, order[1:], strict=False)]
        else:
            order, need = list(range(i, j + 1)), 0
            if j - i > 1:
                order.sort(key=left.__getitem__)
            back = [_common(left[a], left[b]) for a, b in zip(order, order[1:], strict=False)]
        for x, c in enumerate(order):
            most = max(back[x - 1] if x else -1, back[x] if x < len(back) else -1)
            if most >= need:
                runs[c].append((-most, shared))

    stack: list[tuple[int, int]] = []  # (common prefix, first suffix) of open intervals
    for i in range(n):
        shared, first = (prefix[i] if i < n - 1 else -1), i
        while stack and stack[-1][0] > shared:
            top, first = stack.pop()
            if first < i:
                maximal(first, i, top)
        if i < n - 1 and (not stack or stack[-1][0] < shared):
            stack.append((shared, first))
    return runs


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for t in batch[name]:
        yield t.as_py()


def _merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _hashes_at(text: bytes, places: np.ndarray, k: int) -> np.ndarray:
    """The hashes of the k bytes at these places, as anchors() gives them."""
    data = np.frombuffer(text, np.uint8)
    if len(places) * k > 8 * len(data):
        return gram_hashes(data, k)[places].view(np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(data, k)[places].astype(np.uint64) + np.uint64(1)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(k - 1, _BASE)]))
    return _mixed((grams * up).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _row(names: list[str], columns: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, length: int = 200, k: int = 50, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes), a row for each row of docs.

    Every byte goes that is covered by a string of `length` bytes that also starts anywhere else in docs as given. A null text is
    empty. Equal texts are known by 16 bytes of their SHA-256: of a text that occurs twice all goes (if long enough), and it is
    searched once. Equal contexts of one anchor hash are scanned once, too: they repeat in full, and share what the scan finds.
    Texts are read again where they are needed and never shuffled while what selects them is counted to be small.
    """
    if not 0 < k <= length:
        raise ValueError("0 < k <= length")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    rows = rows.withColumn("whole_sha", F.sha2("text", 256)).withColumn("sha", F.unhex(F.substring("whole_sha", 1, 32)))
    known = stored(rows.select("doc_id", "whole_sha", F.octet_length("text").cast("long").alias("n"), "sha"), "repeat-texts")
    copied = stored(known.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")).where("copies > 1"), "repeat-copies")
    # one row of each text (of rows with one text and id, each: that text goes anyway)
    one = rows.join(small_or_not(copied.select("sha", "least", F.lit(True).alias("again")), _IDS), "sha", "left")
    one = one.where(F.col("again").isNull() | F.col("doc_id").eqNullSafe(F.col("least"))).select("sha", "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(np.frombuffer(t, np.uint8), length, k) for t in _texts(batch)]
            ends = pa.array(np.cumsum([0, *(len(p) for p, _ in found)]).astype(np.int32))
            places = np.concatenate([*(p for p, _ in found), np.empty(0)]).astype(np.int32)
            hashes = np.concatenate([np.empty(0, np.int64), *(h for _, h in found)])
            yield _row(["sha", "places", "hashes"], [batch["sha"], *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (places, hashes))], [None] * 3)

    marked = stored(one.mapInArrow(mark, "sha binary, places array<int>, hashes array<long>"), "repeat-anchors")
    often = marked.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    at = marked.select("sha", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("sha", F.col("x.places").alias("place"), F.col("x.hashes").alias("hash"))
    hit = at.join(small_or_not(stored(often, "repeat-hashes"), _IDS), "hash", "left_semi")
    wanted = stored(hit.groupBy("sha").agg(F.array_distinct(F.collect_list("place")).alias("places")), "repeat-places")  # of one text

    before = length - k

    def parts(text: bytes, places: list[int]) -> tuple[list[bytes], list[bytes]]:
        return [text[max(0, i - before) : i][::-1] for i in places], [text[i : i + length] for i in places]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for sha, text, places in zip(*(batch[c].to_pylist() for c in ("sha", "text", "places")), strict=True):
                p = np.array(places, np.int32)
                near = [xxhash.xxh64_intdigest(text[max(0, i - before) : i + length], min(i, before)) - (1 << 63) for i in places]
                size = np.minimum(p, before), np.minimum(len(text) - p, length)
                yield _row(["hash", "digest", "sha", "place", "back", "ahead"], [_hashes_at(text, p, k), near, [sha] * len(p), p, *(x.astype(np.int32) for x in size)], [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()])

    contexts = stored(_with_places(one, wanted).mapInArrow(digest, "hash long, digest long, sha binary, place int, back int, ahead int"), "repeat-contexts")
    kinds = contexts.groupBy("hash", "digest").agg(F.count("*").alias("n"), F.min(F.struct("sha", "place")).alias("at"), F.max("back").alias("back"), F.max("ahead").alias("ahead"))
    kinds = stored(kinds, "repeat-kinds")
    several = stored(kinds.groupBy("hash").agg(F.count("*").alias("kinds")).where("kinds > 1"), "repeat-several")
    chosen = kinds.join(small_or_not(several, _IDS), "hash").select("hash", "digest", "kinds", "at.sha", "at.place")
    chosen = stored(chosen.groupBy("sha").agg(F.collect_list(F.struct("place", "hash", "digest", "kinds")).alias("places")), "repeat-chosen")

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, of in zip(batch["text"].to_pylist(), batch["places"].to_pylist(), strict=True):
                left, right = parts(text, [x["place"] for x in of])
                yield _row(["hash", "digest", "kinds", "left", "right"], [*([x[c] for x in of] for c in ("hash", "digest", "kinds")), left, right], [pa.int64()] * 3 + [pa.binary()] * 2)

    shown = _with_places(one, chosen).mapInArrow(context, "hash long, digest long, kinds long, left binary, right binary")
    found = _scanned(shown.where(F.col("kinds") <= group), length)
    if several.where(F.col("kinds") > group).limit(1).count():
        found = found.unionByName(_counted(shown.where(F.col("kinds") > group), length))
    twins = kinds.where((F.col("n") > 1) & (F.col("back") + F.col("ahead") >= length)).select("hash", "digest", (-F.col("back")).cast("long").alias("a"), F.col("ahead").cast("long").alias("b"))
    # all runs about one anchor hold the anchor, so together they are one run
    found = found.unionByName(twins).groupBy("hash", "digest").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    covered = contexts.join(stored(found, "repeat-found"), ["hash", "digest"]).select("sha", (F.col("place") + F.col("a")).alias("a"), (F.col("place") + F.col("b")).alias("b"))
    gone = stored(covered.groupBy("sha").agg(F.collect_set(F.struct("a", "b")).alias("places")), "repeat-runs")  # of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, text, of in zip(*(batch[c].to_pylist() for c in ("sha", "text", "places")), strict=True):
                merged, kept, last = _merged([(r["a"], r["b"]) for r in of]), [], 0
                for a, b in merged:
                    kept.append(text[last:a])
                    last = b
                rest = b"".join([*kept, text[last:]])
                yield _row(["sha", "removed", "spans", "kept_sha", "rest"], [[sha], [len(text) - len(rest)], [len(merged)], [hashlib.sha256(rest).hexdigest()], [rest if with_text else None]], [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()])

    partly = _with_places(one, gone).mapInArrow(cut, "sha binary, removed long, spans long, kept_sha string, rest binary").dropDuplicates(["sha"])
    whole = copied.select("sha", F.lit(True).alias("copied"))
    result = (rows.withColumn("n", F.octet_length("text").cast("long")) if with_text else known).join(whole, "sha", "left").join(partly, "sha", "left")
    all_gone = F.col("copied") & (F.col("n") >= length)
    pick = lambda full, part, none: F.when(all_gone, full).otherwise(F.coalesce(part, none))
    zero = F.lit(0).cast("long")
    columns = [F.col("doc_id"), F.col("n").alias("n_bytes"), pick(F.col("n"), F.col("removed"), zero).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("spans"), zero).alias("n_spans"), pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha"), F.col("whole_sha")).alias("kept_sha256")]
    if with_text:
        columns.append(pick(F.lit(b""), F.col("rest"), F.col("text")).alias("kept"))
    return result.select(*columns)


#: Rows of ids, and numbers in lists beside them, that are broadcast at most.
_IDS, _NUMBERS = 2_000_000, 8_000_000


def _with_places(one: DataFrame, places: DataFrame) -> DataFrame:
    """one: sha, text; places: sha, places (a list), a stored table. Broadcast if its lists are counted to be small."""
    n = places.agg(F.count("*"), F.sum(F.size("places"))).first()
    return one.join(F.broadcast(places) if n[0] <= _IDS and (n[1] or 0) <= _NUMBERS else places, "sha")


def _scanned(shown: DataFrame, length: int) -> DataFrame:
    """Contexts in suffix order -> hash, digest, a, b: runs of bytes about the anchor that repeat."""
    kinds = [pa.int64()] * 4

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, [], []

        def over() -> None:
            for (digest, _, _), runs in zip(held, repeat_runs([r[2] for r in held], [r[1] for r in held], length), strict=True):
                if runs:
                    out.append((current, digest, min(a for a, _ in runs), max(b for _, b in runs)))

        for batch in batches:
            for h, *r in zip(*(batch[c].to_pylist() for c in ("hash", "digest", "left", "right")), strict=True):
                if h != current:
                    over()
                    current, held = h, []
                held.append(r)
            if out:
                yield _row(["hash", "digest", "a", "b"], list(zip(*out, strict=True)), kinds)
                out = []
        over()
        yield _row(["hash", "digest", "a", "b"], list(zip(*out, strict=True)) or [[]] * 4, kinds)

    rows = shown.select("hash", "digest", "left", "right").repartition("hash").sortWithinPartitions("hash", "right", "left")
    return rows.mapInArrow(scan, "hash long, digest long, a long, b long")


def _counted(shown: DataFrame, length: int) -> DataFrame:
    """The same for hashes with very many different contexts, without holding them together: every window of `length` bytes
    about an anchor is hashed and counted by partial sums; windows of two contexts give a run each."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, digest, left, right in zip(*(batch[c].to_pylist() for c in ("hash", "digest", "left", "right")), strict=True):
                near = left[::-1] + right
                starts = range(max(0, len(near) - length + 1))
                hashed = [hashlib.sha256(near[s : s + length]).digest()[:16] for s in starts]
                yield _row(["hash", "digest", "a", "window"], [[h] * len(starts), [digest] * len(starts), [s - len(left) for s in starts], hashed], [pa.int64()] * 3 + [pa.binary()])

    rows = stored(shown.mapInArrow(windows, "hash long, digest long, a long, window binary"), "repeat-windows")
    often = rows.groupBy("hash", "a", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(often, ["hash", "a", "window"], "left_semi").select("hash", "digest", "a", (F.col("a") + length).alias("b"))
