"""Joins of strings by edit distance within a length window, and hashed randomness for null models."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_window_join(queries: DataFrame, pool: DataFrame, text: str = "sca", window: int = 2, most: float = 1.0) -> DataFrame:
    """Pairs whose lengths differ by at most `window` and whose distance over the longer length is at most `most`.

    Queries are given a row for each length they may meet, so the join is by equality of length (and can be split where one length is
    common); distances beyond the bound are given up early. Columns of the pool get the suffix _m; `ned` is added.
    """
    q = queries.withColumn("_len", F.explode(F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda o: F.length(text) + o)))
    p = pool.select(*(F.col(c).alias(f"{c}_m") for c in pool.columns)).withColumn("_len", F.length(f"{text}_m"))
    pairs = q.join(p, "_len")
    longer = F.greatest(F.length(text), F.length(f"{text}_m"))
    bound = F.floor(longer * most)
    pairs = pairs.withColumn("_d", F.levenshtein(F.col(text), F.col(f"{text}_m"))).where((F.col("_d") <= bound) & (longer > 0))
    return pairs.withColumn("ned", F.col("_d") / F.greatest(F.length(text), F.length(f"{text}_m"))).drop("_d", "_len")


def nearest_of(queries: list[str], texts: list[str], most: int = 5) -> list[list[tuple[int, int]]]:
    """For each query its nearest texts (index, distance) by distance over the longer length, equals by index; no text is empty.

    Queries of one length look for texts within one edit, those that need more within two, and so on, until nothing unseen can be as near. Where that
    leaves out little (few texts, or half a query's signs edited), all texts are compared."""
    asked, found = sorted(set(queries)), {}
    longest = max(map(len, texts), default=0)
    signs = sorted(set("".join(texts)).union(*asked))
    both = _both_ways(texts, signs) if _FEW < len(texts) and longest <= 64 and len(signs) < 256 and signs[0] > "\0" else None
    for m in {len(q) for q in asked}:
        left, most_edits = [q for q in asked if len(q) == m], 0
        while both and left and 2 * (most_edits + 1) < m and most_edits < _MOST_EDITS:
            most_edits += 1
            near = _within(left, both, signs, most_edits, most)
            settled = [q for q in left if len(near[q]) == most and near[q][-1][0] < (most_edits + 1) / max(m, longest)]
            found.update((q, near[q]) for q in settled)
            left = sorted(set(left).difference(settled))
        found.update(_nearest_of_few(left, both[0], signs, most) if both and len(left) <= _LEFT else _nearest_of_all(left, texts, most))
    return [[(i, d) for _, i, d in found[q]] for q in queries]


#: Up to so many texts are compared one and all; queries that need more edits than this are compared with all.
_FEW, _MOST_EDITS = 1 << 12, 7
#: Up to so many queries that are left meet all texts one by one.
_LEFT = 32
#: Queries that go together (a quarter as many for each edit of their first part above one), and pairs that are compared at once.
_ASKED, _PAIRS = 512, 1 << 16


class _Sorted:
    """Strings in the order of their signs, each sign a code from 1, zeros behind; `at` is each one's number. Those that begin with the same w signs are a
    group: starts(w) has each group's first string and the number of strings, children(w) each group's first group of w + 1 signs and their number."""

    def __init__(self, codes: np.ndarray):
        n, longest = codes.shape
        self.at = np.argsort(np.ascontiguousarray(codes).view(f"S{longest}")[:, 0], kind="stable")
        self.codes = codes[self.at]
        self.lens = np.count_nonzero(self.codes, axis=1)
        self._shared, alike = np.zeros(n, np.int16), np.ones(n - 1, bool)
        for i in range(longest):
            alike &= self.codes[1:, i] == self.codes[:-1, i]
            self._shared[1:] += alike
        self._shared[0], self._starts, self._children = -1, {}, {}

    def starts(self, w: int) -> np.ndarray:
        if w not in self._starts:
            self._starts[w] = np.append(np.flatnonzero(self._shared < w), len(self._shared))
        return self._starts[w]

    def children(self, w: int) -> np.ndarray:
        if w not in self._children:
            self._children[w] = np.searchsorted(self.starts(w + 1), self.starts(w))
        return self._children[w]

    def mark(self, signs: int) -> None:
        """kinds: a bit for each sign's first, second... occurrence, as many as fit; places: for each sign the bits of its places; all: of every place."""
        room, n = 64 // signs, len(self.codes)
        self.kinds = np.zeros(n, np.uint64)
        for c in range(1, signs + 1) if room else ():
            k = np.minimum(np.count_nonzero(self.codes == c, axis=1), room).astype(np.uint64)
            self.kinds |= (np.uint64((1 << room) - 1) >> (np.uint64(room) - k)) << np.uint64((c - 1) * room)
        longest = self.codes.shape[1]
        word = np.dtype(np.uint16 if longest <= 16 else np.uint32 if longest <= 32 else np.uint64)
        self.places, rows = np.zeros(n * (signs + 1), word), np.arange(n) * (signs + 1)
        for i in range(longest):
            self.places[rows + self.codes[:, i]] |= word.type(1 << i)
        self.all = np.array([(1 << k) - 1 for k in range(longest + 1)], word)[self.lens]


def _codes(strings: list[str], signs: list[str]) -> np.ndarray:
    """A row of codes for each string: its signs' numbers from 1, zeros behind."""
    longest = max(map(len, strings))
    points = np.array(strings, f"U{longest}").view(np.uint32).reshape(len(strings), longest)
    number = np.zeros(ord(signs[-1]) + 1, np.uint8)
    number[[ord(c) for c in signs]] = range(1, len(signs) + 1)
    return number[points]


def _both_ways(texts: list[str], signs: list[str]) -> list[_Sorted]:
    """Texts from their beginnings and from their ends."""
    codes = _codes(texts, signs)
    back = np.count_nonzero(codes, axis=1)[:, None] - 1 - np.arange(codes.shape[1])
    both = [_Sorted(codes), _Sorted(np.where(back < 0, 0, np.take_along_axis(codes, np.maximum(back, 0), axis=1)).astype(np.uint8))]
    for x in both:
        x.mark(len(signs))
    return both


def _within(queries: list[str], both: list[_Sorted], signs: list[str], most_edits: int, most: int) -> dict[str, list[tuple[float, int, int]]]:
    """queries: of one length. Of each query's texts within most_edits the nearest ones. Of that many edits either at most half fall to the query's
    first part or fewer than half to its last, so each part is begun from with few."""
    first = most_edits // 2
    last, m = most_edits - first - 1, len(queries[0])
    part = min(m, (m + 1) // 2 + first - last)  # about as many texts fit either
    codes, got = _codes(queries, signs), []
    for step, texts, few, upto in ((1, both[0], first, part), (-1, both[1], last, m - part)):
        order = np.argsort(np.ascontiguousarray(codes[:, ::step]).view(f"S{m}")[:, 0])
        together = max(1, _ASKED >> 2 * max(0, few - 1))
        for rows in (order[lo : lo + together] for lo in range(0, len(order), together)):
            asked = _Sorted(codes[rows, ::step])
            asked.mark(len(signs))
            for q, t, d in _near_pairs(asked, texts, most_edits, few, upto):
                got.append(_least(rows[asked.at[q]], d / np.maximum(texts.lens[t], m), texts.at[t], d, most))
    found: dict[str, list[tuple[float, int, int]]] = {q: [] for q in queries}
    if got:
        for q, *x in zip(*(x.tolist() for x in _least(*map(np.concatenate, zip(*got, strict=True)), most)), strict=True):
            found[queries[q]].append(tuple(x))
    return found


def _nearest_of_few(asked: list[str], texts: _Sorted, signs: list[str], most: int) -> dict[str, list[tuple[float, int, int]]]:
    """asked: of one length. Each is compared with all texts, whose bit vectors are there already."""
    found, every = {}, np.arange(len(texts.codes))
    for q, codes in zip(asked, _codes(asked, signs) if asked else (), strict=True):
        d = _distances(np.broadcast_to(codes, (len(every), len(q))), texts, every)
        ratio = d / np.maximum(texts.lens, len(q))
        i = np.flatnonzero(ratio <= np.partition(ratio, min(most, len(every)) - 1)[min(most, len(every)) - 1])
        found[q] = list(zip(*(x.tolist() for x in _least(0 * i, ratio[i], texts.at[i], d[i], most)[1:]), strict=True))
    return found


def _least(q: np.ndarray, ratio: np.ndarray, at: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each q the `most` rows of least ratio, equals by at, each once."""
    order = np.lexsort((at, ratio, q))
    new = np.ones(len(q), bool)
    new[1:] = (np.diff(q[order]) != 0) | (np.diff(at[order]) != 0)
    order = order[new]
    order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < most]
    return q[order], ratio[order], at[order], d[order]


def _spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's numbers from first to before end, one under the other: rows and numbers."""
    n = end - first
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(len(rows)) + np.repeat(first - (np.cumsum(n) - n), n)


@functools.cache
def _automaton(few: int) -> np.ndarray:
    """A text's beginnings as long as a query's, give or take `few`, have distances to it that make one state (0: all above few, 1: nothing read). Next state
    by state and by which of the text's signs about the next place, from `few` before it to `few` behind, equal the query's next sign."""
    size, over = 2 * few + 1, few + 1
    states, table = [(over,) * size, (over,) * few + tuple(range(over))], []
    number = {s: i for i, s in enumerate(states)}
    for now in states:  # grows
        row = []
        for equal in range(1 << size):
            new: list[int] = []
            for s in range(size):
                above = now[s + 1] if s + 1 < size else over
                new.append(min(over, now[s] + 1 - (equal >> s & 1), above + 1, (new[-1] if s else over) + 1))
            if tuple(new) not in number:
                number[tuple(new)] = len(states)
                states.append(tuple(new))
            row.append(number[tuple(new)])
        table.append(row)
    return np.array(table, np.int16)


def _near_pairs(asked: _Sorted, texts: _Sorted, most_edits: int, few: int, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """asked: of one length. Rows of asked and texts that are within most_edits, with their distances, if the first `upto` signs take no more than `few` edits.

    Groups of alike beginnings meet, one sign more at each step, and go where no text can come to so few edits; then strings meet whose signs fit."""
    step, word, m = _automaton(few), texts.places.dtype, asked.codes.shape[1]
    width = len(texts.places) // len(texts.codes)
    t = np.arange(len(texts.starts(few)) - 1)
    u, state = np.zeros(len(t), np.int64), np.ones(len(t), np.int16)
    top, window = word.type(1 << 2 * few), word.type((1 << 2 * few + 1) - 1)

    def equal(i: int, starts: np.ndarray) -> np.ndarray:
        found = texts.places[starts[t] * width + asked.codes[asked.starts(i + 1)[:-1], i][u]]
        return (found >> word.type(i - few) if i >= few else found << word.type(few - i)) & window

    for i in range(upto):
        below, within = asked.children(i), texts.children(i + few)
        rows, v = _spread(below[u], below[u + 1])
        u, t, state = v, t[rows], state[rows]
        hopeful = np.flatnonzero(step[state, equal(i, texts.starts(i + few)) | top])  # whatever the last sign, which groups of that width don't share
        rows, t = _spread(within[t[hopeful]], within[t[hopeful] + 1])
        u, state = u[hopeful][rows], state[hopeful][rows]
        state = step[state, equal(i, texts.starts(i + few + 1))]
        alive = np.flatnonzero(state)
        u, t, state = u[alive], t[alive], state[alive]
    starts, ends = asked.starts(upto), texts.starts(upto + few)
    rows, q = _spread(starts[u], starts[u + 1])
    t = t[rows]
    total = np.cumsum(ends[t + 1] - ends[t])
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, _PAIRS)), len(t)))
    for a, b in itertools.pairwise(cuts):
        rows, at = _spread(ends[t[a:b]], ends[t[a:b] + 1])
        row = q[a:b][rows]
        x, y = asked.kinds[row], texts.kinds[at]
        fit = (np.abs(texts.lens[at] - m) <= most_edits) & (np.bitwise_count(x & ~y) <= most_edits) & (np.bitwise_count(y & ~x) <= most_edits)
        row, at = row[fit], at[fit]
        d = _distances(asked.codes[row], texts, at)
        near = d <= most_edits
        if near.any():
            yield row[near], at[near], d[near]


def _distances(codes: np.ndarray, texts: _Sorted, at: np.ndarray) -> np.ndarray:
    """The distance of each row of codes to the text beside it, by bit vectors as in _distances_of."""
    word, one, start = texts.places.dtype, texts.places.dtype.type(1), at * (len(texts.places) // len(texts.codes))
    pv, mv = np.full(len(at), ~word.type(0)), np.zeros(len(at), word)
    for i in range(codes.shape[1]):
        eq = texts.places[start + codes[:, i]]
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = ((mv | ~(xh | pv)) << one) | one
        xv = eq | mv
        pv, mv = ((pv & xh) << one) | ~(xv | ph), ph & xv
    full = texts.all[at]
    return np.bitwise_count(pv & full).astype(np.int16) - np.bitwise_count(mv & full) + np.int16(codes.shape[1])


def _nearest_of_all(asked: list[str], texts: list[str], most: int) -> dict[str, list[tuple[float, int, int]]]:
    """asked: sorted. Edit distance by bit vectors over texts of one length at once, as short as the length lets them be, where a query goes on from the
    signs that it begins with like the one before. A distance is the query's length and what the last column's steps, up and down, come to."""
    found: dict[str, list[tuple[float, int, int]]] = {q: [] for q in asked}
    lens = np.array([len(t) for t in texts])
    for n in np.unique(lens).tolist() if asked else ():
        same_length = np.flatnonzero(lens == n)
        for k in range(0, len(same_length), _BLOCK):
            at = same_length[k : k + _BLOCK]
            for q, d in _distances_of(asked, [texts[i] for i in at], n):
                best, longer, least = found[q], max(len(q), n), int(d.min())
                if len(best) >= most and least / longer > best[-1][0]:
                    continue
                got: list[int] = []
                while len(got) < min(most, len(at)):
                    hits, i = (d == least).tobytes(), -1
                    while len(got) < most and (i := hits.find(1, i + 1)) >= 0:
                        got.append(i)
                    least += 1
                found[q] = sorted(best + [(int(d[i]) / longer, int(at[i]), int(d[i])) for i in got])[:most]
    return found


#: Texts whose bit vectors are held at once, few enough for a core's cache.
_BLOCK = 1 << 15


def _distances_of(asked: list[str], texts: list[str], n: int) -> Iterator[tuple[str, np.ndarray]]:
    """asked: sorted; texts: all of n signs. Each query with its distances to the texts."""
    if n > 64:
        yield from ((q, np.array([_distance(q, t) for t in texts])) for q in asked)
        return
    word = np.dtype(np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64)
    signs, masks, one, full = np.array([list(t) for t in texts]), {}, word.type(1), word.type((1 << n) - 1)
    for i in range(n):
        for c in np.unique(signs[:, i]):
            masks.setdefault(c, np.zeros(len(texts), word))[signs[:, i] == c] |= word.type(1 << i)
    none, states, before = np.zeros(len(texts), word), [(np.full(len(texts), full), np.zeros(len(texts), word))], ""
    for q in asked:
        same = next((i for i, (a, b) in enumerate(zip(q, before, strict=False)) if a != b), min(len(q), len(before)))
        del states[same + 1 :]
        for c in q[same:]:
            pv, mv = states[-1]
            eq = masks.get(c, none)
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = ((mv | ~(xh | pv)) << one) | one
            xv = eq | mv
            states.append((((pv & xh) << one) | ~(xv | ph), ph & xv))
        before, (pv, mv) = q, states[-1]
        yield q, np.bitwise_count(pv & full).astype(np.int16) - np.bitwise_count(mv & full) + np.int16(len(q))


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(queries: DataFrame, pool: DataFrame, most: int = 5, window: int = 2, parts: int = 8) -> DataFrame:
    """queries: sca, len; pool: lang, sca, len (each string of a language once) -> q, lang, m, ned, rk: for each query and language the
    nearest strings whose length differs by at most `window`, all of them compared; equals in the order of m.

    Queries of one length meet the strings of the lengths near it in one task, in parts by what the queries begin with. The strings come there in arrays.
    """
    part = F.pmod(F.crc32(F.substring("sca", 1, 3).cast("binary")), F.lit(parts))
    q = queries.select(F.col("sca").alias("q"), F.col("len").cast("long").alias("qlen"), part.alias("part"))
    near = F.explode(F.sequence(F.col("len").cast("long") - window, F.col("len").cast("long") + window))
    blocks = pool.where("len > 0").groupBy("lang", "len", F.pmod(F.crc32(F.col("sca").cast("binary")), F.lit(64))).agg(F.sort_array(F.collect_list("sca")).alias("texts"))
    p = blocks.select("lang", "texts", near.alias("qlen")).select("lang", "texts", "qlen", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, qs = [], left["q"].tolist()
        for lang, g in right.groupby("lang") if qs else ():
            texts = sorted(t for block in g["texts"] for t in block)
            for x, got in zip(qs, nearest_of(qs, texts, most), strict=True):
                out += [(x, lang, texts[i], d / max(len(x), len(texts[i])), r) for r, (i, d) in enumerate(got, 1)]
        return pd.DataFrame(out, columns=["q", "lang", "m", "ned", "rk"])

    keys = ["qlen", "part"]
    return q.groupBy(keys).cogroup(p.groupBy(keys)).applyInPandas(match, "q string, lang string, m string, ned double, rk long")


def draw(seed: str, *parts: Column) -> Column:
    """A number from 0 to 2^32 - 1, drawn by md5 of a seed and what it is drawn for: the same in every run and partitioning."""
    text = F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def random_strings(spark, lengths: list[int], samples: int, alphabet: str, seed: str) -> DataFrame:
    """len, sample, text: `samples` random strings of each length."""
    rows = spark.range(samples).select(F.col("id").alias("sample"), F.explode(F.array(*map(F.lit, lengths))).alias("len"))
    letter = lambda i: F.substring(F.lit(alphabet), (draw(seed, F.col("len"), F.col("sample"), i) % len(alphabet) + 1).cast("int"), F.lit(1))
    return rows.select("len", "sample", F.array_join(F.transform(F.sequence(F.lit(1), F.col("len")), letter), "").alias("text"))


def shuffled(items: Column, seed: str, key: Column) -> Column:
    """An array in hash order: a permutation that is the same in every run."""
    pairs = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(pairs), lambda p: p["x"])


def resampled(df: DataFrame, key: str, replicates: int, seed: str) -> DataFrame:
    """The rows of df for each replicate (column r), each taken a Poisson number of times (mean 1) by hash of its key: the large-sample
    form of drawing with replacement. Nothing is numbered or shuffled."""
    u = draw(seed, F.col("r"), F.col(key)) / 2**32
    below, total, term = [], 0.0, math.exp(-1)
    for i in range(12):
        total += term
        below.append(F.when(u >= total, 1).otherwise(0))
        term /= i + 1
    times = sum(below[1:], below[0])
    rows = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_k", times).where("_k > 0")
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")


def null_p_value(observed: DataFrame, null: DataFrame, by: list[str], value: str = "ned", tolerance: float = 1e-12) -> DataFrame:
    """Adds p = (null values at or under the observed one + 1) / (all + 1). The null is summed to one row per value first."""
    cum = null.groupBy(*by, value).agg(F.count("*").alias("_k"))
    pairs = observed.join(cum.withColumnRenamed(value, "_v"), by, "left")
    keys = observed.columns
    hits = F.sum(F.when(F.col("_v") <= F.col(value) + tolerance, F.col("_k")).otherwise(0))
    return pairs.groupBy(*keys).agg(((hits + 1) / (F.coalesce(F.sum("_k"), F.lit(0)) + 1)).alias("p"))


def first_contained(strings: DataFrame, anchors: DataFrame, text: str, anchor: str, order: list[str], longest: int = 4) -> DataFrame:
    """strings with the first anchor that each contains, as a struct `hit` of the anchors' columns: one equal to the string, else the first by
    `order` (then by itself) of those within it; null if there is none.

    No nested loop: an anchor is known by its first `longest` signs (by all, if it has fewer), a string by all its runs of as many signs
    as some anchor is known by; what meets in one is then compared as a whole. Empty and null anchors are contained nowhere. Strings
    may repeat; each different one is searched once, and a string's anchors are reduced before its rows are joined back.
    """
    row = F.struct(*(F.col(c) for c in anchors.columns))
    known = anchors.where(F.length(anchor) > 0).select(F.col(anchor).alias("_a"), F.struct(*order, anchor).alias("_o"), row.alias("_row"), F.substring(anchor, 1, longest).alias("_gram"))
    lengths = sorted(r[0] for r in known.select(F.length("_gram")).distinct().collect())  # at most `longest` numbers
    each = strings.where(F.length(text) > 0).select(F.col(text).alias("_t")).distinct()
    runs = lambda n: F.when(F.length("_t") >= n, F.transform(F.sequence(F.lit(1), F.length("_t") - n + 1), lambda i: F.substring(F.col("_t"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    if not lengths:
        return strings.withColumn("hit", F.lit(None).cast(known.schema["_row"].dataType))
    grams = each.select("_t", F.explode(F.array_distinct(F.concat(*map(runs, lengths)))).alias("_gram"))
    met = grams.join(known, "_gram").where(F.contains("_t", "_a"))
    best = met.groupBy("_t").agg(F.min_by("_row", F.struct((F.col("_a") != F.col("_t")).alias("x"), F.col("_o").alias("o"))).alias("hit"))
    return strings.join(best, F.col(text) == F.col("_t"), "left").drop("_t")
