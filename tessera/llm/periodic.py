"""Periodic runs of words, by the runs theorem.

Every maximal run holds a Lyndon word as long as its period that is the longest one starting there, under one of the two orders
of the words. The longest Lyndon word at a place ends before the next smaller value of the inverse suffix array (before the next
greater one under the reversed order), so two candidates a place suffice. A candidate is extended to the right and, on the reversed
text, to the left by common prefixes: minima of the LCP array between two ranks, read from a sparse table.

Texts go through in chunks. A chunk's texts lie behind each other in one array, in which a word's symbol holds its text's number,
so nothing matches across texts; later texts sort first, so a text's end sorts before all that is in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Words of a chunk; a longer text is a chunk of its own. A chunk takes about 16 bytes a word and doubling of its longest repeat.
CHUNK = 1 << 18


def doubled(symbols: np.ndarray, rounds: int = 63) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffixes sorted by their first 2**rounds symbols: their order, ranks for 1, 2, 4... symbols (one more entry ends each), and the
    places in the order that aren't settled. A rank is the first place of those that are alike; only unsettled ones are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    place = np.arange(n)
    keys, open_, rank, levels, h = symbols[order], place, np.full(n + 1, -1, np.int64), [], 1
    while True:
        new = np.ones(len(open_), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(new, place[: len(open_)], 0))]
        levels.append(rank.astype(np.int32))
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = open_[~alone]
        if not len(open_) or len(levels) > rounds:
            return order, levels, open_
        at = order[open_]
        keys = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(keys, kind="stable")
        order[open_], keys, h = at[by], keys[by], 2 * h


class Suffixes:
    """Ranks of all suffixes, and the common prefix of any two by the LCP array's minimum between their ranks."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        order, levels, _ = doubled(symbols)
        self.rank = levels[-1]
        a, b = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(self.n, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
            a, b = a + step, b + step
            lcp[1:] += step.astype(np.int32)
        self.minima = [lcp]
        while 2 << (len(self.minima) - 1) <= self.n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at i and j (i <> j); 0 where one of them is the end."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        r, s = self.rank[i[inside]], self.rank[j[inside]]
        lo, hi = np.minimum(r, s) + 1, np.maximum(r, s) + 1
        k = np.frexp((hi - lo).astype(float))[1] - 1
        for level in np.unique(k):
            here = k == level
            m = self.minima[level]
            out[inside[here]] = np.minimum(m[lo[here]], m[hi[here] - (1 << int(level))])
        return out


def next_smaller(values: list[int]) -> np.ndarray:
    """For each place the next one of a smaller value, else the end."""
    out, stack = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def _symbols(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Later texts sort first."""
    return (text.max(initial=0) - text) * (words.max(initial=0) + 1) + words


def runs(words: np.ndarray, text: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at least `least` words and `times` (2 or more) periods: first word, length and period, by first word, then period.

    words: numbers of the words of texts one behind another; text: the number of each word's text, ascending. First words are
    places in words. A run's places a period apart share at least `shared` words, so texts without such a repeat have none.
    """
    shared = min(max(least, times * p) - p for p in range(1, least + 1))
    order, _, open_ = doubled(_symbols(words, text), rounds=shared.bit_length() - 1)
    keep = np.flatnonzero(np.isin(text, text[order[open_]]))
    if not len(keep):
        return keep, keep, keep
    w, t = words[keep], text[keep]
    ahead, n = Suffixes(_symbols(w, t)), len(keep)
    ranks = ahead.rank[:n]
    p = np.concatenate([next_smaller(x.tolist()) for x in (ranks, -ranks)]) - np.tile(np.arange(n), 2)
    i = np.tile(np.arange(n), 2)
    some = i + p < n
    i, p = i[some], p[some]
    some = (w[i] == w[i + p]) & (t[i] == t[i + p])
    i, p = i[some], p[some]
    need = np.maximum(least, times * p)
    right = ahead.common(i, i + p)
    some = right >= need - 2 * p  # from the run's second period on at the latest
    i, p, end = i[some], p[some], (i + p + right)[some]
    by = np.lexsort((i, p, end))
    i, p, end = i[by], p[by], end[by]
    first = np.ones(len(i), bool)
    first[1:] = (end[1:] != end[:-1]) | (p[1:] != p[:-1])  # one end and period: one run
    i, p, end = i[first], p[first], end[first]
    if not len(i):
        return i, i, i
    behind = Suffixes(_symbols(w[::-1], t[::-1]))
    start = i - behind.common(n - i, n - i - p)
    length = end - start
    some = length >= np.maximum(least, times * p)
    start, length, p = start[some], length[some], p[some]
    by = np.lexsort((p, start))
    return keep[start[by]], length[by], p[by]


_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _chunk(texts: list[list[str]], least: int, times: int) -> tuple[list[list[dict]], list[str]]:
    known: dict[str, int] = {}
    number = known.setdefault
    words = np.array([number(w, len(known)) for ws in texts for w in ws], np.int64)
    sizes = np.array([len(ws) for ws in texts], np.int64)
    starts, text = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
    found: list[list[dict]] = [[] for _ in texts]
    gone: dict[int, np.ndarray] = {}
    for a, n, p in zip(*(x.tolist() for x in runs(words, text, least, times)), strict=True):
        at = int(text[a])
        a -= int(starts[at])
        found[at].append({"start": a, "length": n, "period": p})
        gone.setdefault(at, np.zeros(sizes[at], bool))[a + p : a + n] = True
    return found, [" ".join([w for w, g in zip(ws, gone[k].tolist(), strict=True) if not g] if k in gone else ws) for k, ws in enumerate(texts)]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period; in words from 0) and collapsed, a row for each row of docs.

    A run is a stretch of words that are identical a period apart, of smallest period, at least `least` words and `times` periods
    long, that neither neighbour continues. collapsed: the words, joined by a space, without those that lie behind the first
    period of a run. A null text has no words: no runs, collapsed is empty. Rows are judged alone: repeated rows and ids stay.
    Nothing is shuffled; a task holds a chunk of texts or one longer text at a time.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            found, collapsed = _chunk(texts, least, times)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(found, _SCHEMA.field("runs").type), pa.array(collapsed, pa.string())], schema=_SCHEMA)

        for batch in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids.append(i)
                texts.append(_WORDS(text.as_py() or ""))
                held += len(texts[-1])
                if held >= CHUNK:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield out(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, _FOUND)
