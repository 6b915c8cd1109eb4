"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Tokens, and stems of a few letters for tokens not known, get the log-odds of toxic against other documents under a Dirichlet prior
that follows the frequencies of all documents. A token's documents are counted once for a group of near copies, and it enters the
lexicon, on either side, if an exact bound of the binomial tail stays below a false-discovery rate over all tokens and stems; any
other token has the pooled log-odds of the rest less a cost. A linear scan finds all maximal scoring segments of a text. The best
score among n random tokens has the extreme-value law P(S >= x) = 1 - exp(-K n exp(-lambda x)); in its terms a segment scores
lambda S - ln(K n), and those above 0 are passages that chance does not explain. K and a logistic curve over the best and the sum of
them are fitted on documents that the lexicon in use there did not see (parts, each scored by the lexicon of the others).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import about, stored

_TOKEN = re.compile(r"[^\W\d_]+")
#: Words whose scores a task remembers, and counts of tokens that it holds before it hands them on.
_REMEMBERED, _COUNTED = 200_000, 100_000


@dataclass(frozen=True)
class Fit:
    """docs: labels to learn from, about so many at most (those of low hash of id), and texts, twice as many at most; prior: the
    Dirichlet prior's weight in tokens; false: rate of false discoveries among the lexicon's entries; cost: of a token that is not in
    it; highest: log-odds of any token at most (and at least, below 0); stems: letters that stand for tokens of more than so many; clean:
    share of the clean documents outside the fit that `Model.cut` may lose; parts: of the sample, each scored by what the others teach."""

    docs: int = 20_000
    prior: float = 500.0
    false: float = 0.01
    cost: float = 0.5
    highest: float = 8.0
    stems: tuple[int, ...] = (4, 5, 6)
    clean: float = 0.005
    parts: int = 8


class _Known(dict):
    """Scores of words as they stand between white space: of their tokens the one farthest from 0. Remembers a bounded number."""

    def __init__(self, model: Model, most: int = _REMEMBERED):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        plain = word.rstrip(".,")
        found = self[word] = self.model.token_score(plain) if plain.isalpha() else max(map(self.model.token_score, _TOKEN.findall(word)), key=abs, default=0.0)
        return found


@dataclass
class Model:
    """odds: token, or stem and an asterisk, -> log-odds; other: score of any other token; cut: the score above
    which documents should go, chosen on documents outside the fit (see _cut)."""

    odds: dict[str, float] = field(default_factory=dict)
    other: float = -0.5
    stems: tuple[int, ...] = (4, 5, 6)
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)
    cut: float = 0.5

    def __post_init__(self):
        self.known = _Known(self)

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "known"}

    def __setstate__(self, state):
        vars(self).update(state)
        self.known = _Known(self)

    def token_score(self, token: str) -> float:
        """Of the token itself, else of its longest known stem, else 0 (which stands for `other`)."""
        found = self.odds.get(token)
        for n in reversed(self.stems):
            if found is None and len(token) > n:
                found = self.odds.get(token[:n] + "*")
        return found or 0.0

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """The number of words, and of each maximal scoring segment its score and its words' span."""
        words = (text or "").lower().split()
        scores = list(map(self.known.__getitem__, words))
        if not any(scores):
            return len(words), []
        return len(words), maximal_segments([(i, s) for i, s in enumerate(scores) if s], self.other)

    def features(self, text: str | None) -> tuple[float, float, int, float]:
        """Best segment in extreme-value terms, the sum of the significant ones, their number, the best raw score."""
        n, found = self.segments(text)
        chance, best = float(np.log(max(self.scale * max(n, 1), 1e-12))), max((s for s, _, _ in found), default=0.0)
        above = [self.decay * s - chance for s, _, _ in found if self.decay * s > chance]
        return self.decay * best - chance, float(np.log1p(sum(above))), len(above), best

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * best + c * total, -30, 30))))


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[float, int, int]]:
    """hits: positions and their scores; all other positions score `other` (below 0). All maximal scoring segments, as by Ruzzo and
    Tompa, in linear time: a candidate keeps its sums before (l) and at its end (r) and the last candidate before it with a smaller
    l. A new one looks for its own along that chain, so what it passes over is never looked at again, and swallows back to it
    while that one's r is below its own."""
    out: list[tuple] = []
    total, at = 0.0, 0
    for i, s in hits:
        total += other * (i - at)
        low, total, at = total, total + s, i + 1
        if s <= 0:
            continue
        start, j = i, len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= low:
                j = out[j][4]
            if j < 0 or out[j][1] >= total:
                break
            low, _, start, _, before = out[j]
            del out[j:]
            j = before
        out.append((low, total, start, i + 1, j))
    return [(high - low, a, b) for low, high, a, b, _ in out]


def _tail(a: Column, b: Column, high: Column, low: Column) -> Column:
    """Log of a bound (Chernoff's, never too small) of the binomial tail beyond a of a + b, of the share `high` or more of chance where a's
    share is above it, or `low` and less where it is below; null in between."""
    f = a / (a + b)
    p = F.when(f > high, high).when(f < low, low)
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    return -(a + b) * (part(f, p) + part(1 - f, 1 - p))


@dataclass
class _Side:
    """What one part of the sample holds: documents and distinct tokens (of each document), toxic and not."""

    docs: tuple[int, int]
    tokens: tuple[int, int]


def _lexicons(counts: DataFrame, sides: list[tuple[Column, Column, _Side]], fit: Fit) -> list[list]:
    """For each side entries (token, d, a, b) below the false-discovery rate (Benjamini and Hochberg). The expected share of a token's
    documents lies between that of documents and that of tokens: common tokens are in every document, rare ones in long ones. Tokens
    of so few documents that not even all of them toxic would do are no tests (Tarone)."""
    least, shares = float(np.log(fit.false)), [(s.tokens[0] / max(sum(s.tokens), 1), s.docs[0] / max(sum(s.docs), 1)) for _, _, s in sides]
    able = [0 < min(x) and max(x) < 1 for x in shares]
    of = lambda values: F.array(*(F.lit(float(v)) for v in values))[F.col("k")]
    rows = counts.select("token", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b")) for k, (a, b, _) in enumerate(sides) if able[k]))).alias("x")).select("token", "x.*") if any(able) else None
    if rows is None:
        return [[] for _ in sides]
    a, b = F.col("a"), F.col("b")
    rows = rows.where(a + b >= of(least / np.log(max(x)) if good else 1 for x, good in zip(shares, able, strict=True)))
    prior = fit.prior * (a + b) / of(max(sum(s.tokens), 1) for _, _, s in sides)
    odds = lambda x, i: F.log((x + prior) / (of(s.tokens[i] for _, _, s in sides) + fit.prior - x - prior))
    tests = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    good = rows.withColumn("p", _tail(a, b, of(map(max, shares)), of(map(min, shares)))).where(F.col("p") < least).select("k", "p", "token", (odds(a, 0) - odds(b, 1)).alias("d"), "a", "b").collect()
    out = []
    for k in range(len(sides)):
        found = sorted(tuple(r)[1:] for r in good if r["k"] == k)
        out.append([x[1:] for x in found[: max((i for i, x in enumerate(found, 1) if x[0] <= np.log(fit.false * i / tests[k])), default=0)]])
    return out


def _model(rows: list, side: _Side, fit: Fit) -> Model:
    """The lexicon's model; lambda solves sum p(s) exp(lambda s) = 1 over the scores of a token of documents that aren't toxic."""
    limit = lambda d: max(-fit.highest, min(fit.highest, d))
    whole = [r for r in rows if r[0][-1] != "*"]
    rest = [max(n - sum(r[x] for r in whole), 1) / max(n, 1) for n, x in zip(side.tokens, (2, 3), strict=True)]
    model = Model({token: limit(d) for token, d, _, _ in rows}, min(0.0, float(np.log(rest[0] / rest[1]))) - fit.cost, fit.stems)
    p = np.array([(b + 0.5) / max(side.tokens[1], 1) for _, _, _, b in rows])
    p = p * min(1.0, 0.5 / p.sum()) if len(rows) else p
    values, p = np.array([*(limit(r[1]) for r in rows), model.other]), np.append(p, 1 - p.sum())
    lo, hi = 1e-3, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * values, 600))).sum() < 1 else (lo, mid)
    model.decay = lo
    return model


_MIX = np.random.default_rng(1).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def _sketch(words: list[str]) -> list[int]:
    """Four numbers of two least hashes each of the three-word shingles: near copies share one of them, others hardly."""
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    if len(h) > 2:
        h = np.unique((h[:-2] * np.uint64(961) + h[1:-1] * np.uint64(31) + h[2:]) * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(29))) + np.uint64(1)
    least = np.array([((h * m) ^ ((h * m) >> np.uint64(31))).min() for m in _MIX], np.uint64) * _MIX if len(h) else _MIX
    return ((least[::2] ^ (least[1::2] >> np.uint64(7))) >> np.uint64(1)).astype(np.int64).tolist()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, toxic, text -> h, toxic, n (distinct tokens), sketch; a task holds the tokens of one text at a time."""

    def one(text: str | None) -> tuple[int, list[int]]:
        words = _TOKEN.findall((text or "").lower())
        return len(set(words)), _sketch(words)

    for batch in batches:
        got = [one(t.as_py()) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["h"], batch["toxic"], pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.list_(pa.int64()))], names=["h", "toxic", "n", "sketch"])


def _one_of_each(rows: list) -> list:
    """rows: h, toxic, distinct, sketch, at most twice Fit.docs -> the row of least h of each group of one label that a sketch links."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for r in rows:
        names = [(r["toxic"], j, k) for j, k in enumerate(r["sketch"])]
        for name in names[1:]:
            up[top(name)] = top(names[0])
    first: dict = {}
    for r in sorted(rows, key=lambda r: r["h"]):
        first.setdefault(top((r["toxic"], 0, r["sketch"][0])), r)
    return list(first.values())


def train(docs: DataFrame, labels: DataFrame, fit: Fit | None = None) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (rows with null count for nothing; of an id with both, toxic counts). Learns from a
    bounded sample, each group of near copies once; without both kinds of label the model says what there is: a small constant, or 1/2 and
    more if all are toxic."""
    fit = fit or Fit()
    spark = docs.sparkSession
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = about(stored(known, "toxicity-labels"), fit.docs, F.col("doc_id"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("h"), "text", "toxic")  # about fit.docs ids
    sample = about(stored(sample.dropDuplicates(["h", "toxic"]), "toxicity-sample"), 2 * fit.docs, F.col("h"))
    rows = _one_of_each(sample.mapInArrow(_sketches, "h long, toxic long, n long, sketch array<long>").collect())  # fit.docs bounds them
    part_of = lambda r: r["h"] % fit.parts
    held = [None, *range(fit.parts)]  # nothing, and each part in turn
    side = [_Side(*(tuple(sum(f(r) for r in rows if r["toxic"] == k and part_of(r) != part) for k in (1, 0)) for f in (lambda r: 1, lambda r: r["n"]))) for part in held]
    toxic, rest = side[0].docs
    if not toxic or not rest:
        return Model(curve=(4.0 if toxic else -4.0, 0.0, 0.0))
    once = F.broadcast(spark.createDataFrame([(r["h"], r["toxic"]) for r in rows], "h long, toxic long"))
    sample = stored(sample.join(once, ["h", "toxic"], "left_semi").select("text", "toxic", F.pmod("h", F.lit(fit.parts)).alias("part")), "toxicity-once")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in each]

        def rows_out() -> pa.RecordBatch:
            rows = [pa.array([t for s in seen for t in s], pa.string()), pa.array([k for k, s in enumerate(seen) for _ in s], pa.int32()), pa.array([n for s in seen for n in s.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(rows, names=["token", "k", "n"])

        for batch in batches:
            for text, label, part in zip(batch["text"], batch["toxic"].to_pylist(), batch["part"].to_pylist(), strict=True):
                tokens = set(_TOKEN.findall((text.as_py() or "").lower()))
                seen[2 * part + 1 - label].update(tokens | {t[:n] + "*" for n in fit.stems for t in tokens if len(t) > n})
                if sum(map(len, seen)) > _COUNTED:
                    yield rows_out()
                    for s in seen:
                        s.clear()
        yield rows_out()

    each = [f"{c}{part}" for part in range(fit.parts) for c in "ab"]
    of_each = (F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(each))
    counts = stored(sample.mapInArrow(count, "token string, k int, n long").groupBy("token").agg(*of_each), "toxicity-tokens")
    summed = lambda c, without: sum((F.col(f"{c}{part}") for part in range(fit.parts) if part != without), F.lit(0))
    lexicons = _lexicons(counts, [(summed("a", part), summed("b", part), s) for part, s in zip(held, side, strict=True)], fit)
    model, *others = (_model(rows, s, fit) for rows, s in zip(lexicons, side, strict=True))

    def measured(models: list[Model]) -> np.ndarray:
        """Label and features of every text by the model of the other parts."""

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m in models:
                m.known.most = _REMEMBERED // len(models)  # a task holds them all
            for batch in batches:
                got = [(y, *models[part].features(t.as_py())) for t, y, part in zip(batch["text"], batch["toxic"].to_pylist(), batch["part"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([float(g[k]) for g in got], pa.float64()) for k in range(3)], names=["y", "best", "total"])

        return np.array(sorted(map(tuple, sample.mapInArrow(rate, "y double, best double, total double").collect())))  # fit.docs bounds them

    x = measured(others)
    clean = x[:, 0] == 0
    model.scale = float(clean.sum() / np.exp(-x[clean, 1]).sum())  # most likely K for clean texts: best is lambda S - ln(n) while K is 1
    for m in others:
        m.scale = model.scale
    x = measured(others)
    model.curve = logistic(np.column_stack([np.ones(len(x)), x[:, 1:]]), x[:, 0])
    model.cut = _cut(np.array([model.probability(b, t) for _, b, t in x]), x[:, 0], fit.clean)
    return model


def _cut(scores: np.ndarray, y: np.ndarray, clean: float) -> float:
    """The score above which most toxic texts less clean ones (as shares) lie, while at most a share `clean` of the clean ones do; the
    highest of equals, and 1/2 at most. 1/2 where no score keeps to the share."""
    best = -1.0, 0.5
    for t in sorted({0.5, *scores[scores < 0.5].tolist()}):
        caught, lost = (scores[y == 1] > t).mean(), (scores[y == 0] > t).mean()
        if lost <= clean:
            best = max(best, (caught - lost, t))
    return float(best[1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method with a little ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row (all columns of docs as a struct, so that no name can clash), score (0 to 1), predicted, passages (significant
    segments) and best_segment (its raw score).

    A null or empty text has no segments and the score of none. Texts are whole; a task streams what it reads.
    """
    rows = docs.select(F.struct("*").alias("row"))  # the text goes over once, within its row
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of what fit.docs documents hold

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [m.features(t.as_py()) for t in batch["row"].field(text_col)]
            s = np.array([m.probability(b, t) for b, t, _, _ in got], float)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([k for _, _, k, _ in got], pa.int64()), pa.array([b for _, _, _, b in got], pa.float64())], names=["row", "score", "predicted", "passages", "best_segment"])

    return rows.mapInArrow(rate, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int, passages long, best_segment double")
