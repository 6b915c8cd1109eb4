"""Bootstraps of document statistics: all replicates in one scan.

Each document is taken a Poisson number of times in each replicate (the large-sample form of drawing with replacement, which needs no
numbering of documents). Its counts by cell are multiplied with its row of weights and summed over a task's documents as one matrix
product, so a task gives a row for each cell, not for each document and replicate; rows of a cell are then added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How likely a Poisson count of mean 1 is at most 0, 1, 2, ...
POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759)
#: Documents, and documents times cells, of one matrix product; cells that a task holds before it hands them on.
DOCS, ENTRIES, HELD = 256, 1 << 22, 1 << 15
_BOS, _EOS, _LEFT, _RIGHT = "<BOS>", "<EOS>", 1, 2


def weights(doc_ids: list, replicates: int, seed: str) -> np.ndarray:
    """A row a document: 1 (the sample itself), then its count in each replicate, four from each md5 of seed, block and id."""
    blocks = [f"{seed}|{b}|".encode() for b in range(-(-replicates // 4))]
    drawn = b"".join(hashlib.md5(b + str("" if i is None else i).encode()).digest() for i in doc_ids for b in blocks)
    u = np.frombuffer(drawn, ">u4").reshape(len(doc_ids), -1)[:, :replicates] / 4294967296
    return np.column_stack([np.ones(len(doc_ids)), np.searchsorted(POISSON, u, side="right")])


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _letter_cells(texts: list[str], contexts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the letters of words of two letters or more: document, sign and what it is counted under. That is, with contexts, each
    neighbour with its side, else the place: 0 first, 1 inner, 2 last."""
    joined = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    letter = _letters()[joined]
    at = np.flatnonzero(letter)
    before, after = letter[at - 1], letter[at + 1]
    at, before, after = (x[before | after] for x in (at, before, after))
    doc, sign = np.searchsorted(ends, at - 1, side="right"), joined[at]
    if not contexts:
        return doc, sign, np.where(~before, 0, np.where(after, 1, 2))
    left, right = np.where(before, joined[at - 1], 0), np.where(after, joined[at + 1], 0)
    return np.concatenate([doc, doc]), np.concatenate([sign, sign]), np.concatenate([left + (_LEFT << 21), right + (_RIGHT << 21)])


def _name(code: int, contexts: bool) -> str:
    if not contexts:
        return ("initial", "medial", "final")[code]
    side, c = code >> 21, code & ((1 << 21) - 1)
    return f"{'L' if side == _LEFT else 'R'}:{chr(c) if c else _BOS if side == _LEFT else _EOS}"


def letter_counts(docs: DataFrame, replicates: int, seed: str, contexts: bool = False) -> DataFrame:
    """docs: doc_id, lang, text -> lang, sign, cell and v: counts of the sample and of each replicate, replicates + 1 in all.

    Signs are lower-cased letters in words of two or more; cell is initial, medial or final, or with contexts a neighbour ('L:' or
    'R:' and the sign or sentinel). A null text has no words; a null id is drawn for as an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, DOCS):
                part = batch.slice(a, DOCS)
                langs, texts = part["lang"].to_pylist(), [t or "" for t in part["text"].to_pylist()]
                names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                of = np.array([names[x] for x in langs])
                doc, sign, under = _letter_cells(texts, contexts)
                if not len(doc):
                    continue
                keys, cell = np.unique(np.column_stack([of[doc], sign, under]), axis=0, return_inverse=True)
                cell, drawn = cell.reshape(-1), weights(part["doc_id"].to_pylist(), replicates, seed)
                step = max(1, ENTRIES // len(keys))
                total = np.zeros((len(keys), replicates + 1))
                for b in range(0, len(texts), step):
                    here = (doc >= b) & (doc < b + step)
                    n = min(step, len(texts) - b)
                    total += np.bincount((doc[here] - b) * len(keys) + cell[here], minlength=n * len(keys)).reshape(n, -1).T.astype(float) @ drawn[b : b + n]
                back = list(names)
                for (l, s, u), v in zip(keys.tolist(), total, strict=True):
                    k = (back[l], s, u)
                    held[k] = held[k] + v if k in held else v
                if len(held) > HELD:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    def out(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        v = np.array(list(held.values())).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in held], pa.string()), pa.array([chr(k[1]) for k in held]), pa.array([_name(k[2], contexts) for k in held]), pa.ListArray.from_arrays(np.arange(len(v) + 1) * v.shape[1], v.ravel())], names=["lang", "sign", "cell", "v"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(zip(*(batch[c].to_pylist() for c in ("lang", "sign", "cell")), strict=True), batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1), strict=True):
                held[k] = held[k] + v if k in held else v
        if held:
            v = np.array(list(held.values()))
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in held], pa.string()) for i in range(3)), pa.ListArray.from_arrays(np.arange(len(v) + 1) * v.shape[1], v.ravel())], names=["lang", "sign", "cell", "v"])

    schema = "lang string, sign string, cell string, v array<long>"
    dealt = docs.select("doc_id", "lang", "text").repartition("doc_id", F.xxhash64("text"))  # a file may hold all in one row group
    return dealt.select("doc_id", "lang", F.lower("text").alias("text")).mapInArrow(count, schema).repartition("lang", "sign", "cell").mapInArrow(add, schema)


def by_replicate(counts: DataFrame) -> DataFrame:
    """lang, sign, cell, r (0: the sample) and n, for counts above 0."""
    return counts.select("lang", "sign", "cell", F.posexplode("v").alias("r", "n")).where("n > 0")
