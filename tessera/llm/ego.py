"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are turned to their principal axes; a grid of cells as wide as the radius lies over the leading ones, and vectors
are sorted by their cells (by first axis, then second, and so on). The sorted sequence is cut into blocks with bounding boxes.
Blocks whose boxes are nearer than the radius are joined, each pair by halving the longer interval again and again: a pair of
intervals whose boxes are further apart than the radius is skipped, a pair of short ones is compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import components
from tessera.llm.shared import about, stored

#: Vectors of a block, vectors of a leaf of the recursion, axes of the sort, axes of the boxes (what is left of the norm is one more), axes by which blocks meet.
BLOCK, LEAF, ORDER_AXES, BOX_AXES, MEET_AXES = 4096, 256, 8, 16, 3
#: The axes are fitted on about so many vectors, those of low hash; they steer the skipping, not the result.
FIT_ROWS = 20_000


def principal_axes(classes: DataFrame, rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """For the commonest length among a bounded sample of vectors: its axes as columns, largest spread first."""
    sample = [np.asarray(r[0], float) for r in about(classes, rows, F.col("cid")).select("v").collect()]
    if not sample:
        return {}
    lengths = [len(v) for v in sample]
    d = max(sorted(set(lengths)), key=lengths.count)
    x = np.array([v / np.linalg.norm(v) for v in sample if len(v) == d])
    _, axes = np.linalg.eigh(np.cov(x.T).reshape(d, d)) if len(x) > 1 else (None, np.eye(d))
    return {d: axes[:, ::-1].copy()}


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shadow(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """The leading coordinates and the norm of the rest: distances between shadows are never above those between vectors."""
    d = x.shape[1]
    y = x @ axes[d] if d in axes else x
    out = np.zeros((len(x), BOX_AXES + 1))
    out[:, : min(d, BOX_AXES)] = y[:, :BOX_AXES]
    out[:, BOX_AXES] = np.linalg.norm(y[:, BOX_AXES:], axis=1)
    return out


def _apart(lo_a, hi_a, lo_b, hi_b) -> float:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


class _Join:
    """Links within one pair of blocks: how many each vector has (copies counted), and a forest that connects what they do."""

    def __init__(self, cosine: float, reach: float):
        self.cosine, self.reach = cosine, reach

    def __call__(self, a: tuple, b: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """a, b: (class ids, copies, unit vectors, shadows), b None for a with itself -> ids, counts, edges from, edges to."""
        self.a, self.b, self.same = a, b or a, b is None
        self.na, self.nb = np.zeros(len(a[0]), np.int64), np.zeros(len(self.b[0]), np.int64)
        self.p, self.q = [], []
        self._pair(0, len(a[0]), 0, len(self.b[0]))
        ids = np.concatenate([a[0]] if self.same else [a[0], self.b[0]])
        counts = self.na if self.same else np.concatenate([self.na, self.nb])
        p, q = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.p, self.q))
        p, q = forest(len(ids), p, q)
        some = counts > 0
        return ids[some], counts[some], ids[p], ids[q]

    def _pair(self, i: int, j: int, k: int, m: int) -> None:
        if self.same and m <= i:
            return  # the mirror image of a pair that is joined
        sa, sb = self.a[3][i:j], self.b[3][k:m]
        if _apart(sa.min(0), sa.max(0), sb.min(0), sb.max(0)) > self.reach:
            return
        if max(j - i, m - k) > LEAF:
            if j - i >= m - k:
                h = i + max(LEAF, (j - i) // 2 // LEAF * LEAF)
                self._pair(i, h, k, m)
                self._pair(h, j, k, m)
            else:
                h = k + max(LEAF, (m - k) // 2 // LEAF * LEAF)
                self._pair(i, j, k, h)
                self._pair(i, j, h, m)
            return
        near = self.a[2][i:j] @ self.b[2][k:m].T >= self.cosine
        if self.same and i == k:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.na[i:j] += near @ self.b[1][k:m]
        if not (self.same and i == k):
            (self.na if self.same else self.nb)[k:m] += self.a[1][i:j] @ near
        nodes = np.concatenate([np.arange(i, j), np.arange(k, m) + (0 if self.same else len(self.na))])
        p, q = np.nonzero(near)
        p, q = forest_of_places(nodes, p, q + (j - i)) if not (self.same and i == k) else forest_of_places(nodes[: j - i], p, q)
        self.p.append(p)
        self.q.append(q)


def forest_of_places(nodes: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = forest(len(nodes), p, q)
    return nodes[p], nodes[q]


def forest(n: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of n nodes to the least node that edges p, q connect it with; none for that node itself."""
    least = np.arange(n)
    while len(p):
        low = np.minimum(least[p], least[q])
        before = least.copy()
        np.minimum.at(least, p, low)
        np.minimum.at(least, q, low)
        least = least[least]
        if (before == least).all():
            break
    moved = np.flatnonzero(least != np.arange(n))
    return moved, least[moved]


_BLOCK = "block long, d int, n int, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary"


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], cell: float, size: int) -> DataFrame:
    """classes: cid, v, copies -> blocks of the vectors in epsilon grid order, a row each."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(v, float) for v in batch["v"].to_pylist()]
            out, kinds = np.zeros((len(lists), ORDER_AXES), np.int64), np.array([len(v) for v in lists])
            for d in np.unique(kinds):
                at = np.flatnonzero(kinds == d)
                out[at] = np.floor(_shadow(_unit(np.array([lists[i] for i in at])), axes)[:, :ORDER_AXES] / cell)
            yield pa.RecordBatch.from_arrays([batch["cid"], pa.array(kinds.astype(np.int32)), batch["copies"], batch["v"], *(pa.array(out[:, i]) for i in range(ORDER_AXES))], names=["cid", "d", "copies", "v", *keys])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("d", "cid", "copies", "v")), strict=True):
                if held and (len(held) == size or held[0][0] != row[0]):
                    yield block(held, number)
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield block(held, number)

    def block(rows: list[tuple], number: int) -> pa.RecordBatch:
        vectors = np.array([r[3] for r in rows], float)
        shadow = _shadow(_unit(vectors), axes)
        one = {"block": number, "d": rows[0][0], "n": len(rows), "lo": shadow.min(0).tolist(), "hi": shadow.max(0).tolist(), "ids": np.array([r[1] for r in rows], np.int64).tobytes(), "copies": np.array([r[2] for r in rows], np.int64).tobytes(), "vectors": vectors.astype(np.float32 if floats else float).tobytes()}
        return pa.RecordBatch.from_pylist([one], schema=schema)

    doubles = pa.list_(pa.float64())
    schema = pa.schema([("block", pa.int64()), ("d", pa.int32()), ("n", pa.int32()), ("lo", doubles), ("hi", doubles), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])
    keys, kind = [f"c{i}" for i in range(ORDER_AXES)], classes.schema["v"].dataType.simpleString()
    floats = kind == "array<float>"
    rows = classes.mapInArrow(cells, f"cid long, d int, copies long, v {kind}, " + ", ".join(f"{k} long" for k in keys))
    rows = rows.repartitionByRange("d", *keys).sortWithinPartitions("d", *keys, "cid")
    return stored(rows.mapInArrow(cut, _BLOCK), "ego-blocks")


def _near_blocks(blocks: DataFrame, reach: float) -> DataFrame:
    """Pairs i <= j of blocks whose boxes are within the radius: they meet in a cell of the first axes, in one of them only."""
    cell = reach**0.5
    boxes = blocks.select("block", "d", "lo", "hi")
    for k in range(MEET_AXES):
        first, last = (F.floor(F.col(c)[k] / cell + sign * 0.5000001).cast("int") for c, sign in (("lo", -1), ("hi", 1)))
        boxes = boxes.withColumn(f"f{k}", first).withColumn(f"k{k}", F.explode(F.sequence(first, last)))
    other = boxes.select(*(F.col(c).alias(f"{c}_" if c in ("block", "lo", "hi") or c[0] == "f" else c) for c in boxes.columns))
    pairs = boxes.join(other, ["d", *(f"k{k}" for k in range(MEET_AXES))]).where("block <= block_")
    for k in range(MEET_AXES):
        pairs = pairs.where(F.col(f"k{k}") == F.greatest(f"f{k}", f"f{k}_"))
    gaps = F.zip_with(F.zip_with("lo", "hi_", lambda x, y: x - y), F.zip_with("lo_", "hi", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    far = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return pairs.where(far <= reach * 1.000001).select(F.col("block").alias("i"), F.col("block_").alias("j"))


def _joined(pairs: DataFrame, blocks: DataFrame, axes: dict[int, np.ndarray], cosine: float, reach: float) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(r: dict, s: str) -> tuple:
            n = r["n" + s]
            x = _unit(np.frombuffer(r["vectors" + s], np.float32 if len(r["vectors" + s]) == 4 * n * r["d"] else float).reshape(n, r["d"]))
            return np.frombuffer(r["ids" + s], np.int64), np.frombuffer(r["copies" + s], np.int64), x, _shadow(x, axes)

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                ids, counts, p, q = _Join(cosine, reach)(side(r, ""), None if r["i"] == r["j"] else side(r, "_"))
                for a, b, n in ((ids, ids, counts), (p, q, np.zeros(len(p), np.int64))):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    kept = ["d", "n", "ids", "copies", "vectors"]
    left = blocks.select(F.col("block").alias("i"), *kept)
    right = blocks.select(F.col("block").alias("j"), *(F.col(c).alias(c + "_") for c in kept[1:]))
    rows = pairs.repartition("i", "j").join(left.hint("merge"), "i").join(right.hint("merge"), "j")
    return stored(rows.repartition("i", "j").mapInArrow(join, "a long, b long, n long"), "ego-links")


def similar_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row of vectors.

    A vector that is null, empty, zero or holds a null or non-finite number links with nothing; vectors of different lengths
    don't link. Equal vectors are joined as one, with their number. A null id names a component only if all its ids are null.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine is in (0, 1]")
    reach = 2 - 2 * cosine + 1e-9
    kind = vectors.schema[vector_col].dataType
    kind = kind if isinstance(kind.elementType, T.FloatType | T.DoubleType) else T.ArrayType(T.DoubleType())
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.col("v").isNotNull() & F.forall("v", number) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    v = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind.elementType)).otherwise(x))  # -0.0 is 0.0
    good = rows.where("usable").select("vec_id", v.alias("v"))
    classes = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "ego-classes")

    axes = principal_axes(classes)
    blocks = _blocks(classes, axes, reach**0.5, block)
    links = _joined(_near_blocks(blocks, reach), blocks, axes, cosine, reach)
    counts = links.where("n > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(links.where("n = 0").select("a", "b")).select(F.col("node").alias("cid"), "root")
    found = classes.join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    found = stored(found.select("v", "least", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "ego-found")
    named = found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("v", "n_links", "component_id")
    linked = good.join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
