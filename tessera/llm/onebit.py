"""Nearest neighbours by largest inner product, over randomly rotated one-bit codes.

Each vector, less a common centre, is turned by a random frame into `bits` coordinates, of which only the signs are kept, packed,
with correction scalars: the length that was divided out and how far the signs' vector points along the turned one. From these a
query's inner product with the vector is estimated, with an error that has a known spread; only vectors whose estimate plus
`spread` times that error reaches the query's best so far are reranked by the exact product.

Queries are dealt into groups that fit a task, vectors into as many columns as the cluster has use for; a task holds a group of
queries and streams a column of codes past it. Equal vectors are one code, equal queries one search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import about, stored, with_group

#: Bits of a code at least (more if the vectors have more dimensions), errors added to an estimate, seed of the frame.
BITS, SPREAD, SEED = 256, 4.0, 12
#: About so many vectors, of so many bytes at most, are a sample: its mean is the centre, and a query's k-th best in it is where its
#: search starts from. Both save work and change no result.
FIT_ROWS, FIT_BYTES = 20_000, 16 << 20
#: Bytes of the queries that a task holds; vectors and queries estimated at a time; pairs reranked at a time.
QUERY_BYTES, TILE, PAIRS = 32 << 20, 1024, 1 << 15
_NO_ID = (1 << 63) - 1


def frame(d: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """bits x d, its columns orthonormal and random."""
    bits = -(-max(d, bits) // 64) * 64
    return np.linalg.qr(np.random.default_rng([seed, d]).normal(size=(bits, d)))[0]


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length of the residual and share of the signs' vector along it (1 for a vector that is the centre)."""
    x = vectors - centre
    most = np.abs(x).max(axis=1)
    unit = x / np.where(most > 0, most, 1)[:, None]
    norm = np.linalg.norm(unit, axis=1)
    unit /= np.where(norm > 0, norm, 1)[:, None]
    turned = unit @ turn.T
    along = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), most * norm, np.where(norm > 0, along, 1)


def estimates(turned: np.ndarray, bits: np.ndarray, length: np.ndarray, along: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit queries (turned into the frame, single precision; a row a query) with the vectors less the
    centre, and what each vector's may fall short by."""
    n_bits = turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=n_bits).astype(np.float32) * 2 - 1
    signs *= (length / along / np.sqrt(n_bits)).astype(np.float32)[:, None]
    error = length * (spread * np.sqrt(np.maximum(0, 1 - along**2) / (n_bits - 1)) / along + 1e-5)
    return turned @ signs.T, error.astype(np.float32)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from first to last in double precision; what is no number counts as lowest."""
    out = np.cumsum(queries * vectors, axis=1)[:, -1]
    return np.where(np.isnan(out), -np.inf, out)


class _Best:
    """The k best rows of each query so far, by score, then id and row; none below the query's floor."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.least = k, floor.copy()
        self.q, self.score, self.id, self.row = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        q, score, ids, rows = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids), (self.row, rows)))
        by = np.lexsort((rows, ids, -score, q))
        q = q[by]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        nth = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        stay, last = nth < self.k, nth[nth < self.k] == self.k - 1
        by = by[stay]
        self.q, self.score, self.id, self.row = q[stay], score[by], ids[by], rows[by]
        self.least[self.q[last]] = np.maximum(self.least[self.q[last]], self.score[last])


class _Tile:
    """Some queries and what they have found."""

    def __init__(self, queries: np.ndarray, floor: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int):
        size = np.linalg.norm(queries, axis=1)
        self.size = np.where((size > 0) & np.isfinite(size), size, 1)
        self.queries, self.single, self.best = queries, queries.astype(np.float32), _Best(floor, k)
        self.turned, self.centred = (queries / self.size[:, None] @ turn.T).astype(np.float32), queries @ centre

    def bar(self) -> np.ndarray:
        """What a unit query's product with a residual must reach; a little less, for rounding."""
        least = self.best.least
        return ((least - self.centred - 1e-6 * (np.abs(least) + np.abs(self.centred))) / self.size).astype(np.float32)

    def scan(self, vectors, bits, length, along, begins, n, ids, rows, spread: float) -> None:
        guess, error = estimates(self.turned, bits, length, along, spread)
        guess += error
        q, v = np.nonzero(~(guess < self.bar()[:, None]))  # what is no number is reranked
        single = vectors.astype(np.float32)
        norm = np.abs(single).max(axis=1, initial=0) * vectors.shape[1]
        for s in range(0, len(q), PAIRS):
            x, y = q[s : s + PAIRS], v[s : s + PAIRS]
            near = np.einsum("ij,ij->i", self.single[x], single[y])
            some = ~(near < self.best.least[x] - 1e-5 * self.size[x] * norm[y])  # single precision first
            x, y = x[some], y[some]
            score = exact(self.queries[x], vectors[y])
            some = score >= self.best.least[x]
            x, y, score = x[some], y[some], score[some]
            m = n[y]
            at = np.repeat(begins[y] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            self.best.add(np.repeat(x, m), np.repeat(score, m), ids[at], rows[at])


def scan(queries: np.ndarray, floor: np.ndarray, blocks: Iterator[tuple], centre: np.ndarray, turn: np.ndarray, k: int, spread: float = SPREAD) -> Iterator[tuple]:
    """blocks: (vectors, packed bits, length, along, first of its ids, number of ids, ids, rows). floor: a score that each query's
    k-th best reaches. Yields (first query, best) for each tile of queries."""
    with np.errstate(all="ignore"):
        tiles = [_Tile(queries[a : a + TILE], floor[a : a + TILE], centre, turn, k) for a in range(0, len(queries), TILE)]
        for *each, ids, rows in blocks:
            for a in range(0, len(each[0]), TILE):
                for tile in tiles:
                    tile.scan(*(x[a : a + TILE] for x in each), ids, rows, spread)
    return ((i * TILE, tile.best) for i, tile in enumerate(tiles))


def _classes(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """cid, v, asks (whether a query has this vector), ids (the k + 1 least, by id and row): a stored row for each different vector.

    Of copies, which tie in every search, only the k + 1 of least id can be among k neighbours of any row, itself left out. They are
    found within each task first, so a vector of very many copies is in no one task."""
    order = Window.partitionBy("v").orderBy("id", "row")
    few = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    ids = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("ids"))
    asks = rows.where(is_query).select("v").distinct().withColumn("asks", F.lit(True))
    found = ids.join(asks, "v", "left").select("v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    return stored(found.withColumn("cid", F.monotonically_increasing_id()), "onebit-classes")


def _sample(classes: DataFrame) -> dict[int, np.ndarray]:
    """By length, the vectors of a bounded sample."""
    d = classes.agg(F.max(F.size("v"))).first()[0]
    if not d:
        return {}
    lists = about(classes, max(1, min(FIT_ROWS, FIT_BYTES // (8 * d))), F.col("v")).select("v").toArrow()["v"].combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    flat, ends = lists.flatten().to_numpy().astype(float), np.cumsum(sizes)
    return {int(d): flat[(ends - sizes)[sizes == d][:, None] + np.arange(d)] for d in np.unique(sizes)}


def _centres(sample: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    with np.errstate(all="ignore"):
        means = {d: x[np.lexsort(x.T)].mean(axis=0) for d, x in sample.items()}
    return {d: c if np.isfinite(c).all() else np.zeros(d) for d, c in means.items()}


def _floors(queries: np.ndarray, sample: np.ndarray | None, k: int) -> np.ndarray:
    """A little less than each query's k-th best product in the sample."""
    if sample is None or len(sample) < k:
        return np.full(len(queries), -np.inf)
    out = []
    for a in range(0, len(queries), 256):
        x = queries[a : a + 256]
        best = np.partition(x @ sample.T, len(sample) - k, axis=1)[:, len(sample) - k]
        out.append(best - 1e-9 * np.linalg.norm(x, axis=1) * np.abs(sample).max() * sample.shape[1])
    floor = np.concatenate(out) if out else np.empty(0)
    return np.where(np.isfinite(floor), floor, -np.inf)


def _index(classes: DataFrame, sample: dict[int, np.ndarray], centres: dict[int, np.ndarray], bits: int, k: int) -> DataFrame:
    """classes with bits (packed), length and along, every vector's code, and floor, where a query's search starts from; stored."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pc.list_value_length(batch["v"]).to_numpy()
            asks = batch["asks"].to_numpy(zero_copy_only=False)
            packed, length, along, floor = [b""] * len(kinds), np.zeros(len(kinds)), np.ones(len(kinds)), np.full(len(kinds), -np.inf)
            for d in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == d)
                x, asked = _matrix(batch["v"].take(pa.array(at)), d), asks[at]
                with np.errstate(all="ignore"):
                    signs, length[at], along[at] = encode(x, centres.get(d, np.zeros(d)), frame(d, bits))
                    floor[at[asked]] = _floors(x[asked], sample.get(d), k)
                for i, code in zip(at, signs, strict=True):
                    packed[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array(length), pa.array(along), pa.array(floor)], names=[*batch.schema.names, "bits", "length", "along", "floor"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return stored(classes.mapInArrow(code, f"{fields}, bits binary, length double, along double, floor double"), "onebit-index")


def _searched(index: DataFrame, centres: dict[int, np.ndarray], bits: int, k: int, spread: float) -> DataFrame:
    """cid (of a query's vector), score, id, row: the k best rows of each column of vectors, for each different query."""
    dims = F.size("v")
    of = {r[0]: r[1] for r in index.where("asks").groupBy(dims).count().collect()}  # a count for each length of vector
    spark = index.sparkSession
    groups = {d: -(-n * d * 8 // QUERY_BYTES) for d, n in of.items()}
    columns = max(1, -(-2 * spark.sparkContext.defaultParallelism // max([1, sum(groups.values())])))
    number = F.coalesce(*(F.when(dims == d, F.lit(n)) for d, n in groups.items()), F.lit(0)) if groups else F.lit(0)
    place = F.xxhash64("v")
    told = ["d", "g", "c", "kind", "cid", "v", "bits", "length", "along", "floor", "ids"]
    base = index.withColumn("d", dims).withColumn("n", number)
    nothing = {"bits": F.lit(None).cast("binary"), "length": F.lit(0.0), "along": F.lit(1.0), "ids": F.lit(None).cast(index.schema["ids"].dataType)}
    asks = base.where("asks").withColumns({"kind": F.lit(0), "g": F.pmod(place, F.col("n")).cast("int"), "c": F.explode(F.sequence(F.lit(0), F.lit(columns - 1))), **nothing})
    held = base.where("n > 0").withColumns({"kind": F.lit(1), "c": F.pmod(F.shiftright(place, 20), F.lit(columns)).cast("int"), "g": F.explode(F.sequence(F.lit(0), F.col("n") - 1))})
    key = ["d", "g", "c"]
    rows = asks.select(*told).unionByName(held.select(*told)).repartition(*key).sortWithinPartitions(*key, "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (d, _, _), parts in _grouped(batches, key):
            asked, ahead = [], None
            for part in parts:  # queries come first
                cut = int((part["kind"].to_numpy() == 0).sum())
                asked.append((_matrix(part["v"].slice(0, cut), d), part["floor"].to_numpy()[:cut], part["cid"].to_numpy()[:cut]))
                if cut < len(part):
                    ahead = part.slice(cut)
                    break
            queries, floor, cids = map(np.concatenate, zip(*asked, strict=True))
            if not len(cids) or ahead is None:
                continue
            blocks = (_block(p, d) for p in _from(ahead, parts))
            for a, best in scan(queries, floor, blocks, centres.get(d, np.zeros(d)), frame(d, bits), k, spread):
                yield pa.RecordBatch.from_arrays([pa.array(cids[a + best.q]), pa.array(best.score), pa.array(best.id), pa.array(best.row)], names=["cid", "score", "id", "row"])

    return rows.mapInArrow(search, "cid long, score double, id long, row long")


def _from(first, rest) -> Iterator:
    yield first
    yield from rest


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy().astype(float).reshape(-1, d)


def _block(part: pa.RecordBatch, d: int) -> tuple:
    bits = np.array([np.frombuffer(b, np.uint8) for b in part["bits"].to_pylist()])
    ids, n = part["ids"], pc.list_value_length(part["ids"]).to_numpy().astype(np.int64)
    flat = ids.flatten()
    return _matrix(part["v"], d), bits, part["length"].to_numpy(), part["along"].to_numpy(), np.cumsum(n) - n, n, flat.field("id").to_numpy(), flat.field("row").to_numpy()


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple]:
    """(key, its batches) for rows sorted by key; a key's batches are used up before the next key."""

    def pieces() -> Iterator[tuple]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch[c].to_numpy() for c in key])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield tuple(keys[a].tolist()), batch.slice(a, b - a)

    source = pieces()
    ahead = next(source, None)

    def group(of: tuple) -> Iterator[pa.RecordBatch]:
        nonlocal ahead
        while ahead is not None and ahead[0] == of:
            part, ahead = ahead[1], next(source, None)
            yield part

    while ahead is not None:
        of, own = ahead[0], group(ahead[0])
        yield of, own
        for _ in own:
            pass


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 20, bits: int = BITS, spread: float = SPREAD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row of vectors for which is_query (on vec_id) holds.

    Nearness is the inner product in double precision, summed in order; one that is no number (infinities of both signs) counts as
    minus infinity. Nearest first, ties to the smaller vec_id; all others if there are fewer than k. Vectors that are null, empty,
    zero or hold a null or non-finite number take no part, and vectors of different lengths don't meet. A row, not an id, is left
    out of its own search: rows that repeat an id find each other. A null id never asks and comes last among ties.

    A neighbour is missed only where an estimate errs by over `spread` standard errors (about 1 in 30,000 of the hardest ones at 4).
    """
    kind = vectors.schema[vector_col].dataType
    kind = kind if isinstance(kind.elementType, T.FloatType | T.DoubleType) else T.ArrayType(T.DoubleType())
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", number) & F.exists("v", lambda x: x != 0))
    v = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind.elementType)).otherwise(x))  # -0.0 is 0.0
    rows = rows.select(F.coalesce("vec_id", F.lit(_NO_ID)).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "onebit-rows")
    classes = _classes(rows, F.col("asks"), k)
    sample = _sample(classes)
    centres = _centres(sample)
    index = _index(classes, sample, centres, bits, k + 1)
    found = _searched(index, centres, bits, k + 1, spread)
    nth = F.row_number().over(Window.partitionBy("cid").orderBy(F.col("score").desc(), "id", "row"))
    best = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "row", "score"))).alias("best"))
    hits = stored(best.join(index.select("cid", "v"), "cid").select("v", "best"), "onebit-hits")
    asked = with_group(rows.where("asks").select("id", "row", "v"), hits, "v", ("row",), limit=20_000)
    others = F.slice(F.filter("best", lambda b: b["row"] != F.col("row")), 1, k)
    asked = asked.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
    return asked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif("hit.id", F.lit(_NO_ID)).alias("vec_id"), "hit.score")
