import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import onebit


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k, of=20):
    out = []
    for at, (i, q) in enumerate(rows):
        if i is None or i % of or not usable(q):
            continue
        scores = []
        for other, (j, v) in enumerate(rows):
            if other == at or not usable(v) or len(v) != len(q):
                continue
            total = 0.0
            for x, y in zip(q, v, strict=True):
                total += float(x) * float(y)
            scores.append((-total if total == total else float("inf"), j is None, j or 0, j, total if total == total else float("-inf")))
        out += [(i, n + 1, j, s) for n, (_, _, _, j, s) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def data(seed=3, n=700, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(i, (centres[i % 12] * rng.choice([0, 0.4]) + rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(2000 + i, rows[20][1]) for i in range(70)] + [(2010, rows[20][1]), (2020, rows[20][1])]  # many copies, repeated rows
    rows += [(3000, None), (3020, []), (3040, [0.0] * d), (3060, [float("nan")] + [1.0] * (d - 1)), (3080, [float("inf")] + [1.0] * (d - 1)), (3100, [None] + [1.0] * (d - 1))]
    rows += [(None, rows[40][1]), (4000, [1.0, 2.0]), (4001, [2.0, 4.0]), (4020, [-0.0, 1.0]), (4040, [0.0, 1.0]), (4060, [5.0]), (-20, rows[60][1])]
    return rows


def found(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(i, v, "x", 1, 2.0, []) for i, v in rows], f"vec_id long, embedding array<{kind}>, v string, row int, score double, ids array<long>")
    return sorted(map(tuple, onebit.nearest_vectors(df, F.col("vec_id") % 20 == 0, **options).collect()), key=str)


@pytest.mark.parametrize(("tile", "fit_rows", "query_bytes"), [(1024, 20_000, 32 << 20), (64, 300, 24 * 8 * 20), (64, 10, 24 * 8 * 20)])
def test_against_brute_force(spark, monkeypatch, tile, fit_rows, query_bytes):
    for name, value in (("TILE", tile), ("FIT_ROWS", fit_rows), ("QUERY_BYTES", query_bytes)):
        monkeypatch.setattr(onebit, name, value)
    rows = data()
    assert found(spark, rows, k=20) == brute(rows, 20)


def test_empty_few_and_extreme(spark):
    rows = [(0, [1e200, 1.0]), (20, [1e200, -1e200]), (1, [3.0, 4.0]), (2, [-1e200, 1e200]), (3, [1e-300, 0.0])]
    assert found(spark, rows, "double", k=3) == brute(rows, 3)
    assert found(spark, rows[:0], "double") == []
    assert found(spark, [(0, [1.0])], "double") == []
    assert found(spark, [(0, [1.0]), (20, [1.0])], "double") == [(0, 1, 20, 1.0), (20, 1, 0, 1.0)]
    rng = np.random.default_rng(0)  # ties between different vectors
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(300)]
    assert found(spark, rows, "double", k=7) == brute(rows, 7)


@pytest.mark.parametrize("d", [3, 64, 300])
def test_errors_of_estimates(d):
    """The stated error is that of the estimates: about a normal deviate, and 4 of them cover all of these."""
    rng = np.random.default_rng(d)
    x, q, centre, turn = rng.normal(size=(3000, d)), rng.normal(size=(50, d)), rng.normal(size=d) * 0.1, onebit.frame(d)
    bits, length, along = onebit.encode(x, centre, turn)
    assert bits.shape[1] * 8 == max(256, -(-d // 64) * 64)
    size = np.linalg.norm(q, axis=1)[:, None]
    guess, error = onebit.estimates((q / size @ turn.T).astype(np.float32), bits, length, along, 1.0)
    off = (guess - q / size @ (x - centre).T) / error
    assert np.abs(off).max() < 4.8 and 0.3 < off.std() < 1.1


def test_few_are_reranked():
    """On vectors without any structure, the hardest case, the bounds leave out most."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn, centre = onebit.frame(64), np.zeros(64)
    bits, length, along = onebit.encode(x, centre, turn)
    n = np.arange(len(x))
    floor = onebit._floors(x[:100], x[:5000], 21)
    guess, error = onebit.estimates((x[:100] @ turn.T).astype(np.float32), bits, length, along, onebit.SPREAD)
    assert (guess + error >= floor[:, None]).mean() < 0.2
    [(_, best)] = onebit.scan(x[:100], floor, iter([(x, bits, length, along, n, n * 0 + 1, n, n)]), centre, turn, 21)
    want = [set(np.argsort(-(x[q] @ x.T))[:21].tolist()) for q in range(100)]
    assert np.mean([len(set(best.row[best.q == q].tolist()) & want[q]) / 21 for q in range(100)]) > 0.999
