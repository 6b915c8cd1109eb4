import numpy as np
import pytest

from tessera.llm import ego


def brute(rows, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i, j] = link[j, i] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(link), strict=True):
            if root[j] < root[i]:
                root[i], changed = root[j], True
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i][0])
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((rows[i][0], int(link[i].sum()), name[root[i]], rows[i][0] == name[root[i]]) for i in range(n)), key=str)


def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.15, 0.4])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (501, rows[0][1]), (502, None), (503, []), (504, [0.0] * 24), (505, [float("nan")] + [1.0] * 23), (506, [float("inf")] + [1.0] * 23), (507, [None] + [1.0] * 23), (508, [1.0, 2.0]), (509, [2.0, 4.0]), (None, rows[1][1]), (510, [-0.0, 1.0]), (511, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize(("leaf", "block"), [(256, 4096), (16, 64)])
def test_against_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(ego, "LEAF", leaf)
    rows = data()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links int, v string")
    assert sorted(map(tuple, ego.similar_vectors(df, 0.95, block=block).collect()), key=str) == brute(rows, 0.95)


def test_empty_and_doubles(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [1e200, 1e200])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ego.similar_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert ego.similar_vectors(df.limit(0)).count() == 0


def test_far_blocks_are_skipped():
    rng = np.random.default_rng(0)
    x = ego._unit(np.concatenate([rng.normal(size=(300, 20)) * 0.01 + e for e in np.eye(20)[:2]]))
    side = lambda a: (np.arange(len(a)), np.ones(len(a), np.int64), a, ego._shadow(a, {}))
    join = ego._Join(0.95, 0.1)
    ids, counts, _, _ = join(side(x[:300]), side(x[300:]))
    assert len(ids) == 0 and counts.sum() == 0
