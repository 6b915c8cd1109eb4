"""Column assignment, vowel classes, agreement and containment against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.operators.agreement import agreement
from tessera.operators.clustering import anchored_columns, anti_correlation, rand_index, spectral
from tessera.operators.similarity import first_contained
from tessera.plans.learning import vowel_classes


def assigned(rows, a, anchors, columns, isolated):
    """The rules of anchored_columns one sign at a time."""
    found = {i: c for i, c in anchors.items() if not isolated[i]}
    fixed = dict(found)
    for i in range(len(rows)):
        if i in found or isolated[i] or rows[i] < 0:
            continue
        own = {c: [a[i][j] for j in fixed if fixed[j] == c and rows[j] == rows[i]] for c in range(columns)}
        mean = [sum(v) / len(v) if v else 0 for v in own.values()]
        if sum(mean) > 0:
            found[i] = mean.index(min(mean))
            continue
        near = [0.0] * columns
        for j, c in fixed.items():
            whole = sum(max(x, y) for x, y in zip(a[i], a[j], strict=True))
            if rows[j] != rows[i] and whole > 0:
                near[c] += sum(min(x, y) for x, y in zip(a[i], a[j], strict=True)) / whole
        if sum(near) > 0:
            found[i] = near.index(max(near))
        else:
            filled = [sum(v == c for v in found.values()) for c in range(columns)]
            found[i] = filled.index(min(filled))
    return [found.get(i, -1) for i in range(len(rows))]


def test_columns_by_every_rule():
    kinds = Counter()
    for seed in range(200):
        rng = np.random.default_rng(seed)
        n, columns = int(rng.integers(4, 14)), int(rng.integers(2, 5))
        a = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < rng.choice([0.1, 0.4, 0.9]))
        a = np.triu(a, 1) + np.triu(a, 1).T
        rows, isolated = rng.integers(-1, 3, n), rng.random(n) < 0.15
        anchors = {int(i): int(rng.integers(columns)) for i in rng.choice(n, rng.integers(1, 4), replace=False)}
        if all(isolated[i] for i in anchors):
            continue
        got = anchored_columns(rows, a.astype(float), anchors, columns, isolated).tolist()
        assert got == assigned(rows.tolist(), a.tolist(), anchors, columns, isolated.tolist())
        kinds.update(got)
    assert kinds[-1] and kinds[0] and kinds[3]


def test_columns_of_small_cases():
    a = np.zeros((5, 5))
    a[1, 2] = a[2, 1] = 3.0
    rows = np.array([0, 0, 0, 1, -1])
    assert anchored_columns(rows, a, {1: 0}, 2).tolist() == [1, 0, 1, 0, -1]  # least filled, given, least alternation, least filled
    assert anchored_columns(rows, a, {}, 2, frequency=np.array([1, 5, 5, 0, 9])).tolist() == [0, 0, 1, 0, -1]  # in turn by frequency
    a[3, 2] = a[2, 3] = 1.0
    assert anchored_columns(rows, a, {1: 1}, 2)[3] == 1  # alike with the anchor of another row
    assert anchored_columns(np.array([], int), np.zeros((0, 0)), {}, 3).tolist() == []


def test_vowel_classes_against_a_direct_decomposition(spark):
    rng = np.random.default_rng(2)
    n, groups = 12, np.arange(12) % 3
    right = np.where(groups[:, None] == groups[None], 0.8, 0.2) + rng.random((n, n)) * 0.05
    left = rng.random((n, n)) * 0.5
    right, left = (np.round((m + m.T) / 2, 6) for m in (right, left))
    pairs = [(f"s{i:02}", f"s{j:02}", float(right[i, j]), float(left[i, j])) for i in range(n) for j in range(i + 1, n)]
    table = lambda k: spark.createDataFrame([("x", a, b, p[k]) for a, b, *p in pairs], "lang string, a string, b string, similarity double")
    got = {r.sign: r.vowel_class for r in vowel_classes(table(0), table(1), 3).collect()}
    np.fill_diagonal(right, 1)
    np.fill_diagonal(left, 1)
    affinity = right - 0.15 * left
    affinity = (affinity - affinity.min()) / (affinity.max() - affinity.min())
    np.fill_diagonal(affinity, 0)
    assert np.allclose(affinity, anti_correlation(right, left))
    root = 1 / np.sqrt(affinity.sum(1))
    values, vectors = np.linalg.eigh(root[:, None] * affinity * root[None])
    lead = vectors[:, np.argsort(-values)[:3]]
    lead /= np.linalg.norm(lead, axis=1, keepdims=True)
    near = (lead @ lead.T) > 0.5  # rows of one class point the same way
    labels = np.array([got[f"s{i:02}"] for i in range(n)])
    assert ((labels[:, None] == labels[None]) == near).all() and rand_index(labels, groups) == 1
    assert spectral(anti_correlation(right, left), 3)[1] == 3
    assert anti_correlation(np.ones((2, 2)), np.ones((2, 2))).tolist() == [[0, 1], [1, 0]]


def test_missing_pairs_count_as_unlike(spark):
    one = spark.createDataFrame([("x", "a", "b", 0.9), ("x", "c", "d", 0.9)], "lang string, a string, b string, similarity double")
    got = {r.sign: r.vowel_class for r in vowel_classes(one, one.limit(0), 2).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]
    assert vowel_classes(one.limit(0), one.limit(0)).collect() == []


def test_agreement(spark):
    rng = random.Random(3)
    pairs = [(g, rng.choice([1, 2, 3, None]), rng.choice("pqr")) for g in "ab" for _ in range(25)] + [("c", 1, "p"), ("a", 1, None)]
    got = {(r.g, r.label): r for r in agreement(spark.createDataFrame(pairs, "g string, label int, truth string"), ["g"], "label", "truth").collect()}
    for g in "abc":
        own = [(x, t) for h, x, t in pairs if h == g and x is not None and t is not None]
        for label in {x for x, _ in own}:
            n = Counter(t for x, t in own if x == label)
            truth, k = min(n.items(), key=lambda i: (-i[1], i[0]))
            r = got[g, label]
            assert (r.items, r.majority, r.agreeing, r.classes, r.merged) == (n.total(), truth, k, len(n), len(n) > 1)
            assert r.split == sum(len({x for x, t in own if t == c}) > 1 for c in n) and r.rate == pytest.approx(k / n.total(), abs=1e-6)
            assert r.ari == pytest.approx(rand_index(np.array([x for x, _ in own]), np.array([t for _, t in own])), abs=1e-6)


def test_first_contained(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    strings = [word() for _ in range(150)] + [None, "", "ab", "ab"]
    anchors = [(w, rng.randint(0, 5)) for w in dict.fromkeys(word() for _ in range(60))] + [(None, 0)]
    sdf, adf = spark.createDataFrame([(s, 1) for s in strings], "s string, hit2 int"), spark.createDataFrame(anchors, "a string, rank int")
    out = first_contained(sdf, adf, "s", "a", ["rank"], longest=3)
    got = sorted(((r.s, None if r.hit is None else r.hit.a) for r in out.collect()), key=str)
    held = [(a, k) for a, k in anchors if a]
    want = [(s, min(((a != s, k, a) for a, k in held if a in s), default=(0, 0, None))[2] if s else None) for s in strings]
    assert got == sorted(want, key=str) and any(a for _, a in got)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert first_contained(sdf, adf.limit(0), "s", "a", ["rank"]).where("hit IS NOT NULL").count() == 0
