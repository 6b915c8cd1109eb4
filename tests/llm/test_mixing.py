import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix, mixed_documents, targets


def fill(sizes, weights, share, most):
    """By the words of the contract: deal by weight, cut at the most, deal the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), list(names)
    while left > 1e-9 and open_:
        total, spill = sum(w[s] for s in open_), 0.0
        for s in open_:
            out[s] += left * w[s] / total
            if out[s] > most * sizes[s]:
                spill += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
        open_ = [s for s in open_ if out[s] < most * sizes[s] - 1e-12]
        left = spill
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 40, None: 7}, {"x": 3}, {"a": 0, "b": 10, "c": 0}, {"é": 10, "z": 1000, "Z": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n_rows long")
    want = fill(sizes, (3, 1, 2), 1.5, 2.0)
    for r in targets(df, (3, 1, 2), 1.5, 2.0).collect():
        assert abs(r.target - want[r.source]) < 1e-6


def test_budgets_are_exact(spark, documents, nothing):
    rows = spark.createDataFrame([(i, "w " * (i % 37), f"s{i % 3 if i % 2 else 0}") for i in range(900)], "doc_id long, text string, source string")
    for df in (rows, documents):
        got = mix(df)
        again = sorted(map(tuple, got.collect()), key=str)
        assert again == sorted(map(tuple, mix(df.repartition(7)).collect()), key=str)
        by = {}
        for _, size, source_size, target, taken in again:
            assert 0 <= taken <= 2 * size
            a = by.setdefault((source_size, target), [0, 0])
            a[0], a[1] = a[0] + size, a[1] + taken
        assert all(abs(t - target) <= 0.5 * (s // source_size if source_size else 1) for (source_size, target), (s, t) in by.items())
    assert mix(nothing).count() == 0


def test_documents_follow_the_mix(documents):
    df = documents.dropDuplicates(["doc_id"]).where("doc_id is not null")
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = {r.doc_id: r.taken for r in mix(df).collect() if r.taken}
    got = {}
    out = mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
        assert r.n_chars == len(r.text)
    assert got == want


def test_rows_alike_keep_the_budget(spark):
    """Rows of one id and size, some of one text: together they take what the mix gives them, to the word."""
    texts = ["a b c d e f g", "h i j k l m n", "a b c d e f g", "o p q r s t u", "one two three", "x y"]
    rows = [(5, t, "s1") for t in texts] + [(None, t, "s2") for t in texts] + [(i, "p q r s t u v w " * 3, "s3") for i in range(10, 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "length(text) AS n_chars")
    got = {(r.doc_id, r.source): r.n for r in mixed_documents(df).groupBy("doc_id", "source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20]+"), F.lit(0)))).alias("n")).collect()}
    want = {}
    sources = {5: "s1", None: "s2"}
    for r in mix(df).collect():
        key = r.doc_id, sources.get(r.doc_id, "s3")
        want[key] = want.get(key, 0) + r.taken
    assert got == {k: v for k, v in want.items() if v}
