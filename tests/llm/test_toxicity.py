import math
import random
import time

from tessera.llm import toxicity

PLAIN = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "vu", "zelig")]


def slow_segments(scores):
    """Recursively the leftmost best segment, then the rest on either side: what the linear scan must give."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j + 1)
    if best is None:
        return []
    return [*slow_segments(scores[: best[1]]), best, *[(s, a + best[2], b + best[2]) for s, a, b in slow_segments(scores[best[2] :])]]


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 40)
        hits = [(i, round(rng.uniform(-2, 4), 6) or 1.0) for i in range(n) if rng.random() < 0.5]
        scores = [dict(hits).get(i, -0.53) for i in range(n)]
        got = toxicity.maximal_segments(hits, -0.53)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in slow_segments(scores)]
        assert all(abs(sum(scores[a:b]) - s) < 1e-9 for s, a, b in got)


def test_the_scan_is_linear():
    for hits in ([(20 * i, 3.0) for i in range(100_000)], [(i, 1.0 + i % 7 - 3.9 * (i % 2)) for i in range(100_000)], [(2 * i, 100_000.0 - i) for i in range(100_000)]):
        began = time.time()
        toxicity.maximal_segments(hits, -0.5)
        assert time.time() - began < 1


def test_tail_is_a_bound(spark):
    """Never below the exact binomial tail, on either side."""
    from pyspark.sql import functions as F

    rows = [(a, b) for a in range(12) for b in range(12) if a + b]
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", toxicity._tail(F.col("a"), F.col("b"), F.lit(0.3), F.lit(0.2)).alias("p")).collect():
        n, side = r.a + r.b, 0.3 if r.a / (r.a + r.b) > 0.3 else 0.2
        more = range(r.a, n + 1) if side == 0.3 else range(r.a + 1)
        exact = sum(math.comb(n, k) * side**k * (1 - side) ** (n - k) for k in more)
        assert r.p is None if 0.2 <= r.a / n <= 0.3 else math.exp(r.p) >= exact - 1e-12


def test_copies_teach_once(spark):
    """Words of one document with many near copies don't become toxic, words that many documents share do."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(PLAIN, k=60) + (["scumbag"] if i % 8 == 0 else [])), int(i % 8 == 0)) for i in range(400)]
    one = [*rng.choices(PLAIN, k=80), "harmless", "pebble"]
    rows += [(1000 + i, " ".join([*one[: i % 80], "".join(rng.choices("xyz", k=6)), *one[i % 80 + 1 :]]), 1) for i in range(40)]
    model = toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id long, toxic int"))
    assert model.odds["scumbag"] > 3 and {"harmless", "pebble"}.isdisjoint(model.odds) and model.token_score("baka") == 0


def test_learns_and_holds_out(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        words = rng.choices(PLAIN, k=rng.randint(20, 120))
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "moronish", "scumbag", "vileness"]) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(1, None), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).select("row.doc_id", "score", "predicted", "passages").collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.97 * len(held) and 0 < model.cut <= 0.5


def test_odd_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(0, 1), (7, 0), (8, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(documents, toxicity.train(documents, labels))
    assert out.count() == documents.count() and out.select("row.*").columns == documents.columns
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.collect())
    none = toxicity.train(documents, labels.limit(0))
    assert {r.predicted for r in toxicity.score(documents, none).collect()} == {0}
    assert toxicity.score(nothing, none).count() == 0


def test_cut():
    import numpy as np

    y = np.array([0] * 200 + [1] * 4)
    assert toxicity._cut(np.array([0.01] * 200 + [0.9] * 4), y, 0.005) == 0.5
    assert toxicity._cut(np.array([0.01] * 199 + [0.3] + [0.2, 0.4, 0.6, 0.9]), y, 0.005) == 0.01
    assert toxicity._cut(np.array([0.01] * 190 + [0.3] * 10 + [0.2, 0.4, 0.6, 0.9]), y, 0.005) == 0.3


def test_counts_go_on_before_a_task_holds_all(spark, monkeypatch):
    """The same model, whether a task hands its counts on at once or at its end; before, it held all of them."""
    import random

    from tessera.llm import toxicity

    draw = random.Random(5)
    some = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    docs = spark.createDataFrame([(i, f"{some()} {'venomous slur' if i % 3 == 0 else 'kind note'}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "_COUNTED", 10)
    parts = toxicity.train(docs, labels)
    assert whole.odds == parts.odds and whole.odds and whole.cut == parts.cut


def test_a_task_holds_the_tokens_of_one_text():
    """Sketches of a batch take far less memory than its tokens, which were all held at once before."""
    import tracemalloc

    import pyarrow as pa

    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda i: " ".join(letters[i % 26] + letters[j % 26] + letters[j // 26 % 26] * (j // 676 + 1) for j in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([0] * 200), pa.array([text(i) for i in range(200)])], names=["h", "toxic", "text"])
    tracemalloc.start()
    (got,) = toxicity._sketches(iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4_000_000  # 400,000 tokens of 50 bytes and more
    assert set(got["n"].to_pylist()) == {2000} and got.num_rows == 200
