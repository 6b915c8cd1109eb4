"""Bootstraps against loops over documents and replicates, gates and operators on small tables."""

import hashlib
import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bootstrap
from tessera.operators.agreement import bridge
from tessera.operators.clustering import rand_index
from tessera.plans import registry, validation
from tessera.plans.vocabulary import CLASSES, LETTERS

DIR = "/root/testdata/sf0.001"
DOCS = [(1, "en", "The cat sat; a cat ran."), (2, "en", "A banana and an apple, apple pie"), (3, None, "no language"), (4, "de", "Übel über übel äß"), (5, "en", None), (6, "de", ""), (None, "en", "ill eel ox ox ox"), (2, "en", "x")]


def count(i, r, seed):
    h = hashlib.md5(f"{seed}|{(r - 1) // 4}|{'' if i is None else i}".encode()).hexdigest()
    u = int(h[8 * ((r - 1) % 4) :][:8], 16) / 4294967296
    return sum(u >= p for p in bootstrap.POISSON)


def cells(text, contexts):
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        if len(w) > 1:
            for k, s in enumerate(w):
                if contexts:
                    yield s, "L:" + (w[k - 1] if k else "<BOS>")
                    yield s, "R:" + (w[k + 1] if k + 1 < len(w) else "<EOS>")
                else:
                    yield s, "initial" if k == 0 else "final" if k == len(w) - 1 else "medial"


def looped(docs, replicates, seed, contexts):
    total = {}
    for i, lang, text in docs:
        w = [1] + [count(i, r, seed) for r in range(1, replicates + 1)]
        for (s, c), n in Counter(cells(text, contexts)).items():
            total[lang, s, c] = [a + n * b for a, b in zip(total.get((lang, s, c), [0] * len(w)), w, strict=True)]
    return total


@pytest.mark.parametrize(("contexts", "docs", "entries", "held"), [(False, 256, 1 << 22, 1 << 15), (True, 3, 40, 5)])
def test_counts_of_all_replicates(spark, monkeypatch, contexts, docs, entries, held):
    for name, value in (("DOCS", docs), ("ENTRIES", entries), ("HELD", held)):
        monkeypatch.setattr(bootstrap, name, value)
    df = spark.createDataFrame(DOCS, "doc_id long, lang string, text string").repartition(3)
    got = {(r.lang, r.sign, r.cell): r.v for r in bootstrap.letter_counts(df, 13, "s", contexts).collect()}
    assert got == looped(DOCS, 13, "s", contexts)
    assert bootstrap.letter_counts(df.limit(0), 13, "s", contexts).count() == 0


def tail(k, n, p, upper):
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p))
    return math.fsum(term(i) for i in (range(k, n + 1) if upper else range(k + 1)))


def test_vowel_interval(spark):
    docs = [(i, "en" if i % 3 else "de", "away over ends over the away into at all " * (1 + i % 4) + "kitten butter bottle " * (i % 5)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    total, want = looped(docs, 40, "vowels", False), {}
    for lang in ("de", "en"):
        found = []
        for r in range(41):
            signs = {}
            for (of, s, c), v in total.items():
                if of == lang and v[r]:
                    x = signs.setdefault(s, Counter())
                    x[c] += v[r]
            whole = sum(x.total() for x in signs.values())
            p0, m0 = (sum(x[c] for x in signs.values()) / whole for c in ("initial", "medial"))
            tested = [x for x in signs.values() if x.total() >= 15]
            limit = 0.05 / max(1, len(tested))
            found.append(sum(tail(x["initial"], x.total(), p0, True) < limit and tail(x["medial"], x.total(), m0, False) < limit for x in tested))
        low, high = np.percentile(found[1:], [2.5, 97.5])
        want[lang] = (found[0], 40, int(low), int(high))
    got = {r.lang: tuple(r)[1:] for r in validation.vowel_interval(df, 40).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_rand_interval(spark):
    docs = [(i, "en", "banana papaya tomato kettle supper dinner " * (1 + i % 3) + "zebra fig lemon " * (i % 4)) for i in range(12)]
    total, aris, truth = looped(docs, 20, "rand", True), [], dict(zip(LETTERS, CLASSES, strict=True))
    for r in range(21):
        table = {}
        for (_, s, c), v in total.items():
            if v[r]:
                table.setdefault(s, Counter())[c] += v[r]
        signs, contexts = sorted(s for s in table if s in truth), sorted({c for x in table.values() for c in x})
        labels = validation.context_classes(signs, np.array([[table[s][c] for c in contexts] for s in signs], float))
        aris.append(rand_index(labels, np.array([truth[s] for s in signs])))
    [row] = validation.rand_interval(spark.createDataFrame(docs, "doc_id long, lang string, text string"), 20).collect()
    assert (row.lang, row.signs, row.replicates) == ("en", len(signs), 20)
    assert [row.ari, row.low, row.middle, row.high] == pytest.approx([aris[0], *np.percentile(aris[1:], [2.5, 50, 97.5])], abs=2e-6)
    assert row.low < row.high


def test_weights_are_poisson():
    w = bootstrap.weights(list(range(400)), 101, "x")
    assert w.shape == (400, 102) and (w[:, 0] == 1).all()
    assert abs(w[:, 1:].mean() - 1) < 0.02 and abs(w[:, 1:].var() - 1) < 0.03
    assert (bootstrap.weights([7], 101, "x") == w[7]).all()


def test_gates_tell_planted_pairs_from_permuted_ones(spark, tmp_path):
    """Long words of many shapes: those planted are found again, permuted and random ones are not."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list(LETTERS), p=[1 / 26] * 26) for _ in range(rng.integers(6, 9)))
    texts = [(i, " ".join(word() for _ in range(60)), ("de", "fr", "en")[i % 3], "s") for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.gate, r.lang): r for r in registry.queries()["p5_validation_gates"](spark, str(tmp_path)).collect()}
    assert set(got) == {(g, x) for g in ("recovery", "permuted", "control", "expected", "unique") for x in ("de", "fr")}
    assert all(r.passed for r in got.values()) and all(r.tests > 100 for r in got.values())
    assert got["recovery", "de"].share == 1 and got["permuted", "de"].hits == 0
    queries = registry.queries()["p5_gate_queries"](spark, str(tmp_path))
    assert queries.where("gate = 'recovery' AND ned > 0").count() == 0
    assert queries.where("gate = 'permuted'").where(F.sort_array(F.split("q", "")) != F.sort_array(F.split("expected", ""))).count() == 0
    assert all(a <= b for a, b in pairwise(r.q_value for r in queries.where("gate = 'recovery' AND lang = 'de'").orderBy("p", "q_value").collect()))


def test_bridge_and_its_conflicts(spark):
    """Codes of two known readings take the later one's value; without a known reading, a code, a reading or a value there is no row."""
    inventory = spark.createDataFrame([("a", ["A1", "A2", "A1", None]), ("b", ["A2"]), ("c", ["A3"]), (None, ["A4"]), ("d", None), ("e", ["A2", "A5"])], "reading string, codes array<string>")
    anchors = spark.createDataFrame([("a", "x", 1), ("b", "y", 3), ("e", "y", 3), ("d", "z", 9), ("c", None, 4), (None, "q", 5)], "reading string, value string, nth int")
    got = {r.code: (r.value, r.reading, r.readings, r.contested) for r in bridge(inventory, anchors).collect()}
    assert got == {"A1": ("x", "a", 1, False), "A2": ("y", "e", 3, True), "A5": ("y", "e", 1, False)}
    assert bridge(inventory.limit(0), anchors).count() == 0 == bridge(inventory, anchors.limit(0)).count()


def test_override_keeps_statistics(spark):
    rows = {(r.lang, r.sign): r for r in registry.queries()["p1_vowel_override"](spark, DIR).collect()}
    tested = {(r.lang, r.sign): r for r in registry.queries()["p1_vowel_enrichment"](spark, DIR).collect()}
    assert {x for _, x in rows} == set(validation.VOWELS) and len(rows) == len(validation.VOWELS) * len({lang for lang, _ in rows})
    for key, r in rows.items():
        t = tested.get(key)
        assert r.tested == (t is not None) and (r.total, r.detected) == ((t.total, t.is_vowel) if t else (max(r.total, 1), False))
        assert r.confidence == pytest.approx(min(1, t.enrichment / 3) if t else 0.5, abs=1e-6)


def test_replicates_are_counted_by_several_tasks(spark, tmp_path):
    """A file of one row group was counted in one task; weights are those of the plain comparison with each share."""
    import numpy as np

    from tessera.operators import bootstrap

    spark.range(4000).selectExpr("id AS doc_id", "'en' AS lang", "'some words ' || id AS text").coalesce(1).write.parquet(f"{tmp_path}/d")
    plan = bootstrap.letter_counts(spark.read.parquet(f"{tmp_path}/d"), 4, "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" in plan[plan.rindex("MapInArrow") :]
    u = np.frombuffer(b"".join(bootstrap.hashlib.md5(f"x|{b}|{i}".encode()).digest() for i in range(50) for b in range(5)), ">u4").reshape(50, -1) / 4294967296
    assert (bootstrap.weights(list(range(50)), 20, "x")[:, 1:] == (u[..., None] >= np.array(bootstrap.POISSON)).sum(2)).all()
