import hashlib
import math
import re
import zlib

import pytest

from tessera.llm import importance


def brute(docs, target, buckets=10_000, share=(25, 100), least=20, seed=7):
    """The same by loops over one document at a time; nothing is collapsed."""

    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return words, [zlib.crc32(f.encode()) % buckets for f in [*words, *map(" ".join, zip(words, words[1:], strict=False))]]

    def total(texts):
        n = [0] * buckets
        for t in texts:
            for b in features(t)[1]:
                n[b] += 1
        return n

    s, t = total(x for _, x in docs), total(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    ranked = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(ranked[: share[0] * len(ranked) // share[1]])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=str)


def run(spark, docs, target, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1.5 AS weight", "'r' AS rank", "'d' AS digest", "3 AS copies", "0 AS score")
    return sorted(map(tuple, importance.resample(df, target, **options).collect()), key=str)


@pytest.mark.parametrize("many", [500, 2])
def test_against_loops(spark, documents, monkeypatch, many):
    monkeypatch.setattr(importance, "MANY", many)  # with 2 the copies below go by broadcast
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    rows += [(100 + i, f"Text number {i % 37} about Rivers and é{i % 11} boats; " * (1 + i % 9)) for i in range(120)]
    rows += [(300 + i, "many copies of the same words over and over " * 3) for i in range(40)]
    target = ["rivers and boats", None, "", "the same river", "rivers and boats"]
    table = spark.createDataFrame([(t, 7) for t in target], "text string, doc_id int")
    got = run(spark, rows, table)
    assert got == brute(rows, target)
    assert sum(r[4] is not None for r in got) > 20


def test_scores_that_tie_go_to_the_smaller_id(spark):
    noise = {i: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296))) for i in range(3000)}
    rows = [(i, "a b c d " * 5) for i in noise]
    rank = {r[0]: r[4] for r in run(spark, rows, spark.createDataFrame([("x",)], "text string"), share=(1, 2))}
    order = sorted(noise, key=lambda i: (-noise[i], i))
    assert len(set(noise.values())) < 3000
    assert [i for i in sorted((i for i in rank if rank[i]), key=rank.get)] == order[:1500]
    assert sorted(filter(None, rank.values())) == list(range(1, 1501))


def test_empty_tables(spark, nothing):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(nothing, target).collect() == []
    rows = [(1, "one two " * 20), (2, "three four " * 20), (3, ""), (4, None)]
    assert run(spark, rows, target.limit(0)) == brute(rows, [])
