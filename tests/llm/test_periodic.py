import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import periodic, queries


def brute(words, least=6, times=4):
    """Every period is tried at every place."""
    found = []
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            stretch = words[i : j + p]
            smallest = next(q for q in range(1, p + 1) if all(x == y for x, y in zip(stretch, stretch[q:], strict=False)))
            if smallest == p and len(stretch) >= max(least, times * p):
                found.append((i, len(stretch), p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {k for a, n, p in found for k in range(a + p, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts(seed, count, longest):
    rng = random.Random(seed)
    for _ in range(count):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, longest))]
        if words and rng.random() < 0.7:
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            words[a:] = [words[min(a + k % p, len(words) - 1)] for k in range(len(words) - a)]
        yield words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (5, 3), (9, 2)])
def test_kernel_against_all_periods(least, times):
    for seed in range(40):
        held = list(texts(seed, 12, 60))
        words = np.array([ord(w) for ws in held for w in ws], np.int64)
        text = np.repeat(np.arange(len(held)), [len(ws) for ws in held])
        starts = np.cumsum([0, *map(len, held)])
        got = list(zip(*(x.tolist() for x in periodic.runs(words, text, least, times)), strict=True))
        want = [(int(starts[k]) + a, n, p) for k, ws in enumerate(held) for a, n, p in brute(ws, least, times)]
        assert got == want


def test_common_prefixes():
    s = np.array([ord(c) for c in "mississippimississippi"], np.int64)
    suffixes = periodic.Suffixes(s)
    pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
    i, j = map(np.array, zip(*pairs, strict=True))
    same = lambda a, b: next((k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]), 0)
    assert suffixes.common(i, j).tolist() == [same(a, b) for a, b in pairs]
    assert [int(k) for k in np.argsort(suffixes.rank[: len(s)])] == sorted(range(len(s)), key=lambda k: s[k:].tolist())


def test_long_texts_are_chunks_of_their_own():
    words = ["x", "y", "z"] * 100_000
    found, left = periodic._chunk([["a"] * 7, words, ["b"]], 6, 4)
    assert [[tuple(r.values()) for r in f] for f in found] == [[(0, 7, 1)], [(0, 300_000, 3)], []]
    assert left == ["a", "x y z", "b"]


@pytest.mark.parametrize("chunk", [1 << 18, 50])
def test_documents(spark, documents, nothing, monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(1000 + k, " \n".join(ws)) for k, ws in enumerate(texts(5, 60, 80))]
    df = documents.select("doc_id", "text", "row", "size").unionByName(spark.createDataFrame(rows[documents.count() :], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()), key=str)
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute(words) if len(words) < 200 else [(0, len(words), 1)]
        want.append((i, len(words), found, collapsed(words, found)))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(nothing).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "and", "éa", "b", "c"]) for _ in range(rng.randint(0, 70)))) for i in range(150)] + [(None, "a b c d e f g h"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted, want = 0, []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)], planted + 1
        found = brute(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{a},{n},{p}\n" for a, n, p in found)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(collapsed(words, found))))
    out = queries.op11_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert planted > 5 and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
