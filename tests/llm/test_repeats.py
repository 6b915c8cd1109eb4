import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield len(t), int(gone.sum()), int((np.diff([0, *gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()


def rows(seed=5):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcde é") for _ in range(3000))
    out = []
    for i in range(60):
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 2900)
            t += base[a : a + rng.randint(5, 120)] + rng.choice(["", "x", "qq"])
        out.append((i, t))
    return [*out, (100, None), (101, ""), (102, "ab" * 200), (103, out[3][1]), (104, out[3][1]), (104, out[3][1]), (None, "\0" * 100), (106, "a" * 500)]


@pytest.mark.parametrize(("length", "k", "group"), [(20, 8, 200_000), (20, 8, 5), (40, 40, 200_000)])
def test_against_brute_force(spark, length, k, group):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(map(tuple, repeats.remove_repeats(df, length, k, group).collect()), key=str)
    assert got == sorted(((i, *w) for (i, _), w in zip(data, brute([(t or "").encode() for _, t in data], length), strict=True)), key=str)


def test_kept_bytes_and_empty(spark, documents, nothing):
    texts = {r.doc_id: (r.text or "").encode() for r in documents.where("doc_id not in (0, 6)").collect()}
    for r in repeats.remove_repeats(documents, 20, 8, with_text=True).where("doc_id not in (0, 6)").collect():
        assert len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and r.n_bytes == len(texts[r.doc_id])
    assert repeats.remove_repeats(nothing).count() == 0


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    whole = [x.tolist() for x in repeats.anchors(data, 200, 50)]
    monkeypatch.setattr(repeats, "_CHUNK", 700)
    assert [x.tolist() for x in repeats.anchors(data, 200, 50)] == whole
    assert np.diff(whole[0]).max() <= 151
