import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components


def slow_fingerprint(text):
    words = "".join(c.lower() if c < "\x80" else c for c in text or "").split(" ")
    words = [w for x in words for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", x)]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        rng, masks = random.Random(radius), simhash.masks(radius)
        assert len(masks) == (1 << (radius + 1)) - 1
        for _ in range(2000):
            bits = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(m & bits == 0 for m in masks)


def test_fingerprints(documents):
    got = simhash.fingerprints(documents).collect()
    want = sorted(slow_fingerprint(r.text) for r in documents.collect())
    assert sorted(np.array([r.fp for r in got], np.int64).view(np.uint64).tolist()) == want


def test_links_are_whole_with_large_buckets_split(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = [centre]
    for _ in range(300):  # a chain and a cloud around it
        fps.append(rng.choice(fps) ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))))
    fps += [rng.getrandbits(64) for _ in range(50)]
    distinct = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in distinct], "fp long")
    want = slow_components(distinct)
    for part in (4096, 20):
        roots = {r.node: r.root for r in components(simhash.near_edges(df, part=part)).collect()}
        of = [roots.get(int(np.uint64(f).astype(np.int64)), int(np.uint64(f).astype(np.int64))) for f in distinct]
        pairs = {}
        assert all(pairs.setdefault(w, g) == g for w, g in zip(want, of, strict=True)) and len(set(of)) == len(set(want))


def test_documents(documents, nothing):
    got = {}
    for r in simhash.near_duplicates(documents).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got[1] == got[2] == got[0] == {0} and got[3] == got[4] == got[5] == {3}
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_of_each(documents, nothing):
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == [0, 3, 6, 6, 7, 8, 9, 10, 11] and kept.where("doc_id is null").count() == 1
    assert simhash.one_of_each(nothing).count() == 0


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert len(got) == n + 2 and {got[x] for x in range(n)} == {0} and got[1001] == 1000
    assert components(edges.limit(0)).count() == 0


def test_groups_meet_rows_by_broadcast_and_by_salted_shuffle(spark):
    rows = spark.createDataFrame([(i, None if i % 50 == 7 else i % 3 if i < 900 else i, i % 11) for i in range(1000)], "doc_id long, root long, th long")
    groups = rows.groupBy("root").count().where("count > 1 AND root IS NOT NULL")
    plain = list(map(tuple, rows.join(groups, "root", "left").select("doc_id", "root", "th", "count").collect()))
    for limit in (10, 0):
        got = simhash.with_group(rows, groups, "root", ("doc_id", "th"), limit).select("doc_id", "root", "th", "count").collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain, key=str)
