import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.scalar import sound_classes
from tessera.operators import clustering as C
from tessera.operators import sequences as Q
from tessera.operators import similarity as M


def test_sequences(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "b", "c"]), (2, ["a"]), (3, [])], "id int, s array<string>")
    assert [(r.offset, r.gram) for r in Q.ngrams(df, "s", 2).where("id = 1").collect()] == [(0, ["a", "b"]), (1, ["b", "c"]), (2, ["c", "b"]), (3, ["b", "c"])]
    found = {r.id: r.f for r in df.select("id", Q.find_all(F.col("s"), F.array(F.lit("b"), F.lit("c"))).alias("f")).collect()}
    assert found == {1: [1, 3], 2: [], 3: []}
    cut = df.where("id = 1").select(Q.cut_where(F.col("s"), F.array(F.lit("a b"), F.lit("b c"))).alias("m")).first().m
    assert cut == [["a", "b", "c"], ["b", "c"]]
    words = spark.createDataFrame([("abcd",), ("a",)], "w string")
    assert sorted((r.stem, r.suffix) for r in Q.splits(words, "w", 3).collect()) == [("a", "bcd"), ("ab", "cd"), ("abc", "d")]


def test_windows(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 4, 2), (1, 5, 3), (2, 7, None)], "g int, p int, v long")
    got = sorted((r.g, r.first, r.last, r.n, r.total, r.unparsed) for r in Q.runs(df, ["g"], "p", "v").collect())
    assert got == [(1, 0, 1, 2, 5, True), (1, 4, 5, 2, 5, False), (2, 7, 7, 1, None, True)]
    ctx = {r.p: (r.left, r.right) for r in Q.contexts(df.withColumn("s", F.col("p").cast("string")), "s", ["g"], "p").where("g = 1").collect()}
    assert ctx[0] == ("<BOS>", "1") and ctx[5] == ("4", "<EOS>")
    s = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 5.0), ("c", 5.0)], "g string, v double")
    assert sorted((r.g, r.scaled) for r in Q.min_max(s, "v", ["g"]).collect()) == [("a", 0.0), ("a", 1.0), ("b", 1.0), ("c", 0.5), ("c", 0.5)]
    assert Q.top_k(s, ["g"], [F.desc("v")], 1).count() == 3
    assert [r.running_min for r in Q.cumulative_min(s.where("g = 'a'"), "v", [F.desc("v")], ["g"]).orderBy(F.desc("v")).collect()] == [3.0, 1.0]


def test_chains_agree_with_a_greedy_walk(spark):
    rng = random.Random(1)
    keys = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(40)})
    want = {k: min((r for r in keys if k.startswith(r)), key=len) for k in keys}
    got = Q.chains(spark.createDataFrame([("x", k) for k in keys], "l string, k string"), "k", ["l"]).collect()
    assert {r.k: r.root for r in got} == want


def test_similarity_join_equals_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("PTKV") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "sca string")
    got = {(r.sca, r.sca_m): round(r.ned, 9) for r in M.length_window_join(df, df, most=0.5).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b): round(lev(a, b) / max(len(a), len(b)), 9) for a in set(words) for b in set(words) if abs(len(a) - len(b)) <= 2}
    assert got == {k: v for k, v in want.items() if v <= 0.5}


def test_random_draws_repeat(spark):
    a = M.random_strings(spark, [4, 6], 20, "ABC", "seed").orderBy("len", "sample").collect()
    assert a == M.random_strings(spark, [4, 6], 20, "ABC", "seed").repartition(7).orderBy("len", "sample").collect()
    assert {len(r.text) for r in a} == {4, 6} and set("".join(r.text for r in a)) == set("ABC")
    one = spark.range(1).select(M.shuffled(F.array(*map(F.lit, "abcdef")), "s", F.lit("key")).alias("x")).first().x
    assert sorted(one) == list("abcdef")
    df = spark.createDataFrame([(i,) for i in range(30)], "id int")
    sample = M.resampled(df, "id", 3, "boot")
    sizes = [r["count"] for r in sample.groupBy("r").count().collect()]
    assert len(sizes) == 3 and 60 < sum(sizes) < 120 and sample.distinct().count() < sum(sizes) and sample.count() == sum(sizes)
    null = spark.createDataFrame([("x", v / 10) for v in range(10)], "l string, ned double")
    obs = spark.createDataFrame([("x", 0.2), ("y", 0.5)], "l string, ned double")
    assert {r.l: round(r.p, 9) for r in M.null_p_value(obs, null, ["l"]).collect()} == {"x": round(4 / 11, 9), "y": 1.0}


def test_kernels():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(8, 3)) * 0.1 + c for c in np.eye(3) * 5])
    d, truth = np.linalg.norm(x[:, None] - x[None], axis=2), np.repeat([0, 1, 2], 8)
    for method in ("average", "complete", "ward"):
        assert C.rand_index(C.linkage(d, 3, method), truth) == 1
    assert C.rand_index(C.kmeans(x, 3), truth) == 1 and C.silhouette(d, truth) > 0.9
    labels, k = C.spectral(np.exp(-(d**2)))
    assert k == 3 and C.rand_index(labels, truth) == 1
    assert C.rand_index(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) < 0 and C.rand_index(np.array([1]), np.array([1])) == 0
    merged = C.merge_groups([frozenset("ab"), frozenset("abc"), frozenset("xy"), frozenset("z")], 0.5, 10)
    assert merged[0] == merged[1] != merged[2] != merged[3] and len(set(C.merge_groups([frozenset(c) for c in "abcdef"], 0.9, 2))) == 2
    edges = {(a, b): 1.0 for a in "aeio" for b in "aeio" if a < b}
    assert C.densest_clique(list("aeioxy"), edges, dict.fromkeys("aeioxy", 1.5), 3, 4)[0] == ("a", "e", "i", "o") or C.densest_clique(list("aeioxy"), edges, dict.fromkeys("aeioxy", 1.5), 3, 4)[1] == pytest.approx(1.5)
    assert C.pack_rows(["p", "q", "r"], {"p": 0, "q": 1, "r": 0}, {("p", "q"): 2.0, ("q", "r"): 3.0}) == {"p": 0, "q": 0, "r": 1}


def test_corpus_views(spark, tmp_path):
    from tessera.sources import contracts, corpora

    inv = {"ka": {"type": "syllabogram", "confidence": "high", "ipa": "ka", "count": 3, "ab_codes": ["AB77"]}, "KU": {"type": "logogram", "ab_codes": ["AB81"]}}
    words = [{"ab_codes": "AB77-AB77", "sign_readings": ["ka", "ka"], "has_damage": False}, {"ab_codes": "AB77-AB81-AB77", "sign_readings": ["ka", "KU", "ka"], "has_damage": True}, {"ab_codes": "[?]", "sign_readings": ["?"]}, {"ab_codes": "", "sign_readings": ["ka"]}, {"ab_codes": "A701-A704", "sign_readings": ["A701", "A704"]}]
    seq = [{"reading": "ka", "type": "syllabogram", "ab_code": "AB77"}, {"reading": "A704", "type": "syllabogram"}, {"reading": "A707", "type": "numeral"}, {"reading": "AB120/GRA", "type": "logogram"}]
    insc = [{"id": "HT1", "type": "tablet", "site": "Haghia", "words": words, "signs_sequence": seq}, {"words": []}]
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"sign_inventory": inv, "inscriptions": insc}))
    corpus = corpora.scan(spark, path.as_uri())
    w = corpora.words(corpus)
    assert [(r.word_index, r.sign_ids, r.has_damage) for r in w.orderBy("word_index").collect()] == [(0, ["AB77", "AB77"], False), (1, ["AB77", "AB77"], True), (2, [], False), (3, ["R_ka"], False), (4, [], False)]
    assert [r.place for r in corpora.positions(w).orderBy("position").collect()] == ["initial", "final"] and corpora.bigrams(w).count() == 2
    assert [(r.reading, r.kind, r.value) for r in corpora.sign_stream(corpus).orderBy("position").collect()] == [("ka", "syllabogram", None), ("A704", "numeral", 10), ("A707", "numeral", None), ("AB120/GRA", "named_ideogram", None)]
    g = corpora.grammar_words(corpus).orderBy("position").collect()
    assert [(r.position, r.n_words, r.has_numeral_after) for r in g] == [(0, 3, False), (1, 3, True), (2, 3, False)]
    assert {r.ab_code: r.reading for r in corpora.readings_of_codes(corpus, ["high"]).collect()} == {"AB77": "ka", "AB81": "KU"}
    bare = tmp_path / "bare.json"
    bare.write_text(json.dumps(insc))
    assert corpora.sign_lists(corpora.scan(spark, bare.as_uri())).count() == 4

    with pytest.raises(ValueError, match="lacks b"):
        contracts.read_contract(spark, path.as_uri(), "sign_inventory string", ["b"])
    with pytest.raises(ValueError):
        contracts.settings({"segmentation_method": "morfessor"})
    assert contracts.settings({"alpha": 0.01}).alpha == 0.01
    html = spark.createDataFrame([("<p>a<b>b</b></p><script>x<y</script> c",)], "h string").select(contracts.html_text(F.col("h")).alias("t")).first().t
    assert html == "a b c"
    contracts.write_contract({"x": spark.createDataFrame([(float("inf"),)], "v double")}, (tmp_path / "out").as_uri(), spark.createDataFrame([("h",)], "hash string"))
    assert spark.read.parquet((tmp_path / "out/x").as_uri()).first().v == 1e308
    made = []
    for _ in range(2):
        contracts.cached(spark, (tmp_path / "cache").as_uri(), lambda: made.append(1) or spark.range(3))
    assert len(made) == 1


def test_lexicons(spark, tmp_path):
    from tessera.sources import lexicons

    (tmp_path / "hit.tsv").write_text("Word\tIPA\tSCA\tSource\tConcept_ID\nwatar\twatar\tWVTVR\ta\tWATER\nwatar2\twatar\t\tb\t-\nx\t\t\t\t\nkessar\tkes\tKVS\tb\t-\n")
    got = {r.word: (r.lang, r.sca, r.gloss) for r in lexicons.lexicons(spark, (tmp_path / "hit.tsv").as_uri()).collect()}
    assert got == {"watar": ("hit", "WVTVR", "water"), "kessar": ("hit", "KVS", None)}
    (tmp_path / "linear_a_vs_hit_clean.tsv").write_text("linear_a_signs\tlinear_a_ipa\tmatched_word\tscore\ttop3_matches\tipa_length\nka-ro\tkaro\tkes\t-4.5\tkes (-4.5); wat (x); wa (-6)\t4\nka\tka\tk\tbad\t\t2\n")
    r = lexicons.fleet_results(spark, (tmp_path / "linear_a_vs_hit_clean.tsv").as_uri()).collect()
    assert len(r) == 1 and r[0].lang == "hit" and r[0].per_char == -1.125 and [(m.word, m.score) for m in r[0].top3] == [("kes", -4.5), ("wa", -6.0)]
    (tmp_path / "lydian_glosses.tsv").write_text("# c\nword\ttranslation\tsource\nbira\thouse\tx\nbira\thome\ty\n")
    assert [(x.lang, x.word, x.translation) for x in lexicons.glosses(spark, (tmp_path / "lydian_glosses.tsv").as_uri()).collect()] == [("lydian", "bira", "home")]
    assert spark.createDataFrame([("θæŋk",)], "w string").select(sound_classes(F.col("w")).alias("s")).first().s == "TVNK"


def test_streaming_counts(spark, tmp_path):
    from tessera.streaming.counts import event_counts

    events = spark.createDataFrame([("2024-01-01 00:10:00", "click", 1.0), ("2024-01-01 00:20:00", "click", 2.0), ("2024-01-01 05:00:00", "view", 1.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet((tmp_path / "in").as_uri())
    stream = spark.readStream.schema(events.schema).parquet((tmp_path / "in").as_uri())
    q = event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", (tmp_path / "cp").as_uri()).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.value) for r in spark.table("counts").collect()) == [("click", 2, 3.0), ("view", 1, 1.0)]


def test_nearest_compares_every_string(spark):
    """Equal to all pairs, also with more strings of one length than a cap of 500 would leave and with texts of any length."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("HJKLMNPRSTVW") for _ in range(n))
    pool = sorted({(lang, word(rng.randint(5, 7))) for lang in ("de", "fr") for _ in range(1200)} | {("de", word(n)) for n in (1, 2, 31, 32, 33, 64, 65, 70)})
    qs = sorted({w for _, w in pool[:200]} | {word(rng.randint(4, 8)) for _ in range(60)} | {word(n) for n in (1, 32, 34, 63, 66)})
    frame = lambda rows, names: spark.createDataFrame([(*r, len(r[-1])) for r in rows], names)
    got = {}
    for r in M.nearest(frame([(q,) for q in qs], "sca string, len long"), frame(pool, "lang string, sca string, len long")).collect():
        got.setdefault((r.q, r.lang), []).append((r.rk, r.ned, r.m))
    want = {}
    for q in qs:
        for lang in ("de", "fr"):
            near = sorted((M._distance(q, m) / max(len(q), len(m)), m) for x, m in pool if x == lang and abs(len(m) - len(q)) <= 2)[:5]
            if near:
                want[q, lang] = [(i, *x) for i, x in enumerate(near, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_merged_groups_equal_a_plain_search():
    rng = random.Random(9)

    def plain(groups, threshold, most):
        left = [(set(g), [i]) for i, g in enumerate(groups)]
        while len(left) > 1:
            score, i, j = max((1.0 if not a and not b else len(a & b) / len(a | b), -i, -j) for i, (a, _) in enumerate(left) for j, (b, _) in enumerate(left) if i < j)
            if score < threshold and len(left) <= most:
                break
            i, j = -i, -j
            left[i] = left[i][0] | left[j][0], left[i][1] + left[j][1]
            del left[j]
        return [next(k for k, (_, m) in enumerate(left) if i in m) for i in range(len(groups))]

    for _ in range(30):
        groups = [frozenset(rng.sample("abcdefg", rng.randint(0, 4))) for _ in range(rng.randint(0, 25))]
        assert C.merge_groups(groups, 0.5, 6) == plain(groups, 0.5, 6)


def test_merging_rescores_only_rows_that_lost_their_best():
    """Rows already united were scored again at every step, so four times the groups took some eighty times as long."""
    draw, took = random.Random(2), []
    for n in (400, 1600):
        groups = [frozenset(int(draw.paretovariate(0.7)) % 1500 for _ in range(draw.randint(0, 7))) for _ in range(n)]
        start = time.process_time()
        C.merge_groups(groups, 0.5, 20)
        took.append(time.process_time() - start)
    assert took[1] < 35 * max(took[0], 0.05)
