"""Shapes of plans and steps that decide how work grows with the tables."""

import contextlib
import hashlib
import io
import json
import random

from pyspark.sql import functions as F

from tessera.operators import similarity as M
from tessera.plans import evidence, registry

DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain("simple")
    return text.getvalue()


def test_near_pairs_do_not_meet_by_language(spark):
    """All documents of a language in one task before."""
    docs = spark.createDataFrame([(1, "Aaaa b c d e aaaa", "en"), (1, "b aaaa", "en"), (2, "aaaa b", "en"), (None, "aaaa b", "en"), (3, None, "en"), (4, "b", None)], "doc_id long, text string, lang string")
    words = spark.createDataFrame([("en", "aaaa", 4, 5), ("en", "b", 1, 4)], "lang string, word string, n long, freq long")
    found = evidence.near_table(docs, words)
    assert "SortMergeJoin" not in plan_of(found) and "BroadcastHashJoin" in plan_of(found)
    assert {(r.word, r.ideogram): r.k for r in found.collect()} == {("aaaa", "aaaa"): 2, ("b", "aaaa"): 2, ("c", "aaaa"): 1, ("d", "aaaa"): 1, ("e", "aaaa"): 1}


def test_fisher_tails_make_no_row_a_term(spark):
    text = registry.queries()["p4_fisher"](spark, DIR).explain
    with contextlib.redirect_stdout(io.StringIO()) as out:
        text("simple")
    assert "Generate explode(sequence" not in out.getvalue() and "near_table" not in registry.oracle_sql()["p4_fisher"]


def test_contract_hash_is_that_of_all_documents_in_order(spark, tmp_path):
    """Each document's whole hash counts; before, eight digits of it were summed."""
    rows = [(10, "b", "en"), (9, "a", "en"), (None, "c", "en"), (11, None, "en"), (1, "d", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    found = {r.lang: (r.documents, r.corpus_hash) for r in registry.queries()["sn_contract_metadata"](spark, str(tmp_path)).collect()}
    assert found == {"en": (4, md5("".join(map(md5, "ab")) + md5("") + md5("c"))), "de": (1, md5(md5("d")))}


def test_nearest_of_all_lengths_and_blocks(monkeypatch):
    """Bit vectors are as short as their texts; before, texts of all lengths shared the longest's."""
    monkeypatch.setattr(M, "_BLOCK", 7)
    draw = random.Random(3)
    word = lambda most: "".join(draw.choice("abV") for _ in range(draw.randint(1, most)))
    texts = sorted({word(n) for n in (4, 9, 16, 17, 33, 70) for _ in range(12)})
    assert {len(v.dtype.name) and v.dtype.name for _, v in M._distances_of(["ab"], ["abV"], 3)} == {"int16"}
    for q in (word(n) for n in (1, 5, 16, 18, 40)):
        want = sorted((M._distance(q, t) / max(len(q), len(t)), i) for i, t in enumerate(texts))[:5]
        assert [i for i, _ in M.nearest_of([q], texts)[0]] == [i for _, i in want]
        assert M.nearest_of([q], texts[:2], 5)[0] and all(d == M._distance(q, texts[i]) for i, d in M.nearest_of([q], texts)[0])


def test_near_texts_are_found_without_comparing_all(monkeypatch):
    """Every query met every text before, so work grew with the square of the vocabulary."""
    draw, whole = random.Random(5), M._nearest_of_all
    word = lambda lo, hi: "".join(draw.choice("VVVPTKN") for _ in range(draw.randint(lo, hi)))
    rest = []
    monkeypatch.setattr(M, "_FEW", 10)
    for m in range(1, 15):
        texts = sorted({word(max(1, m - 2), m + 2) for _ in range(400)} | {word(m, m)[::-1] for _ in range(9)} | {"P" * 40, "xyz"})
        qs = sorted({word(m, m) for _ in range(15)} | set(texts[:9]) | {"Z" * m, word(1, 9)})
        for most in (1, 5):
            want = whole(qs, texts, most)
            with monkeypatch.context() as at:
                at.setattr(M, "_nearest_of_all", lambda asked, *a: rest.append(len(asked)) or whole(asked, *a))
                assert M.nearest_of(qs, texts, most) == [[(i, d) for _, i, d in want[q]] for q in qs]
        if m == 10:
            rest.clear()
            texts = sorted({word(9, 11) for _ in range(3000)})
            with monkeypatch.context() as at:
                at.setattr(M, "_nearest_of_all", lambda asked, *a: rest.append(len(asked)) or whole(asked, *a))
                M.nearest_of(texts[:500], texts, 1)
            assert sum(rest) < 25


def test_queries_look_for_near_texts_together(monkeypatch):
    """Each query went through the texts by itself, several times; now those that begin alike go together, and few texts are compared whole."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("VVVPTKNSLR") for _ in range(draw.randint(9, 13)))
    texts, qs = sorted({word() for _ in range(6000)}), sorted({q for q in (word() for _ in range(1500)) if len(q) == 11})
    want, whole, steps, met = M._nearest_of_all(qs, texts, 2), [], [], []
    monkeypatch.setattr(M, "_nearest_of_all", lambda asked, *a, real=M._nearest_of_all: whole.extend(asked) or real(asked, *a))
    monkeypatch.setattr(M, "_near_pairs", lambda *a, real=M._near_pairs: steps.append(1) or real(*a))
    monkeypatch.setattr(M, "_distances", lambda codes, t, at, real=M._distances: met.append(len(at)) or real(codes, t, at))
    assert M.nearest_of(qs, texts, 2) == [[(i, d) for _, i, d in want[q]] for q in qs]
    assert len(qs) > 200 and not whole and len(steps) < len(qs) / 4 and sum(met) < len(qs) * len(texts) / 10
    assert M._nearest_of_few(qs[:9], M._both_ways(texts, sorted(set("".join(texts))))[0], sorted(set("".join(texts))), 2) == {q: want[q] for q in qs[:9]}


def test_no_task_has_a_language_or_all_texts(spark, monkeypatch):
    """Texts of one row group were cut up in one task; a pair's results were written, and met their last machine, in one."""
    words = registry._word_table(spark, DIR)
    plan = plan_of(words)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning(doc_id")
    from tessera.plans import scans

    made = []
    monkeypatch.setattr(scans.lexicons, "result_pairs", lambda spark, path, real=scans.lexicons.result_pairs: made.append(path) or real(spark, path))
    found = registry.queries()["src_result_pairs"](spark, DIR)
    want = {(f"en_{r.lang}", r.k, r.f) for r in words.where("lang IS NOT NULL AND n > 3").groupBy("lang").agg({"*": "count", "freq": "sum"}).toDF("lang", "k", "f").selectExpr("lang", "k", "f").collect()}
    assert {(r.pair, *sorted((r.rows_, r.score))) for r in found.collect()} == {(p, *sorted(x)) for p, *x in want}
    assert "Window" not in plan_of(found)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(made[0]).count()
    assert files > 64


def test_corpus_files_stay_small_and_words_are_not_dealt_out(spark):
    """Files were 26 times the text and more; words of an inscription met by a window over its number."""
    from tessera.plans import scans
    from tessera.sources import corpora

    text = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    for parts in (["inventory", "ab_codes", "sign_readings", "has_damage"], ["signs_sequence"], ["ab_codes"]):
        path = scans._corpus_file(spark, DIR, *parts)
        size = spark.read.format("binaryFile").load(path).selectExpr("sum(length)").first()[0]
        assert 0 < size < 2.5 * text
    words = corpora.grammar_words(corpora.scan(spark, path, lines=True))
    assert "Exchange" not in plan_of(words) and words.count() > 0


def dealt_out_with(df) -> list[list[str]]:
    """Types of the columns that go along with each row, for each explode of the optimized plan."""
    found, left = [], [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "Generate":
            along = node.requiredChildOutput()
            found.append([along.apply(i).dataType().typeName() for i in range(along.size())])
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_a_word_does_not_carry_its_inscription(spark):
    """For their number each word had all words of its inscription beside it, which are kept until the last is dealt out: with 20,000 words gigabytes."""
    found = registry.queries()["src_grammar_words"](spark, DIR)
    along = dealt_out_with(found)
    assert len(along) == 2 and all(t in ("string", "long") for of in along for t in of)


def test_sounds_are_counted_in_one_pass(spark, tmp_path):
    """The corpus was written to files and parsed three times, for words, signs and pairs; of one row group, in one task."""
    from tessera.plans import scans
    from tessera.sources import corpora

    found = scans.src_corpus_words(spark, DIR)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(sign_inventory") == 1 and "Join" not in plan and "size(" not in "".join(x for x in plan.splitlines() if "Filter" in x)
    assert plan.index("from_json") < plan.index("RepartitionByExpression [doc_id")
    rows = [(7, "cut off", "en", "s1"), (1, "Aqua ab as a zzz quiz Straße été", "fr", None), (None, "aa b", "de", "s1"), (2, None, "en", "s2"), (3, "12 !", "es", "s2"), (4, "abba as", None, "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (DIR, str(tmp_path)):
        w = corpora.words(corpora.scan(spark, scans._corpus_file(spark, d, "inventory", "ab_codes", "sign_readings", "has_damage"), lines=True)).withColumn("insc_id", F.col("insc_type"))
        count = lambda df: {r.insc_id: r["count"] for r in df.groupBy("insc_id").count().collect()}
        places = corpora.positions(w)
        each = [count(x) for x in (w, w.where("has_damage"), places, places.where("place = 'initial' AND sign_id = 'A'"), corpora.bigrams(w))]
        assert {r.lang: tuple(r)[1:] for r in scans.src_corpus_words(spark, d).collect()} == {lang: tuple(x.get(lang, 0) for x in each) for lang in each[0]} != {}


def test_signs_of_plain_words_are_those_looked_up_one_by_one(spark):
    """Words whose readings are all syllabograms keep their codes; what is odd goes by the inventory, else by the code."""
    from tessera.sources import corpora

    kinds = {"ka": "syllabogram", "ti": "syllabogram", "GRA": "logogram", "AB5": "syllabogram", "no": None}
    given = [
        ("A-B", ["ka", "ti"]), ("A-B", ["ka", "GRA"]), ("A-B", ["ka"]), ("A-AB5", ["ka"]), ("A-B", ["ka", None]), ("A-AB5", [None, "so"]), ("A-B", ["ka", "ti", "GRA"]), ("A", ["so"]), ("AB5-A704", ["no", "so"]),
        ("", ["ka", "GRA"]), (None, ["ka"]), ("A-B", None), (None, None), ("A--B", ["ka", "ti", "ka"]), ("ka-ka", ["ti", "ti"]),
    ]
    want = []
    for codes, readings in given:
        r = readings or []
        pairs = [(c, r[i] if i < len(r) and r[i] is not None else c) for i, c in enumerate(codes.split("-"))] if codes else [(f"R_{x}", x) for x in r]
        want.append([c for c, x in pairs if (kinds.get(x) or kinds.get(c)) == "syllabogram"])
    some = {"words": [{"ab_codes": c, "sign_readings": r} for c, r in given] + [None]}
    line = lambda **x: json.dumps({"inscriptions": [some, {"words": None}, {"words": []}, None]} | x)
    lines = spark.createDataFrame([("a", line(sign_inventory={k: {"type": v} for k, v in kinds.items()})), ("b", line()), ("c", "{")], "path string, json string")
    for path, signs in (("a", want), ("b", [[]] * len(given))):
        rows = corpora.words(corpora.parse(lines.where(F.col("path") == path))).orderBy("word_index").collect()
        assert [r.sign_ids for r in rows] == [*signs, []] and [r.word_index for r in rows] == list(range(len(given) + 1))
    assert not corpora.words(corpora.parse(lines.where("path = 'c'"))).count() and not corpora.grammar_words(corpora.parse(lines.where("path = 'c'"))).count()


def test_profiles_deal_out_counts_not_words(spark):
    """Each word met its neighbours by a window over its document before, once for each of four uses."""
    plan = plan_of(registry.queries()["p3_profile_ppmi"](spark, DIR))
    assert "lag(" not in plan and "lead(" not in plan
