"""Every relational query against the other engine on the smallest tables."""

import hashlib
import math
import re
from collections import Counter
from statistics import fmean, pstdev

import duckdb
import pytest

from tessera.operators.similarity import nearest_of
from tessera.plans import registry
from tessera.plans.dialect import DUCK, SPARK
from tessera.plans.vocabulary import ALPHABET, CLASSES, FIXED_SAMPLES, LETTERS

DIR = "/root/testdata/sf0.001"
_oracles = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    return sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(_oracles))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    c = duck.execute(_oracles[name])
    names = [x[0] for x in c.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, c.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(_oracles)))
def test_clusterings_run(spark, name):
    df = registry.queries()[name](spark, DIR)
    assert df.count() > 0


def test_shuffled_words_lose_their_structure(spark):
    """In words whose letters are in hash order, initial rates of letters are near the same as all rates."""
    got = registry.queries()["rs_shuffle_null"](spark, DIR).where("total >= 200").collect()
    first = sum(r.shuffled for r in got) / sum(r.total for r in got)
    assert got and sum(abs(r.shuffled / r.total - first) > 0.25 for r in got) <= 0.1 * len(got)


def test_no_query_reads_more_than_it_names(spark):
    plan = registry.queries()["p1_word_length_stats"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_dialects_differ_only_where_they_must():
    assert SPARK.r6("x") == "(round(x, 6) + 0D)" and DUCK.r6("x") == "(round(x, 6) + 0::DOUBLE)"


def test_matches_miss_no_equal_string(spark):
    """Every English class string that another language has too is matched at distance 0, and every one is a query."""
    q = registry.queries()
    sca = q["p5_sca_encode"](spark, DIR).where("len >= 4").select("lang", "sca").distinct().collect()
    words = {lang: {r.sca for r in sca if r.lang == lang} for lang in ("en", "de", "es", "fr")}
    rows = q["p5_edit_distance_matches"](spark, DIR).collect()
    equal = {(r.q, r.lang) for r in rows if r.ned == 0 and r.q == r.m}
    assert equal == {(x, lang) for lang in ("de", "es", "fr") for x in words["en"] & words[lang]}
    assert {r.q for r in rows} == {x for x in words["en"] if len(x) <= max(map(len, set.union(*(words[k] for k in ("de", "es", "fr"))))) + 2}


def test_shuffle_null_counts_every_word(spark, duck):
    """Observed and total are the corpus' own counts, worked out here from the documents."""
    text = duck.execute("SELECT lang, text FROM documents WHERE text IS NOT NULL").fetchall()
    want = {}
    for lang, t in text:
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            for i, sign in enumerate(word if len(word) >= 2 else ""):
                k = want.setdefault((lang, sign), [0, 0])
                k[0] += i == 0
                k[1] += 1
    got = {(r.lang, r.sign): [r.observed, r.total] for r in registry.queries()["rs_shuffle_null"](spark, DIR).collect()}
    assert got == want


def test_all_signatures_and_words_take_part(spark):
    """Each signature that shares a suffix is paired, each one's suffixes are in a paradigm, each word seen twice is profiled and classed."""
    q, there = registry.queries(), "/root/testdata/sf0.01"
    groups = {(r.lang, r.signature): set(r.signature.split("|")) for r in q["p2_signature_groups"](spark, there).collect()}
    assert max(sum(x == lang for x, _ in groups) for lang in ("en", "de", "fr")) > 40
    pairs = {(r.lang, r.a, r.b): (r.shared, r.jaccard) for r in q["p2_signature_jaccard"](spark, there).collect()}
    want = {(x, a, b): (len(s & t), round(len(s & t) / len(s | t), 6)) for (x, a), s in groups.items() for (y, b), t in groups.items() if x == y and a < b and s & t}
    assert pairs == want
    slots = {(r.lang, r.suffix) for r in q["p2_paradigm_slots"](spark, there).collect()}
    assert slots == {(lang, x) for (lang, _), s in groups.items() for x in s}
    words = {(r.lang, r.word) for r in spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("lang", "explode(regexp_extract_all(lower(text), '(\\\\p{L}+)', 1)) AS word").groupBy("lang", "word").count().where("count >= 2").collect()}
    profiled = {(r.lang, r.word) for r in q["p3_profile_ppmi"](spark, DIR).select("lang", "word").distinct().collect()}
    assert profiled <= words and len(profiled) > 0.9 * len(words)
    classed = [(r.lang, r.word) for r in q["p3_word_classes"](spark, DIR).collect()]
    assert len(classed) == len(set(classed)) and set(classed) == profiled


def test_observed_words_and_readings_meet_all_candidates(spark):
    """Distances of all English class strings of four signs or more to pools of 500 a length, and of readings to all words, by search."""
    q = registry.queries()
    words = q["p5_sca_encode"](spark, DIR).collect()
    sca = {(r.lang, r.sca) for r in words}
    pools = {}
    for lang in sorted({x for x, _ in sca}):
        for n in range(2, 30):
            of = sorted((t for x, t in sca if x == lang and len(t) == n), key=lambda t: (hashlib.md5(t.encode()).hexdigest(), t))
            pools[lang, n] = of[:500]
    asked = sorted(t for x, t in sca if x == "en" and len(t) >= 4)
    got = {(r.q, r.lang): r.ned for r in q["p5_mc_pvalue"](spark, DIR).collect()}
    lexicon = {(r.lang, r.sca) for r in words if r.lang != "en"}
    code = str.maketrans(LETTERS, CLASSES)
    readings = [(h, h.reading.translate(code)) for h in q["p5_hypotheses"](spark, DIR).collect()]

    def near(asked, texts):
        return {t: round(d / max(len(t), len(texts[i])), 6) for t, ((i, d),) in zip(asked, nearest_of(asked, texts, 1), strict=True)} if texts else {}

    best = {}
    for lang in ("de", "es", "fr"):
        for n in range(4, 30):
            own = [t for t in asked if len(t) == n]
            want = near(own, sorted(x for m in range(n - 2, n + 3) for x in pools.get((lang, m), [])))
            assert {t: got[t, lang] for t in own if (t, lang) in got} == want
            own = sorted({t for _, t in readings if len(t) == n})
            best[lang, n] = near(own, sorted(x for k, x in lexicon if k == lang and abs(len(x) - n) <= 2))
    hits = {}
    for h, t in readings:
        for lang in ("de", "es", "fr"):
            if best[lang, len(t)].get(t, 1) <= 0.4:
                for sign, r in (("w", h.w_as), ("y", h.y_as)):
                    if r != "-":
                        hits[sign, r] = hits.get((sign, r), 0) + 1
    assert {(r.sign, r.reading): r.hits for r in q["p5_reading_votes"](spark, DIR).collect()} == hits


def test_tails_are_dealt_a_thousand_times(spark, duck):
    """The mean and spread of the purity over 1000 deals, dealt here."""
    text = duck.execute("SELECT lang, text FROM documents WHERE text IS NOT NULL AND lang = 'es'").fetchall()
    words = {w for _, t in text for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 4}
    stems = Counter(w[-2:] for w in words)
    pairs = sorted(p for p, k in stems.items() if k >= 3)
    heads, purity = [p[0] for p in pairs], []
    for r in range(1001):
        dealt = pairs if r == 0 else sorted(pairs, key=lambda p: (hashlib.md5(f"{r}|{p}".encode()).hexdigest(), p))
        kinds = Counter((h, t[1] in "aeiou") for h, t in zip(heads, dealt, strict=True))
        by_head = Counter(heads)
        purity.append(sum(n * (n - 1) / 2 for n in kinds.values()) / sum(n * (n - 1) / 2 for n in by_head.values()))
    got = registry.queries()["rs_tail_shuffle"](spark, DIR).where("lang = 'es'").first()
    want = purity[0], fmean(purity[1:]), pstdev(purity[1:])
    assert all(abs(a - b) < 2e-6 for a, b in zip((got.observed, got.shuffled_mean, got.shuffled_sd), want, strict=True))


def test_bias_corrections_by_loops(spark):
    """The three corrections of one language's readings of seven letters, from null strings drawn and searched here."""
    q = registry.queries()
    code = str.maketrans(LETTERS, CLASSES)
    sca = {(r.lang, r.sca) for r in q["p5_sca_encode"](spark, DIR).select("lang", "sca").collect()}
    pool = sorted(t for n in range(5, 10) for t in sorted((t for x, t in sca if x == "de" and len(t) == n), key=lambda t: (hashlib.md5(t.encode()).hexdigest(), t))[:500])
    drawn = lambda r, p: ALPHABET[int(hashlib.md5(f"null|7|{r}|{p}".encode()).hexdigest()[:8], 16) % 12]
    null = {}
    for c in ALPHABET:
        strings = [c + "".join(drawn(r, p) for p in range(2, 8)) for r in range(1, FIXED_SAMPLES + 1)]
        null[c] = [d / max(7, len(pool[i])) for ((i, d),) in nearest_of(strings, pool, 1)]
    rate = {c: 1.0 if c == "V" else 1 / max(fmean(v), 0.01) for c, v in null.items()}
    mean = fmean(v for c, v in rate.items() if c != "V")
    column = {r.sign: r.vowel_column for r in q["p1_vowel_columns"](spark, DIR).where("lang = 'en'").collect()}

    def prior(sign, c):
        known = [x.translate(code) for x, k in column.items() if k == column.get(sign) >= 0 and x in LETTERS and x not in "wy"] if sign in column else []
        return (known.count(c) + 1) / (len(known) + 12) if known else 1 / 12

    readings = {(h.word, h.reading): (h.w_as, h.y_as) for h in q["p5_hypotheses"](spark, DIR).collect() if len(h.word) == 7}
    lexicon = sorted({t for x, t in sca if x == "de" and 5 <= len(t) <= 9})
    rows = q["p5_bias_corrections"](spark, DIR).where("lang = 'de' AND length(word) = 7").collect()
    assert {(r.word, r.reading) for r in rows} == set(readings) and len(rows) > 100
    raised = lowered = 0
    for r in rows[::7]:
        to = {s: x.translate(code) for s, x in zip("wy", readings[r.word, r.reading], strict=True) if x != "-"}
        first = to[min(to, key=r.word.index)]
        ((i, d),) = nearest_of([r.reading.translate(code)], lexicon, 1)[0]
        ned = d / max(7, len(lexicon[i]))
        assert r.class_conditional == pytest.approx((sum(x <= ned + 1e-9 for x in null[first]) + 1) / (FIXED_SAMPLES + 1), abs=2e-6)
        assert r.freq_norm == pytest.approx(min(1, r.p * math.prod(rate[c] / mean for c in to.values())), abs=5e-6)
        assert r.grid_prior == pytest.approx(min(1, r.p * math.prod(1 / 12 / prior(s, c) for s, c in to.items())), abs=2e-5)
        raised, lowered = raised + (r.grid_prior > r.p), lowered + (r.grid_prior < r.p)
    assert raised or lowered


def test_kept_matches_are_found_again(spark):
    """The nearest strings are searched once a session: a later query's plan reads what is kept."""

    def names(node):
        children = node.children()
        return [node.nodeName()] + [x for i in range(children.size()) for x in names(children.apply(i))]

    for name in ("p5_topk_per_language", "p5_mc_pvalue", "p5_class_conditional", "p5_reading_votes"):
        found = names(registry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan())
        assert "InMemoryRelation" in found and not any(x.startswith("FlatMap") for x in found)


def test_signs_are_read_without_a_file(spark, monkeypatch):
    """The views of signs write no file, where all their lines stood before, and read what they would from files."""
    from tessera.plans import scans
    from tessera.sources import corpora

    d, made_in = "/root/testdata/sf0.001", scans.scratch
    for view, parts in ((corpora.sign_stream, ["signs_sequence"]), (corpora.sign_lists, ["sign_readings", "has_damage"])):
        made, filed = (sorted(map(str, view(x).collect())) for x in (corpora.parse(scans._corpus_lines(spark, d, *parts)), corpora.scan(spark, scans._corpus_file(spark, d, *parts), lines=True)))
        assert made == filed and made
    monkeypatch.setattr(scans, "scratch", lambda *a: made_in(*a) and 1 / 0)
    assert scans.src_sign_lists(spark, d).count() > 0 and scans.src_sign_stream(spark, d).count() > 0
