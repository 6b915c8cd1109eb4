"""Checks of the method by itself: gates over injected tables, bootstraps of its results, and reports against a known truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.agreement import bridge
from tessera.operators.bootstrap import POISSON, by_replicate, letter_counts
from tessera.operators.clustering import linkage, rand_index
from tessera.plans.dialect import SPARK
from tessera.plans.phonology import _enriched, p1_vowel_columns, p1_vowel_enrichment
from tessera.plans.registry import POOL, kept, plan, relational
from tessera.plans.vocabulary import CLASSES, LETTERS, _coded, _sca, p5_mc_pvalue

#: Lengths (in classes) of injected strings, draws of the null for each length.
_SHORT, _LONG, _DRAWS = 6, 7, 99


def _respelled() -> tuple[str, str]:
    """Each letter and the next one of its class: a regular change of sounds that keeps the classes."""
    kin = {c: [x for x, y in zip(LETTERS, CLASSES, strict=True) if y == c] for c in CLASSES}
    return LETTERS, "".join(kin[c][(kin[c].index(x) + 1) % len(kin[c])] for x, c in zip(LETTERS, CLASSES, strict=True))


def _pool(d) -> str:
    """CTEs up to pool; in Spark it is a kept table."""
    return _coded(d) + f""", cd AS (SELECT lang, sca, len, min(word) AS word FROM sc WHERE lang <> 'en' AND len >= {_SHORT - 2} AND len <= {_LONG + 2} GROUP BY lang, sca, len),
pool AS (SELECT lang, sca, len, word FROM (SELECT *, row_number() OVER (PARTITION BY lang, len ORDER BY md5(sca), sca) AS rk FROM cd) WHERE rk <= {POOL})"""


def gate_pool(words: DataFrame) -> DataFrame:
    """The same over word_table, without common table expressions, as what is kept is found again by its plan."""
    rows = words.where("n >= 2 AND lang <> 'en'").where(F.col("word").rlike("^[a-z]+$")).select("lang", "word", F.translate("word", LETTERS, CLASSES).alias("sca"))
    rows = rows.withColumn("len", F.length("sca").cast("long")).where(F.col("len").between(_SHORT - 2, _LONG + 2)).groupBy("lang", "sca", "len").agg(F.min("word").alias("word"))
    order = Window.partitionBy("lang", "len").orderBy(F.md5(F.col("sca").cast("binary")), "sca")
    return rows.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= POOL).drop("rk")


def _injected(d) -> str:
    """CTEs: pool (at most POOL candidates of each language and length, by hash), iq (injected queries by gate) and nq (null strings).

    recovery: a pool's words respelled within their classes, to be found again. permuted: the pool's own class strings with their
    signs in hash order. control: as long, every sign drawn by hash from all signs of the candidates' pool. The null's strings are
    permuted likewise by other draws, so that permuted queries are exchangeable with it."""
    old, new = _respelled()
    glue = (lambda x, o: f"array_join(transform(array_sort(collect_list(struct({o} AS o, {x} AS x))), y -> y.x), '')") if d.name == "spark" else (lambda x, o: f"string_agg({x}, '' ORDER BY {o})")
    order = "md5({0} || '|' || sca || '|' || CAST(p AS VARCHAR(9)))"
    pool = "pool AS (SELECT lang, sca, len, word FROM gate_pool)" if d.name == "spark" else _pool(d)
    return f"""{pool},
src AS (SELECT lang, sca, len, word, row_number() OVER (PARTITION BY lang, len ORDER BY sca) AS nth, count(*) OVER (PARTITION BY lang, len) AS of FROM pool WHERE len >= {_SHORT} AND len <= {_LONG}),
sg AS (SELECT lang, sca, len, p, x FROM src {d.each(d.letters('sca'), 'p', 'x')}),
al AS (SELECT lang, x, sum(k) OVER (PARTITION BY lang ORDER BY x ROWS UNBOUNDED PRECEDING) - k AS lo, sum(k) OVER (PARTITION BY lang ORDER BY x ROWS UNBOUNDED PRECEDING) AS hi, sum(k) OVER (PARTITION BY lang) AS t FROM (SELECT lang, x, count(*) AS k FROM sg GROUP BY lang, x)),
dw AS (SELECT sg.lang, sca, len, p, {d.hash32("'control|' || sg.lang || '|' || sca || '|' || CAST(p AS VARCHAR(9))")} % t AS spot, al.x, al.lo, al.hi FROM sg JOIN al ON al.lang = sg.lang),
iq AS (SELECT 'recovery' AS gate, lang, {_sca(f"translate(word, '{old}', '{new}')")} AS q, len, sca AS expected FROM src
  UNION ALL SELECT 'permuted', lang, {glue('x', order.format("'permuted'"))}, len, sca FROM sg GROUP BY lang, sca, len
  UNION ALL SELECT 'control', lang, {glue('x', 'p')}, len, sca FROM dw WHERE spot >= lo AND spot < hi GROUP BY lang, sca, len),
pk AS (SELECT src.lang, src.len, src.sca, r.r FROM src JOIN {d.series('1', str(_DRAWS), 'r')} r ON src.nth = {d.hash32("src.lang || '|' || CAST(src.len AS VARCHAR(9)) || '|' || CAST(r.r AS VARCHAR(9))")} % src.of + 1),
nq AS (SELECT lang, len, r, {glue('x', order.format('CAST(r AS VARCHAR(9))'))} AS q FROM (SELECT pk.lang, pk.len, pk.r, pk.sca, p, x FROM pk JOIN sg ON sg.lang = pk.lang AND sg.sca = pk.sca) GROUP BY lang, len, r, sca)"""


def _gates(d) -> str:
    """CTE qv: each injected query's nearest pool entry, p against the null and q-value among its gate's and language's queries."""
    near = lambda q, keys: f"SELECT {keys}, min(ned) AS ned, {best} AS m, count(*) FILTER (WHERE ned = lo) AS ties FROM (SELECT *, min(ned) OVER (PARTITION BY {keys}) AS lo FROM (SELECT {q}.*, pool.sca, CAST(levenshtein({q}.q, pool.sca) AS DOUBLE) / greatest({q}.len, pool.len) AS ned FROM (SELECT {q}.*, {q}.len + s.o AS b FROM {q} CROSS JOIN {d.series('-2', '2', 'o')} s) {q} JOIN pool ON pool.lang = {q}.lang AND pool.len = {q}.b)) GROUP BY {keys}"
    best = "min(CASE WHEN ned = lo THEN sca END)"
    return _injected(d) + f""", iqs AS (SELECT gate, lang, len, q, expected FROM iq), ob AS ({near('iqs', 'gate, lang, len, q, expected')}), nu AS ({near('nq', 'lang, len, r, q')}),
nd AS (SELECT lang, len, ned, CAST(sum(count(*)) OVER (PARTITION BY lang, len ORDER BY ned) AS DOUBLE) AS at_most, sum(count(*)) OVER (PARTITION BY lang, len) AS draws FROM nu GROUP BY lang, len, ned),
pv AS (SELECT ob.gate, ob.lang, ob.len, ob.q, ob.expected, ob.m, ob.ties, ob.ned, (coalesce(max(at_most), 0) + 1) / (max(nl.draws) + 1) AS p FROM ob JOIN (SELECT lang, len, max(draws) AS draws FROM nd GROUP BY lang, len) nl ON nl.lang = ob.lang AND nl.len = ob.len
  LEFT JOIN nd ON nd.lang = ob.lang AND nd.len = ob.len AND nd.ned <= ob.ned + 0.000000000001 GROUP BY ob.gate, ob.lang, ob.len, ob.q, ob.expected, ob.m, ob.ties, ob.ned),
rr AS (SELECT *, row_number() OVER (PARTITION BY gate, lang ORDER BY p, q, expected) AS rk, count(*) OVER (PARTITION BY gate, lang) AS tests FROM pv),
qv AS (SELECT *, least({d.number(1)}, min(p * tests / rk) OVER (PARTITION BY gate, lang ORDER BY p DESC, q DESC, expected DESC ROWS UNBOUNDED PRECEDING)) AS qv FROM rr)"""


def gates_sql(d) -> str:
    return f"WITH {_gates(d)} SELECT gate, lang, len, q, expected, m, ties, ned, p, qv FROM qv"


def _judged(d) -> str:
    """The injected queries as a subquery; in Spark a kept table (found again only where no other common table expression stands)."""
    return "gate_table" if d.name == "spark" else f"({gates_sql(d)}) gt"


@relational
def p5_gate_queries(d) -> str:
    """Every injected query with its nearest candidate, p and q-value."""
    return f"SELECT gate, lang, q, expected, m, ties, {d.r6('ned')} AS ned, {d.r6('p')} AS p, {d.r6('qv')} AS q_value FROM {_judged(d)}"


@relational
def p5_validation_gates(d) -> str:
    """A row for each gate and language. recovery passes if half of the planted pairs are found at a false discovery rate of 0.1;
    permuted and control pass if nothing is found at 0.05; expected and unique (of what is found of the planted pairs) pass from nine
    tenths with the very candidate, and from one half with no other as near. A gate without tests doesn't pass."""
    found = "CASE WHEN gate = 'recovery' THEN qv < 0.1 ELSE qv < 0.05 END"
    share = d.r6("CASE WHEN tests > 0 THEN CAST(hits AS DOUBLE) / tests ELSE 0 END")
    return f"""SELECT gate, lang, tests, hits, {share} AS share, tests > 0 AND CASE WHEN gate IN ('permuted', 'control') THEN hits = 0 WHEN gate = 'expected' THEN 10 * hits >= 9 * tests ELSE 2 * hits >= tests END AS passed
FROM (SELECT CASE WHEN kind = 'all' THEN gate ELSE kind END AS gate, lang, CASE WHEN kind = 'all' THEN n ELSE found END AS tests, CASE kind WHEN 'all' THEN found WHEN 'expected' THEN found_expected ELSE found_alone END AS hits
  FROM (SELECT gate, lang, count(*) AS n, count(*) FILTER (WHERE {found}) AS found, count(*) FILTER (WHERE {found} AND m = expected) AS found_expected, count(*) FILTER (WHERE {found} AND ties = 1) AS found_alone FROM {_judged(d)} GROUP BY gate, lang) g
  CROSS JOIN (VALUES ('all'), ('expected'), ('unique')) k(kind) WHERE kind = 'all' OR gate = 'recovery')"""


#: Replicates of the two bootstraps.
VOWEL_REPLICATES, RAND_REPLICATES = 1000, 200


def _vowel_test(d) -> str:
    """CTEs over cl (r, lang, sign, k_initial, k_medial, total): vc, the number of vowel-like signs of each replicate and language.

    Exact binomial tails, Bonferroni at 0.05. A count on the wrong side of its mean has a tail of a half or more and one whose Chernoff
    bound is under the limit is under it; only between the two are tails summed up."""

    def below(k: str, n: str, p: str, upper: bool) -> str:
        kl = f"({k} * ln(CAST({k} AS DOUBLE) / {n} / {p}) + ({n} - {k}) * ln((1 - CAST({k} AS DOUBLE) / {n}) / (1 - {p})))"
        exact = (d.binom_upper if upper else d.binom_lower)(k, n, p)
        wrong, all_of = (f"{k} <= floor({n} * {p})", f"{k} = {n}") if upper else (f"{k} >= ceil({n} * {p})", f"{k} = 0")
        ends = f"exp({n} * ln({p}))" if upper else f"exp({n} * ln(1 - {p}))"
        return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN FALSE WHEN {wrong} THEN FALSE WHEN {all_of} THEN {ends} < lim WHEN exp(-{kl}) < lim THEN TRUE ELSE ({exact}) < lim END"

    return f"""tt AS (SELECT r, lang, CAST(sum(k_initial) AS DOUBLE) / sum(total) AS p0, CAST(sum(k_medial) AS DOUBLE) / sum(total) AS m0 FROM cl GROUP BY r, lang),
te AS (SELECT cl.r, cl.lang, sign, k_initial, k_medial, total, p0, m0, 0.05 / count(*) OVER (PARTITION BY cl.r, cl.lang) AS lim FROM cl JOIN tt ON tt.r = cl.r AND tt.lang = cl.lang WHERE total >= 15),
vw AS (SELECT r, lang, {below('k_initial', 'total', 'p0', True)} AND {below('k_medial', 'total', 'm0', False)} AS vowel FROM te),
vc AS (SELECT tt.r, tt.lang, CAST(count(*) FILTER (WHERE vowel) AS DOUBLE) AS vowels FROM tt LEFT JOIN vw ON vw.r = tt.r AND vw.lang = tt.lang GROUP BY tt.r, tt.lang),
ci AS (SELECT lang, CAST(max(CASE WHEN r = 0 THEN vowels END) AS BIGINT) AS vowels, count(*) FILTER (WHERE r > 0) AS replicates, {d.quantile('CASE WHEN r > 0 THEN vowels END', 0.025)} AS low, {d.quantile('CASE WHEN r > 0 THEN vowels END', 0.975)} AS high FROM vc GROUP BY lang)
SELECT lang, vowels, replicates, CAST(floor(low) AS BIGINT) AS low, CAST(floor(high) AS BIGINT) AS high FROM ci"""


def vowel_interval(docs: DataFrame, replicates: int = VOWEL_REPLICATES, seed: str = "vowels") -> DataFrame:
    """docs: doc_id, lang, text -> lang, vowels, replicates, low, high: how many signs the positional test finds vowel-like in the sample, and
    the 95 % interval of that number when documents are resampled."""
    cells = by_replicate(letter_counts(docs, replicates, seed).where("lang IS NOT NULL"))
    some = lambda place: F.sum(F.when(F.col("cell") == place, F.col("n")).otherwise(0))
    cl = cells.groupBy("r", "lang", "sign").agg(some("initial").alias("k_initial"), some("medial").alias("k_medial"), F.sum("n").alias("total"))
    return docs.sparkSession.sql("WITH " + _vowel_test(SPARK).replace("FROM cl ", "FROM {cl} cl "), cl=cl)


def _vowel_sql(d, replicates: int = VOWEL_REPLICATES, seed: str = "vowels") -> str:
    times = "CASE " + " ".join(f"WHEN u < {p} THEN {i}" for i, p in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"
    return f"""WITH {d.word_occ()}, dc AS (SELECT doc_id, lang, sign, count(*) FILTER (WHERE p = 0) AS ki, count(*) FILTER (WHERE p > 0 AND p < n - 1) AS km, count(*) AS t FROM (SELECT doc_id, lang, n, p, sign FROM w {d.each(d.letters('word'), 'p', 'sign')} WHERE n >= 2) GROUP BY doc_id, lang, sign),
dr AS (SELECT dd.doc_id, r.r, ('0x' || substr(md5('{seed}|' || CAST((r.r - 1) // 4 AS VARCHAR) || '|' || coalesce(CAST(dd.doc_id AS VARCHAR), '')), CAST(1 + 8 * ((r.r - 1) % 4) AS INT), 8))::BIGINT / 4294967296::DOUBLE AS u FROM (SELECT DISTINCT doc_id FROM dc) dd CROSS JOIN {d.series('1', str(replicates), 'r')} r),
wx AS (SELECT doc_id, 0 AS r, 1 AS k FROM (SELECT DISTINCT doc_id FROM dc) UNION ALL SELECT doc_id, r, {times} FROM dr),
cl AS (SELECT r, lang, sign, CAST(sum(ki * k) AS BIGINT) AS k_initial, CAST(sum(km * k) AS BIGINT) AS k_medial, CAST(sum(t * k) AS BIGINT) AS total FROM dc JOIN wx ON wx.doc_id = dc.doc_id WHERE k > 0 AND lang IS NOT NULL GROUP BY r, lang, sign),
{_vowel_test(d)}"""


@plan(_vowel_sql)
def rs_vowel_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vowel_interval(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))


def context_classes(signs: list[str], contexts: np.ndarray, k: int = 8) -> np.ndarray:
    """Labels of signs from their counts by context: cosines of positive pointwise mutual information, average linkage to k classes."""
    total, rows, columns = contexts.sum(), contexts.sum(1, keepdims=True), contexts.sum(0, keepdims=True)
    some = contexts > 0
    x = np.maximum(0, np.log2(np.where(some, contexts * total, 1) / np.where(some, rows * columns, 1)))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    far = np.round(np.maximum(0, 1 - x @ x.T), 9)
    np.fill_diagonal(far, 0)
    return linkage(far, min(k, len(signs)))


def _rand(pdf: pd.DataFrame) -> pd.DataFrame:
    table = pdf.pivot_table(index="sign", columns="cell", values="n", aggfunc="sum", fill_value=0).sort_index()
    truth = dict(zip(LETTERS, CLASSES, strict=True))
    signs = [s for s in table.index if s in truth]
    labels = context_classes(signs, table.loc[signs].to_numpy(float)) if len(signs) > 1 else np.zeros(len(signs), int)
    return pd.DataFrame([(pdf["lang"].iloc[0], int(pdf["r"].iloc[0]), len(signs), rand_index(labels, np.array([truth[s] for s in signs])))], columns=["lang", "r", "signs", "ari"])


def rand_interval(docs: DataFrame, replicates: int = RAND_REPLICATES, seed: str = "rand") -> DataFrame:
    """docs: doc_id, lang, text -> lang, signs, ari, replicates, low, middle, high: how well classes by context agree with sound classes in
    the sample, and the 95 % interval of that when documents are resampled. All replicates' counts come from one scan; each is then
    clustered as a group of a few thousand cells."""
    cells = by_replicate(letter_counts(docs, replicates, seed, contexts=True).where("lang IS NOT NULL"))
    found = cells.groupBy("lang", "r").applyInPandas(_rand, "lang string, r long, signs long, ari double")
    drawn = F.when(F.col("r") > 0, F.col("ari"))
    quantile = lambda p: F.round(F.percentile(drawn, F.lit(p)), 6)
    own = lambda c: F.max(F.when(F.col("r") == 0, F.col(c)))
    return found.groupBy("lang").agg(own("signs").alias("signs"), F.round(own("ari"), 6).alias("ari"), F.count(drawn).alias("replicates"), quantile(0.025).alias("low"), quantile(0.5).alias("middle"), quantile(0.975).alias("high"))


@plan()
def rs_rand_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rand_interval(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))


@relational
def p1_column_report(d) -> str:
    """Vowel columns against known vowels (a sign's own class, C for any consonant): each column's majority, how many agree, what it
    merges; how many of its classes are split over columns; and the adjusted Rand index of its language."""
    known = f"CASE WHEN instr('aeiou', sign) > 0 THEN sign WHEN instr('{LETTERS}', sign) > 0 THEN 'C' END"
    return f"""WITH pr AS (SELECT lang, vowel_column AS label, {known} AS truth FROM ({p1_vowel_columns(d)}) g), cn AS (SELECT lang, label, truth, count(*) AS n FROM pr WHERE truth IS NOT NULL GROUP BY lang, label, truth),
la AS (SELECT lang, label, sum(n) AS n, count(*) AS classes FROM cn GROUP BY lang, label), tr AS (SELECT lang, truth, sum(n) AS n, count(*) AS labels FROM cn GROUP BY lang, truth),
sa AS (SELECT lang, sum(n * (n - 1) / 2) AS a, CAST(sum(n) AS DOUBLE) AS n FROM la GROUP BY lang), sb AS (SELECT lang, sum(n * (n - 1) / 2) AS b FROM tr GROUP BY lang), sc2 AS (SELECT lang, sum(n * (n - 1) / 2) AS i FROM cn GROUP BY lang),
ar AS (SELECT sa.lang, CASE WHEN abs((a + b) / 2 - a * b / (n * (n - 1) / 2)) < 0.000000000001 THEN {d.number(0)} ELSE (i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) END AS ari FROM sa JOIN sb ON sb.lang = sa.lang JOIN sc2 ON sc2.lang = sa.lang WHERE n > 1),
mj AS (SELECT cn.lang, cn.label, cn.truth, cn.n, row_number() OVER (PARTITION BY cn.lang, cn.label ORDER BY cn.n DESC, cn.truth) AS rk, sum(CASE WHEN tr.labels > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cn.lang, cn.label) AS split FROM cn JOIN tr ON tr.lang = cn.lang AND tr.truth = cn.truth)
SELECT la.lang, la.label, CAST(la.n AS BIGINT) AS items, mj.truth AS majority, mj.n AS agreeing, {d.r6('CAST(mj.n AS DOUBLE) / la.n')} AS rate, la.classes, la.classes > 1 AS merged, CAST(mj.split AS BIGINT) AS split, {d.r6('ar.ari')} AS ari
FROM la JOIN mj ON mj.lang = la.lang AND mj.label = la.label AND mj.rk = 1 JOIN ar ON ar.lang = la.lang"""


@relational
def join_ensemble(d) -> str:
    """Each tested sign with what two classifications say of it; the grid's column is null where it has none."""
    return f"SELECT e.lang, e.sign, e.is_vowel, e.confidence, g.vowel_column, coalesce(g.vowel_column > 0, FALSE) AS placed FROM ({p1_vowel_enrichment(d)}) e LEFT JOIN ({p1_vowel_columns(d)}) g ON g.lang = e.lang AND g.sign = e.sign"


@relational
def p5_observed_expected(d) -> str:
    """Matches significant at 0.05, before any correction, beside those that chance gives; a signal from three times as many on."""
    return f"SELECT lang, count(*) AS tests, count(*) FILTER (WHERE p <= 0.05) AS observed, {d.r6('0.05 * count(*)')} AS expected, {d.r6('count(*) FILTER (WHERE p <= 0.05) / (0.05 * count(*))')} AS ratio, count(*) FILTER (WHERE p <= 0.05) > 3 * 0.05 * count(*) AS signal FROM ({p5_mc_pvalue(d)}) m GROUP BY lang"


#: Signs that are taken for vowels whatever the test finds.
VOWELS = ("a", "e", "i", "o", "u", "ä", "ö", "ü")


@relational
def p1_vowel_override(d) -> str:
    """The named vowels in place of the detected ones, in each language: a tested sign keeps its statistics and has a third of its
    enrichment as confidence, at most 1; one too rare to be tested, or never seen, has one half and counts as seen once at least."""
    rows = ", ".join(f"({i}, '{v}')" for i, v in enumerate(VOWELS))
    zero = d.number(0)
    return f"""WITH {_enriched(d)}, ov AS (SELECT * FROM (VALUES {rows}) v(i, sign)), la AS (SELECT DISTINCT lang FROM c WHERE lang IS NOT NULL)
SELECT la.lang, ov.sign, coalesce(v.k_initial, 0) AS k_initial, coalesce(v.k_medial, 0) AS k_medial, coalesce(v.total, greatest(coalesce(c.total, 0), 1)) AS total, {d.r6(f'coalesce(v.enrichment, {zero})')} AS enrichment, v.sign IS NOT NULL AS tested,
  coalesce(v.p_initial < 0.05 / v.testable AND v.p_medial < 0.05 / v.testable, FALSE) AS detected, {d.r6(f'CASE WHEN v.sign IS NULL THEN {d.number(0.5)} ELSE greatest({zero}, least({d.number(1)}, v.enrichment / 3)) END')} AS confidence
FROM la CROSS JOIN ov LEFT JOIN v ON v.lang = la.lang AND v.sign = ov.sign LEFT JOIN c ON c.lang = la.lang AND c.sign = ov.sign"""


def _bridge_sql(d) -> str:
    return f"""WITH {d.word_occ()}, rd AS (SELECT substr(word, 1, 2) AS reading, min({_sca('substr(word, 1, 1)')}) AS onset, sum(freq) AS nth, count(*) FILTER (WHERE lang = 'en') > 0 AS known FROM uw WHERE {d.matches('^[b-df-hj-np-tv-z][aeiou]', 'word')} GROUP BY substr(word, 1, 2)),
ex AS (SELECT unnest([onset || 'V', onset || right(reading, 1)]) AS code, reading, nth, known FROM rd), kn AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY nth DESC, reading DESC) AS rk, count(*) OVER (PARTITION BY code) AS readings FROM ex WHERE known)
SELECT code, reading AS value, reading, readings, readings > 1 AS contested FROM kn WHERE rk = 1"""


@plan(_bridge_sql)
def p1_anchor_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of an inventory of syllables by the readings that are known. Readings are the beginnings of words by a consonant and a vowel, their
    codes the consonant's class with any and with this vowel; known are those of English words, the commoner the later."""
    words = spark.table(kept(spark, sf_dir, "word_table")).where("n >= 2").where(F.col("word").rlike("^[b-df-hj-np-tv-z][aeiou]"))
    rows = words.groupBy(F.substring("word", 1, 2).alias("reading")).agg(F.sum("freq").alias("nth"), F.bool_or(F.col("lang") == "en").alias("known"))
    onset = F.translate(F.substring("reading", 1, 1), LETTERS, CLASSES)
    inventory = rows.select("reading", F.array(F.concat(onset, F.lit("V")), F.concat(onset, F.substring("reading", 2, 1))).alias("codes"))
    return bridge(inventory, rows.where("known").select("reading", F.col("reading").alias("value"), "nth"))
