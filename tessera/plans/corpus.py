"""Scans, set operations, top-k, and what a sink adds to a contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.similarity import first_contained
from tessera.plans.registry import kept, plan, relational


@relational
def src_documents_words(d) -> str:
    """The adapter: one row for each word of each document."""
    return f"WITH {d.word_occ()} SELECT doc_id, lang, CAST(wpos AS BIGINT) AS wpos, word, n, nw FROM w"


@relational
def src_json_events(d) -> str:
    """A number out of the events' JSON, by type."""
    k = d.json_int("props", "k")
    return f"SELECT event_type, count(*) AS k, CAST(sum({k}) AS BIGINT) AS total, min({k}) AS low, max({k}) AS high FROM events GROUP BY event_type"


@relational
def src_html_strip(d) -> str:
    """Pages without their markup: length and hash of what is left."""
    text = d.drop("<[^>]+>", "html")
    return f"SELECT page_id, CAST(length({text}) AS BIGINT) AS n, md5({text}) AS hash FROM pages"


@relational
def src_sign_types(d) -> str:
    """Words by the kind of sign their pattern says: numerals, symbols, syllabograms; the rest unknown."""
    word = "regexp_extract_all(text, '([^ \\\\n]+)', 1)" if d.name == "spark" else "regexp_extract_all(text, '[^ \\n]+')"
    kind = f"CASE WHEN {d.matches('^[0-9.,]+$', 'x')} THEN 'numeral' WHEN {d.matches('[#*$%&|<>]', 'x')} THEN 'logogram' WHEN {d.matches('[0-9]', 'x')} THEN 'mixed' WHEN {d.matches('[a-zA-Z]', 'x')} THEN 'syllabogram' ELSE 'unknown' END"
    return f"SELECT lang, kind, count(*) AS k FROM (SELECT lang, {kind} AS kind FROM documents {d.each(word, 'p', 'x')}) GROUP BY lang, kind"


@relational
def src_cv_parse(d) -> str:
    """Two-letter endings as consonant and vowel; a pure vowel has no consonant, digits at the end go."""
    return f"WITH {d.word_occ()}, e AS (SELECT DISTINCT lang, substr(word, n - 1, 2) AS reading FROM uw WHERE n >= 3) SELECT lang, reading, CASE WHEN {d.matches('^[aeiou]$', 'substr(reading, 2, 1)')} THEN CASE WHEN {d.matches('^[aeiou]', 'reading')} THEN '' ELSE substr(reading, 1, 1) END END AS consonant, CASE WHEN {d.matches('[aeiou]$', 'reading')} THEN substr(reading, 2, 1) END AS vowel FROM e"


@relational
def sn_contract_metadata(d) -> str:
    """What goes with a contract: counts of the corpus and a hash over its documents in order, those without a number last."""
    glue = "array_join(transform(array_sort(collect_list(struct(doc_id IS NULL AS last, doc_id, h))), x -> x.h), '')" if d.name == "spark" else "string_agg(h, '' ORDER BY doc_id, h)"
    return f"WITH h AS (SELECT doc_id, lang, md5(coalesce(text, '')) AS h FROM documents) SELECT lang, count(*) AS documents, md5({glue}) AS corpus_hash FROM h GROUP BY lang"


@relational
def sn_histogram(d) -> str:
    """Ten bins of document lengths up to 10,000 signs, the last open."""
    return f"SELECT CAST(least({d.div('n_chars', '1000')}, 9) AS BIGINT) AS bin, count(*) AS k, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY least({d.div('n_chars', '1000')}, 9)"


@relational
def sn_sanitized(d) -> str:
    """Numbers as a JSON sink writes them: not-a-number 0, infinities the largest numbers of their sign."""
    value = "CASE WHEN n_chars % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN n_chars % 50 = 1 THEN CAST('Infinity' AS DOUBLE) WHEN n_chars % 50 = 2 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(n_chars AS DOUBLE) / 7 END"
    return f"SELECT doc_id, CASE WHEN isnan(v) THEN {d.number(0)} WHEN v = CAST('Infinity' AS DOUBLE) THEN 1e308 WHEN v = CAST('-Infinity' AS DOUBLE) THEN -1e308 ELSE {d.r6('v')} END AS value FROM (SELECT doc_id, {value} AS v FROM documents)"


@relational
def set_union_corpora(d) -> str:
    """Two halves of a corpus joined again, the later entry of a word winning."""
    return f"WITH {d.word_occ()}, un AS (SELECT lang, word, max(CASE WHEN source < 'src15' THEN 0 ELSE 1 END) AS later, count(*) AS k FROM (SELECT lang, word, source FROM w WHERE n >= 2 AND source < 'src15' UNION ALL SELECT lang, word, source FROM w WHERE n >= 2 AND source >= 'src15') GROUP BY lang, word) SELECT lang, CAST(later AS BIGINT) AS later, count(*) AS words, CAST(sum(k) AS BIGINT) AS k FROM un GROUP BY lang, later"


@relational
def set_new_only(d) -> str:
    return f"WITH {d.word_occ()} SELECT lang, word FROM (SELECT DISTINCT lang, word FROM w WHERE n >= 2 AND source >= 'src15') EXCEPT SELECT lang, word FROM w WHERE source < 'src15'"


@relational
def set_common_words(d) -> str:
    """Words of all four languages."""
    return f"WITH {d.word_occ()} SELECT word FROM uw WHERE lang = 'en' INTERSECT SELECT word FROM uw WHERE lang = 'de' INTERSECT SELECT word FROM uw WHERE lang = 'fr' INTERSECT SELECT word FROM uw WHERE lang = 'es'"


@relational
def topk_words_per_lang(d) -> str:
    return f"WITH {d.word_occ()} SELECT lang, word, freq, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, word) AS rk FROM uw) WHERE rk <= 10"


@relational
def dedup_keep_best(d) -> str:
    """Of words with one beginning of four letters the most frequent."""
    return f"WITH {d.word_occ()} SELECT lang, stem, word, freq FROM (SELECT lang, substr(word, 1, 4) AS stem, word, freq, row_number() OVER (PARTITION BY lang, substr(word, 1, 4) ORDER BY freq DESC, word) AS rk FROM uw WHERE n >= 4) WHERE rk = 1"


@relational
def join_first_match(d) -> str:
    """Glosses of all English words: another language's same word, else the least word that begins with it or that it begins with."""
    return f"""WITH {d.word_occ()}, q AS (SELECT word, n FROM uw WHERE lang = 'en' AND n >= 4), x AS (SELECT DISTINCT word, n FROM uw WHERE lang <> 'en' AND n >= 4), pf AS (SELECT word, substr(word, 1, CAST(l AS INT)) AS prefix FROM x {d.each_of('CAST(4 AS BIGINT)', 'x.n', 'l')}), qf AS (SELECT word, substr(word, 1, CAST(l AS INT)) AS prefix FROM q {d.each_of('CAST(4 AS BIGINT)', 'q.n', 'l')}),
ca AS (SELECT q.word, pf.word AS gloss FROM q JOIN pf ON pf.prefix = q.word UNION ALL SELECT qf.word, x.word FROM qf JOIN x ON x.word = qf.prefix)
SELECT word, coalesce(max(CASE WHEN gloss = word THEN gloss END), min(gloss)) AS gloss, CAST(CASE WHEN max(CASE WHEN gloss = word THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 2 END AS BIGINT) AS kind FROM ca GROUP BY word"""


@relational
def join_constraints(d) -> str:
    """Keys of two sources (endings and beginnings) united, then each looked up in both: the assembly of constraints."""
    return f"""WITH {d.word_occ()}, a AS (SELECT lang, substr(word, n - 2, 3) AS k, CAST(sum(freq) AS BIGINT) AS ending FROM uw WHERE n >= 5 GROUP BY lang, substr(word, n - 2, 3)), b AS (SELECT lang, substr(word, 1, 3) AS k, CAST(sum(freq) AS BIGINT) AS beginning FROM uw WHERE n >= 5 GROUP BY lang, substr(word, 1, 3)), u AS (SELECT lang, k FROM a UNION SELECT lang, k FROM b)
SELECT u.lang, u.k, coalesce(ending, 0) AS ending, coalesce(beginning, 0) AS beginning FROM u LEFT JOIN a ON a.lang = u.lang AND a.k = u.k LEFT JOIN b ON b.lang = u.lang AND b.k = u.k"""


def _contained_sql(d) -> str:
    return f"""WITH {d.word_occ()}, en AS (SELECT word FROM uw WHERE lang = 'en'), an AS (SELECT lang, word AS anchor, docs FROM wt WHERE lang <> 'en' AND n >= 3 AND docs >= 2),
hit AS (SELECT en.word, an.lang AS field, an.anchor, row_number() OVER (PARTITION BY en.word ORDER BY an.anchor <> en.word, an.docs DESC, an.lang, an.anchor) AS rk FROM en JOIN an ON contains(en.word, an.anchor))
SELECT en.word, hit.field, hit.anchor, coalesce(hit.anchor = en.word, FALSE) AS whole FROM en LEFT JOIN hit ON hit.word = en.word AND hit.rk = 1"""


@plan(_contained_sql)
def join_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every English word with the anchor that names its field: an equal one, else the first that it contains. Anchors are the words of
    other languages in two documents or more, the most widespread first."""
    words = spark.table(kept(spark, sf_dir, "word_table"))
    anchors = words.where("lang <> 'en' AND n >= 3 AND docs >= 2").select(F.col("word").alias("anchor"), "lang", (-F.col("docs")).alias("less"))
    found = first_contained(words.where("lang = 'en' AND n >= 2").select("word"), anchors, "word", "anchor", ["less", "lang"])
    return found.select("word", F.col("hit.lang").alias("field"), F.col("hit.anchor").alias("anchor"), F.coalesce(F.col("hit.anchor") == F.col("word"), F.lit(False)).alias("whole"))
