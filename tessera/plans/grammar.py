"""Pillar 3: profiles of words, word order, agreement, function words and their summary.

A word's class is its last letter's kind here (vowel, s, n, r, other), its suffix the last two letters of a longer word.
"""

from __future__ import annotations

import re

from tessera.plans.dialect import documents_with_words
from tessera.plans.registry import relational

_CLASS = "CASE WHEN substr(word, n, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 1 WHEN substr(word, n, 1) = 's' THEN 2 WHEN substr(word, n, 1) = 'n' THEN 3 WHEN substr(word, n, 1) = 'r' THEN 4 ELSE 0 END"
_SUFFIX = "CASE WHEN n >= 4 THEN substr(word, n - 1, 2) END"


def _rel(d) -> str:
    return f"CASE WHEN nw <= 1 THEN {d.number(0.5)} ELSE CAST(wpos AS DOUBLE) / (nw - 1) END"


@relational
def p3_positional_features(d) -> str:
    """Initial, final and mean relative place within documents, of words seen five times or more."""
    return f"WITH {d.word_occ()} SELECT lang, word, count(*) AS k, {d.r6(f'avg(CASE WHEN wpos = 0 THEN {d.number(1)} ELSE {d.number(0)} END)')} AS initial_rate, {d.r6(f'avg(CASE WHEN wpos = nw - 1 THEN {d.number(1)} ELSE {d.number(0)} END)')} AS final_rate, {d.r6(f'avg({_rel(d)})')} AS mean_position FROM w GROUP BY lang, word HAVING count(*) >= 5"


@relational
def p3_type_rates(d) -> str:
    """Shares of a word's occurrences in three groups of sources."""
    return f"WITH {d.word_occ()} SELECT lang, word, count(*) AS k, {d.r6("CAST(count(*) FILTER (WHERE source = 'src0') AS DOUBLE) / count(*)")} AS tablet_rate, {d.r6("CAST(count(*) FILTER (WHERE source IN ('src1', 'src2', 'src3')) AS DOUBLE) / count(*)")} AS libation_rate, {d.r6("CAST(count(*) FILTER (WHERE source NOT IN ('src0', 'src1', 'src2', 'src3')) AS DOUBLE) / count(*)")} AS other_rate FROM w WHERE source IS NOT NULL GROUP BY lang, word HAVING count(*) >= 5"


#: A word is profiled from so many occurrences on.
LEAST_FREQ = 2


def _eligible() -> str:
    return f"tw AS (SELECT lang, word, freq AS k FROM wt WHERE freq >= {LEAST_FREQ})"


def _profiles(d, of: str = "") -> str:
    """PPMI profiles; of: a CTE with lang and word of the words that are profiled (else all eligible ones).

    Here a document's pairs come from its own array. What a word and a context have in all follows from the words' counts, as does how often
    they begin and end documents, so that of the pairs only the counts are dealt out."""
    top = f"SELECT lang, word, c AS context, ppmi + {d.number(0)} AS ppmi FROM (SELECT *, row_number() OVER (PARTITION BY lang, word, substr(c, 1, 2) ORDER BY ppmi DESC, c) AS rk FROM v WHERE ppmi > 0) WHERE rk <= 20"
    score = f"round(greatest({d.number(0)}, log2(j.n / al.n / (sw.n / st.n * cc.n / ct.n))), 6) AS ppmi"
    if d.name == "duck":
        return f"""WITH {d.word_occ()}, {_eligible()}, pr AS (SELECT lang, word, coalesce(lag(word) OVER (PARTITION BY doc_id, lang ORDER BY wpos), '<BOS>') AS l, coalesce(lead(word) OVER (PARTITION BY doc_id, lang ORDER BY wpos), '<EOS>') AS r FROM w WHERE nw >= 2),
tr AS (SELECT lang, word, 'L:' || l AS c FROM pr UNION ALL SELECT lang, word, 'R:' || r AS c FROM pr), j AS (SELECT tr.lang, tr.word, tr.c, CAST(count(*) AS DOUBLE) AS n FROM tr JOIN tw ON tw.lang = tr.lang AND tw.word = tr.word GROUP BY tr.lang, tr.word, tr.c),
al AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n FROM tr GROUP BY lang), sw AS (SELECT lang, word, sum(n) AS n FROM j GROUP BY lang, word), st AS (SELECT lang, sum(n) AS n FROM sw GROUP BY lang), cc AS (SELECT lang, c, power(CAST(count(*) AS DOUBLE), 0.75) AS n FROM tr GROUP BY lang, c), ct AS (SELECT lang, sum(n) AS n FROM cc GROUP BY lang),
v AS (SELECT j.lang, j.word, j.c, {score} FROM j JOIN al ON al.lang = j.lang JOIN sw ON sw.lang = j.lang AND sw.word = j.word JOIN st ON st.lang = j.lang JOIN cc ON cc.lang = j.lang AND cc.c = j.c JOIN ct ON ct.lang = j.lang)
{top}"""
    few, met = (f", {of}", "JOIN some ON some.lang = pr.lang AND some.word = pr.word") if of else ("", "")
    return f"""WITH {d.word_occ()}, {_eligible()}{few}, ow AS (SELECT lang, word, k, heads, ends FROM place_table), dl AS (SELECT lang, sum(k) * 2D AS n, sum(heads) AS docs FROM ow GROUP BY lang),
wd AS (SELECT lang, inline(arrays_zip(ws, concat(array('<BOS>'), slice(ws, 1, size(ws) - 1)), concat(slice(ws, 2, size(ws)), array('<EOS>')))) AS (word, l, r) FROM ({d.doc_words()}) WHERE size(ws) >= 2),
pr AS (SELECT lang, word, explode(array('L:' || l, 'R:' || r)) AS c FROM wd),
j AS (SELECT pr.lang, pr.word, pr.c, CAST(count(*) AS DOUBLE) AS n FROM pr {met} GROUP BY pr.lang, pr.word, pr.c),
sw AS (SELECT ow.lang, ow.word, ow.k * 2D AS n FROM ow JOIN tw ON tw.lang = ow.lang AND tw.word = ow.word), st AS (SELECT lang, sum(n) AS n FROM sw GROUP BY lang),
cc AS (SELECT lang, c, power(CAST(k AS DOUBLE), 0.75D) AS n FROM (SELECT lang, 'L:' || word AS c, k - ends AS k FROM ow UNION ALL SELECT lang, 'R:' || word, k - heads FROM ow UNION ALL SELECT lang, 'L:<BOS>', docs FROM dl UNION ALL SELECT lang, 'R:<EOS>', docs FROM dl) WHERE k > 0), ct AS (SELECT lang, sum(n) AS n FROM cc GROUP BY lang),
la AS (SELECT dl.lang, dl.n AS al, st.n AS st, ct.n AS ct FROM dl JOIN st ON st.lang = dl.lang JOIN ct ON ct.lang = dl.lang), jc AS (SELECT j.lang, j.word, j.c, j.n, cc.n AS cn FROM j JOIN cc ON cc.lang = j.lang AND cc.c = j.c),
v AS (SELECT /*+ BROADCAST(la) */ j.lang, j.word, j.c, {score.replace("al.n", "la.al").replace("st.n", "la.st").replace("ct.n", "la.ct").replace("cc.n", "j.cn")} FROM jc j JOIN sw ON sw.lang = j.lang AND sw.word = j.word JOIN la ON la.lang = j.lang)
{top}"""


@relational
def p3_profile_ppmi(d) -> str:
    """PPMI of words seen twice or more with their neighbours: joint over all pairs, stems over eligible ones, contexts smoothed by 0.75."""
    return _profiles(d)


def _pairs(d) -> str:
    """CTEs ws (words with class and suffix) and nb: neighbours' classes and suffixes within documents, here from a document's own array."""
    if d.name == "spark":
        of = lambda expression, word: re.sub(r"(?<!')\bn\b(?!')", f"length({word})", re.sub(r"\bword\b", word, expression))
        nb = f"SELECT lang, {of(_CLASS, 'x.a')} AS c1, {of(_SUFFIX, 'x.a')} AS s1, {of(_CLASS, 'x.b')} AS c2, {of(_SUFFIX, 'x.b')} AS s2 FROM (SELECT lang, explode(transform(sequence(1, size(ws) - 1), i -> struct(ws[i - 1] AS a, ws[i] AS b))) AS x FROM ({d.doc_words()}) WHERE size(ws) > 1)"
    else:
        nb = "SELECT * FROM (SELECT lang, c AS c1, sx AS s1, lead(c) OVER z AS c2, lead(sx) OVER z AS s2 FROM ws WINDOW z AS (PARTITION BY doc_id, lang ORDER BY wpos)) WHERE c2 IS NOT NULL"
    return d.word_occ() + f", ws AS (SELECT doc_id, lang, source, wpos, nw, word, {_CLASS} AS c, {_SUFFIX} AS sx FROM w), nb AS ({nb})"


@relational
def p3_precedence_matrix(d) -> str:
    return f"WITH {_pairs(d)} SELECT lang, CAST(c1 AS BIGINT) AS first, CAST(c2 AS BIGINT) AS second, count(*) AS k FROM nb GROUP BY lang, c1, c2"


def _directions(d) -> str:
    return _pairs(d) + f""", po AS (SELECT lang, least(c1, c2) AS a, greatest(c1, c2) AS b, count(*) FILTER (WHERE c1 < c2) AS k, count(*) AS n FROM nb WHERE c1 <> c2 GROUP BY lang, least(c1, c2), greatest(c1, c2) HAVING count(*) >= 3),
dt AS (SELECT lang, a, b, k, n, {d.binom_two_sided_half('k', 'n')} AS p FROM po)"""


@relational
def p3_direction_test(d) -> str:
    """Whether one class precedes the other more often than not: exact two-sided test against one half."""
    return f"WITH {_directions(d)} SELECT lang, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, k AS a_first, n, {d.r6('p')} AS p, CASE WHEN p >= 0.05 THEN 'free' WHEN 2 * k > n THEN 'a_first' ELSE 'b_first' END AS direction FROM dt"


@relational
def p3_position_stats(d) -> str:
    return f"WITH {_pairs(d)} SELECT lang, CAST(c AS BIGINT) AS class, count(*) AS k, {d.r6(f'avg({_rel(d)})')} AS mean_position, {d.r6(f'stddev_pop({_rel(d)})')} AS sd_position FROM ws GROUP BY lang, c"


def _agreement(d) -> str:
    return _pairs(d) + f""", sc AS (SELECT lang, c, sx, CAST(count(*) AS DOUBLE) AS k FROM ws WHERE sx IS NOT NULL GROUP BY lang, c, sx), sn AS (SELECT lang, c, sum(k) AS n FROM sc GROUP BY lang, c),
ex AS (SELECT a.lang, a.c AS a, b.c AS b, sum(a.k / na.n * b.k / nb.n) AS e FROM sc a JOIN sc b ON a.lang = b.lang AND a.sx = b.sx AND a.c <= b.c JOIN sn na ON na.lang = a.lang AND na.c = a.c JOIN sn nb ON nb.lang = b.lang AND nb.c = b.c GROUP BY a.lang, a.c, b.c),
ob AS (SELECT lang, least(c1, c2) AS a, greatest(c1, c2) AS b, count(*) FILTER (WHERE s1 = s2) AS k, count(*) AS n FROM nb WHERE s1 IS NOT NULL AND s2 IS NOT NULL GROUP BY lang, least(c1, c2), greatest(c1, c2) HAVING count(*) >= 5),
ag AS (SELECT ob.*, coalesce(ex.e, 0) AS e, count(*) OVER (PARTITION BY ob.lang) AS tests FROM ob LEFT JOIN ex ON ex.lang = ob.lang AND ex.a = ob.a AND ex.b = ob.b), tt AS (SELECT *, {d.binom_upper('k', 'n', 'e')} AS p FROM ag)"""


@relational
def p3_agreement(d) -> str:
    """Neighbours with one suffix against what the two classes' suffix shares expect; exact upper tail, Bonferroni."""
    return f"WITH {_agreement(d)} SELECT lang, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, k AS same, n, {d.r6('CAST(k AS DOUBLE) / n')} AS rate, {d.r6('e')} AS expected, {d.r6(f'least({d.number(1)}, p * tests)')} AS p_corrected FROM tt"


@relational
def p3_expected_agreement(d) -> str:
    """Simpson's index of a class's suffixes."""
    return f"WITH {_agreement(d)} SELECT sc.lang, CAST(sc.c AS BIGINT) AS class, {d.r6('sum(sc.k / sn.n * sc.k / sn.n)')} AS expected FROM sc JOIN sn ON sn.lang = sc.lang AND sn.c = sc.c GROUP BY sc.lang, sc.c"


def _functional(d) -> str:
    """CTE fu. Which words are short, frequent and widespread is known from their counts; only short words' places are looked at."""
    return d.word_occ() + f""", {documents_with_words(d, 'dn')}, cn AS (SELECT wt.lang, wt.word, wt.freq AS k, CAST(wt.docs AS DOUBLE) / dn.n AS spread FROM wt JOIN dn ON dn.lang = wt.lang WHERE wt.n <= 3 AND wt.freq >= 20 AND wt.docs >= 0.1 * dn.n),
st AS (SELECT lang, word, avg({_rel(d)}) AS pos, avg(CASE WHEN wpos = 0 THEN {d.number(1)} ELSE {d.number(0)} END) AS ini, avg(CASE WHEN wpos = nw - 1 THEN {d.number(1)} ELSE {d.number(0)} END) AS fin FROM w WHERE n <= 3 GROUP BY lang, word),
de AS (SELECT lang, substr(word, 1, n - 1) AS stem, count(*) AS forms FROM uw WHERE n <= 4 GROUP BY lang, substr(word, 1, n - 1)),
fu AS (SELECT cn.lang, cn.word, cn.k, cn.spread, pos, ini, fin, CASE WHEN ini >= 0.5 OR fin >= 0.5 THEN 'structural_marker' WHEN pos >= 0.4 AND pos <= 0.6 THEN 'relator' WHEN pos < 0.4 THEN 'determiner' ELSE 'particle' END AS label
  FROM cn JOIN st ON st.lang = cn.lang AND st.word = cn.word LEFT JOIN de ON de.lang = cn.lang AND de.stem = cn.word WHERE coalesce(de.forms, 0) < 10)"""


@relational
def p3_functional_words(d) -> str:
    """Short, frequent, widespread words that hardly take endings, labelled by place."""
    return f"WITH {_functional(d)} SELECT lang, word, k, {d.r6('spread')} AS spread, {d.r6('pos')} AS mean_position, label FROM fu"


@relational
def p3_grammar_sketch(d) -> str:
    """One row a language: number of fixed orders and of agreeing class pairs, and the sketch's booleans."""
    return f"""WITH {_agreement(d)}, po AS (SELECT lang, least(c1, c2) AS a, greatest(c1, c2) AS b, count(*) FILTER (WHERE c1 < c2) AS k, count(*) AS n FROM nb WHERE c1 <> c2 GROUP BY lang, least(c1, c2), greatest(c1, c2) HAVING count(*) >= 3),
wo AS (SELECT lang, count(*) AS pairs, count(*) FILTER (WHERE {d.binom_two_sided_half('k', 'n')} < 0.05) AS fixed FROM po GROUP BY lang), ar AS (SELECT lang, count(*) FILTER (WHERE p * tests < 0.05) AS agreeing FROM tt GROUP BY lang)
SELECT wo.lang, pairs, fixed, coalesce(agreeing, 0) AS agreeing, 2 * fixed > pairs AS has_word_order, coalesce(agreeing, 0) > 0 AS has_agreement, wo.lang || ': ' || CAST(fixed AS VARCHAR(20)) || ' fixed orders, ' || CAST(coalesce(agreeing, 0) AS VARCHAR(20)) || ' agreements' AS summary FROM wo LEFT JOIN ar ON ar.lang = wo.lang"""


@relational
def p3_coherence(d) -> str:
    """Mean over classes of the share of the class's commonest suffix."""
    return f"WITH {_pairs(d)}, sc AS (SELECT lang, c, sx, CAST(count(*) AS DOUBLE) AS k FROM ws WHERE sx IS NOT NULL GROUP BY lang, c, sx), cl AS (SELECT lang, c, max(k) / sum(k) AS share FROM sc GROUP BY lang, c) SELECT lang, count(*) AS classes, {d.r6('avg(share)')} AS coherence FROM cl GROUP BY lang"
