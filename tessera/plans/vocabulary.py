"""Pillar 5: words against candidate languages by sound class, with null models, semantics, strata and stability.

Queries are English words, candidates are the other languages' words; both as strings of sound classes, so that edit distance is over
single-byte signs. Candidates are compared within two signs of a query's length, joined by length, and each class string once.
"""

from __future__ import annotations

from tessera.plans.phonology import p1_vowel_columns
from tessera.plans.registry import POOL, relational

#: Letters and the sound classes that they fall into; any other letter goes.
LETTERS = "pbfvtdszckgxqmnlrwjhaeiouy"
CLASSES = "PPPPTTSSSKKKKMNLRWJHVVVVVV"
ALPHABET = "HJKLMNPRSTVW"
#: Random strings of each length, and of each length and first class.
SAMPLES, FIXED_SAMPLES = 1000, 200
#: Letters taken as unknown signs, with their candidate readings.
READINGS = {"w": ("v", "u", "b"), "y": ("i", "j")}


def _sca(word: str) -> str:
    return f"translate({word}, '{LETTERS}', '{CLASSES}')"


def _coded(d) -> str:
    """CTE sc: plain words with their class string and its length."""
    return d.word_occ() + f", sc AS (SELECT lang, word, freq, sca, CAST(length(sca) AS BIGINT) AS len FROM (SELECT lang, word, freq, {_sca('word')} AS sca FROM uw WHERE {d.matches('^[a-z]+$', 'word')}))"


@relational
def p5_sca_encode(d) -> str:
    return f"WITH {_coded(d)} SELECT lang, word, sca, len FROM sc"


def _sides(d, cap: int | None = None) -> str:
    """CTEs qy (queries: all English class strings of four signs or more) and lx (candidates; cap: at most so many of a language and
    length, by hash, for the null model's pool)."""
    lx = "SELECT lang, sca, len, min(word) AS word FROM sc WHERE lang <> 'en' AND len >= 2 GROUP BY lang, sca, len"
    if cap:
        lx = f"SELECT lang, sca, len, word FROM (SELECT *, row_number() OVER (PARTITION BY lang, len ORDER BY md5(sca), sca) AS rk FROM ({lx})) WHERE rk <= {cap}"
    return _coded(d) + f""", qy AS (SELECT sca, len, sum(freq) AS k, min(word) AS word FROM sc WHERE lang = 'en' AND len >= 4 GROUP BY sca, len),
lx AS ({lx}), qb AS (SELECT qy.*, qy.len + s.o AS b FROM qy CROSS JOIN {d.series('-2', '2', 'o')} s)"""


def _matched(d, cap: int | None = None, best: bool = True) -> str:
    """_sides and tk (the five nearest candidates of each language for each query, rk; distances normalised by the longer one) and be
    (the nearest). Here they are a kept table, which the operator `nearest` makes; best: of the nearest alone, which takes less search."""
    names = "qy.sca AS q, qy.word AS qword, qy.len AS qlen, qy.k, lx.lang, lx.sca AS m, lx.word AS mword"
    if d.name == "spark":
        table = "pool_match_table" if cap else "best_match_table" if best else "match_table"
        tk = f"SELECT {names}, t.ned, t.rk FROM (SELECT q, lang, m, ned, rk FROM {table}) t JOIN qy ON qy.sca = t.q JOIN lx ON lx.lang = t.lang AND lx.sca = t.m"
    else:
        ma = f"SELECT {names.replace('qy.', 'qb.')}, CAST(levenshtein(qb.sca, lx.sca) AS DOUBLE) / greatest(qb.len, lx.len) AS ned FROM qb JOIN lx ON lx.len = qb.b"
        tk = f"SELECT q, qword, qlen, k, lang, x.m AS m, x.mword AS mword, x.ned AS ned, rk FROM (SELECT q, qword, qlen, k, lang, unnest(xs) AS x, generate_subscripts(xs, 1) AS rk FROM (SELECT q, qword, qlen, k, lang, min({{'ned': ned, 'm': m, 'mword': mword}}, 5) AS xs FROM ({ma}) GROUP BY q, qword, qlen, k, lang))"
    return _sides(d, cap) + f", tk AS ({tk}), be AS (SELECT * FROM tk WHERE rk = 1)"


@relational
def p5_edit_distance_matches(d) -> str:
    """The nearest candidate of each language for each query."""
    return f"WITH {_matched(d)} SELECT q, lang, m, {d.r6('ned')} AS ned FROM be"


@relational
def p5_topk_per_language(d) -> str:
    return f"WITH {_matched(d, best=False)} SELECT q, lang, m, {d.r6('ned')} AS ned, CAST(rk AS BIGINT) AS rank FROM tk WHERE ned <= 0.7"


def _scored(d) -> str:
    """CTE no: scores (1 - distance) put between 0 and 1 within a query: alone 1, without spread 1/2."""
    return _matched(d) + f", mm AS (SELECT *, 1 - ned AS raw, min(1 - ned) OVER (PARTITION BY q) AS lo, max(1 - ned) OVER (PARTITION BY q) AS hi, count(*) OVER (PARTITION BY q) AS cnt FROM be), no AS (SELECT q, qword, qlen, k, lang, m, mword, ned, raw, CASE WHEN cnt = 1 THEN {d.number(1)} WHEN hi - lo < 0.000000001 THEN {d.number(0.5)} ELSE (raw - lo) / (hi - lo) END AS score FROM mm)"


@relational
def p5_minmax_scores(d) -> str:
    return f"WITH {_scored(d)} SELECT q, lang, m, {d.r6('score')} AS score FROM no"


#: Syllables that stand for gloss keywords, with their fields.
_FIELDS = (("ach", "COMMODITY:GRAIN"), ("bo", "COMMODITY:OLIVE"), ("ent", "COMMODITY"), ("ier", "PLACE"), ("ou", "PLACE:RIVER"), ("ung", "PERSON"), ("ado", "FUNCTION:TOTAL"), ("re", "FUNCTION"))


def _meaning(d) -> str:
    """CTE sm: combined scores. The gloss of a match is the word itself; its field is that of the most specific keyword in it (the first
    among equals). A query's own field comes from its word alike; provenance is by length here, and weighs 1, 0.8, 0.5 or 0.3."""
    rows = ", ".join(f"({i}, '{a}', '{b}', {b.count(':') + 1})" for i, (a, b) in enumerate(_FIELDS))

    def field(word: str, table: str) -> str:
        return f"SELECT x.{word} AS word, f.field FROM (SELECT *, row_number() OVER (PARTITION BY {word} ORDER BY depth DESC, i) AS rk FROM (SELECT DISTINCT t.{word}, kw.i, kw.field, kw.depth FROM {table} t JOIN kw ON strpos(t.{word}, kw.keyword) > 0)) x JOIN kw f ON f.i = x.i WHERE x.rk = 1"

    strpos = (lambda s: s) if d.name == "duck" else (lambda s: s.replace("strpos(", "instr("))
    return _scored(d) + strpos(f""", kw AS (SELECT * FROM (VALUES {rows}) v(i, keyword, field, depth)), fm AS ({field('mword', 'no')}), fq AS ({field('qword', 'no')}),
se AS (SELECT no.*, fq.field AS qfield, fm.field AS mfield, CASE WHEN fq.field IS NULL OR fm.field IS NULL THEN NULL WHEN fq.field = fm.field THEN {d.number(1)} WHEN split_part(fq.field, ':', 1) = split_part(fm.field, ':', 1) THEN {d.number(0.5)} ELSE {d.number(0)} END AS sem,
  CASE WHEN qlen >= 8 THEN 'INDEPENDENT' WHEN qlen = 7 THEN 'CONSENSUS_CONFIRMED' WHEN qlen = 6 THEN 'CONSENSUS_ASSUMED' ELSE 'CONSENSUS_DEPENDENT' END AS provenance FROM no LEFT JOIN fm ON fm.word = no.mword LEFT JOIN fq ON fq.word = no.qword),
sm AS (SELECT *, 0.5 * score + coalesce(sem * CASE provenance WHEN 'INDEPENDENT' THEN 1.0 WHEN 'CONSENSUS_CONFIRMED' THEN 0.8 WHEN 'CONSENSUS_ASSUMED' THEN 0.5 ELSE 0.3 END, 0) AS combined FROM se)""")


@relational
def p5_gloss_audit(d) -> str:
    """Of each language's matches how many have a gloss that falls into a field."""
    return f"WITH {_meaning(d)} SELECT lang, count(*) AS entries, count(mfield) AS glossed, {d.r6('CAST(count(mfield) AS DOUBLE) / count(*)')} AS coverage FROM sm GROUP BY lang"


@relational
def p5_semantic_score(d) -> str:
    return f"WITH {_meaning(d)} SELECT q, lang, qfield, mfield, CAST(sem AS DOUBLE) AS semantic FROM sm"


@relational
def p5_combined_score(d) -> str:
    return f"WITH {_meaning(d)} SELECT q, lang, provenance, {d.r6('CAST(combined AS DOUBLE)')} AS combined FROM sm"


def _strata(d) -> str:
    return _meaning(d) + """, bs AS (SELECT * FROM (SELECT q, lang, qfield, round(CAST(combined AS DOUBLE), 9) AS c, row_number() OVER (PARTITION BY q ORDER BY round(CAST(combined AS DOUBLE), 9) DESC, lang) AS rk FROM sm) WHERE rk = 1),
st AS (SELECT CASE WHEN c >= 0.5 THEN lang ELSE 'unknown_substrate' END AS stratum, count(*) AS k, count(DISTINCT qfield) AS domains FROM bs GROUP BY CASE WHEN c >= 0.5 THEN lang ELSE 'unknown_substrate' END)"""


@relational
def p5_strata(d) -> str:
    """Queries by their best language, from 0.5 on; the rest is substrate; under five is noise."""
    return f"WITH {_strata(d)} SELECT stratum, k, {d.r6('CAST(k AS DOUBLE) / sum(k) OVER ()')} AS proportion, domains, k < 5 AS is_noise FROM st"


@relational
def p5_portrait(d) -> str:
    """Strata rolled up to families."""
    family = "CASE stratum WHEN 'unknown_substrate' THEN 'substrate' WHEN 'de' THEN 'germanic' WHEN 'fr' THEN 'romance' WHEN 'es' THEN 'romance' ELSE 'ambiguous' END"
    return f"WITH {_strata(d)}, tt AS (SELECT CAST(sum(k) AS DOUBLE) AS t FROM st) SELECT {family} AS family, CAST(sum(k) AS BIGINT) AS k, {d.r6('sum(k) / max(t)')} AS fraction FROM st CROSS JOIN tt GROUP BY {family}"


@relational
def p5_crossref(d) -> str:
    """Vocabularies of two halves of the sources: in both, new only, old only."""
    return f"""WITH {d.word_occ()}, ol AS (SELECT DISTINCT lang, word FROM w WHERE source < 'src15' AND n >= 2), nw2 AS (SELECT DISTINCT lang, word FROM w WHERE source >= 'src15' AND n >= 2)
SELECT coalesce(ol.lang, nw2.lang) AS lang, count(*) FILTER (WHERE ol.word IS NOT NULL AND nw2.word IS NOT NULL) AS corroborated, count(*) FILTER (WHERE ol.word IS NULL) AS new_only, count(*) FILTER (WHERE nw2.word IS NULL) AS old_only FROM ol FULL JOIN nw2 ON ol.lang = nw2.lang AND ol.word = nw2.word GROUP BY coalesce(ol.lang, nw2.lang)"""


def _analytical(d, ned: str, length: str, pool: str) -> str:
    """Chance of a best match this near: substitution ball of radius floor(ned * length), corrected for insertions and deletions."""
    radius = f"floor(({ned}) * ({length}) + 0.000000001)"
    ball = d.sum_range("0", d.big(radius), f"exp({d.log_choose(length, 'i')} + i * ln({d.number(11)}))")
    correction = f"CASE WHEN {radius} = 0 THEN 1.0 WHEN {radius} = 1 THEN 2.3 WHEN {radius} = 2 THEN 4.0 ELSE 2 * {radius} END"
    single = f"(({ball}) * {correction} / exp(({length}) * ln({d.number(12)})))"
    return f"CASE WHEN {single} >= 1 THEN {d.number(1)} ELSE 1 - exp(({pool}) * ln(1 - {single})) END"


def _pools(d) -> str:
    return _matched(d, POOL) + ", lc AS (SELECT lang, len, count(*) AS n FROM lx GROUP BY lang, len), po AS (SELECT qb.sca AS q, lc.lang, CAST(sum(lc.n) AS BIGINT) AS pool FROM qb JOIN lc ON lc.len = qb.b GROUP BY qb.sca, lc.lang), ap AS (SELECT be.q, be.qlen, be.lang, be.ned, po.pool FROM be JOIN po ON po.q = be.q AND po.lang = be.lang)"


@relational
def p5_analytical_pvalue(d) -> str:
    return f"WITH {_pools(d)} SELECT q, lang, {d.r6('ned')} AS ned, pool, {d.r6(_analytical(d, 'ned', 'qlen', 'pool'))} AS p FROM ap"


def _null(d, fixed: bool = False) -> str:
    """CTE nu (nf with fixed): for random class strings (their signs drawn by hash) as long as any query the nearest of a language's pool
    (POOL candidates of each length). fixed: with the first sign set to each class in turn. Here they are kept tables."""
    name = "nf" if fixed else "nu"
    if d.name == "spark":
        return f"{name} AS (SELECT lang, len, r, fixed, ned FROM {'fixed_' if fixed else ''}null_table)"
    sign = f"substr('{ALPHABET}', CAST({d.hash32("'null|' || CAST(l.len AS VARCHAR(9)) || '|' || CAST(r.r AS VARCHAR(9)) || '|' || CAST(p AS VARCHAR(9))")} % 12 + 1 AS INT), 1)"
    first = f"(SELECT unnest(string_split('{ALPHABET}', '')) AS fixed)" if fixed else "(SELECT NULL AS fixed)"
    return f"""{name}s AS (SELECT len, r, fixed, string_agg(CASE WHEN p = 1 AND fixed IS NOT NULL THEN fixed ELSE s END, '' ORDER BY p) AS sca FROM (SELECT l.len, r.r, f.fixed, p, {sign} AS s FROM (SELECT DISTINCT len FROM qy) l CROSS JOIN {d.series('1', str(FIXED_SAMPLES if fixed else SAMPLES), 'r')} r CROSS JOIN {first} f {d.each_of('1', 'l.len', 'p')}) GROUP BY len, r, fixed),
{name} AS (SELECT lang, len, r, fixed, ned FROM (SELECT lx.lang, x.sca, min(CAST(levenshtein(x.sca, lx.sca) AS DOUBLE) / greatest(x.len, lx.len)) AS ned FROM (SELECT DISTINCT sca, len, len + s.o AS b FROM {name}s CROSS JOIN {d.series('-2', '2', 'o')} s) x JOIN lx ON lx.len = x.b GROUP BY lx.lang, x.sca) JOIN {name}s USING (sca))"""


def _tested(d, fixed: bool = False) -> str:
    """CTEs qy, lx, ob (every query's nearest of each pool), the null's, and nd: how many of them are at most so far off, of how many."""
    if d.name == "spark":
        head = "ob AS (SELECT q, CAST(length(q) AS BIGINT) AS len, lang, ned FROM pool_match_table WHERE rk = 1)"
    else:
        head = f"{_matched(d, POOL)}, ob AS (SELECT q, qlen AS len, lang, ned FROM be)"
    table = "nf" if fixed else "nu"
    return f"""{head}, {_null(d, fixed)},
nd AS (SELECT lang, len, fixed, ned, CAST(sum(k) OVER (PARTITION BY lang, len, fixed ORDER BY ned) AS BIGINT) AS at_most, CAST(sum(k) OVER (PARTITION BY lang, len, fixed) AS BIGINT) AS draws FROM (SELECT lang, len, fixed, round(ned, 9) AS ned, count(*) AS k FROM {table} GROUP BY lang, len, fixed, round(ned, 9)) g)"""


def _share(at: str, null: str = "nd") -> str:
    """(null distances at or under the observed one, plus 1) / (all plus 1), over the rows that `at` joins with the null's values."""
    return f"CAST(coalesce(max(CASE WHEN {null}.ned <= {at} + 0.000000001 THEN {null}.at_most END), 0) + 1 AS DOUBLE) / (max({null}.draws) + 1)"


@relational
def p5_mc_null(d) -> str:
    """The null distribution as values with cumulative counts."""
    return f"WITH {_tested(d)} SELECT lang, len, {d.r6('ned')} AS ned, at_most FROM nd"


def _mc_p(d) -> str:
    return _tested(d) + f", mp AS (SELECT ob.q, ob.lang, max(ob.ned) AS ned, {_share('ob.ned')} AS p FROM ob JOIN nd ON nd.lang = ob.lang AND nd.len = ob.len GROUP BY ob.q, ob.lang)"


@relational
def p5_mc_pvalue(d) -> str:
    """(null distances at or under the observed one, plus 1) / (all plus 1)."""
    return f"WITH {_mc_p(d)} SELECT q, lang, {d.r6('ned')} AS ned, {d.r6('p')} AS p FROM mp"


def _fdr(d) -> str:
    """CTE qv. Comparisons of one p share a q-value, that of the last of them; there are no more values of p than draws, so the windows
    without a key hold those, not the comparisons."""
    return _mc_p(d) + f""", pk AS (SELECT p, count(*) AS k FROM mp GROUP BY p), pr AS (SELECT p, sum(k) OVER (ORDER BY p) AS rk, sum(k) OVER () AS m FROM pk),
pq AS (SELECT p, least({d.number(1)}, min(p * m / rk) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS qv FROM pr), qv AS (SELECT mp.q, mp.lang, mp.p, pq.qv FROM mp JOIN pq ON pq.p = mp.p)"""


@relational
def p5_bh_fdr(d) -> str:
    """Benjamini and Hochberg: the least p * m / rank from here up."""
    return f"WITH {_fdr(d)} SELECT q, lang, {d.r6('p')} AS p, {d.r6('qv')} AS q_value, qv <= 0.05 AS significant FROM qv"


@relational
def p5_class_conditional(d) -> str:
    """p against the null whose first sign has the query's class."""
    return f"""WITH {_tested(d, True)}
SELECT ob.q, ob.lang, substr(ob.q, 1, 1) AS fixed, {d.r6('max(ob.ned)')} AS ned, {d.r6(_share('ob.ned'))} AS p FROM ob JOIN nd ON nd.lang = ob.lang AND nd.len = ob.len AND nd.fixed = substr(ob.q, 1, 1) GROUP BY ob.q, ob.lang, substr(ob.q, 1, 1)"""


def _hypotheses(d) -> str:
    """CTE hy: words with the letters w and y taken as unknown: every combination of their candidate readings."""
    values = {s: ", ".join(f"('{s}', '{x}')" for x in r) for s, r in READINGS.items()}
    return d.word_occ() + f""", uk AS (SELECT word, freq FROM uw WHERE lang = 'en' AND n >= 4 AND {d.matches('^[a-z]+$', 'word')} AND {d.matches('[wy]', 'word')}),
rw AS (SELECT * FROM (VALUES {values['w']}) v(s, r)), ry AS (SELECT * FROM (VALUES {values['y']}) v(s, r)),
h1 AS (SELECT uk.word, coalesce(rw.r, '-') AS w_as, CASE WHEN rw.r IS NULL THEN uk.word ELSE replace(uk.word, 'w', rw.r) END AS x FROM uk LEFT JOIN rw ON rw.s = CASE WHEN contains(uk.word, 'w') THEN 'w' END),
hy AS (SELECT h1.word, w_as, coalesce(ry.r, '-') AS y_as, CASE WHEN ry.r IS NULL THEN x ELSE replace(x, 'y', ry.r) END AS reading FROM h1 LEFT JOIN ry ON ry.s = CASE WHEN contains(h1.word, 'y') THEN 'y' END)"""


@relational
def p5_hypotheses(d) -> str:
    return f"WITH {_hypotheses(d)} SELECT word, w_as, y_as, reading FROM hy"


def _read(d) -> str:
    """CTE hp: each hypothesis' nearest candidate within two signs of its length (here from a kept table), how many there are, and its
    analytical p."""
    if d.name == "spark":
        near = "SELECT q AS sca, lang, ned FROM reading_table"
    else:
        near = f"SELECT hw.sca, lc.lang, min(CAST(levenshtein(hw.sca, lc.sca) AS DOUBLE) / greatest(hw.len, lc.len)) AS ned FROM (SELECT DISTINCT sca, len, len + s.o AS b FROM hs CROSS JOIN {d.series('-2', '2', 'o')} s) hw JOIN lc ON lc.len = hw.b GROUP BY hw.sca, lc.lang"
    return _hypotheses(d) + f""", lc AS (SELECT DISTINCT lang, {_sca('word')} AS sca, n AS len FROM uw WHERE lang <> 'en' AND {d.matches('^[a-z]+$', 'word')}),
hs AS (SELECT hy.*, {_sca('reading')} AS sca, CAST(length(reading) AS BIGINT) AS len FROM hy), ls AS (SELECT lang, len, count(*) AS k FROM lc GROUP BY lang, len),
lp AS (SELECT h.len, ls.lang, CAST(sum(ls.k) AS BIGINT) AS pool FROM (SELECT DISTINCT len, len + s.o AS b FROM hs CROSS JOIN {d.series('-2', '2', 'o')} s) h JOIN ls ON ls.len = h.b GROUP BY h.len, ls.lang), hn AS ({near}),
hb AS (SELECT hs.word, hs.w_as, hs.y_as, hs.reading, hn.lang, hs.len, lp.pool, hn.ned FROM hs JOIN hn ON hn.sca = hs.sca JOIN lp ON lp.len = hs.len AND lp.lang = hn.lang),
hp AS (SELECT *, round({_analytical(d, 'ned', 'len', 'pool')}, 9) AS p FROM hb)"""


@relational
def p5_bias_corrections(d) -> str:
    """Each reading's analytical p beside three corrections of it.

    class_conditional: p from the null whose first sign has the class of the word's first unknown sign's reading. freq_norm: p times, for
    each unknown sign, the rate of its reading's class over the mean rate of consonants; a class's rate is one over its mean null distance
    (at least 0.01), a vowel's is 1. grid_prior: p times, for each unknown sign in a column of the grid with known signs, the uniform
    share of a class over the prior of its reading's class, the known signs of that column counted with one added to each class."""
    read = lambda c: f"CASE WHEN {c} <> '-' THEN {_sca(c)} END"
    one, uniform = d.number(1), f"({d.number(1)} / {len(ALPHABET)})"
    null = f"{_sides(d, POOL)[len(_coded(d)):].lstrip(', ')}, " if d.name == "duck" else ""
    coded = _coded(d)[len(d.word_occ()) :].lstrip(", ") + ", " if d.name == "duck" else ""
    norm = lambda s: f"coalesce(r{s}.rate / mr.m, {one})"
    prior = lambda s: f"CASE WHEN t{s}.t IS NULL OR c{s} IS NULL THEN {one} ELSE {uniform} / ((coalesce(k{s}.n, 0) + {one}) / (t{s}.t + {len(ALPHABET)})) END"
    joins = " ".join(f"LEFT JOIN fr r{s} ON r{s}.lang = hc.lang AND r{s}.len = hc.len AND r{s}.fixed = hc.c{s} LEFT JOIN kt t{s} ON t{s}.sign = '{s}' LEFT JOIN kn k{s} ON k{s}.sign = '{s}' AND k{s}.cls = hc.c{s}" for s in READINGS)
    return f"""WITH {_read(d)}, {coded}{null}{_null(d, True)},
nd AS (SELECT lang, len, fixed, ned, sum(k) OVER (PARTITION BY lang, len, fixed ORDER BY ned) AS at_most, sum(k) OVER (PARTITION BY lang, len, fixed) AS draws FROM (SELECT lang, len, fixed, round(ned, 9) AS ned, count(*) AS k FROM nf GROUP BY lang, len, fixed, round(ned, 9)) g),
fr AS (SELECT lang, len, fixed, CASE WHEN fixed = 'V' THEN {one} ELSE {one} / greatest(avg(ned), 0.01) END AS rate FROM nf GROUP BY lang, len, fixed), mr AS (SELECT lang, len, avg(rate) AS m FROM fr WHERE fixed <> 'V' GROUP BY lang, len),
gc AS (SELECT sign, vowel_column FROM ({p1_vowel_columns(d)}) g WHERE lang = 'en' AND vowel_column >= 0 AND {d.matches('^[a-z]$', 'sign')}),
kn AS (SELECT u.sign, {_sca('k.sign')} AS cls, count(*) AS n FROM gc u JOIN gc k ON k.vowel_column = u.vowel_column WHERE u.sign IN ('w', 'y') AND k.sign NOT IN ('w', 'y') GROUP BY u.sign, {_sca('k.sign')}), kt AS (SELECT sign, sum(n) AS t FROM kn GROUP BY sign),
hc AS (SELECT *, {read('w_as')} AS cw, {read('y_as')} AS cy, CASE WHEN w_as = '-' OR y_as <> '-' AND instr(word, 'y') < instr(word, 'w') THEN {read('y_as')} ELSE {read('w_as')} END AS c1 FROM hp),
cc AS (SELECT o.lang, o.len, o.c1, o.ned, {_share('o.ned')} AS p FROM (SELECT DISTINCT lang, len, c1, round(ned, 9) AS ned FROM hc) o JOIN nd ON nd.lang = o.lang AND nd.len = o.len AND nd.fixed = o.c1 GROUP BY o.lang, o.len, o.c1, o.ned)
SELECT hc.word, hc.lang, hc.reading, {d.r6('hc.p')} AS p, {d.r6(f'coalesce(cc.p, {one})')} AS class_conditional, {d.r6(f'least({one}, hc.p * {norm("w")} * {norm("y")})')} AS freq_norm, {d.r6(f'least({one}, hc.p * {prior("w")} * {prior("y")})')} AS grid_prior
FROM hc LEFT JOIN cc ON cc.lang = hc.lang AND cc.len = hc.len AND cc.c1 = hc.c1 AND cc.ned = round(hc.ned, 9) LEFT JOIN mr ON mr.lang = hc.lang AND mr.len = hc.len {joins}"""


def _best(d) -> str:
    return _read(d) + f""", nb AS (SELECT *, count(*) OVER (PARTITION BY word, lang) AS readings, row_number() OVER (PARTITION BY word, lang ORDER BY p, reading) AS rk FROM hp),
sl AS (SELECT word, lang, reading, w_as, y_as, readings, p, least({d.number(1)}, p * readings) AS adjusted FROM nb WHERE rk = 1)"""


@relational
def p5_stem_language_best(d) -> str:
    """The best reading of a word in a language; p times the number of readings."""
    return f"WITH {_best(d)} SELECT word, lang, reading, readings, {d.r6('adjusted')} AS adjusted FROM sl"


@relational
def p5_self_consistency(d) -> str:
    """For each unknown sign and language the reading that most best hypotheses choose: confirmed with two thirds of three votes or
    more, tentative with half, else inconclusive."""
    return f"""WITH {_best(d)}, vo AS (SELECT lang, 'w' AS sign, w_as AS r, count(*) AS k FROM sl WHERE w_as <> '-' GROUP BY lang, w_as UNION ALL SELECT lang, 'y', y_as, count(*) FROM sl WHERE y_as <> '-' GROUP BY lang, y_as),
vr AS (SELECT *, sum(k) OVER (PARTITION BY lang, sign) AS t, row_number() OVER (PARTITION BY lang, sign ORDER BY k DESC, r) AS rk FROM vo)
SELECT lang, sign, r AS reading, k AS votes, CAST(t AS BIGINT) AS total, CASE WHEN k >= 3 AND 3 * k >= 2 * t THEN 'CONFIRMED' WHEN 2 * k >= t THEN 'TENTATIVE' ELSE 'INCONCLUSIVE' END AS verdict FROM vr WHERE rk = 1"""


def _chains(d) -> str:
    """CTE ch: all words of three letters or more under the shortest of them that begins them (their root)."""
    return d.word_occ() + f""", cw AS (SELECT lang, word, n, freq FROM uw WHERE n >= 3), pf AS (SELECT lang, word, n, freq, l, substr(word, 1, CAST(l AS INT)) AS prefix FROM cw {d.each_of('CAST(3 AS BIGINT)', 'cw.n', 'l')}),
rt AS (SELECT pf.lang, pf.word, pf.n, pf.freq, min(pf.l) AS l FROM pf JOIN cw r ON r.lang = pf.lang AND r.word = pf.prefix GROUP BY pf.lang, pf.word, pf.n, pf.freq), ch AS (SELECT lang, substr(word, 1, CAST(l AS INT)) AS root, word, n, freq FROM rt)"""


@relational
def p5_chains(d) -> str:
    return f"WITH {_chains(d)} SELECT lang, root, count(*) AS members, max(n) AS longest, CAST(sum(freq) AS BIGINT) AS freq FROM ch GROUP BY lang, root HAVING count(*) >= 2"


@relational
def p5_rank_stability(d) -> str:
    """Along a chain of three members or more, by length: how often the next has the same ending class as the one before."""
    return f"""WITH {_chains(d)}, ms AS (SELECT lang, root, word, n, {_sca('substr(word, n, 1)')} AS winner, count(*) OVER (PARTITION BY lang, root) AS members FROM ch),
lg AS (SELECT lang, root, winner, lag(winner) OVER (PARTITION BY lang, root ORDER BY n, word) AS before, members FROM ms WHERE members >= 3)
SELECT lang, root, max(members) AS members, {d.r6(f'avg(CASE WHEN winner = before THEN {d.number(1)} ELSE {d.number(0)} END)')} AS stability FROM lg WHERE before IS NOT NULL GROUP BY lang, root"""


def _stable(d) -> str:
    """CTE ws: chains of three members or more with the share of their commonest ending class."""
    return _chains(d) + f""", mc AS (SELECT lang, root, {_sca('substr(word, n, 1)')} AS e, count(*) AS k FROM ch GROUP BY lang, root, {_sca('substr(word, n, 1)')}),
ws AS (SELECT lang, root, e AS mode_word, t AS members, CAST(k AS DOUBLE) / t AS stability FROM (SELECT *, sum(k) OVER (PARTITION BY lang, root) AS t, row_number() OVER (PARTITION BY lang, root ORDER BY k DESC, e) AS rk FROM mc) WHERE rk = 1 AND t >= 3)"""


@relational
def p5_word_stability(d) -> str:
    return f"WITH {_stable(d)} SELECT lang, root, mode_word, CAST(members AS BIGINT) AS members, {d.r6('stability')} AS stability FROM ws"


def _cascade(d) -> str:
    return _stable(d) + """, f0 AS (SELECT *, stability >= 0.7 AS s0, length(root) >= 4 AS s1, members >= 4 AS s2 FROM ws), mw AS (SELECT lang, mode_word FROM (SELECT lang, mode_word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, mode_word) AS rk FROM f0 WHERE s0 GROUP BY lang, mode_word) WHERE rk = 1),
f3 AS (SELECT f0.*, mw.mode_word IS NULL AS s3 FROM f0 LEFT JOIN mw ON mw.lang = f0.lang AND mw.mode_word = f0.mode_word)"""


@relational
def p5_stability_filters(d) -> str:
    """Chains left after each filter: stability, word length, members, not the language's commonest stable word."""
    return f"WITH {_cascade(d)} SELECT lang, count(*) AS chains, count(*) FILTER (WHERE s0) AS stable, count(*) FILTER (WHERE s0 AND s1) AS long_words, count(*) FILTER (WHERE s0 AND s1 AND s2) AS many_members, count(*) FILTER (WHERE s0 AND s1 AND s2 AND s3) AS rare_mode FROM f3 GROUP BY lang"


@relational
def p5_filter_ablation(d) -> str:
    """Survival of two languages' chains with each filter left out."""
    pct = lambda c: d.r6(f"100 * CAST(count(*) FILTER (WHERE {c}) AS DOUBLE) / count(*)")
    return f"WITH {_cascade(d)} SELECT lang, {pct('s0 AND s1 AND s2 AND s3')} AS all_filters, {pct('s1 AND s2 AND s3')} AS without_stability, {pct('s0 AND s2 AND s3')} AS without_length, {pct('s0 AND s1 AND s3')} AS without_members, {pct('s0 AND s1 AND s2')} AS without_mode FROM f3 WHERE lang IN ('de', 'fr') GROUP BY lang"


@relational
def p5_rank_shift(d) -> str:
    """Languages ranked by mean stability before and by survivors after the filters."""
    return f"""WITH {_cascade(d)}, be AS (SELECT lang, CAST(row_number() OVER (ORDER BY round(avg(stability), 9) DESC, lang) AS BIGINT) AS r FROM f3 GROUP BY lang), af AS (SELECT lang, CAST(row_number() OVER (ORDER BY count(*) DESC, lang) AS BIGINT) AS r FROM f3 WHERE s0 AND s1 AND s2 AND s3 GROUP BY lang), mx AS (SELECT count(*) AS m FROM be)
SELECT be.lang, be.r AS rank_before, coalesce(af.r, mx.m) AS rank_after, be.r - coalesce(af.r, mx.m) AS change FROM be LEFT JOIN af ON af.lang = be.lang CROSS JOIN mx"""


@relational
def p5_chain_language_overlap(d) -> str:
    """Roots by the number of languages in which their chain is stable."""
    return f"WITH {_stable(d)}, rl AS (SELECT root, count(DISTINCT lang) AS langs FROM ws WHERE stability >= 0.5 GROUP BY root) SELECT langs, count(*) AS roots FROM rl GROUP BY langs"


@relational
def p5_reading_votes(d) -> str:
    """Per unknown sign and reading: words, mean distance; dominant with twice the runner-up and three words, or alone with two."""
    return f"""WITH {_best(d)}, hv AS (SELECT 'w' AS sign, hp.w_as AS r, hp.word, hp.ned FROM hp WHERE hp.w_as <> '-' AND hp.ned <= 0.4 UNION ALL SELECT 'y', hp.y_as, hp.word, hp.ned FROM hp WHERE hp.y_as <> '-' AND hp.ned <= 0.4),
hg AS (SELECT sign, r, count(DISTINCT word) AS words, count(*) AS hits, avg(ned) AS mean_ned FROM hv GROUP BY sign, r), hr AS (SELECT *, lead(words) OVER (PARTITION BY sign ORDER BY words DESC, r) AS runner_up, count(*) OVER (PARTITION BY sign) AS options, row_number() OVER (PARTITION BY sign ORDER BY words DESC, r) AS rk FROM hg)
SELECT sign, r AS reading, words, hits, {d.r6('mean_ned')} AS mean_distance, rk = 1 AND ((options > 1 AND words >= 2 * runner_up AND words >= 3) OR (options = 1 AND words >= 2)) AS dominant FROM hr"""


@relational
def p5_threshold_calibration(d) -> str:
    """Quantiles of scores by language, and how many pass each threshold from 0.25 to 1 in quarters."""
    return f"""WITH {_matched(d)}, sc2 AS (SELECT lang, 1 - ned AS s FROM be), qn AS (SELECT lang, {d.r6(d.quantile('s', 0.25))} AS q1, {d.r6(d.quantile('s', 0.5))} AS median, {d.r6(d.quantile('s', 0.75))} AS q3 FROM sc2 GROUP BY lang), th AS (SELECT CAST(i AS DOUBLE) / 4 AS t FROM {d.series('1', '4', 'i')} s)
SELECT qn.lang, q1, median, q3, th.t AS threshold, count(*) FILTER (WHERE sc2.s >= th.t) AS passing FROM qn JOIN sc2 ON sc2.lang = qn.lang CROSS JOIN th GROUP BY qn.lang, q1, median, q3, th.t"""


@relational
def p5_length_strata(d) -> str:
    return f"WITH {_matched(d)}, bn AS (SELECT lang, CASE WHEN qlen <= 4 THEN 'short' WHEN qlen <= 6 THEN 'medium' ELSE 'long' END AS bin, ned FROM be) SELECT lang, bin, count(*) AS k, {d.r6('avg(ned)')} AS mean_ned, {d.r6('stddev_pop(ned)')} AS sd_ned FROM bn GROUP BY lang, bin"


@relational
def p5_gradient_check(d) -> str:
    """Whether the median score falls with the query's length, step by step; total range and mean step."""
    return f"""WITH {_matched(d)}, md AS (SELECT least(qlen, 8) AS len, round({d.quantile('1 - ned', 0.5)}, 9) AS m FROM be GROUP BY least(qlen, 8)), nx AS (SELECT len, m, lead(m) OVER (ORDER BY len) AS nxt FROM md)
SELECT count(*) AS steps, count(*) FILTER (WHERE nxt > m) = 0 AS falling, {d.r6('(SELECT max(m) - min(m) FROM md)')} AS total_range, {d.r6('avg(m - nxt)')} AS mean_step FROM nx WHERE nxt IS NOT NULL"""


@relational
def p5_mann_whitney(d) -> str:
    """Distances of two languages: rank-sum U (ties share ranks), normal z without corrections, its band. Ranks
    come from the counts of equal distances, which are few."""
    return f"""WITH {_matched(d)}, xy AS (SELECT round(ned, 9) AS v, CAST(count(*) FILTER (WHERE lang = 'de') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE lang = 'fr') AS DOUBLE) AS b FROM be WHERE lang IN ('de', 'fr') GROUP BY round(ned, 9)),
rk AS (SELECT a, b, sum(a + b) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - (a + b - 1) / 2 AS r FROM xy), ag AS (SELECT sum(a) AS n1, sum(b) AS n2, sum(r * a) AS r1 FROM rk), uu AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM ag), zz AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM uu)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {d.r6('u')} AS u, {d.r6('z')} AS z, CASE WHEN abs(z) >= 2.576 THEN 'p < 0.01' WHEN abs(z) >= 1.96 THEN 'p < 0.05' ELSE 'n.s.' END AS band FROM zz"""


@relational
def p5_cohens_d(d) -> str:
    return f"WITH {_matched(d)}, st AS (SELECT avg(ned) FILTER (WHERE lang = 'de') AS m1, avg(ned) FILTER (WHERE lang <> 'de') AS m2, var_pop(ned) FILTER (WHERE lang = 'de') AS v1, var_pop(ned) FILTER (WHERE lang <> 'de') AS v2 FROM be) SELECT {d.r6('m1')} AS mean_within, {d.r6('m2')} AS mean_between, {d.r6('(m2 - m1) / sqrt((v1 + v2) / 2)')} AS cohens_d FROM st"


@relational
def p5_band_verdict(d) -> str:
    """Languages against a reference's mean (German): within one deviation below, within two, or noise."""
    return f"""WITH {_matched(d)}, rf AS (SELECT avg(1 - ned) AS m, stddev_pop(1 - ned) AS s FROM be WHERE lang = 'de'), gr AS (SELECT lang, avg(1 - ned) AS m, count(*) AS k FROM be GROUP BY lang HAVING count(*) >= 5)
SELECT gr.lang, k, {d.r6('gr.m')} AS mean_score, CASE WHEN gr.m >= rf.m - rf.s THEN 'COGNATE-LIKE' WHEN gr.m >= rf.m - 2 * rf.s THEN 'WEAK SIGNAL' ELSE 'NOISE-LIKE' END AS verdict FROM gr CROSS JOIN rf"""
