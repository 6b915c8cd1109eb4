"""Pillar 1: where signs stand, what follows what, which signs alternate, and what that says about vowels and consonants.

Signs are letters, words are runs of letters, the candidate language is the document's. Words are counted once per language and
weighted by frequency before they are taken apart, so the letters of a corpus are never all spread out.
"""

from __future__ import annotations

from tessera.plans.registry import relational


def _signs(d) -> str:
    """CTE s: letters of distinct words with place, weight and both neighbours' places."""
    return f"{d.word_occ()}, s AS (SELECT lang, word, n, freq, p, sign FROM uw {d.each(d.letters('word'), 'p', 'sign')})"


def _labelled(d) -> str:
    return _signs(d) + ", l AS (SELECT *, CASE WHEN n = 1 THEN 'singleton' WHEN p = 0 THEN 'initial' WHEN p = n - 1 THEN 'final' ELSE 'medial' END AS place FROM s)"


def _counts(d) -> str:
    """CTE c: per language and sign the numbers of places."""
    return _labelled(d) + ", c AS (SELECT lang, sign, CAST(sum(CASE WHEN place = 'initial' THEN freq ELSE 0 END) AS BIGINT) AS k_initial, CAST(sum(CASE WHEN place = 'medial' THEN freq ELSE 0 END) AS BIGINT) AS k_medial, CAST(sum(CASE WHEN place = 'final' THEN freq ELSE 0 END) AS BIGINT) AS k_final, CAST(sum(freq) AS BIGINT) AS total FROM l GROUP BY lang, sign)"


@relational
def p1_positional_counts(d) -> str:
    """Initial, medial and final occurrences of each sign; words of one letter are left out."""
    return f"WITH {_counts(d)} SELECT lang, sign, k_initial, k_medial, k_final, total FROM c"


@relational
def p1_position_rates(d) -> str:
    """Shares of a sign's occurrences, and mean relative position (index over length less one)."""
    return f"WITH {_counts(d)}, r AS (SELECT lang, sign, sum(freq * CASE WHEN n <= 1 THEN {d.number(0.5)} ELSE CAST(p AS DOUBLE) / (n - 1) END) / sum(freq) AS pos FROM s GROUP BY lang, sign) SELECT c.lang, c.sign, {d.r6('CAST(k_initial AS DOUBLE) / total')} AS initial_rate, {d.r6('CAST(k_medial AS DOUBLE) / total')} AS medial_rate, {d.r6('CAST(k_final AS DOUBLE) / total')} AS final_rate, {d.r6('pos')} AS mean_position FROM c JOIN r ON c.lang = r.lang AND c.sign = r.sign"


@relational
def p1_word_length_stats(d) -> str:
    return f"WITH {d.word_occ()} SELECT lang, count(*) AS n_words, {d.r6('avg(CAST(n AS DOUBLE))')} AS mean_len, {d.r6('stddev_pop(CAST(n AS DOUBLE))')} AS sd_len, min(n) AS min_len, max(n) AS max_len, {d.r6(d.quantile('n', 0.5))} AS median_len FROM w GROUP BY lang"


def _enriched(d) -> str:
    """CTE v: enrichment of each sign in initial place, with both exact tails, Bonferroni over the signs seen 15 times or more."""
    return _counts(d) + f""", t AS (SELECT lang, CAST(sum(k_initial) AS DOUBLE) / sum(total) AS p0, CAST(sum(k_medial) AS DOUBLE) / sum(total) AS m0 FROM c GROUP BY lang),
x AS (SELECT c.lang, sign, k_initial, k_medial, k_final, total, p0, m0, count(*) OVER (PARTITION BY c.lang) AS testable FROM c JOIN t ON c.lang = t.lang WHERE total >= 15),
v AS (SELECT lang, sign, k_initial, k_medial, total, testable, CAST(k_initial AS DOUBLE) / total / p0 AS enrichment, CAST(k_initial AS DOUBLE) / total AS initial_fraction,
  {d.binom_upper('k_initial', 'total', 'p0')} AS p_initial, {d.binom_lower('k_medial', 'total', 'm0')} AS p_medial FROM x)"""


@relational
def p1_vowel_enrichment(d) -> str:
    """A sign is vowel-like if it is enriched initially and depleted medially, both at 0.05 over the number of tests."""
    small = "0.05 / testable"
    return f"WITH {_enriched(d)} SELECT lang, sign, k_initial, k_medial, total, {d.r6('enrichment')} AS enrichment, {d.r6('p_initial')} AS p_initial, {d.r6('p_medial')} AS p_medial, {d.r6(f'least({d.number(1)}, greatest(p_initial, p_medial) * testable)')} AS p_corrected, p_initial < {small} AND p_medial < {small} AS is_vowel, {d.r6(f'least({d.number(1)}, enrichment / 3)')} AS confidence FROM v"


def _bigrams(d) -> str:
    """CTE b: counts of neighbouring signs."""
    return _signs(d) + f", b AS (SELECT lang, sign AS a, nxt AS b, CAST(sum(freq) AS BIGINT) AS k FROM (SELECT lang, freq, sign, lead(sign) OVER (PARTITION BY lang, word ORDER BY p) AS nxt FROM s) WHERE nxt IS NOT NULL GROUP BY lang, sign, nxt)"


@relational
def p1_bigram_counts(d) -> str:
    return f"WITH {_bigrams(d)} SELECT lang, a, b, k FROM b"


def _residuals(d) -> str:
    """CTE g: the whole grid of sign pairs, empty cells included, with expectation and Poisson tails."""
    return _bigrams(d) + f""", f AS (SELECT lang, sign FROM s GROUP BY lang, sign HAVING sum(freq) >= 15),
ra AS (SELECT lang, a, CAST(sum(k) AS DOUBLE) AS n FROM b GROUP BY lang, a), cb AS (SELECT lang, b, CAST(sum(k) AS DOUBLE) AS n FROM b GROUP BY lang, b), tt AS (SELECT lang, CAST(sum(k) AS DOUBLE) AS n FROM b GROUP BY lang),
g AS (SELECT x.lang, x.sign AS a, y.sign AS b, coalesce(b.k, 0) AS observed, coalesce(ra.n, 0) * coalesce(cb.n, 0) / tt.n AS expected
  FROM f x JOIN f y ON x.lang = y.lang JOIN tt ON tt.lang = x.lang LEFT JOIN ra ON ra.lang = x.lang AND ra.a = x.sign LEFT JOIN cb ON cb.lang = y.lang AND cb.b = y.sign LEFT JOIN b ON b.lang = x.lang AND b.a = x.sign AND b.b = y.sign)"""


@relational
def p1_bigram_residuals(d) -> str:
    return f"WITH {_residuals(d)} SELECT lang, a, b, observed, {d.r6('expected')} AS expected, {d.r6('(observed - expected) / sqrt(expected)')} AS residual FROM g WHERE expected > 0"


@relational
def p1_forbidden_favored(d) -> str:
    """Cells with an expectation of 2 or more: forbidden if never seen (chance exp(-E)), favored if above it (Poisson tail)."""
    return f"""WITH {_residuals(d)}, e AS (SELECT *, count(*) OVER (PARTITION BY lang) AS tests FROM g WHERE expected >= 2),
q AS (SELECT *, CASE WHEN observed = 0 THEN exp(-expected) WHEN observed > expected THEN {d.poisson_upper('observed', 'expected')} END AS p FROM e)
SELECT lang, a, b, observed, {d.r6('expected')} AS expected, {d.r6(f'least({d.number(1)}, p * tests)')} AS p_corrected, CASE WHEN observed = 0 THEN 'forbidden' ELSE 'favored' END AS kind FROM q WHERE p * tests < 0.01"""


@relational
def p1_positional_constraints(d) -> str:
    return f"""WITH {_counts(d)} SELECT lang, sign, total, CASE WHEN k_initial = total THEN 'initial_only' WHEN k_initial = 0 AND k_final = 0 THEN 'never_initial_or_final' WHEN k_initial = 0 THEN 'never_initial' ELSE 'never_final' END AS kind
FROM c WHERE total >= 15 AND (k_initial = total OR k_initial = 0 OR k_final = 0)"""


def _alternations(d, rest: str = "substr(word, 1, n - k)", last: str = "substr(word, n, 1)", least: int = 2) -> str:
    """CTE e: unordered sign pairs that end words with one stem; a stem weighs 1 (one sign dropped) or 1/2 (two dropped), the most once."""
    return d.word_occ() + f""", k AS (SELECT lang, {rest} AS stem, {last} AS x, k FROM uw JOIN {d.series('1', '2', 'k')} ks ON n - k >= {least}),
u AS (SELECT DISTINCT lang, stem, k, x FROM k),
st AS (SELECT a.lang, a.x AS a, b.x AS b, a.stem, max(CASE WHEN a.k = 1 THEN {d.number(1)} ELSE {d.number(0.5)} END) AS weight FROM u a JOIN u b ON a.lang = b.lang AND a.stem = b.stem AND a.k = b.k AND a.x < b.x GROUP BY a.lang, a.x, b.x, a.stem),
e AS (SELECT lang, a, b, count(*) AS stems, sum(weight) AS weight FROM st GROUP BY lang, a, b)"""


@relational
def p1_alternation_pairs(d) -> str:
    return f"WITH {_alternations(d)} SELECT lang, a, b, stems, {d.r6('weight')} AS weight FROM e WHERE stems >= 2"


def _significant(d) -> str:
    """CTE z: pairs with the Poisson tail of their number of stems; both dropped lengths' branching stems count in the rate."""
    return _alternations(d) + f""", br AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n FROM (SELECT lang, stem, k FROM u GROUP BY lang, stem, k HAVING count(*) > 1) GROUP BY lang),
fs AS (SELECT lang, substr(word, n, 1) AS x, CAST(sum(freq) AS DOUBLE) AS n FROM uw GROUP BY lang, substr(word, n, 1)), ft AS (SELECT lang, sum(n) AS n FROM fs GROUP BY lang),
z AS (SELECT e.lang, e.a, e.b, e.stems, e.weight, fa.n / ft.n * fb.n / ft.n * br.n AS rate FROM e JOIN fs fa ON fa.lang = e.lang AND fa.x = e.a JOIN fs fb ON fb.lang = e.lang AND fb.x = e.b JOIN ft ON ft.lang = e.lang JOIN br ON br.lang = e.lang WHERE e.stems >= 2)"""


@relational
def p1_alternation_significant(d) -> str:
    return f"WITH {_significant(d)}, y AS (SELECT *, {d.poisson_upper('stems', 'rate')} AS p FROM z) SELECT lang, a, b, stems, {d.r6('rate')} AS expected, {d.r6('p')} AS p, p < 0.01 AS significant FROM y"


@relational
def p1_initial_alternations(d) -> str:
    """The mirror image: first signs before one rest of two letters or more."""
    return f"""WITH {d.word_occ()}, u AS (SELECT DISTINCT lang, substr(word, 2) AS rest, substr(word, 1, 1) AS x FROM uw WHERE n >= 3)
SELECT a.lang, a.x AS a, b.x AS b, count(*) AS rests FROM u a JOIN u b ON a.lang = b.lang AND a.rest = b.rest AND a.x < b.x GROUP BY a.lang, a.x, b.x HAVING count(*) >= 2"""


def _graph(d) -> str:
    """CTEs g2 (edges both ways) and vc (the five most enriched signs of a language, ranked)."""
    return _alternations(d) + f""", g1 AS (SELECT * FROM e WHERE stems >= 2), g2 AS (SELECT lang, a AS x, b AS y, weight FROM g1 UNION ALL SELECT lang, b, a, weight FROM g1),
fi AS (SELECT lang, sign, CAST(sum(CASE WHEN p = 0 THEN freq ELSE 0 END) AS DOUBLE) / sum(freq) AS f, sum(freq) AS n FROM (SELECT lang, word, n, freq, p, sign FROM uw {d.each(d.letters('word'), 'p', 'sign')}) GROUP BY lang, sign HAVING sum(freq) >= 15),
vc AS (SELECT lang, sign, f, rk FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f DESC, sign) AS rk FROM fi) WHERE rk <= 5)"""


@relational
def p1_alternation_degree(d) -> str:
    return f"WITH {_graph(d)} SELECT lang, x AS sign, count(*) AS degree, {d.r6('sum(weight)')} AS strength FROM g2 GROUP BY lang, x"


@relational
def p1_vowel_columns(d) -> str:
    """Each sign goes to the candidate it alternates least with (ties: the higher ranked), -1 without any evidence."""
    return f"""WITH {_graph(d)}, q AS (SELECT fi.lang, fi.sign, vc.rk, coalesce(g2.weight, 0) AS weight, sum(coalesce(g2.weight, 0)) OVER (PARTITION BY fi.lang, fi.sign) AS seen FROM fi JOIN vc ON fi.lang = vc.lang LEFT JOIN g2 ON g2.lang = fi.lang AND g2.x = fi.sign AND g2.y = vc.sign),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, sign ORDER BY weight, rk) AS o FROM q)
SELECT lang, sign, CAST(CASE WHEN seen = 0 THEN -1 ELSE rk END AS BIGINT) AS vowel_column FROM o WHERE o = 1"""


@relational
def p1_row_jaccard(d) -> str:
    """Weighted Jaccard (sum of minima over sum of maxima) of two signs' rows in the alternation graph."""
    return f"""WITH {_graph(d)}, tot AS (SELECT lang, x, sum(weight) AS t FROM g2 GROUP BY lang, x),
m AS (SELECT a.lang, a.x AS a, b.x AS b, sum(least(a.weight, b.weight)) AS low FROM g2 a JOIN g2 b ON a.lang = b.lang AND a.y = b.y AND a.x < b.x GROUP BY a.lang, a.x, b.x)
SELECT m.lang, m.a, m.b, {d.r6('low / (ta.t + tb.t - low)')} AS similarity FROM m JOIN tot ta ON ta.lang = m.lang AND ta.x = m.a JOIN tot tb ON tb.lang = m.lang AND tb.x = m.b"""


@relational
def p1_same_class_adjacency(d) -> str:
    """How often neighbours share a vowel column, against one in the number of columns (exact upper tail), by language."""
    return f"""WITH {_graph(d)}, q AS (SELECT fi.lang, fi.sign, vc.rk, coalesce(g2.weight, 0) AS weight FROM fi JOIN vc ON fi.lang = vc.lang LEFT JOIN g2 ON g2.lang = fi.lang AND g2.x = fi.sign AND g2.y = vc.sign),
o AS (SELECT lang, sign, rk AS col FROM (SELECT *, row_number() OVER (PARTITION BY lang, sign ORDER BY weight, rk) AS o FROM q) WHERE o = 1),
nb AS (SELECT lang, sign AS a, nxt AS b, freq FROM (SELECT lang, freq, sign, lead(sign) OVER (PARTITION BY lang, word ORDER BY p) AS nxt FROM (SELECT lang, word, n, freq, p, sign FROM uw {d.each(d.letters('word'), 'p', 'sign')})) WHERE nxt IS NOT NULL),
kk AS (SELECT nb.lang, CAST(sum(CASE WHEN x.col = y.col THEN freq ELSE 0 END) AS BIGINT) AS k, CAST(sum(freq) AS BIGINT) AS n FROM nb JOIN o x ON x.lang = nb.lang AND x.sign = nb.a JOIN o y ON y.lang = nb.lang AND y.sign = nb.b GROUP BY nb.lang)
SELECT lang, k AS same, n AS pairs, {d.r6('CAST(k AS DOUBLE) / n')} AS rate, {d.r6('CAST(k AS DOUBLE) / n - 0.2')} AS effect, {d.r6(d.binom_upper('k', 'n', d.number(0.2)))} AS p FROM kk"""


def _contexts(d) -> str:
    """CTE x: right and left neighbours of signs with sentinels, by side."""
    whole = _signs(d) + """, nb AS (SELECT lang, sign, freq, coalesce(lag(sign) OVER z, '<BOS>') AS l, coalesce(lead(sign) OVER z, '<EOS>') AS r FROM s WINDOW z AS (PARTITION BY lang, word ORDER BY p)),
x AS (SELECT lang, sign, c, CAST(sum(freq) AS DOUBLE) AS v FROM (SELECT lang, sign, 'L:' || l AS c, freq FROM nb UNION ALL SELECT lang, sign, 'R:' || r AS c, freq FROM nb) GROUP BY lang, sign, c)"""
    return d.contexts(whole)


@relational
def p1_context_vectors(d) -> str:
    return f"WITH {_contexts(d)} SELECT lang, sign, c AS context, CAST(v AS BIGINT) AS n FROM x"


@relational
def p1_tfidf(d) -> str:
    """tf * ln(N / (df + 1)); may be negative for a context that every sign has."""
    return f"WITH {_contexts(d)}, df AS (SELECT lang, c, count(*) AS df FROM x GROUP BY lang, c), nn AS (SELECT lang, count(DISTINCT sign) AS n FROM x GROUP BY lang), t AS (SELECT lang, sign, sum(v) AS t FROM x GROUP BY lang, sign) SELECT x.lang, x.sign, x.c AS context, {d.r6('v / t * ln(CAST(nn.n AS DOUBLE) / (df + 1))')} AS tfidf FROM x JOIN df ON df.lang = x.lang AND df.c = x.c JOIN nn ON nn.lang = x.lang JOIN t ON t.lang = x.lang AND t.sign = x.sign"


def _ppmi(d) -> str:
    return _contexts(d) + f""", t AS (SELECT lang, sign, sum(v) AS t FROM x GROUP BY lang, sign), cc AS (SELECT lang, c, sum(v) AS t FROM x GROUP BY lang, c), al AS (SELECT lang, sum(v) AS t FROM x GROUP BY lang),
pm AS (SELECT x.lang, x.sign, x.c, greatest({d.number(0)}, log2(v * al.t / (t.t * cc.t) + 0.0000000001)) AS v FROM x JOIN t ON t.lang = x.lang AND t.sign = x.sign JOIN cc ON cc.lang = x.lang AND cc.c = x.c JOIN al ON al.lang = x.lang)"""


@relational
def p1_ppmi(d) -> str:
    return f"WITH {_ppmi(d)} SELECT lang, sign, c AS context, {d.r6('v')} AS ppmi FROM pm WHERE v > 0"


def _cosine(d) -> str:
    return _ppmi(d) + """, nr AS (SELECT lang, sign, sqrt(sum(v * v)) AS n FROM pm GROUP BY lang, sign),
co AS (SELECT a.lang, a.sign AS a, b.sign AS b, round(sum(a.v * b.v) / (max(na.n) * max(nb.n)), 6) AS cosine FROM pm a JOIN pm b ON a.lang = b.lang AND a.c = b.c AND a.sign <> b.sign JOIN nr na ON na.lang = a.lang AND na.sign = a.sign JOIN nr nb ON nb.lang = b.lang AND nb.sign = b.sign WHERE na.n > 0 AND nb.n > 0 GROUP BY a.lang, a.sign, b.sign),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang, a ORDER BY cosine DESC, b) AS rk FROM co)"""


@relational
def p1_cosine_topk(d) -> str:
    return f"WITH {_cosine(d)} SELECT lang, a AS sign, b AS neighbour, cosine, CAST(rk AS BIGINT) AS rank FROM rk WHERE rk <= 5"


@relational
def p1_mutual_knn(d) -> str:
    return f"WITH {_cosine(d)}, kk AS (SELECT * FROM rk WHERE rk <= 5) SELECT x.lang, x.a, x.b, x.cosine FROM kk x JOIN kk y ON x.lang = y.lang AND x.a = y.b AND x.b = y.a WHERE x.a < x.b"


def _side(d, side: str) -> str:
    """CTE xs: contexts of one side of the signs seen 15 times or more."""
    return _contexts(d) + f""", xs AS (SELECT x.lang, x.sign, x.c, x.v, sum(x.v) OVER (PARTITION BY x.lang, x.sign) AS t, sum(x.v) OVER (PARTITION BY x.lang, x.c) AS tc, sum(x.v) OVER (PARTITION BY x.lang) AS al FROM x WHERE substr(x.c, 1, 2) = '{side}:'), xf AS (SELECT * FROM xs WHERE t >= 15)"""


def _cosines(weights: str) -> str:
    """CTE cs: cosines of all pairs of signs with a context in common, over CTE wv (lang, sign, c, v)."""
    return f"""wv AS ({weights}), nm AS (SELECT lang, sign, sqrt(sum(v * v)) AS n FROM wv GROUP BY lang, sign HAVING sum(v * v) > 0),
cs AS (SELECT p.lang, p.sign AS a, q.sign AS b, sum(p.v * q.v) / (max(na.n) * max(nb.n)) AS cosine FROM wv p JOIN wv q ON p.lang = q.lang AND p.c = q.c AND p.sign < q.sign JOIN nm na ON na.lang = p.lang AND na.sign = p.sign JOIN nm nb ON nb.lang = q.lang AND nb.sign = q.sign GROUP BY p.lang, p.sign, q.sign)"""


@relational
def p1_right_similarity(d) -> str:
    """Cosines of signs by positive pointwise mutual information with what follows them."""
    ppmi = f"SELECT lang, sign, c, greatest({d.number(0)}, log2(v * al / (t * tc))) AS v FROM xf"
    return f"WITH {_side(d, 'R')}, {_cosines(ppmi)} SELECT lang, a, b, {d.r6('cosine')} AS similarity FROM cs"


@relational
def p1_left_similarity(d) -> str:
    """Cosines of signs by term frequency and inverse document frequency, tf * ln(signs / (df + 1)), of what precedes them."""
    tfidf = "SELECT xf.lang, xf.sign, xf.c, xf.v / t * ln(CAST(sn.n AS DOUBLE) / (df.df + 1)) AS v FROM xf JOIN df ON df.lang = xf.lang AND df.c = xf.c JOIN sn ON sn.lang = xf.lang"
    return f"WITH {_side(d, 'L')}, df AS (SELECT lang, c, count(*) AS df FROM xf GROUP BY lang, c), sn AS (SELECT lang, count(DISTINCT sign) AS n FROM xf GROUP BY lang), {_cosines(tfidf)} SELECT lang, a, b, {d.r6('cosine')} AS similarity FROM cs"


_LABELS = "lb AS (SELECT doc_id, lang AS x, source AS y FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), cn AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS n FROM lb GROUP BY x, y), mx AS (SELECT x, sum(n) AS n FROM cn GROUP BY x), my AS (SELECT y, sum(n) AS n FROM cn GROUP BY y), tn AS (SELECT sum(n) AS n FROM cn)"


@relational
def p1_cluster_ari(d) -> str:
    """Adjusted Rand index of two labellings (language and source), from their table of counts."""
    return f"""WITH {_LABELS}, q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cn) AS i, (SELECT sum(n * (n - 1) / 2) FROM mx) AS a, (SELECT sum(n * (n - 1) / 2) FROM my) AS b, (SELECT n * (n - 1) / 2 FROM tn) AS t)
SELECT {d.r6('CASE WHEN (a + b) / 2 = a * b / t THEN 0 ELSE (i - a * b / t) / ((a + b) / 2 - a * b / t) END')} AS ari FROM q"""


@relational
def p1_label_entropy_nmi(d) -> str:
    return f"""WITH {_LABELS}, h AS (SELECT (SELECT -sum(mx.n / tn.n * log2(mx.n / tn.n)) FROM mx CROSS JOIN tn) AS hx, (SELECT -sum(my.n / tn.n * log2(my.n / tn.n)) FROM my CROSS JOIN tn) AS hy, (SELECT -sum(cn.n / tn.n * log2(cn.n / tn.n)) FROM cn CROSS JOIN tn) AS hxy)
SELECT {d.r6('hx')} AS h_x, {d.r6('hy')} AS h_y, {d.r6('hxy')} AS h_joint, {d.r6('hx + hy - hxy')} AS mutual_information, {d.r6(f'CASE WHEN least(hx, hy) > 0 THEN (hx + hy - hxy) / least(hx, hy) ELSE {d.number(0)} END')} AS nmi FROM h"""


@relational
def p1_series_recovery(d) -> str:
    """A series (language) is recovered if one label has half of it or more and the series is 0.3 of that label or more."""
    return f"""WITH {_LABELS}, b AS (SELECT cn.x, cn.y, cn.n, mx.n AS nx, my.n AS ny, row_number() OVER (PARTITION BY cn.x ORDER BY cn.n DESC, cn.y) AS rk FROM cn JOIN mx ON mx.x = cn.x JOIN my ON my.y = cn.y)
SELECT x AS series, y AS label, {d.r6('n / nx')} AS majority, {d.r6('n / ny')} AS purity, n / nx >= 0.5 AND n / ny >= 0.3 AS recovered FROM b WHERE rk = 1"""


@relational
def p1_triangulation(d) -> str:
    """For each sign outside the anchors: consonant votes by mean alternation weight with the anchors times their coverage, the vowels
    it alternates with (excluded), and a tier."""
    return f"""WITH {_graph(d)}, an AS (SELECT vc.lang, vc.sign, vc.rk FROM vc), ev AS (SELECT g2.lang, g2.x AS sign, an.rk, sum(g2.weight) AS wt, count(*) AS k FROM g2 JOIN an ON an.lang = g2.lang AND an.sign = g2.y GROUP BY g2.lang, g2.x, an.rk),
na AS (SELECT lang, count(*) AS n FROM an GROUP BY lang),
sm AS (SELECT ev.lang, ev.sign, sum(wt) / sum(k) * count(*) / max(na.n) AS score, CAST(max(na.n) AS BIGINT) - count(*) AS allowed, max(wt) AS top FROM ev JOIN na ON na.lang = ev.lang GROUP BY ev.lang, ev.sign)
SELECT sm.lang, sm.sign, {d.r6('score')} AS score, allowed AS vowels_left, CASE WHEN allowed = 1 AND score >= 2 THEN 'STRONG' WHEN allowed <= 2 AND score >= 1 THEN 'PROBABLE' WHEN allowed <= 4 THEN 'CONSTRAINED' ELSE 'INSUFFICIENT' END AS tier
FROM sm LEFT JOIN an ON an.lang = sm.lang AND an.sign = sm.sign WHERE an.sign IS NULL"""


@relational
def p1_vowel_ranking(d) -> str:
    """enrichment * sqrt(max(initial degree, 1)) * initial fraction, ranked."""
    return f"""WITH {_enriched(d)}, u AS (SELECT DISTINCT lang, substr(word, 2) AS rest, substr(word, 1, 1) AS x FROM uw WHERE n >= 3),
ip AS (SELECT a.lang, a.x AS a, b.x AS b FROM u a JOIN u b ON a.lang = b.lang AND a.rest = b.rest AND a.x <> b.x GROUP BY a.lang, a.x, b.x HAVING count(*) >= 2), dg AS (SELECT lang, a, count(*) AS degree FROM ip GROUP BY lang, a),
sc AS (SELECT v.lang, v.sign, coalesce(degree, 0) AS degree, round(enrichment * sqrt(CAST(greatest(coalesce(degree, 0), 1) AS DOUBLE)) * initial_fraction, 6) AS composite FROM v LEFT JOIN dg ON dg.lang = v.lang AND dg.a = v.sign)
SELECT lang, sign, degree, composite, CAST(row_number() OVER (PARTITION BY lang ORDER BY composite DESC, sign) AS BIGINT) AS rank FROM sc"""


def _tails(d) -> str:
    """CTE cs: two-letter endings as head and tail, of words of four letters or more, seen on three stems or more."""
    return d.word_occ() + ", cs AS (SELECT lang, substr(word, n - 1, 1) AS head, substr(word, n, 1) AS tail, count(*) AS stems FROM uw WHERE n >= 4 GROUP BY lang, substr(word, n - 1, 1), substr(word, n, 1) HAVING count(*) >= 3)"


@relational
def p1_compound_suffix_pairs(d) -> str:
    """Tails that share a head (same consonant, another vowel) and heads that share a tail (same vowel)."""
    return f"WITH {_tails(d)} SELECT a.lang, 'shared_head' AS kind, a.head AS shared, a.tail AS a, b.tail AS b, a.stems + b.stems AS stems FROM cs a JOIN cs b ON a.lang = b.lang AND a.head = b.head AND a.tail < b.tail UNION ALL SELECT a.lang, 'shared_tail', a.tail, a.head, b.head, a.stems + b.stems FROM cs a JOIN cs b ON a.lang = b.lang AND a.tail = b.tail AND a.head < b.head"


@relational
def p1_purity_baseline(d) -> str:
    """Share of tail pairs under one head that agree in being a, e, i, o, u or not, against all pairs of the language's tails."""
    kind = "CASE WHEN tail IN ('a', 'e', 'i', 'o', 'u') THEN 'v' ELSE 'c' END"
    pairs = "n * (n - 1) / 2"
    return f"""WITH {_tails(d)}, gk AS (SELECT lang, head, {kind} AS t, CAST(count(*) AS DOUBLE) AS n FROM cs GROUP BY lang, head, {kind}), gh AS (SELECT lang, head, sum(n) AS n, sum({pairs}) AS same FROM gk GROUP BY lang, head),
ak AS (SELECT lang, t, CAST(count(*) AS DOUBLE) AS n FROM (SELECT DISTINCT lang, tail, {kind} AS t FROM cs) GROUP BY lang, t), aa AS (SELECT lang, sum(n) AS n, sum({pairs}) AS same FROM ak GROUP BY lang), hh AS (SELECT lang, sum(same) AS same, sum({pairs}) AS pairs FROM gh GROUP BY lang)
SELECT hh.lang, {d.r6('hh.same / nullif(hh.pairs, 0)')} AS purity, {d.r6('aa.same / nullif(aa.n * (aa.n - 1) / 2, 0)')} AS baseline FROM hh JOIN aa ON aa.lang = hh.lang"""
