"""Pillar 2: suffixes, segmentation, affix productivity, stems' signatures and what class of word they hint at."""

from __future__ import annotations

from tessera.plans.registry import relational

#: Suffixes of one to three signs; a suffix counts from so many occurrences and stems on.
LONGEST, LEAST_FREQ, LEAST_STEMS = 3, 3, 2


@relational
def p2_unique_words(d) -> str:
    return f"WITH {d.word_occ()} SELECT lang, word, n, freq, docs FROM wt WHERE n >= 2"


def _splits(d) -> str:
    """CTE sp: every split of every word into stem and suffix; sf: suffixes with frequency and distinct stems; va: the valid ones."""
    return d.word_occ() + f""", sp AS (SELECT lang, word, n, freq, k, substr(word, 1, n - k) AS stem, substr(word, n - k + 1) AS suffix FROM uw JOIN {d.series('1', str(LONGEST), 'k')} ks ON k <= n - 1),
sf AS (SELECT lang, suffix, k, count(DISTINCT stem) AS stems, CAST(sum(freq) AS BIGINT) AS freq FROM sp GROUP BY lang, suffix, k), va AS (SELECT * FROM sf WHERE freq >= {LEAST_FREQ} AND stems >= {LEAST_STEMS})"""


@relational
def p2_suffix_stats(d) -> str:
    return f"WITH {_splits(d)} SELECT lang, suffix, k, stems, freq FROM sf"


@relational
def p2_valid_suffixes(d) -> str:
    return f"WITH {_splits(d)} SELECT lang, suffix, stems, freq FROM va"


def _segmented(d) -> str:
    """CTE sg: of each word the longest valid suffix whose boundary is neither forbidden nor favored (the pairs within words that
    are seen more than ten times as often as chance), or the whole word."""
    return _splits(d) + f""", lt AS (SELECT lang, word, freq, p, x FROM uw {d.each(d.letters('word'), 'p', 'x')}), bg AS (SELECT lang, x, y, CAST(sum(freq) AS DOUBLE) AS k FROM (SELECT lang, freq, x, lead(x) OVER (PARTITION BY lang, word ORDER BY p) AS y FROM lt) WHERE y IS NOT NULL GROUP BY lang, x, y),
b1 AS (SELECT lang, x, sum(k) AS n FROM bg GROUP BY lang, x), b2 AS (SELECT lang, y, sum(k) AS n FROM bg GROUP BY lang, y), b0 AS (SELECT lang, sum(k) AS n FROM bg GROUP BY lang),
fv AS (SELECT bg.lang, bg.x, bg.y FROM bg JOIN b1 ON b1.lang = bg.lang AND b1.x = bg.x JOIN b2 ON b2.lang = bg.lang AND b2.y = bg.y JOIN b0 ON b0.lang = bg.lang WHERE bg.k > 10 * b1.n * b2.n / b0.n),
ok AS (SELECT sp.lang, sp.word, sp.stem, sp.suffix, sp.k FROM sp JOIN va ON va.lang = sp.lang AND va.suffix = sp.suffix LEFT JOIN fv ON fv.lang = sp.lang AND fv.x = substr(sp.stem, length(sp.stem), 1) AND fv.y = substr(sp.suffix, 1, 1) WHERE fv.x IS NULL),
lg AS (SELECT lang, word, stem, suffix FROM (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY k DESC) AS o FROM ok) WHERE o = 1),
sg AS (SELECT uw.lang, uw.word, uw.freq, coalesce(lg.stem, uw.word) AS stem, coalesce(lg.suffix, '') AS suffix FROM uw LEFT JOIN lg ON lg.lang = uw.lang AND lg.word = uw.word)"""


@relational
def p2_segmentation(d) -> str:
    return f"WITH {d.segmented(_segmented(d))} SELECT lang, word, freq, stem, suffix FROM sg"


@relational
def p2_affix_productivity(d) -> str:
    """Stems of a suffix over those of the language's most productive one."""
    return f"WITH {d.segmented(_segmented(d))}, af AS (SELECT lang, suffix, count(DISTINCT stem) AS stems, CAST(sum(freq) AS BIGINT) AS freq FROM sg WHERE suffix <> '' GROUP BY lang, suffix) SELECT lang, suffix, stems, freq, {d.r6('CAST(stems AS DOUBLE) / max(stems) OVER (PARTITION BY lang)')} AS productivity FROM af WHERE stems >= {LEAST_STEMS}"


def _merges(d) -> str:
    """CTE mg: the hundred commonest pairs of signs of a language, seen three times or more."""
    return d.word_occ() + f""", lt AS (SELECT lang, word, freq, p, x FROM uw {d.each(d.letters('word'), 'p', 'x')}), nx AS (SELECT lang, word, freq, p, x, lead(x) OVER (PARTITION BY lang, word ORDER BY p) AS y FROM lt),
bg AS (SELECT lang, x, y, CAST(sum(freq) AS BIGINT) AS k FROM nx WHERE y IS NOT NULL GROUP BY lang, x, y), mg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, x, y) AS rk FROM bg WHERE k >= 3) WHERE rk <= 100)"""


@relational
def p2_bpe_pairs(d) -> str:
    return f"WITH {_merges(d)} SELECT lang, x AS a, y AS b, k, CAST(rk AS BIGINT) AS rank FROM mg"


@relational
def p2_bpe_morphemes(d) -> str:
    """Words cut wherever a pair of signs is no merge; the stem is the longest morpheme, the first among equals."""
    return f"""WITH {_merges(d)}, ct AS (SELECT nx.lang, nx.word, nx.freq, nx.p, nx.x, CASE WHEN nx.y IS NOT NULL AND mg.rk IS NULL THEN 1 ELSE 0 END AS cut FROM nx LEFT JOIN mg ON mg.lang = nx.lang AND mg.x = nx.x AND mg.y = nx.y),
mo AS (SELECT lang, word, freq, m, min(p) AS a, count(*) AS len FROM (SELECT *, coalesce(sum(cut) OVER (PARTITION BY lang, word ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM ct) GROUP BY lang, word, freq, m),
st AS (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY len DESC, a) AS o, count(*) OVER (PARTITION BY lang, word) AS morphemes FROM mo)
SELECT lang, word, freq, morphemes, substr(word, CAST(a AS INT) + 1, CAST(len AS INT)) AS stem FROM st WHERE o = 1"""


def _signatures(d) -> str:
    """CTEs sx (stem with suffix), gs (stem with its signature: its set of suffixes), gg (signatures with two stems or more)."""
    return d.segmented(_segmented(d)) + f""", sx AS (SELECT DISTINCT lang, stem, suffix FROM sg), gs AS (SELECT lang, stem, {d.joined_set('suffix', '|')} AS signature, count(*) AS slots FROM sx GROUP BY lang, stem HAVING count(*) >= 2),
gg AS (SELECT lang, signature, max(slots) AS slots, count(*) AS stems FROM gs GROUP BY lang, signature HAVING count(*) >= 2)"""


@relational
def p2_signature_groups(d) -> str:
    return f"WITH {_signatures(d)} SELECT lang, signature, slots, stems FROM gg"


def _signature_suffixes(d) -> str:
    """CTE ex: all signatures of two stems or more with their suffixes as rows."""
    return _signatures(d) + """, ex AS (SELECT DISTINCT gg.lang, gg.signature, gg.slots, sx.suffix FROM gg JOIN gs ON gs.lang = gg.lang AND gs.signature = gg.signature JOIN sx ON sx.lang = gs.lang AND sx.stem = gs.stem)"""


@relational
def p2_signature_jaccard(d) -> str:
    """Of signatures that share a suffix: shared suffixes over all."""
    return f"WITH {_signature_suffixes(d)}, pr AS (SELECT a.lang, a.signature AS a, b.signature AS b, max(a.slots) AS na, max(b.slots) AS nb, count(*) AS k FROM ex a JOIN ex b ON a.lang = b.lang AND a.suffix = b.suffix AND a.signature < b.signature GROUP BY a.lang, a.signature, b.signature) SELECT lang, a, b, k AS shared, {d.r6('CAST(k AS DOUBLE) / (na + nb - k)')} AS jaccard FROM pr"


def _inflection(d) -> str:
    return _signatures(d) + f""", af AS (SELECT lang, suffix, count(DISTINCT stem) AS stems FROM sg WHERE suffix <> '' GROUP BY lang, suffix), pp AS (SELECT lang, suffix, stems, CAST(stems AS DOUBLE) / max(stems) OVER (PARTITION BY lang) AS productivity FROM af),
ip AS (SELECT DISTINCT sx.lang, sx.suffix FROM sx JOIN gs ON gs.lang = sx.lang AND gs.stem = sx.stem JOIN gg ON gg.lang = gs.lang AND gg.signature = gs.signature),
ic AS (SELECT pp.lang, pp.suffix, stems, productivity, ip.suffix IS NOT NULL AS in_paradigm, CASE WHEN productivity > 0.3 AND ip.suffix IS NOT NULL THEN 'inflectional' WHEN productivity < 0.1 OR ip.suffix IS NULL THEN 'derivational' ELSE 'ambiguous' END AS class FROM pp LEFT JOIN ip ON ip.lang = pp.lang AND ip.suffix = pp.suffix)"""


@relational
def p2_inflection_class(d) -> str:
    """Inflectional: productivity over 0.3 and in a paradigm; derivational: under 0.1 or in none; else ambiguous."""
    return f"WITH {_inflection(d)} SELECT lang, suffix, stems, {d.r6('productivity')} AS productivity, in_paradigm, class FROM ic"


@relational
def p2_word_class_hints(d) -> str:
    """A stem in a paradigm declines, one with inflectional endings outside of any inflects, others are invariant."""
    return f"""WITH {_inflection(d)}, hi AS (SELECT sx.lang, sx.stem, count(*) AS endings, count(*) FILTER (WHERE ic.class = 'inflectional') AS inflectional, max(CASE WHEN gg.signature IS NOT NULL THEN 1 ELSE 0 END) AS paradigm FROM sx LEFT JOIN ic ON ic.lang = sx.lang AND ic.suffix = sx.suffix LEFT JOIN gs ON gs.lang = sx.lang AND gs.stem = sx.stem LEFT JOIN gg ON gg.lang = gs.lang AND gg.signature = gs.signature GROUP BY sx.lang, sx.stem)
SELECT lang, stem, endings, inflectional, CASE WHEN paradigm = 1 THEN 'declining' WHEN inflectional > 0 THEN 'inflecting' WHEN endings = 1 THEN 'invariant' ELSE 'unknown' END AS hint FROM hi"""
