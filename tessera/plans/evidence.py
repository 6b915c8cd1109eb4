"""Pillar 4: what stands near what, totals, formulas, places, and the evidence they add up to.

Ideograms are the eight commonest words of four letters or more of a language; numerals and totals are the lines of orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.dialect import documents_with_words
from tessera.plans.registry import relational

WINDOW = 3
#: Ideograms of a language.
IDEOGRAMS = 8


def near_table(docs: DataFrame, words: DataFrame) -> DataFrame:
    """lang, word, ideogram, k: documents in which they stand within the window. The pairs come from a document's own array of words, so that
    no occurrence is shuffled to meet another; the ideograms, eight a language, go to the documents."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("freq"), "word"))
    ids = words.where("n >= 4").withColumn("rk", rank).where(f"rk <= {IDEOGRAMS}").groupBy("lang").agg(F.collect_list("word").alias("ids"))
    rows = docs.select("doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("ws")).where("doc_id IS NOT NULL AND size(ws) > 0").join(F.broadcast(ids), "lang")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, lang, ws, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "lang", "ws", "ids")), strict=True):
                known = set(ids)
                met = sorted({(x, w) for i, w in enumerate(ws) if w in known for x in ws[max(0, i - WINDOW) : i + WINDOW + 1]})
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(met), pa.int64()), pa.array([lang] * len(met), pa.string()), pa.array([x for x, _ in met], pa.string()), pa.array([w for _, w in met], pa.string())], names=["doc_id", "lang", "word", "ideogram"])

    return rows.select("doc_id", "lang", "ws", "ids").mapInArrow(near, "doc_id long, lang string, word string, ideogram string").groupBy("lang", "word", "ideogram").agg(F.countDistinct("doc_id").alias("k"))


def _near(d) -> str:
    """CTEs io (ideograms), sg (sign-groups seen five times or more), co (documents in which a sign-group stands within the window).

    Here the counts of pairs near each other are a kept table (near_table)."""
    if d.name == "spark":
        near = "pc AS (SELECT lang, word, ideogram, k FROM near_table)"
    else:
        near = f"""ip AS (SELECT w.doc_id, w.lang, w.word AS ideogram, w.wpos + s.o AS wpos FROM w JOIN io ON io.lang = w.lang AND io.word = w.word CROSS JOIN {d.series(str(-WINDOW), str(WINDOW), 'o')} s),
pc AS (SELECT w.lang, w.word, ip.ideogram, count(DISTINCT w.doc_id) AS k FROM w JOIN ip ON ip.doc_id = w.doc_id AND ip.lang = w.lang AND ip.wpos = w.wpos GROUP BY w.lang, w.word, ip.ideogram)"""
    return d.word_occ() + f""", wc AS (SELECT lang, word, n, freq AS k, docs FROM wt), io AS (SELECT lang, word FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, word) AS rk FROM wc WHERE n >= 4) WHERE rk <= 8),
sg AS (SELECT wc.lang, wc.word FROM wc LEFT JOIN io ON io.lang = wc.lang AND io.word = wc.word WHERE wc.k >= 5 AND io.word IS NULL), {near},
co AS (SELECT pc.lang, pc.word, pc.ideogram, pc.k FROM pc JOIN sg ON sg.lang = pc.lang AND sg.word = pc.word)"""


@relational
def p4_cooccurrence(d) -> str:
    return f"WITH {_near(d)} SELECT lang, word, ideogram, k FROM co WHERE k >= 2"


def _exclusive(d) -> str:
    return _near(d) + """, tt AS (SELECT lang, word, sum(k) AS t FROM co GROUP BY lang, word), be AS (SELECT * FROM (SELECT co.lang, co.word, co.ideogram, co.k, CAST(co.k AS DOUBLE) / tt.t AS exclusivity, row_number() OVER (PARTITION BY co.lang, co.word ORDER BY co.k DESC, co.ideogram) AS rk FROM co JOIN tt ON tt.lang = co.lang AND tt.word = co.word) WHERE rk = 1 AND k >= 2)"""


@relational
def p4_exclusivity(d) -> str:
    """A sign-group's strongest ideogram and its share of all the group's co-occurrences."""
    return f"WITH {_exclusive(d)} SELECT lang, word, ideogram, k, {d.r6('exclusivity')} AS exclusivity FROM be"


def _upper_tail(d) -> str:
    """CTE ft: p, the upper tail of fx' tables. Here the terms of the range come one from another, from the most likely one up and down."""
    n, row, col = "docs", "with_word", "with_ideogram"
    low, high = d.fisher_range("k", row, col, n)
    if d.name == "duck":
        return f"""ft AS (SELECT lang, word, least({d.number(1)}, sum({d.fisher_term('i', row, col, n)})) AS p FROM (SELECT lang, word, with_word, with_ideogram, docs, i FROM fx {d.each_of(low, high, 'i')}) GROUP BY lang, word)"""
    up = f"({col} - i + 1D) * ({row} - i + 1D) / (i * ({n} - {col} - {row} + i * 1D))"
    down = f"(i + 1D) * ({n} - {col} - {row} + i + 1D) / (({col} - i * 1D) * ({row} - i * 1D))"
    summed = lambda lo, hi, step, ratio: f"CASE WHEN {lo} {'<=' if step > 0 else '>='} {hi} THEN aggregate(sequence({lo}, {hi}, {step}L), struct(1D AS t, 0D AS s), (x, i) -> struct(x.t * {ratio} AS t, x.s + x.t * {ratio} AS s), x -> x.s) ELSE 0D END"
    return f"""fr AS (SELECT *, greatest(low, least(high, CAST(floor(({row} + 1D) * ({col} + 1D) / ({n} + 2D)) AS BIGINT))) AS mode FROM (SELECT lang, word, with_word, with_ideogram, docs, {low} AS low, {high} AS high FROM fx) WHERE low <= high),
ft AS (SELECT lang, word, least(1D, {d.fisher_term('mode', row, col, n)} * (1D + {summed('mode + 1', 'high', 1, up)} + {summed('mode - 1', 'low', -1, down)})) AS p FROM fr)"""


def _fisher(d) -> str:
    return _exclusive(d) + f""", {documents_with_words(d, 'nd')},
fx AS (SELECT be.lang, be.word, be.ideogram, be.k, be.exclusivity, dw.docs AS with_word, di.docs AS with_ideogram, greatest(nd.n, dw.docs + di.docs - be.k) AS docs FROM be JOIN wc dw ON dw.lang = be.lang AND dw.word = be.word JOIN wc di ON di.lang = be.lang AND di.word = be.ideogram JOIN nd ON nd.lang = be.lang),
{_upper_tail(d)},
fp AS (SELECT fx.*, ft.p FROM fx JOIN ft ON ft.lang = fx.lang AND ft.word = fx.word),
ev AS (SELECT *, CASE WHEN exclusivity >= 0.3 AND p < 0.05 THEN 'strong' WHEN exclusivity >= 0.3 OR p < 0.05 THEN 'suggestive' END AS evidence FROM fp)"""


@relational
def p4_fisher(d) -> str:
    """Exact upper tail of the table of documents with the sign-group, the ideogram, both and neither; strong or suggestive evidence."""
    return f"WITH {_fisher(d)} SELECT lang, word, ideogram, k, with_word, with_ideogram, {d.r6('exclusivity')} AS exclusivity, {d.r6('p')} AS p, evidence FROM ev WHERE evidence IS NOT NULL"


def _islands(d) -> str:
    """CTEs li (lines of orders; a line is a numeral if its discount is 0.05 or less; the total marker is the dearest line) and cl
    (runs of numerals with start, end and sum; a line taxed over 0.07 can't be read; the sum is null if none can)."""
    return """l0 AS (SELECT l_orderkey AS o, l_quantity AS q, l_tax, l_discount, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS p FROM lineitem),
li AS (SELECT o, p, q, CASE WHEN l_tax > 0.07 THEN NULL ELSE q END AS v, l_discount <= 0.05 AS num, row_number() OVER (PARTITION BY o ORDER BY l_extendedprice DESC, p) = 1 AS marker FROM l0),
nm AS (SELECT *, p - row_number() OVER (PARTITION BY o ORDER BY p) AS island FROM li WHERE num AND NOT marker),
cl AS (SELECT o, min(p) AS a, max(p) AS b, count(*) AS k, sum(v) AS total FROM nm GROUP BY o, island)"""


@relational
def p4_numeral_islands(d) -> str:
    return f"WITH {_islands(d)} SELECT o AS orderkey, CAST(a AS BIGINT) AS first_line, CAST(b AS BIGINT) AS last_line, k, CAST(total AS DOUBLE) AS total FROM cl"


@relational
def p4_total_verification(d) -> str:
    """Clusters strictly before the marker against the first after it. The sum before is unreadable only if a cluster is and the
    readable part is 0."""
    return f"""WITH {_islands(d)}, mk AS (SELECT o, p FROM li WHERE marker), pre AS (SELECT mk.o, count(*) AS k, CASE WHEN count(cl.total) < count(*) AND sum(coalesce(cl.total, 0)) = 0 THEN NULL ELSE sum(coalesce(cl.total, 0)) END AS s FROM mk JOIN cl ON cl.o = mk.o AND cl.b < mk.p GROUP BY mk.o),
post AS (SELECT o, total FROM (SELECT mk.o, cl.total, row_number() OVER (PARTITION BY mk.o ORDER BY cl.a) AS rk FROM mk JOIN cl ON cl.o = mk.o AND cl.a > mk.p) WHERE rk = 1)
SELECT mk.o AS orderkey, CAST(mk.p AS BIGINT) AS marker, CAST(pre.s AS DOUBLE) AS before_sum, CAST(post.total AS DOUBLE) AS after_value, CASE WHEN post.o IS NULL THEN 'no_post_numeral' WHEN pre.s IS NULL OR post.total IS NULL THEN 'unparsable' WHEN pre.s = post.total THEN 'matching' ELSE 'discrepant' END AS status
FROM mk LEFT JOIN pre ON pre.o = mk.o LEFT JOIN post ON post.o = mk.o"""


@relational
def p4_positional_roles(d) -> str:
    """What a line is by its neighbours: before or after the marker, before or after a numeral, or alone."""
    return f"""WITH {_islands(d)}, ro AS (SELECT o, p, CASE WHEN marker THEN 'kuro_marker' WHEN lead(marker) OVER z THEN 'pre_kuro' WHEN lead(num) OVER z THEN 'pre_numeral' WHEN lag(marker) OVER z THEN 'post_kuro' WHEN lag(num) OVER z THEN 'post_numeral' ELSE 'standalone' END AS role FROM li WINDOW z AS (PARTITION BY o ORDER BY p))
SELECT o AS orderkey, CAST(p AS BIGINT) AS line, role FROM ro"""


def _formula(d) -> str:
    """CTE fe: words by the share of their language's documents that they stand in."""
    return d.word_occ() + f""", nd AS (SELECT lang, CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM w GROUP BY lang),
fe AS (SELECT wt.lang, wt.word, wt.docs, wt.docs / nd.n AS rate, CASE WHEN wt.docs / nd.n >= 0.2 THEN 'fixed' WHEN wt.docs / nd.n < 0.05 THEN 'variable' ELSE 'semi_fixed' END AS kind FROM wt JOIN nd ON nd.lang = wt.lang)"""


@relational
def p4_formula_elements(d) -> str:
    return f"WITH {_formula(d)} SELECT lang, word, docs, {d.r6('rate')} AS rate, kind FROM fe"


_TERCILE = "CASE WHEN nw <= 1 THEN 'early' WHEN 3 * wpos < nw - 1 THEN 'early' WHEN 3 * wpos < 2 * (nw - 1) THEN 'middle' ELSE 'late' END"


@relational
def p4_formula_positions(d) -> str:
    """The third of a document in which a fixed or semi-fixed element mostly stands (ties: the earlier in the alphabet)."""
    return f"""WITH {_formula(d)}, ps AS (SELECT w.lang, w.word, {_TERCILE} AS third, count(*) AS k FROM w JOIN fe ON fe.lang = w.lang AND fe.word = w.word WHERE fe.kind <> 'variable' GROUP BY w.lang, w.word, {_TERCILE}),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY k DESC, third) AS rk, sum(k) OVER (PARTITION BY lang, word) AS t FROM ps) SELECT lang, word, third, k, {d.r6('CAST(k AS DOUBLE) / t')} AS share FROM rk WHERE rk = 1"""


@relational
def p4_template_coverage(d) -> str:
    """Share of its language's fixed elements that a document has."""
    return f"""WITH {_formula(d)}, nf AS (SELECT lang, count(*) AS n FROM fe WHERE kind = 'fixed' GROUP BY lang), hv AS (SELECT DISTINCT w.doc_id, w.lang, w.word FROM w JOIN fe ON fe.lang = w.lang AND fe.word = w.word WHERE fe.kind = 'fixed')
SELECT hv.doc_id, hv.lang, count(*) AS present, {d.r6('CAST(count(*) AS DOUBLE) / max(nf.n)')} AS coverage FROM hv JOIN nf ON nf.lang = hv.lang GROUP BY hv.doc_id, hv.lang"""


#: Sign patterns that are searched, with the sources they are expected in.
_PLACES = (("PHA", "tion", "src1"), ("TYL", "schaft", "src2"), ("KNO", "ment", "src3"), ("DIK", "heit", "src4"), ("SET", "ado", "src5"))


def _places(d) -> str:
    rows = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _PLACES)
    return d.word_occ() + f""", pl AS (SELECT * FROM (VALUES {rows}) v(place, pattern, site)), ds AS (SELECT w.lang, w.source, w.word, w.n, count(*) AS k FROM w GROUP BY w.lang, w.source, w.word, w.n),
hp AS (SELECT ds.lang, ds.source, ds.word, ds.k, pl.place, pl.site, pl.pattern, ds.n - length(pl.pattern) + 1 AS most FROM ds CROSS JOIN pl WHERE ds.n >= length(pl.pattern)),
hi AS (SELECT lang, source, word, k, place, site, p FROM hp {d.each_of('1', 'most', 'p')} WHERE substr(word, CAST(p AS INT), length(pattern)) = pattern)"""


@relational
def p4_pattern_search(d) -> str:
    """All places of a run of signs within words, and how often the source is the expected one."""
    return f"WITH {_places(d)} SELECT place, lang, CAST(p - 1 AS BIGINT) AS start, count(DISTINCT word) AS words, CAST(sum(k) AS BIGINT) AS occurrences, CAST(sum(CASE WHEN source = site THEN k ELSE 0 END) AS BIGINT) AS at_site FROM hi GROUP BY place, lang, p"


@relational
def p4_anchor_assembly(d) -> str:
    """Evidence of ideograms, formulas and places by word; the largest confidence counts, from 0.3 on, and names the field."""
    places = ", ".join(f"('{a}', '{b}')" for a, b, _ in _PLACES)
    return f"""WITH {_fisher(d)}, fd AS (SELECT lang, word, docs FROM wt), pl AS (SELECT * FROM (VALUES {places}) v(place, pattern)),
it AS (SELECT lang, word, 'ideogram' AS source, greatest(0.1, CASE WHEN evidence = 'strong' THEN 0.7 ELSE 0.4 END * least(exclusivity / 0.5, 1)) AS c, 'COMMODITY:' || ideogram AS field FROM ev WHERE evidence IS NOT NULL
  UNION ALL SELECT fd.lang, fd.word, 'formula', 0.5, NULL FROM fd JOIN nd ON nd.lang = fd.lang WHERE fd.docs >= 0.2 * nd.n
  UNION ALL SELECT uw.lang, uw.word, 'place_name', 0.9, 'PLACE:' || pl.place FROM uw JOIN pl ON substr(uw.word, 1, length(pl.pattern)) = pl.pattern),
ag AS (SELECT lang, word, count(*) AS items, max(c) AS confidence, {d.joined_set('source')} AS sources FROM it GROUP BY lang, word), bf AS (SELECT lang, word, field FROM (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY c DESC, field) AS rk FROM it WHERE field IS NOT NULL) WHERE rk = 1)
SELECT ag.lang, ag.word, items, {d.r6('CAST(confidence AS DOUBLE)')} AS confidence, sources, bf.field FROM ag LEFT JOIN bf ON bf.lang = ag.lang AND bf.word = ag.word WHERE confidence >= 0.3"""
