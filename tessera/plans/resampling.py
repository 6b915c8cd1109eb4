"""Null models and resampling. Draws are md5 of what is drawn for and a seed, so every engine and every partitioning draws the same."""

from __future__ import annotations

from tessera.plans.registry import relational


#: How likely a Poisson count of mean 1 is at most 0, 1, 2, ...
_POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759)


@relational
def rs_bootstrap_ci(d) -> str:
    """Documents resampled 50 times, each taken a Poisson number of times by hash (the large-sample form of drawing with replacement, which
    needs no numbering of documents): 95 % interval of their mean length."""
    u = f"CAST({d.hash32("'boot|' || CAST(r.r AS VARCHAR(9)) || '|' || CAST(sz.doc_id AS VARCHAR(20))")} AS DOUBLE) / 4294967296"
    times = "CASE " + " ".join(f"WHEN u < {p} THEN {i}" for i, p in enumerate(_POISSON)) + f" ELSE {len(_POISSON)} END"
    return f"""WITH sz AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS n FROM documents), dr AS (SELECT r.r, sz.n, {u} AS u FROM sz CROSS JOIN {d.series('1', '50', 'r')} r), wt AS (SELECT r, n, {times} AS k FROM dr),
me AS (SELECT r, sum(n * k) / sum(k) AS mean FROM wt GROUP BY r)
SELECT count(*) AS replicates, {d.r6(d.quantile('mean', 0.025))} AS low, {d.r6(d.quantile('mean', 0.5))} AS middle, {d.r6(d.quantile('mean', 0.975))} AS high FROM me"""


@relational
def rs_shuffle_null(d) -> str:
    """Letters of every word put in hash order, by three seeds: how often each comes first, beside how often it does in fact."""
    if d.name == "spark":  # the first in hash order is the least, which needs no window
        least = "array_min(transform(ls, (x, i) -> struct(md5(concat_ws('|', CAST(seed AS STRING), word, CAST(i AS STRING))) AS h, x AS s))).s"
        sh = f"sh AS (SELECT lang, freq, {least} AS sign, 1 AS rk FROM (SELECT lang, word, freq, {d.letters('word')} AS ls FROM uw) LATERAL VIEW explode(sequence(1, 3)) k AS seed)"
    else:
        sh = f"sh AS (SELECT s.lang, s.word, s.freq, s.sign, k.seed, row_number() OVER (PARTITION BY s.lang, s.word, k.seed ORDER BY md5(CAST(k.seed AS VARCHAR(9)) || '|' || s.word || '|' || CAST(s.p AS VARCHAR(9)))) AS rk FROM s CROSS JOIN {d.series('1', '3', 'seed')} k)"
    return f"""WITH {d.word_occ()}, s AS (SELECT lang, word, n, freq, p, sign FROM uw {d.each(d.letters('word'), 'p', 'sign')}), {sh},
ob AS (SELECT lang, sign, CAST(sum(CASE WHEN p = 0 THEN freq ELSE 0 END) AS BIGINT) AS observed, CAST(sum(freq) AS BIGINT) AS total FROM s GROUP BY lang, sign), nu AS (SELECT lang, sign, CAST(sum(CASE WHEN rk = 1 THEN freq ELSE 0 END) AS DOUBLE) / 3 AS shuffled FROM sh GROUP BY lang, sign)
SELECT ob.lang, ob.sign, observed, total, {d.r6(f'coalesce(shuffled, {d.number(0)})')} AS shuffled FROM ob LEFT JOIN nu ON nu.lang = ob.lang AND nu.sign = ob.sign"""


@relational
def rs_tail_shuffle(d) -> str:
    """Tails dealt anew over heads 1000 times: share of tail pairs under one head that agree in being a vowel, observed and by chance."""
    kind, pairs = "CASE WHEN tail IN ('a', 'e', 'i', 'o', 'u') THEN 'v' ELSE 'c' END", "n * (n - 1) / 2"
    return f"""WITH {d.word_occ()}, cs AS (SELECT lang, substr(word, n - 1, 1) AS head, substr(word, n, 1) AS tail, count(*) AS stems FROM uw WHERE n >= 4 GROUP BY lang, substr(word, n - 1, 1), substr(word, n, 1) HAVING count(*) >= 3),
hs AS (SELECT lang, head, row_number() OVER (PARTITION BY lang ORDER BY head, tail) AS i FROM cs), ts AS (SELECT r.r, cs.lang, {kind} AS t, row_number() OVER (PARTITION BY r.r, cs.lang ORDER BY CASE WHEN r.r = 0 THEN '' ELSE md5(CAST(r.r AS VARCHAR(9)) || '|' || head || tail) END, head, tail) AS i FROM cs CROSS JOIN {d.series('0', '1000', 'r')} r),
gk AS (SELECT ts.r, ts.lang, hs.head, ts.t, CAST(count(*) AS DOUBLE) AS n FROM ts JOIN hs ON hs.lang = ts.lang AND hs.i = ts.i GROUP BY ts.r, ts.lang, hs.head, ts.t), gh AS (SELECT r, lang, head, sum(n) AS n, sum({pairs}) AS same FROM gk GROUP BY r, lang, head), pu AS (SELECT r, lang, sum(same) / sum({pairs}) AS purity FROM gh GROUP BY r, lang)
SELECT lang, {d.r6('max(CASE WHEN r = 0 THEN purity END)')} AS observed, {d.r6('avg(CASE WHEN r > 0 THEN purity END)')} AS shuffled_mean, {d.r6('stddev_pop(CASE WHEN r > 0 THEN purity END)')} AS shuffled_sd FROM pu GROUP BY lang"""


@relational
def rs_leave_one_out(d) -> str:
    """Each frequent sign's place (mostly initial, medial or final) told from the rates of all others in its language but itself: the
    place in which the sign exceeds the rest most."""
    rate = lambda k: f"CAST({k} AS DOUBLE) / total - CAST(t{k} - {k} AS DOUBLE) / nullif(tt - total, 0)"
    return f"""WITH {d.word_occ()}, s AS (SELECT lang, n, freq, p, sign FROM uw {d.each(d.letters('word'), 'p', 'sign')}), c AS (SELECT lang, sign, sum(CASE WHEN p = 0 THEN freq ELSE 0 END) AS a, sum(CASE WHEN p > 0 AND p < n - 1 THEN freq ELSE 0 END) AS b, sum(CASE WHEN p > 0 AND p = n - 1 THEN freq ELSE 0 END) AS e, sum(freq) AS total FROM s GROUP BY lang, sign HAVING sum(freq) >= 15),
x AS (SELECT *, sum(a) OVER (PARTITION BY lang) AS ta, sum(b) OVER (PARTITION BY lang) AS tb, sum(e) OVER (PARTITION BY lang) AS te, sum(total) OVER (PARTITION BY lang) AS tt FROM c), y AS (SELECT lang, sign, round({rate('a')}, 9) AS ra, round({rate('b')}, 9) AS rb, round({rate('e')}, 9) AS re, a, b, e FROM x)
SELECT lang, sign, CASE WHEN ra >= rb AND ra >= re THEN 'initial' WHEN rb >= re THEN 'medial' ELSE 'final' END AS predicted, CASE WHEN a >= b AND a >= e THEN 'initial' WHEN b >= e THEN 'medial' ELSE 'final' END AS actual FROM y"""


@relational
def rs_pool_cap(d) -> str:
    """At most 500 entries of each language and length, those of least hash, with the pool's own hash."""
    glue = "array_join(array_sort(collect_list(word)), ',')" if d.name == "spark" else "string_agg(word, ',' ORDER BY word)"
    return f"WITH {d.word_occ()}, pk AS (SELECT * FROM (SELECT lang, word, n, row_number() OVER (PARTITION BY lang, n ORDER BY md5(word), word) AS rk FROM uw) WHERE rk <= 500) SELECT lang, n, count(*) AS entries, md5({glue}) AS pool_hash FROM pk GROUP BY lang, n"


@relational
def rs_control_queries(d) -> str:
    """A random control for each English class string of four signs or more: as long, each sign drawn by hash from all signs of such strings
    in proportion to their number."""
    from tessera.plans.vocabulary import _coded

    glue = "array_join(transform(array_sort(collect_list(struct(p, x))), y -> y.x), '')" if d.name == "spark" else "string_agg(x, '' ORDER BY p)"
    return f"""WITH {_coded(d)}, qs AS (SELECT DISTINCT sca, len FROM sc WHERE lang = 'en' AND len >= 4), qx AS (SELECT sca, len, p, x FROM qs {d.each(d.letters('sca'), 'p', 'x')}), kx AS (SELECT x, count(*) AS k FROM qx GROUP BY x),
al AS (SELECT x, sum(k) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) - k AS lo, sum(k) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS hi, sum(k) OVER () AS t FROM kx),
dr AS (SELECT qx.sca, qx.len, qx.p, al.x FROM qx JOIN al ON {d.hash32("'control|' || qx.sca || '|' || CAST(qx.p AS VARCHAR(9))")} % al.t >= al.lo AND {d.hash32("'control|' || qx.sca || '|' || CAST(qx.p AS VARCHAR(9))")} % al.t < al.hi)
SELECT sca AS beside, {glue} AS classes, len FROM dr GROUP BY sca, len"""
