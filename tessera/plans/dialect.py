"""The few places where the SQL of Spark and of the checking engine differ.

A query is a function of a dialect that returns SQL text. Spark's own text is planned by Catalyst; the other engine runs the same
relational definition with its own functions, hashing and numerics (its log-gamma against our series, for instance).
"""

from __future__ import annotations

from typing import Protocol


class Dialect(Protocol):
    def each(self, array: str, pos: str, item: str) -> str: ...


def documents_with_words(d, name: str) -> str:
    """CTE: lang and n, the documents that hold a word."""
    letter = d.matches("\\p{L}", "text")
    return f"{name} AS (SELECT lang, count(DISTINCT doc_id) AS n FROM documents WHERE {letter} GROUP BY lang)"


def _tail(d, term: str, lo: str, hi: str) -> str:
    return f"CASE WHEN ({hi}) < ({lo}) THEN 0D ELSE least(1D, {d.sum_range(lo, hi, term)}) END".replace("0D", d.number(0)).replace("1D", d.number(1))


class _Stats:
    """Exact tails as sums of terms exp(log-probability); ranges skip terms more than 12 deviations out, below any double's notice."""

    def log_choose(self, n: str, k: str) -> str:
        return f"({self.lf(n)} - {self.lf(k)} - {self.lf(f'({n}) - ({k})')})"

    def binom_term(self, i: str, n: str, p: str) -> str:
        return f"exp({self.log_choose(n, i)} + ({i}) * ln({p}) + (({n}) - ({i})) * ln(1 - ({p})))"

    def _spread(self, n: str, p: str) -> tuple[str, str]:
        sd = f"sqrt(({n}) * ({p}) * (1 - ({p})))"
        return f"floor(({n}) * ({p}) - 12 * {sd})", f"ceil(({n}) * ({p}) + 12 * {sd} + 40)"

    def binom_upper(self, k: str, n: str, p: str) -> str:
        lo, hi = self._spread(n, p)
        low = self.big(f"greatest({k}, 0, {lo})")
        return f"CASE WHEN ({k}) <= 0 THEN {self.number(1)} WHEN ({p}) <= 0 THEN {self.number(0)} WHEN ({p}) >= 1 THEN {self.number(1)} ELSE {_tail(self, self.binom_term('i', n, p), low, self.big(f'least({n}, greatest({k} + 40, {hi}))'))} END"

    def binom_lower(self, k: str, n: str, p: str) -> str:
        lo, hi = self._spread(n, p)
        return f"CASE WHEN ({k}) >= ({n}) THEN {self.number(1)} WHEN ({p}) <= 0 THEN {self.number(1)} WHEN ({p}) >= 1 THEN {self.number(0)} ELSE {_tail(self, self.binom_term('i', n, p), self.big(f'greatest(0, least({k} - 40, {lo}))'), self.big(f'least({k}, {hi})'))} END"

    def binom_two_sided_half(self, k: str, n: str) -> str:
        """p = 1/2: twice the smaller tail's far side, by symmetry."""
        far = f"greatest({k}, ({n}) - ({k}))"
        return f"least({self.number(1)}, CASE WHEN 2 * ({k}) = ({n}) THEN {self.number(1)} ELSE 2 * ({self.binom_upper(far, n, '0.5')}) END)"

    def poisson_upper(self, k: str, lam: str) -> str:
        term = f"exp(-({lam}) + i * ln({lam}) - {self.lf('i')})"
        return f"CASE WHEN ({k}) <= 0 THEN {self.number(1)} WHEN ({lam}) <= 0 THEN {self.number(0)} ELSE {_tail(self, term, self.big(f'greatest({k}, floor({lam} - 12 * sqrt({lam})))'), self.big(f'greatest({k}, {lam} + 12 * sqrt({lam})) + 200'))} END"

    def fisher_range(self, a: str, row: str, col: str, n: str) -> tuple[str, str]:
        """The terms of P(X >= a) under the hypergeometric law (row of n drawn, col marked) that a double can notice."""
        mean = f"(({self.number(1)} * ({row})) * ({col}) / ({n}))"
        low = self.big(f"greatest({a}, ({row}) + ({col}) - ({n}), floor({mean} - 12 * sqrt({mean})))")
        return low, self.big(f"least({row}, {col}, greatest({a}, ceil({mean})) + ceil(12 * sqrt({mean})) + 40)")

    def fisher_term(self, i: str, row: str, col: str, n: str) -> str:
        return f"exp({self.log_choose(col, i)} + {self.log_choose(f'({n}) - ({col})', f'({row}) - ({i})')} - {self.log_choose(n, row)})"

    def r6(self, x: str) -> str:
        return f"(round({x}, 6) + {self.number(0)})"

    def word_occ(self) -> str:
        """CTEs: w (a row for each word of each document), wt (words by language with frequency and documents) and uw (those of two
        letters or more). Queries count words once and go on with the counts, which grow with the vocabulary, not the corpus."""
        return f"w AS ({self.words()}), wt AS ({self.word_table()}), uw AS (SELECT lang, word, n, freq FROM wt WHERE n >= 2)"


class SparkSQL(_Stats):
    name = "spark"

    def number(self, x: float) -> str:
        return f"{x}D"

    def big(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def words(self) -> str:
        return r"SELECT doc_id, lang, source, wpos, word, CAST(length(word) AS BIGINT) AS n, nw FROM (SELECT doc_id, lang, source, ws, CAST(size(ws) AS BIGINT) AS nw FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '(\\p{L}+)', 1) AS ws FROM documents)) LATERAL VIEW posexplode(ws) t AS wpos, word"

    def doc_words(self) -> str:
        """doc_id, lang, ws: the words of a document in one array, for what lies within a document."""
        return r"SELECT doc_id, lang, regexp_extract_all(lower(text), '(\\p{L}+)', 1) AS ws FROM documents"

    def word_table(self) -> str:
        return "SELECT lang, word, n, freq, docs FROM word_table"

    def segmented(self, whole: str) -> str:
        """CTEs up to sg; here sg is a kept table."""
        return f"{self.word_occ()}, sg AS (SELECT lang, word, freq, stem, suffix FROM segmented_table)"

    def contexts(self, whole: str) -> str:
        """CTEs up to x; here x is a kept table."""
        return "x AS (SELECT lang, sign, c, v FROM context_table)"

    def each(self, array: str, pos: str, item: str) -> str:
        return f"LATERAL VIEW posexplode({array}) {item}_{pos} AS {pos}, {item}"

    def each_of(self, lo: str, hi: str, item: str) -> str:
        return f"LATERAL VIEW explode(sequence({lo}, {hi})) {item}_of AS {item}"

    def letters(self, w: str) -> str:
        return f"filter(split({w}, ''), x -> x <> '')"

    def lf(self, n: str) -> str:
        """ln n!, by Stirling's series eight steps further on."""
        x = f"(({n}) + 9D)"
        steps = " * ".join(f"(({n}) + {i}D)" for i in range(1, 9))
        return f"(({x} - 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) + 1D / (1260D * pow({x}, 5)) - 1D / (1680D * pow({x}, 7)) - ln({steps}))"

    def sum_range(self, lo: str, hi: str, term: str) -> str:
        return f"aggregate(sequence({lo}, {hi}), 0D, (a, i) -> a + {term})"

    def series(self, lo: str, hi: str, name: str) -> str:
        return f"(SELECT explode(sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))) AS {name})"

    def hash32(self, text: str) -> str:
        return f"CAST(conv(substr(md5({text}), 1, 8), 16, 10) AS BIGINT)"

    def joined_set(self, x: str, sep: str = ",") -> str:
        return f"array_join(sort_array(collect_set({x})), '{sep}')"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p}D)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def slice_from(self, word: str, start: str) -> str:
        return f"substr({word}, {start})"

    def find(self, pattern: str, text: str, group: int = 0) -> str:
        return f"regexp_extract({text}, r'{pattern}', {group})"

    def drop(self, pattern: str, text: str, by: str = "") -> str:
        return f"regexp_replace({text}, r'{pattern}', '{by}')"

    def matches(self, pattern: str, text: str) -> str:
        return f"({text} RLIKE r'{pattern}')"

    def json_int(self, json: str, key: str) -> str:
        return f"CAST(get_json_object({json}, '$.{key}') AS BIGINT)"

    def levenshtein(self, a: str, b: str) -> str:
        return f"levenshtein({a}, {b})"


class DuckSQL(_Stats):
    name = "duck"

    def number(self, x: float) -> str:
        return f"{x}::DOUBLE"

    def big(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def words(self) -> str:
        return r"SELECT doc_id, lang, source, wpos::INT AS wpos, ws[wpos + 1] AS word, length(ws[wpos + 1])::BIGINT AS n, len(ws)::BIGINT AS nw FROM (SELECT doc_id, lang, source, ws, unnest(generate_series(0, len(ws) - 1)) AS wpos FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents) WHERE len(ws) > 0)"

    def segmented(self, whole: str) -> str:
        return whole

    def contexts(self, whole: str) -> str:
        return whole

    def word_table(self) -> str:
        return "SELECT lang, word, n, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM w GROUP BY lang, word, n"

    def each(self, array: str, pos: str, item: str) -> str:
        return f", LATERAL (SELECT unnest({array}) AS {item}, generate_subscripts({array}, 1) - 1 AS {pos}) {item}_{pos}"

    def each_of(self, lo: str, hi: str, item: str) -> str:
        return f", LATERAL (SELECT unnest(generate_series({lo}, {hi})) AS {item}) {item}_of"

    def letters(self, w: str) -> str:
        return f"list_filter(string_split({w}, ''), lambda x: x <> '')"

    def lf(self, n: str) -> str:
        return f"lgamma(({n})::DOUBLE + 1)"

    def sum_range(self, lo: str, hi: str, term: str) -> str:
        return f"list_sum(list_transform(generate_series({lo}, {hi}), lambda i: {term}))"

    def series(self, lo: str, hi: str, name: str) -> str:
        return f"(SELECT unnest(generate_series(({lo})::BIGINT, ({hi})::BIGINT)) AS {name})"

    def hash32(self, text: str) -> str:
        return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"

    def joined_set(self, x: str, sep: str = ",") -> str:
        return f"string_agg(DISTINCT {x}, '{sep}' ORDER BY {x})"

    def quantile(self, x: str, p: float) -> str:
        return f"quantile_cont(({x})::DOUBLE, {p})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def slice_from(self, word: str, start: str) -> str:
        return f"substr({word}, {start})"

    def find(self, pattern: str, text: str, group: int = 0) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"

    def drop(self, pattern: str, text: str, by: str = "") -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    def matches(self, pattern: str, text: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    def json_int(self, json: str, key: str) -> str:
        return f"(json_extract_string({json}, '$.{key}'))::BIGINT"

    def levenshtein(self, a: str, b: str) -> str:
        return f"levenshtein({a}, {b})"


SPARK, DUCK = SparkSQL(), DuckSQL()
