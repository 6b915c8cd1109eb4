"""Formulas with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def cases():
    return [
        (S.place_label(F.lit(0), F.lit(1)), "singleton"), (S.place_label(F.lit(2), F.lit(3)), "final"), (S.place_label(F.lit(1), F.lit(3)), "medial"),
        (S.relative_position(F.lit(0), F.lit(1)), 0.5), (S.relative_position(F.lit(1), F.lit(5)), 0.25), (S.third_label(F.lit(0), F.lit(1)), "early"), (S.third_label(F.lit(2), F.lit(4)), "late"),
        (S.sound_classes(F.lit("pater")), "PVTVR"), (S.edit_distance(F.lit("ka"), F.lit("kappu")), 0.6), (S.edit_distance(F.lit(""), F.lit("")), 1.0), (S.edit_distance(F.lit("ab"), F.lit("ab")), 0.0),
        (S.combined_score(F.lit(0.8), F.lit(None).cast("double"), F.lit("INDEPENDENT")), 0.4), (S.combined_score(F.lit(1.0), F.lit(1.0), F.lit("INDEPENDENT")), 1.5), (S.combined_score(F.lit(1.0), F.lit(1.0), F.lit("CONSENSUS_DEPENDENT")), 0.8),
        (S.consonant_of(F.lit("dwe"), "V"), "dw"), (S.consonant_of(F.lit("nwa"), "V"), "nw"), (S.consonant_of(F.lit("ra2"), "V"), "r"), (S.consonant_of(F.lit("a"), "V"), "V"), (S.consonant_of(F.lit("a")), None), (S.consonant_of(F.lit("*56")), None), (S.vowel_of(F.lit("ra2")), "a"),
        (S.jaccard(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3)), 1), 0.5), (S.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"), 1), 1.0), (S.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"), 0), 0.0),
        (S.weighted_jaccard(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(3.0)), F.create_map(F.lit("a"), F.lit(2.0))), 0.2),
        (S.sign_kind(F.lit("AB120/GRA"), F.lit("logogram")), "named_ideogram"), (S.sign_kind(F.lit("A704"), F.lit("syllabogram")), "numeral"), (S.sign_kind(F.lit("A312"), F.lit(None).cast("string")), "unknown_logogram"), (S.sign_kind(F.lit("ka"), F.lit("syllabogram")), "syllabogram"),
        (S.relation_label(F.lit(3), F.lit(5), F.lit(6), 3), "immediately_adjacent"), (S.relation_label(F.lit(3), F.lit(5), F.lit(0), 3), "nearby"), (S.relation_label(F.lit(3), F.lit(5), F.lit(9), 3), "same_inscription"),
        (S.field_of(F.lit("An Olive tree"), {"tree": "COMMODITY", "olive": "COMMODITY:OLIVE"}), "COMMODITY:OLIVE"), (S.semantic_score(F.lit("A:B"), F.lit("A:C")), 0.5), (S.semantic_score(F.lit("A:B"), F.lit(None).cast("string")), None),
        (S.confidence(F.lit(1.0), F.lit(2), F.lit(1.0), F.lit(True), F.lit(True)), 0.35), (S.cleaned_length(F.lit("*-abc†=)")), 3), (S.last_vowel(F.lit("karn")), "a"), (S.json_safe(F.lit(float("inf"))), 1e308), (S.json_safe(F.lit(float("nan"))), 0.0),
        (S.spelled(F.array(F.lit("ka"), F.lit("zz")), F.create_map(F.lit("ka"), F.lit("k"))), None), (S.key_of(F.array(F.lit("KA"), F.lit("Ro"))), "ka|ro"),
    ]


def test_scalars(spark):
    pairs = cases()
    got = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(pairs))).first()
    for x, (column, want) in zip(got, pairs, strict=True):
        assert x == want or isinstance(want, float) and math.isclose(x, want, rel_tol=1e-12), column


def choose(n, k):
    return math.comb(n, k)


@pytest.mark.parametrize(("k", "n", "p"), [(5, 10, 0.3), (0, 10, 0.3), (10, 10, 0.3), (83, 90, 0.339), (7, 20, 0.5), (300, 1000, 0.25)])
def test_binomial_tails(spark, k, n, p):
    upper = math.fsum(choose(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    lower = math.fsum(choose(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert math.isclose(value(spark, stats.binomial_upper(f"{k}", f"{n}", f"{p}D")), upper, rel_tol=1e-8)
    assert math.isclose(value(spark, stats.binomial_lower(f"{k}", f"{n}", f"{p}D")), lower, rel_tol=1e-8)


def test_other_tails(spark):
    assert value(spark, stats.binomial_upper("83", "90", "0.339D")) < 1e-20
    assert math.isclose(value(spark, stats.poisson_upper("3", "0.5D")), 1 - math.exp(-0.5) * (1 + 0.5 + 0.125), rel_tol=1e-9)
    assert value(spark, stats.poisson_upper("0", "0.5D")) == 1
    assert math.isclose(value(spark, stats.binomial_two_sided("9", "10")), 2 * 11 / 1024, rel_tol=1e-9) and value(spark, stats.binomial_two_sided("5", "10")) == 1
    fisher = sum(choose(8, i) * choose(12, 6 - i) for i in range(4, 7)) / choose(20, 6)
    assert math.isclose(value(spark, stats.fisher_greater("4", "6", "8", "20")), fisher, rel_tol=1e-9)


def test_tables(spark):
    p = spark.createDataFrame([(i, x) for i, x in enumerate((0.001, 0.01, 0.03, 0.20, 0.50))], "k int, p double")
    assert [round(r.q_value, 9) for r in stats.benjamini_hochberg(p, "p", ["k"]).orderBy("k").collect()] == [0.005, 0.025, 0.05, 0.25, 0.5]
    same = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 3, "a string, b string")
    assert stats.adjusted_rand(same, "a", "b").first().ari == 1.0
    v = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False)], "v double, f boolean")
    r = stats.mann_whitney(v, "v", F.col("f")).first()
    assert (r.n1, r.n2, r.u) == (2, 2, 0.5) and r.z < 0
    assert math.isclose(v.agg(stats.cohens_d(F.col("f"), F.col("v")).alias("d")).first().d, 2.0)
