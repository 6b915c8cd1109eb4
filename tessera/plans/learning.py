"""Clusterings. Spark aggregates a language's signs, signatures or words to a small table; a numpy kernel labels it, a group at a time.

Labels of a clustering have no SQL, so these have no check in the other engine; the kernels are tested by themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.clustering import anchored_columns, anti_correlation, densest_clique, linkage, merge_groups, pack_rows, silhouette, spectral
from tessera.operators.agreement import agreement
from tessera.plans import grammar, morphology, phonology, vocabulary
from tessera.plans.dialect import SPARK
from tessera.plans.registry import plan, run_sql
from tessera.sources.scratch import stored


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"WITH {phonology._graph(SPARK)} SELECT g1.lang, a, b, weight, fa.f AS fa, fb.f AS fb FROM g1 JOIN fi fa ON fa.lang = g1.lang AND fa.sign = g1.a JOIN fi fb ON fb.lang = g1.lang AND fb.sign = g1.b")


def _matrix(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    signs = sorted({*pdf["a"], *pdf["b"]})
    at, m = {s: i for i, s in enumerate(signs)}, np.zeros((len(signs),) * 2)
    for r in pdf.sort_values(["a", "b"]).itertuples():
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.weight
    return signs, m


@plan()
def p1_spectral_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consonant classes of a language's signs: spectral clusters of the alternation graph."""

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        signs, m = _matrix(pdf)
        labels, k = spectral(m)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "sign": signs, "consonant_class": labels, "classes": k})

    return _edges(spark, sf_dir).groupBy("lang").applyInPandas(grid, "lang string, sign string, consonant_class long, classes long")


@plan()
def p1_agglomerative_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by average linkage of the largest weight less the weight, five classes."""

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        signs, m = _matrix(pdf)
        d = m.max() - m
        np.fill_diagonal(d, 0)
        labels = linkage(d, 5)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "sign": signs, "consonant_class": labels, "silhouette": round(silhouette(d, labels), 6)})

    return _edges(spark, sf_dir).groupBy("lang").applyInPandas(grid, "lang string, sign string, consonant_class long, silhouette double")


@plan()
def p1_vowel_clique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The densest near-clique of enriched signs, and rows of consonants packed beside it."""

    def clique(pdf: pd.DataFrame) -> pd.DataFrame:
        e = {(r.a, r.b): r.weight for r in pdf.itertuples()}
        f = {**dict(zip(pdf["a"], pdf["fa"], strict=True)), **dict(zip(pdf["b"], pdf["fb"], strict=True))}
        mean = sum(f.values()) / len(f)
        rich = {s: v / mean for s, v in f.items()}
        best, score = densest_clique([s for s, v in rich.items() if v >= 1.2] or sorted(rich, key=rich.get)[-5:], e, rich)
        near = lambda x, v: e.get((min(x, v), max(x, v)), 0)
        column = {s: min(range(len(best)), key=lambda i: (near(s, best[i]), i)) for s in rich}
        strength = {s: sum(near(s, t) for t in rich if t != s) for s in rich}
        rows = pack_rows(sorted(rich, key=lambda s: (-strength[s], s)), column, e)
        return pd.DataFrame([(pdf["lang"].iloc[0], s, s in best, column[s], rows[s], round(score, 6)) for s in sorted(rich)], columns=["lang", "sign", "in_clique", "vowel_column", "consonant_row", "score"])

    return _edges(spark, sf_dir).groupBy("lang").applyInPandas(clique, "lang string, sign string, in_clique boolean, vowel_column long, consonant_row long, score double")


@plan()
def p1_context_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consonants by average linkage over mutual nearest neighbours, vowels by spectral clusters of the contexts' distance."""
    cos = run_sql(spark, sf_dir, f"WITH {phonology._cosine(SPARK)} SELECT lang, a, b, cosine, CAST(rk AS BIGINT) AS rk FROM rk")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        signs = sorted({*pdf["a"], *pdf["b"]})
        at, sim, rank = {s: i for i, s in enumerate(signs)}, np.eye(len(signs)), np.full((len(signs),) * 2, 10**6)
        for r in pdf.itertuples():
            sim[at[r.a], at[r.b]], rank[at[r.a], at[r.b]] = r.cosine, r.rk
        mutual = (rank <= 5) & (rank.T <= 5)
        kept = np.where(mutual | np.eye(len(signs), dtype=bool), sim, 0)
        consonant = linkage(1 - kept, min(len(signs), 8))
        far = np.clip(1 - sim, 0, None)
        np.fill_diagonal(far, 0)
        vowel, _ = spectral((far + far.T) / 2, min(5, len(signs) - 1))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "sign": signs, "consonant": consonant, "vowel": vowel})

    return cos.groupBy("lang").applyInPandas(label, "lang string, sign string, consonant long, vowel long")


#: Vowel classes; how much left similarity counts against right similarity.
VOWELS, LEFT_WEIGHT = 5, 0.15


def vowel_classes(right: DataFrame, left: DataFrame, k: int = VOWELS, weight: float = LEFT_WEIGHT) -> DataFrame:
    """right, left: lang, a, b, similarity (a < b; pairs that are missing are 0) -> lang, sign, vowel_class: spectral clusters of right less left
    similarity, a language's signs at a time."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        signs = sorted({*pdf["a"], *pdf["b"]})
        at, both = {s: i for i, s in enumerate(signs)}, np.array([np.eye(len(signs))] * 2)
        for a, b, r, l in zip(pdf["a"], pdf["b"], pdf["r"], pdf["l"], strict=True):
            both[:, at[a], at[b]] = both[:, at[b], at[a]] = r, l
        labels, _ = spectral(anti_correlation(*both, weight), min(k, max(1, len(signs) - 1)))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "sign": signs, "vowel_class": labels})

    pairs = right.withColumnRenamed("similarity", "r").join(left.withColumnRenamed("similarity", "l"), ["lang", "a", "b"], "full").fillna(0.0, ["r", "l"])
    return pairs.groupBy("lang").applyInPandas(label, "lang string, sign string, vowel_class long")


@plan()
def p1_vowel_anticorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vowel classes of signs: alike in what follows them, less so in what precedes them."""
    return vowel_classes(*(run_sql(spark, sf_dir, f(SPARK)) for f in (phonology.p1_right_similarity, phonology.p1_left_similarity)))


#: Signs whose vowel is known, with its column.
ANCHORS = {"a": 0, "e": 1, "i": 2, "o": 3, "u": 4}


@plan()
def p1_anchored_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vowel columns of a language's signs from its consonant rows (spectral) and the signs whose vowel is known."""

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        signs, m = _matrix(pdf)
        rows, _ = spectral(m)
        known = {signs.index(s): c for s, c in ANCHORS.items() if s in signs}
        found = anchored_columns(rows, m, known, len(ANCHORS), m.sum(1) == 0)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "sign": signs, "consonant_row": rows, "vowel_column": found, "anchor": [s in ANCHORS for s in signs]})

    return _edges(spark, sf_dir).groupBy("lang").applyInPandas(columns, "lang string, sign string, consonant_row long, vowel_column long, anchor boolean")


@plan()
def p1_grid_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectral grid's consonant classes against sound classes: each class's majority and agreement, what it merges, and the Rand index."""
    truth = spark.createDataFrame(list(zip(vocabulary.LETTERS, vocabulary.CLASSES, strict=True)), "sign string, truth string")
    grid = p1_spectral_grid(spark, sf_dir).select("lang", "sign", F.col("consonant_class").alias("label"))
    return agreement(grid.join(F.broadcast(truth), "sign"), ["lang"], "label", "truth")


@plan()
def p1_method_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linkage methods and numbers of clusters over the alternation graph, with their silhouettes."""

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        signs, m = _matrix(pdf)
        d = m.max() - m
        np.fill_diagonal(d, 0)
        out = [(pdf["lang"].iloc[0], method, k, round(silhouette(d, linkage(d, k, method)), 6)) for method in ("average", "complete", "ward") for k in range(2, min(9, len(signs)))]
        return pd.DataFrame(out, columns=["lang", "method", "k", "silhouette"])

    return _edges(spark, sf_dir).groupBy("lang").applyInPandas(sweep, "lang string, method string, k long, silhouette double")


@plan()
def p2_paradigm_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signatures of two stems or more merged greedily into at most twenty paradigms; the suffixes of each."""
    ex = run_sql(spark, sf_dir, f"WITH {morphology._signature_suffixes(SPARK)} SELECT lang, signature, suffix FROM ex")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = {s: frozenset(g["suffix"]) for s, g in pdf.groupby("signature")}
        names = sorted(groups)
        number = dict(zip(names, merge_groups([groups[s] for s in names], 0.5, 20), strict=True))
        rows = sorted({(number[s], x) for s in names for x in groups[s]})
        return pd.DataFrame([(pdf["lang"].iloc[0], p, x) for p, x in rows], columns=["lang", "paradigm", "suffix"])

    return ex.groupBy("lang").applyInPandas(merge, "lang string, paradigm long, suffix string")


#: Words of a language whose pairwise distances the linkage has in memory; the work grows with their cube.
LINKED = 60


@plan()
def p3_word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all profiled words. Those of the LINKED commonest: profiles standardised, cut by singular values at 80 % of variance (5 to
    15 axes), Ward linkage, the number of classes from 3 to 10 with the best silhouette. Each other word goes to the class whose mean is
    nearest on the same axes, the first among equals."""
    prof = run_sql(spark, sf_dir, grammar.p3_profile_ppmi(SPARK))
    # the commonest words' own profiles are worked out apart, from their pairs alone, so that those of all words are made once
    some = f"some AS (SELECT lang, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, word) AS rk FROM wt) WHERE rk <= {LINKED})"
    linked = run_sql(spark, sf_dir, grammar._profiles(SPARK, some))

    def classes(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="word", columns="context", values="ppmi", fill_value=0.0).sort_index()
        x = wide.to_numpy(float)
        mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        x = (x - mean) / sd
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        share = np.cumsum(s**2) / max((s**2).sum(), 1e-12)
        k = int(np.clip(np.searchsorted(share, 0.8) + 1, min(5, len(s)), min(15, len(s))))
        y = u[:, :k] * s[:k]
        d = np.sqrt(np.maximum(((y[:, None] - y[None]) ** 2).sum(2), 0))
        best = max((round(silhouette(d, labels), 9), -m, labels.tolist()) for m in range(3, min(10, len(y) - 1) + 1) for labels in [linkage(d, m, "ward")])
        axes = vt[:k].T / sd[:, None]
        means = [y[np.array(best[2]) == c].mean(0) + mean @ axes for c in sorted(set(best[2]))]  # of the plain profile on these axes
        return pd.DataFrame([(pdf["lang"].iloc[0], list(wide.index), best[2], best[0], list(wide.columns), axes.tolist(), [m.tolist() for m in means])], columns=["lang", "words", "labels", "silhouette", "contexts", "axes", "means"])

    model = linked.groupBy("lang").applyInPandas(classes, "lang string, words array<string>, labels array<long>, silhouette double, contexts array<string>, axes array<array<double>>, means array<array<double>>")
    model = stored(model, "word-classes")  # a row a language: at most LINKED words and their contexts
    known = model.select("lang", F.explode(F.map_from_arrays("words", "labels")).alias("word", "label"))
    axes = model.select("lang", F.explode(F.map_from_arrays("contexts", "axes")).alias("context", "axis"))
    # contexts off the axes add nothing; profiles lie by word already, so they meet both without being dealt out again
    met = prof.join(F.broadcast(axes), ["lang", "context"], "left")
    at = met.groupBy("lang", "word").agg(*(F.coalesce(F.sum(F.col("ppmi") * F.get("axis", F.lit(i))), F.lit(0.0)).alias(f"y{i}") for i in range(15)))
    means = model.select("lang", "means", "silhouette", F.array_sort(F.array_distinct("labels")).alias("order"))
    far = F.transform("means", lambda m: F.round(sum((F.col(f"y{i}") - F.coalesce(F.get(m, F.lit(i)), F.lit(0.0))) ** 2 for i in range(15)), 9))
    nearest = F.element_at("order", F.array_position(far, F.array_min(far)).cast("int"))
    found = at.join(F.broadcast(means), "lang").join(F.broadcast(known), ["lang", "word"], "left")
    return found.select("lang", "word", F.coalesce("label", nearest).alias("class"), "silhouette")
