"""Runs the pillars as stages that hand contracts on: what each needs of the ones before is checked, what is finished is not run again.

A contract is a folder: a Parquet table for each section, and `metadata` with one row: the stage, the hash of all that it was made from
(its tables' rows, its settings, its own definition, the contracts before it) and, for each section, its columns and rows. A stage is
resumed if its metadata has the very hash that it would be made from now; so a changed table runs again what reads it and what
depends on that, nothing else. Metadata is written last: a contract without it is unfinished and is written anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import registry
from tessera.sources.contracts import Settings

#: Contracts before a stage, by stage and section.
Upstream = dict[str, dict[str, DataFrame]]
Section = str | Callable[[SparkSession, str, Upstream, Settings], DataFrame]


@dataclass(frozen=True)
class Stage:
    """sections: a query's name, or a function of (spark, folder, contracts before, settings). needs: for each stage before it, the
    sections and columns that it relies on. tables: those that it reads."""

    name: str
    tables: tuple[str, ...]
    sections: dict[str, Section]
    needs: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)


def constraints(spark: SparkSession, data: str, before: Upstream, settings: Settings) -> DataFrame:
    """lang, word, stem, suffix, word_class, signs, placed: segmented words (p2) with their class (p3) and how many of their signs the
    grid (p1) places; only words on which any of them has something to say."""
    grid = before["p1"]["consonants"].select("lang", F.col("sign").alias("s"))
    words = before["p2"]["segmentation"].select("lang", "word", "stem", "suffix")
    signs = words.select("lang", "word", F.explode(F.filter(F.split("word", ""), lambda x: x != "")).alias("s"))
    placed = signs.join(grid.withColumn("known", F.lit(1)), ["lang", "s"], "left").groupBy("lang", "word").agg(F.count("*").alias("signs"), F.count("known").alias("placed"))
    classes = before["p3"]["word_classes"].select("lang", "word", F.col("class").alias("word_class"))
    found = words.join(placed, ["lang", "word"], "left").join(classes, ["lang", "word"], "left")
    return found.where("suffix IS NOT NULL AND suffix <> '' OR word_class IS NOT NULL OR placed > 0")


def strong_candidates(spark: SparkSession, data: str, before: Upstream, settings: Settings) -> DataFrame:
    """Matches of at least the settings' score, for words on which the other contracts have a constraint."""
    scores = registry.queries()["p5_combined_score"](spark, data)
    known = before["p4"]["templates"].select("lang").distinct().withColumn("has_formulas", F.lit(True))
    return scores.where(F.col("combined") >= settings.match_threshold).join(known, "lang", "left").withColumn("has_formulas", F.coalesce("has_formulas", F.lit(False)))


STAGES = (
    Stage("p1", ("documents",), {"vowels": "p1_vowel_enrichment", "columns": "p1_vowel_columns", "consonants": "p1_spectral_grid", "constraints": "p1_forbidden_favored"}),
    Stage("p2", ("documents",), {"segmentation": "p2_segmentation", "affixes": "p2_affix_productivity", "paradigms": "p2_paradigm_slots"}, {"p1": {"vowels": ("lang", "sign", "is_vowel")}}),
    Stage("p3", ("documents",), {"word_classes": "p3_word_classes", "order": "p3_direction_test"}, {"p1": {"consonants": ("lang", "sign")}, "p2": {"segmentation": ("lang", "word", "stem", "suffix")}}),
    Stage("p4", ("documents", "orders", "lineitem"), {"totals": "p4_total_verification", "templates": "p4_formula_elements"}, {"p1": {"vowels": ("lang", "sign")}}),
    Stage(
        "p5", ("documents",), {"constraints": constraints, "candidates": strong_candidates, "gates": "p5_validation_gates"},
        {"p1": {"consonants": ("lang", "sign", "consonant_class")}, "p2": {"segmentation": ("lang", "word", "stem", "suffix")}, "p3": {"word_classes": ("lang", "word", "class")}, "p4": {"templates": ("lang",)}},
    ),
)


class ContractError(ValueError):
    """A contract that lacks what the next stage needs."""


def table_hash(df: DataFrame) -> str:
    """Of a table's rows, in whatever order and files: their number and two sums of their hashes."""
    h = F.xxhash64(*(F.to_json(F.struct(c)) if isinstance(t, str) and t.startswith("map") else F.col(c) for c, t in df.dtypes))
    row = df.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()


def _definition(section: Section) -> str:
    return section if isinstance(section, str) else f"{section.__module__}.{section.__qualname__}"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def metadata(spark: SparkSession, path: str) -> dict | None:
    """The one row of a contract's metadata, or None if the contract is missing or unfinished."""
    df = _read(spark, f"{path}/metadata")
    row = df.first() if df is not None else None
    return None if row is None else row.asDict() | {"sections": json.loads(row["sections"])}


def hand_over(spark: SparkSession, path: str, needs: dict[str, tuple[str, ...]], made_from: str) -> dict[str, DataFrame]:
    """All sections of a contract, after a check that it is finished, is the one that was meant, and holds what is needed."""
    found = metadata(spark, path)
    if found is None:
        raise ContractError(f"no finished contract at {path}")
    if found["made_from"] != made_from:
        raise ContractError(f"the contract at {path} was made from something else")
    for section, columns in needs.items():
        lacking = [section] if section not in found["sections"] else [f"{section}.{c}" for c in columns if c not in found["sections"][section]["columns"]]
        if lacking:
            raise ContractError(f"the contract at {path} lacks {', '.join(lacking)}")
    return {s: spark.read.parquet(f"{path}/{s}") for s in found["sections"]}


def run(spark: SparkSession, data: str, out: str, settings: Settings = Settings(), stages: tuple[Stage, ...] = STAGES, only: list[str] | None = None, again: bool = False) -> dict[str, str]:
    """Runs stages over a folder of tables; each one's outcome: made, or resumed. only: these and what they need. again: nothing is resumed."""
    by_name = {s.name: s for s in stages}
    unknown = set(only or ()) - set(by_name)
    if unknown:
        raise ValueError(f"no such stage: {', '.join(sorted(unknown))}")
    wanted = set(only or by_name)
    for stage in reversed(stages):
        wanted |= set(stage.needs) if stage.name in wanted else set()
    hashes = {t: table_hash(spark.read.parquet(f"{data}/{t}.parquet")) for t in sorted({t for s in stages if s.name in wanted for t in s.tables})}
    made_from: dict[str, str] = {}
    outcome: dict[str, str] = {}
    for stage in stages:
        if stage.name not in wanted:
            continue
        parts = [stage.name, sorted((k, _definition(v)) for k, v in stage.sections.items()), asdict(settings), {t: hashes[t] for t in stage.tables}, {s: made_from[s] for s in stage.needs}]
        made_from[stage.name] = hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
        path = f"{out}/{stage.name}"
        found = metadata(spark, path)
        if not again and found is not None and found["made_from"] == made_from[stage.name] and all(_read(spark, f"{path}/{s}") is not None for s in stage.sections):
            outcome[stage.name] = "resumed"
            continue
        before = {s: hand_over(spark, f"{out}/{s}", needs, made_from[s]) for s, needs in stage.needs.items()}
        _make(spark, stage, data, path, before, settings, made_from)
        outcome[stage.name] = "made"
    return outcome


def _make(spark: SparkSession, stage: Stage, data: str, path: str, before: Upstream, settings: Settings, made_from: dict[str, str]) -> None:
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    store.getFileSystem(spark._jsc.hadoopConfiguration()).delete(store, True)  # unfinished from here on
    told = {}
    for name, section in stage.sections.items():
        df = registry.queries()[section](spark, data) if isinstance(section, str) else section(spark, data, before, settings)
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        told[name] = {"columns": df.columns, "rows": spark.read.parquet(f"{path}/{name}").count()}
    upstream = {s: made_from[s] for s in stage.needs}
    row = spark.createDataFrame([(stage.name, made_from[stage.name], json.dumps(upstream, sort_keys=True), json.dumps(told, sort_keys=True))], "stage string, made_from string, upstream string, sections string")
    row.coalesce(1).withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/metadata")
