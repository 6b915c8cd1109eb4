"""Names of queries, their Spark plans and their checks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import DUCK, SPARK

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, word, n, freq, docs: the adapter's words, counted per document first, so that no distinct is expanded. Texts are dealt out by document
    before they are cut up, as a file may hold all of them in one row group; a document's words then lie together and aren't dealt out for its counts."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").repartition("doc_id")
    per_document = texts.select("doc_id", "lang", words.alias("word")).groupBy("lang", "word", "doc_id").agg(F.count("*").alias("k"))
    return per_document.groupBy("lang", "word").agg(F.length("word").cast("long").alias("n"), F.sum("k").alias("freq"), F.count("*").alias("docs"))


def _place_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, word, k, heads, ends: of the documents of two words or more a word's occurrences, and how many of them begin or end a document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", words.alias("ws")).where("size(ws) >= 2")
    rows = docs.select("lang", F.size("ws").alias("nw"), F.posexplode("ws").alias("i", "word"))
    return rows.groupBy("lang", "word").agg(F.count("*").alias("k"), F.count_if(F.col("i") == 0).alias("heads"), F.count_if(F.col("i") == F.col("nw") - 1).alias("ends"))


def _near_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.evidence import near_table

    return near_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.table(kept(spark, sf_dir, "word_table")))


def _segmented_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, word, freq, stem, suffix: see segmentation.segment."""
    from tessera.operators.segmentation import segment

    return segment(spark.table(kept(spark, sf_dir, "word_table")).where("n >= 2").select("lang", "word", "freq"))


def _context_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, sign, c, v: signs' neighbours in words."""
    from tessera.operators.sequences import neighbour_counts

    return neighbour_counts(spark.table(kept(spark, sf_dir, "word_table")).where("n >= 2").select("lang", "word", "freq"), ["lang"])


def _matching(name: str, *args) -> Query:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.plans import matching

        return getattr(matching, name)(spark.table(kept(spark, sf_dir, "word_table")), *args)

    return make


def _gate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.validation import gate_pool

    return gate_pool(spark.table(kept(spark, sf_dir, "word_table")))


def _gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.validation import gates_sql

    return run_sql(spark, sf_dir, gates_sql(SPARK))


#: Candidates of a language and length in the pools of the null model.
POOL = 500
_MATCHING = {
    "match_table": _matching("match_table"), "best_match_table": _matching("match_table", None, 1), "pool_match_table": _matching("match_table", POOL, 1), "reading_table": _matching("reading_table"),
    "null_table": _matching("null_table", POOL), "fixed_null_table": _matching("null_table", POOL, True),
}
#: Tables that many queries start from; they grow with the vocabulary, not the corpus.
KEPT = {"word_table": _word_table, "place_table": _place_table, "near_table": _near_table, "segmented_table": _segmented_table, "context_table": _context_table, **_MATCHING, "gate_pool": _gate_pool, "gate_table": _gate_table}


def kept(spark: SparkSession, sf_dir: str, table: str) -> str:
    """The name of a view over one of KEPT for this folder, made once a session and kept in memory, else on disk; lost parts are
    computed again from the files. The view stays, as dropping it would drop what is kept."""
    name = f"{table}_{hashlib.md5(sf_dir.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        KEPT[table](spark, sf_dir).persist().createOrReplaceTempView(name)
    return name


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Plans SQL over the tables of a folder; only those that the text names are opened, and their views are dropped again."""
    words = f"w AS ({SPARK.words()}), "
    if not re.search(r"\b(FROM|JOIN) w\b", sql.replace(words, "")):
        sql = sql.replace(words, "")  # the query goes on from counts alone
    sql = re.sub(r"\bFROM (" + "|".join(KEPT) + r")\b", lambda m: f"FROM {kept(spark, sf_dir, m[1])}", sql)
    names = r"\b(FROM|JOIN)(\s+)(" + "|".join(TABLES) + r")\b"
    named = {m[2] for m in re.findall(names, sql)}
    text = re.sub(names, r"\1\2{\3}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in named})


def sql_query(name: str, text: Callable) -> None:
    """Registers a query given as SQL: text(dialect)."""
    _queries[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text(SPARK))
    _oracles[name] = text(DUCK)


def relational(f: Callable) -> Callable:
    """Decorator: a function of a dialect that returns SQL is a query of the function's name."""
    sql_query(f.__name__, f)
    return f


def plan(oracle: Callable | None = None) -> Callable:
    """Decorator: a function of (spark, sf_dir), with its check as SQL if there is one."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle(DUCK)
        return f

    return add


def _load() -> None:
    from tessera.plans import corpus, evidence, grammar, learning, morphology, phonology, resampling, scans, validation, vocabulary  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
