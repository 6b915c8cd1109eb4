"""Corpora of inscriptions in JSON: scans with an explicit schema, flattened into the views that the queries start from.

A corpus is one JSON object with an inventory of signs and a list of inscriptions, or the list alone. Inscriptions are rows at once;
their words and signs are exploded from arrays, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import numeral_value, place_label, sign_kind

INVENTORY = "map<string, struct<type: string, confidence: string, ipa: string, count: bigint, ab_codes: array<string>>>"
INSCRIPTION = """struct<id: string, type: string, site: string, sign_count: bigint,
  words: array<struct<ab_codes: string, sign_readings: array<string>, transliteration: string, has_damage: boolean, has_damage_marker: boolean>>,
  signs_sequence: array<struct<reading: string, type: string, ab_code: string>>>"""


def scan(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """path, corpus_hash, inventory, inscriptions, corrupt: a row for each file, or with lines for each line, so that a corpus of any size
    is read in parts. A bare list is taken as inscriptions without an inventory. What is no JSON of that form has corrupt set
    and no inscriptions."""
    return parse(spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")))


def parse(text: DataFrame) -> DataFrame:
    """path, json: corpora as text, from files or elsewhere -> the columns of scan."""
    bare = F.ltrim("json").startswith("[")
    whole = F.from_json("json", f"struct<sign_inventory: {INVENTORY}, inscriptions: array<{INSCRIPTION}>, _bad: string>", {"columnNameOfCorruptRecord": "_bad"})
    alone = F.from_json("json", f"array<{INSCRIPTION}>")
    read = text.select("path", "json", bare.alias("bare"), F.when(~bare, whole).alias("whole"), F.when(bare, alone).alias("alone"))  # a line is parsed once
    corrupt = F.when(F.col("bare"), F.col("alone").isNull()).otherwise(F.col("whole").isNull() | F.col("whole._bad").isNotNull())
    found = read.select("path", F.sha2("json", 256).alias("corpus_hash"), F.col("whole.sign_inventory").alias("inventory"), F.coalesce("alone", "whole.inscriptions").alias("inscriptions"), F.coalesce(corrupt, F.lit(True)).alias("corrupt"))
    return found.withColumn("inscriptions", F.when(~F.col("corrupt"), F.col("inscriptions")))


def inventory(corpus: DataFrame) -> DataFrame:
    """reading, type, confidence, ipa, count, ab_codes: the signs."""
    return corpus.select(F.explode("inventory").alias("reading", "s")).select("reading", "s.*")


def readings_of_codes(corpus: DataFrame, by_confidence: list[str] | None = None) -> DataFrame:
    """ab_code, reading: of several readings the last in alphabetical order, or that of the best tier of confidence first."""
    rows = inventory(corpus).select("reading", "confidence", F.explode("ab_codes").alias("ab_code"))
    tier = F.coalesce(F.array_position(F.array(*map(F.lit, by_confidence)), F.col("confidence")), F.lit(0)) if by_confidence else F.lit(1)
    rank = F.when(tier == 0, 10**6).otherwise(tier)
    return rows.groupBy("ab_code").agg(F.max_by("reading", F.struct(-rank, F.col("reading"))).alias("reading"))


def _inscriptions(corpus: DataFrame) -> DataFrame:
    # outer, as the plain one would have Spark work out the whole array a second time, to skip empty ones; rows without words or signs go where those are dealt out
    return corpus.select(F.explode_outer("inscriptions").alias("i")).select(F.coalesce("i.id", F.lit("unknown")).alias("insc_id"), F.coalesce("i.type", F.lit("unknown")).alias("insc_type"), F.coalesce("i.site", F.lit("unknown")).alias("site"), "i.words", "i.signs_sequence")


def _codes(word: Column) -> Column:
    """Structs (sign_id, reading): codes paired with readings; without codes the readings name the signs, marked R_."""
    codes = F.split(word["ab_codes"], "-")
    paired = F.transform(codes, lambda c, i: F.struct(c.alias("sign_id"), F.coalesce(F.get(word["sign_readings"], i), c).alias("reading")))
    alone = F.transform(F.coalesce(word["sign_readings"], F.array().cast("array<string>")), lambda r: F.struct(F.concat(F.lit("R_"), r).alias("sign_id"), r.alias("reading")))
    return F.when(F.coalesce(word["ab_codes"], F.lit("")) == "", alone).otherwise(paired)


def words(corpus: DataFrame) -> DataFrame:
    """The view for sounds: insc_id, insc_type, site, word_index, has_damage, sign_ids (syllabograms only) and n.

    A sign's type is the inventory's for its reading, else for its code; else a numeral by its code, else unknown.
    """
    # signs are chosen within an inscription, by its file's inventory, so that neither goes along with each word
    kind = lambda s: F.coalesce(F.col("inventory")[s["reading"]]["type"], F.col("inventory")[s["sign_id"]]["type"], F.when(s["sign_id"].startswith("A7") | s["sign_id"].startswith("NUM"), "numeral").otherwise("unknown"))
    signs = lambda w: F.transform(F.filter(_codes(w), lambda s: kind(s) == "syllabogram"), lambda s: s["sign_id"])
    # an inscription's readings that name no syllabogram are found once; a word without them keeps its codes as they are, others are looked up sign by sign
    none = F.array().cast("array<string>")
    readings = F.array_distinct(F.flatten(F.transform("i.words", lambda w: F.coalesce(w["sign_readings"], none))))
    rest = F.filter(readings, lambda r: F.coalesce(F.col("inventory")[r]["type"] != "syllabogram", F.lit(True)))
    plain = lambda w, codes, rest: F.coalesce((w["ab_codes"] != "") & (F.size(codes) == F.size(w["sign_readings"])) & ~F.arrays_overlap(w["sign_readings"], rest), F.lit(False))
    word = lambda w, codes, rest: F.struct(F.coalesce(w["has_damage"], F.lit(False)).alias("has_damage"), F.when(plain(w, codes, rest), codes).otherwise(signs(w)).alias("sign_ids"))
    codes = F.transform("i.words", lambda w: F.split(w["ab_codes"], "-"))
    # given by a lambda, as a column of its own might be worked out again for each word
    judged = F.get(F.transform(F.array(rest), lambda rest: F.zip_with("i.words", codes, lambda w, c: word(w, c, rest))), F.lit(0))
    rows = corpus.select("inventory", F.explode_outer("inscriptions").alias("i"))  # outer here and below as in _inscriptions
    rows = rows.select(*(F.coalesce(f"i.{c}", F.lit("unknown")).alias(name) for c, name in (("id", "insc_id"), ("type", "insc_type"), ("site", "site"))), judged.alias("judged"))
    rows = rows.select("insc_id", "insc_type", "site", F.posexplode_outer("judged").alias("word_index", "w")).where("word_index IS NOT NULL")
    return rows.select("insc_id", "insc_type", "site", "word_index", "w.has_damage", "w.sign_ids").withColumn("n", F.size("sign_ids"))


def positions(words_: DataFrame, min_length: int = 2, exclude_damaged: bool = True) -> DataFrame:
    """A row for each sign of the words that count, with its place label."""
    rows = words_.where(F.col("n") >= min_length)
    rows = rows.where(~F.col("has_damage")) if exclude_damaged else rows
    rows = rows.select("insc_id", "word_index", "n", F.posexplode("sign_ids").alias("position", "sign_id"))
    return rows.withColumn("place", place_label(F.col("position"), F.col("n")))


def bigrams(words_: DataFrame) -> DataFrame:
    """Neighbouring signs of all words of two or more, damaged ones too."""
    pairs = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct(F.element_at("sign_ids", i).alias("sign_i"), F.element_at("sign_ids", i + 1).alias("sign_j")))
    return words_.where("n >= 2").select("insc_id", "word_index", F.posexplode(pairs).alias("position", "p")).select("insc_id", "word_index", "position", "p.*")


def grammar_words(corpus: DataFrame, is_numeral: Column | None = None) -> DataFrame:
    """The view for grammar: words with any sign that is not damage, numbered anew; whether a word of numerals follows; words a text."""
    codes = lambda w: F.filter(F.transform(F.split(F.coalesce(w["ab_codes"], F.lit("")), "-"), F.trim), lambda s: s != "")
    legible = lambda signs: F.exists(signs, lambda s: ~(s.isin("?", "[?]") | s.startswith("[")))
    rows = _inscriptions(corpus).select("insc_id", "insc_type", "site", F.filter(F.transform("words", codes), legible).alias("signs"))
    # an inscription's words stay one array, so none is dealt out to meet the next
    both = F.arrays_zip("signs", F.slice("signs", 2, F.greatest(F.size("signs"), F.lit(1))).alias("following"))
    # counted before they are dealt out, as each word would carry all words of its inscription along for their number
    rows = rows.select("insc_id", "insc_type", "site", F.size("signs").cast("long").alias("n_words"), both.alias("both"))
    rows = rows.select("insc_id", "insc_type", "site", "n_words", F.posexplode_outer("both").alias("position", "w")).where("position IS NOT NULL")  # as in _inscriptions
    numerals = F.forall("w.following", lambda s: s.startswith("N") | s.rlike("^A7"))
    after = F.coalesce((F.size("w.following") > 0) & numerals, F.lit(False))
    return rows.select("insc_id", "insc_type", "site", F.col("w.signs").alias("signs"), "position", "n_words", after.alias("has_numeral_after"))


def sign_stream(corpus: DataFrame) -> DataFrame:
    """The view for meaning: every sign of an inscription in order, classified anew, with the value of a numeral."""
    rows = _inscriptions(corpus).select("insc_id", "insc_type", "site", F.posexplode("signs_sequence").alias("position", "s"))
    return rows.select("insc_id", "insc_type", "site", "position", F.col("s.reading").alias("reading"), F.col("s.ab_code").alias("ab_code"), sign_kind(F.col("s.reading"), F.col("s.type")).alias("kind"), numeral_value(F.col("s.reading")).alias("value"))


def sign_lists(corpus: DataFrame) -> DataFrame:
    """The scripts' view: readings of undamaged words, without those of digits only."""
    rows = _inscriptions(corpus).select("insc_id", F.explode("words").alias("w")).where(~F.coalesce("w.has_damage", F.lit(False)))
    return rows.select("insc_id", F.filter("w.sign_readings", lambda s: ~s.rlike("^[0-9]+$")).alias("signs")).where(F.size("signs") > 0)


def syllable_words(spark: SparkSession, path: str, min_syllables: int = 1, lines: bool = False) -> DataFrame:
    """{words: [{syllables}]}, one object a file, or with lines one a line: a row for each word that is long enough."""
    rows = spark.read.schema("words array<struct<syllables: array<string>>>").json(path, multiLine=not lines)
    return rows.select(F.explode("words").alias("w")).select(F.col("w.syllables").alias("signs")).where(F.size("signs") >= min_syllables)


def word_list(spark: SparkSession, path: str, column: str, known: list[str], least: int = 2) -> DataFrame:
    """A TSV column of hyphenated words: asterisks and digits go; words of known signs only, `least` or more."""
    rows = spark.read.csv(path, sep="\t", header=True)
    signs = F.filter(F.transform(F.split(F.regexp_replace(column, r"\*", ""), "-"), lambda s: F.regexp_replace(s, r"\d+", "")), lambda s: s != "")
    rows = rows.select(signs.alias("signs"))
    return rows.where((F.size("signs") >= least) & F.forall("signs", lambda s: s.isin(known)))


def cv_words(df: DataFrame, sca: str, least: int = 2) -> DataFrame:
    """Sound-class strings cut into syllables of a consonant at most and a vowel; words with a lone consonant go."""
    syllables = F.regexp_extract_all(sca, F.lit("([^AEIOU]?[AEIOU]|[^AEIOU])"), F.lit(1))
    rows = df.withColumn("signs", syllables)
    return rows.where((F.size("signs") >= least) & ~F.exists("signs", lambda s: ~s.rlike("[AEIOU]$")))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two corpora as one, the second's inventory winning."""
    return a.unionByName(b)
