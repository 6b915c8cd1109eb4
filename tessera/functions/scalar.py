"""Scalar functions as column expressions: positions, sign kinds, consonant and vowel, sound classes, distances, scores.

Two conventions for one notion (Jaccard of empty sets, the consonant of a pure vowel) are two named functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and the twelve sound classes they fall into; all others are dropped.
SOUND_CLASSES = {
    "P": "pbfvɸβ", "T": "tdθðɗɖ", "S": "szʃʒʂʐcçɕʑ", "K": "kgɡxɣqχɢʁ", "M": "mɱ", "N": "nɲŋɳɴ", "L": "lɬɮɭʎ", "R": "rɾɽɻ", "W": "wʷ", "J": "jʝ", "H": "hɦʔʕħɧ", "V": "aeiouəɛɔɪʊæɑʌɒyøœɯɨʉɐɵɤ",
}
#: Weight of a semantic score by provenance.
PROVENANCE_WEIGHTS = {"INDEPENDENT": 1.0, "INDEPENDENT_VALIDATED": 1.0, "CONSENSUS_CONFIRMED": 0.8, "CONSENSUS_ASSUMED": 0.5, "CONSENSUS_DEPENDENT": 0.3}
#: Numeral signs whose value is certain.
NUMERALS = {"A701": 1, "A704": 10, "A705": 100}


def place_label(position: Column, length: Column) -> Column:
    """initial, medial, final, or singleton for a word of one sign; positions start at 0."""
    return F.when(length == 1, "singleton").when(position == 0, "initial").when(position == length - 1, "final").otherwise("medial")


def relative_position(position: Column, length: Column) -> Column:
    """position / (length - 1), one half for a single item."""
    return F.when(length <= 1, F.lit(0.5)).otherwise(position / (length - 1))


def third_label(position: Column, length: Column) -> Column:
    """early, middle or late; a single item is early."""
    r = F.when(length <= 1, F.lit(0.0)).otherwise(position / (length - 1))
    return F.when(r < 1 / 3, "early").when(r < 2 / 3, "middle").otherwise("late")


def relation_label(start: Column, end: Column, at: Column, window: int) -> Column:
    """How far a place is from a span (0 inside): immediately_adjacent up to 1, nearby up to the window, else same_inscription."""
    d = F.greatest(start - at, at - end, F.lit(0))
    return F.when(d <= 1, "immediately_adjacent").when(d <= window, "nearby").otherwise("same_inscription")


def sign_kind(reading: Column, raw_type: Column) -> Column:
    """named_ideogram, numeral, unknown_logogram or syllabogram, by the form of a reading and its type in the corpus."""
    logogram = F.coalesce(raw_type == "logogram", F.lit(False)) | reading.rlike(r"^A[3-6]\d{2}")
    return F.when(reading.rlike(r"(?i)^AB\d+[a-z]?/.+$"), "named_ideogram").when(reading.rlike(r"^A70\d"), "numeral").when(logogram, "unknown_logogram").otherwise("syllabogram")


def numeral_value(reading: Column) -> Column:
    """The value of a numeral sign, null if it is not certain."""
    value = F.lit(None).cast("long")
    for sign, v in NUMERALS.items():
        value = F.when(reading == sign, F.lit(v).cast("long")).otherwise(value)
    return value


def consonant_of(reading: Column, pure_vowel: str | None = None) -> Column:
    """What precedes the final vowel, digits at the end ignored; for a pure vowel `pure_vowel` (null, '' or 'V'); null for *NN."""
    bare = F.regexp_replace(F.lower(reading), r"\d+$", "")
    got = F.regexp_extract(bare, "^(.*?)([aeiou])$", 1)
    return F.when(bare.startswith("*") | ~bare.rlike("[aeiou]$"), F.lit(None).cast("string")).when(got == "", F.lit(pure_vowel).cast("string")).otherwise(got)


def vowel_of(reading: Column) -> Column:
    bare = F.regexp_replace(F.lower(reading), r"\d+$", "")
    return F.when(~bare.startswith("*") & bare.rlike("[aeiou]$"), F.regexp_extract(bare, "([aeiou])$", 1))


def last_vowel(ipa: Column) -> Column:
    got = F.regexp_extract(ipa, "([aeiou])[^aeiou]*$", 1)
    return F.when(got != "", got)


def sound_classes(ipa: Column) -> Column:
    """A string of the twelve classes; characters without one are dropped."""
    chars, classes = zip(*((c, k) for k, cs in SOUND_CLASSES.items() for c in cs), strict=True)
    coded = F.translate(F.lower(ipa), "".join(chars), "".join(classes))
    return F.regexp_replace(coded, f"[^{''.join(SOUND_CLASSES)}]", "")


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length: 0 if equal (and not empty), 1 if either is empty."""
    d = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(1.0)).otherwise(d)


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Of two arrays taken as sets; both_empty is 1 for paradigms, 0 for sign classes."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(float(both_empty))).otherwise(F.size(F.array_intersect(a, b)) / union)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two maps from key to count: sum of minima over sum of maxima, 0 for two empty ones."""
    zero = F.lit(0.0)
    merged = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.least(F.coalesce(x, zero), F.coalesce(y, zero)).alias("lo"), F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)).alias("hi"))))
    total = lambda name: F.aggregate(merged, F.lit(0.0), lambda s, x: s + x[name])
    return F.when(total("hi") == 0, zero).otherwise(total("lo") / total("hi"))


def key_of(signs: Column) -> Column:
    """Lower-case signs, joined by bars: the exposed form of a sign-group."""
    return F.array_join(F.transform(signs, F.lower), "|")


def mapped(signs: Column, names: Column) -> Column:
    """Each sign by its name in a map, itself if it has none."""
    return F.transform(signs, lambda s: F.coalesce(names[s], s))


def spelled(signs: Column, ipa: Column) -> Column:
    """Signs as one string by a map; null if any sign is not in it."""
    got = F.transform(signs, lambda s: ipa[s])
    return F.when(~F.exists(got, lambda x: x.isNull()), F.array_join(got, ""))


def same_type(kind: Column, kinds: list[str]) -> Column:
    """Exact, or equal in lower case with spaces as underscores."""
    return kind.isin(kinds) | F.replace(F.lower(kind), F.lit(" "), F.lit("_")).isin(kinds)


def site_matches(site: Column, expected: Column) -> Column:
    return F.exists(expected, lambda e: F.contains(F.lower(site), F.lower(e)))


def undamaged(signs: Column) -> Column:
    """Signs that are not markers of damage."""
    return F.filter(signs, lambda s: ~(s.isin("?", "[?]") | s.startswith("[")))


def cleaned_length(word: Column) -> Column:
    """Length without affix marks, daggers and equals signs."""
    return F.length(F.regexp_replace(F.regexp_replace(word, r"^[-*\[\](){}+]+|[-*\[\](){}+]+$", ""), "[†=]", ""))


def field_of(gloss: Column, keywords: dict[str, str]) -> Column:
    """The most specific field (most colons) whose keyword the gloss holds; the first keyword among equals; null without any."""
    found = F.lit(None).cast("string")
    for word, field in reversed(sorted(keywords.items(), key=lambda x: -x[1].count(":"))):
        found = F.when(F.contains(F.lower(gloss), F.lit(word)), field).otherwise(found)
    return found


def semantic_score(anchor: Column, candidate: Column) -> Column:
    """1 for one field, one half for one domain, 0 else; null if either is unknown."""
    domain = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return F.when(anchor.isNull() | candidate.isNull(), F.lit(None).cast("double")).when(anchor == candidate, 1.0).when(domain(anchor) == domain(candidate), 0.5).otherwise(0.0)


def combined_score(phonological: Column, semantic: Column, provenance: Column) -> Column:
    """Half the phonological score, and the semantic one weighted by provenance if there is one."""
    weight = F.lit(0.3)
    for name, w in PROVENANCE_WEIGHTS.items():
        weight = F.when(provenance == name, w).otherwise(weight)
    return 0.5 * phonological + F.coalesce(semantic * weight, F.lit(0.0))


def confidence(margin: Column, candidates: Column, sufficiency: Column, consistent: Column, occupied: Column) -> Column:
    """Margin of the consonant, one over the vowels left, sufficiency of data; halved off the grid, 0.7 in a taken cell; 0 to 1."""
    value = margin / candidates * sufficiency * F.when(consistent, 1.0).otherwise(0.5) * F.when(occupied, 0.7).otherwise(1.0)
    return F.when(candidates == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def provenance(independent: Column, confirmed: Column, assumed: Column) -> Column:
    return F.when(independent, "INDEPENDENT").when(confirmed, "CONSENSUS_CONFIRMED").when(assumed, "CONSENSUS_ASSUMED").otherwise("CONSENSUS_DEPENDENT")


def json_safe(x: Column, infinity: float = 1e308) -> Column:
    """Not-a-number as 0, infinities as +-infinity (0 for the last contract)."""
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), float(infinity)).when(x == float("-inf"), -float(infinity)).otherwise(x)
