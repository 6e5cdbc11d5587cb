"""Text normalisers as Column -> Column functions.

Java's ``\\d``, ``\\w``, ``\\b`` and ``(?i)`` are ASCII here; add ``(?U)`` where Unicode classes matter.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def nfc(value: Column) -> Column:
    """NFC form; Spark has no built-in, so only non-ASCII values go through Python."""
    return F.when(value.rlike(r"^[\x00-\x7F]*$"), value).otherwise(_nfc(value))


def clean(value: Column) -> Column:
    """Null is empty, white space is single spaces, trailing punctuation goes (the caller has applied nfc)."""
    spaced = F.trim(F.regexp_replace(text(value), r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(spaced, r"[,;:.\-–—]+$", ""))


def squash(value: Column) -> Column:
    """Lower-case, runs of anything but a-z and 0-9 become one space, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(text(value)), "[^a-z0-9]+", " "))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


#: Letters of degrees and diplomas that may follow a name (our own choice).
QUALIFICATIONS = ("bds", "da", "dip", "diploma", "dm", "dnb", "fcps", "frcs", "mbbs", "mch", "md", "mds", "mrcp", "ms", "phd")
#: Titles that may stand before a name (our own choice).
HONORIFICS = ("dr", "km", "master", "miss", "mr", "mrs", "ms", "prof", "shri", "smt", "sri")
SEXES = {"m": "male", "male": "male", "f": "female", "female": "female", "other": "other"}


def letters(value: Column) -> Column:
    """Lower-case letters of a token, the rest dropped."""
    return F.regexp_replace(F.lower(value), "[^a-z]", "")


def before_first(parts: Column, found) -> Column:
    """The elements before the first one for which ``found`` holds; all if there is none."""
    at = F.array_position(F.transform(parts, found), True)
    return F.when(at > 0, F.slice(parts, F.lit(1), (at - 1).cast("int"))).otherwise(parts)


def person(value: Column) -> Column:
    """A person's name without what follows it; null if nothing is left.

    Read from left to right: a bullet ends it, as does a comma part that begins with a qualification or a word
    that announces a registration; a bracket at the end goes too.
    """
    head = F.split_part(clean(value), F.lit("·"), F.lit(1))
    parts = before_first(F.split(head, ","), lambda p: letters(F.split_part(F.trim(p), F.lit(" "), F.lit(1))).isin(*QUALIFICATIONS))
    tokens = before_first(F.split(F.array_join(parts, ","), " "), lambda t: letters(t).isin("reg", "regn", "registration"))
    name = clean(F.array_join(tokens, " "))
    name = F.when(F.endswith(name, F.lit(")")) & F.contains(name, F.lit("(")), F.substring_index(name, "(", -1)).otherwise("")
    whole = clean(F.array_join(tokens, " "))
    return blank_to_null(clean(F.btrim(F.substring(whole, F.lit(1), F.length(whole) - F.when(name != "", F.length(name) + 1).otherwise(0)), F.lit(" ,;-"))))


def person_key(value: Column) -> Column:
    """Comparison form of a person: squashed, without a title before the name."""
    tokens = F.split(squash(person(value)), " ")
    titled = (F.size(tokens) > 1) & F.get(tokens, F.lit(0)).isin(*HONORIFICS)
    return F.array_join(F.when(titled, F.slice(tokens, 2, F.size(tokens))).otherwise(tokens), " ")


def gender(value: Column) -> Column:
    """The first word that names a sex."""
    word = F.get(F.filter(F.split(F.lower(clean(value)), "[^a-z]+"), lambda t: t.isin(*SEXES)), F.lit(0))
    found = F.lit(None).cast("string")
    for name, sex in SEXES.items():
        found = F.when(word == name, sex).otherwise(found)
    return found


def is_icd10(token: Column) -> Column:
    """A letter but U, two digits, and nothing more or a point and one to four letters or digits."""
    category = token.rlike("^[A-Z][0-9][0-9]") & ~F.startswith(token, F.lit("U"))
    suffix = (F.substring(token, 4, 1) == ".") & F.length(token).between(5, 8) & ~F.contains(F.substring(token, 5, 8), F.lit("."))
    return category & ((F.length(token) == 3) | suffix)


def codes(value: Column) -> Column:
    """The diagnosis codes among the words of a text, in order."""
    return F.filter(F.transform(F.split(F.upper(clean(value)), "[^A-Z0-9.]+"), lambda t: F.btrim(t, F.lit("."))), is_icd10)


def icd10(value: Column) -> Column:
    return F.get(codes(value), F.lit(0))


def without_icd10(value: Column) -> Column:
    """A diagnosis without its code: brackets that hold a code go, and what follows the name of the classification."""
    pieces = F.split(clean(value), "[()]")  # every second one stood in brackets
    kept = F.filter(pieces, lambda p, i: (i % 2 == 0) | (F.size(codes(p)) == 0))
    words = before_first(F.split(F.array_join(kept, " "), " "), lambda t: F.startswith(F.lower(t), F.lit("icd")))
    return blank_to_null(clean(F.array_join(words, " ")))


def first_patterns(value: Column, patterns: dict[str, str], implied: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Keys of the patterns a text matches, in order, without those that a more specific match implies."""
    lowered = F.lower(clean(value))
    found = F.array_compact(F.array(*(F.when(lowered.rlike(p), k) for k, p in patterns.items())))
    for key, general in (implied or {}).items():
        found = F.when(F.array_contains(found, key), F.array_except(found, F.array(*map(F.lit, general)))).otherwise(found)
    return found


def plural(n: Column, singular: str, several: str | None = None) -> Column:
    """3 documents, 1 document, 2 entries."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {singular}").otherwise(f" {several or singular + 's'}"))


def names(values: Column, last: str = "and") -> Column:
    """Distinct sorted values as "a, b and c"."""
    v = F.array_sort(F.array_distinct(F.array_compact(values)))
    head = F.array_join(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), ", ")
    return F.when(F.size(v) == 0, "").when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(F.concat(head, F.lit(f" {last} "), F.element_at(v, -1)))


def snippet(line: Column, start: Column, end: Column, around: int = 28, width: int = 90) -> Column:
    """The text around a match (start and end count from 0), its columns divided by dots."""
    begin = F.greatest(F.lit(0), start - around)
    columns = F.split(F.trim(F.substring(line, begin + 1, end - begin + around)), r"\s\s+")
    return F.left(F.array_join(columns, " · "), F.lit(width))


def file_name(value: Column, most: int = 255) -> Column:
    """Base name without control and direction characters, cut before its extension."""
    base = F.regexp_replace(F.regexp_extract(text(value), r"([^/\\]*)$", 1), r"[\x00-\x1F\x7F‎‏‪-‮⁦-⁩]", "")
    dot = F.regexp_extract(base, r"(\.[^.]{1,16})$", 1)
    cut = F.concat(F.substring(base, F.lit(1), most - F.length(dot)), dot)
    return F.when(F.length(base) > most, cut).otherwise(base)


def email(value: Column) -> Column:
    """Lower-case address of a permissive shape, else null."""
    v = F.lower(F.trim(text(value)))
    return F.when((F.length(v) <= 254) & v.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), v)


def scrub(value: Column, banned: list[str]) -> Column:
    """The sentences of a text that hold none of the banned words."""
    sentences = F.split(text(value), r"(?<=[.!?])\s+")
    return F.array_join(F.filter(sentences, lambda s: ~F.lower(s).rlike(r"\b(" + "|".join(banned) + r")\b")), " ")


def intent(value: Column, groups: dict[str, tuple[str, ...]], other: str = "unknown") -> Column:
    """The first group one of whose keywords the text contains."""
    lowered, found = F.lower(text(value)), F.lit(other)
    for name, keys in reversed(groups.items()):
        hit = F.lit(False)
        for key in keys:
            hit = hit | F.contains(lowered, F.lit(key))
        found = F.when(hit, name).otherwise(found)
    return found
