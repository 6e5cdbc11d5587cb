"""Dates, money and ages as Column -> Column functions.  Unreadable values are null, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import SEXES, blank_to_null, clean, gender, letters, person_key, squash, without_icd10

MONEY = "decimal(18,2)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Three words in single spaces that read as day, month, year or as year, month, day.
DATE = rf" ([0-9]{{1,2}} (?:[0-9]{{1,2}}|(?:{'|'.join(MONTHS)})[a-z]{{0,6}}) [0-9]{{4}}|[0-9]{{4}} [0-9]{{2}} [0-9]{{2}})(?= )"
#: Words around an amount that say nothing of it (our own choice).
CURRENCY = ("inr", "only", "rs", "rupee", "rupees")


def date_of(value: Column) -> Column:
    """The first three neighbouring words that read as day, month, year or as year, month, day.

    Words are runs of letters or digits, so any separator will do; a month is a number or begins with its
    three letters.  Three words that look like a date and are none give null.
    """
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(clean(value)), "[^a-z0-9]+", " "), F.lit(" "))
    # one pattern for the three words: functions over arrays of words are interpreted, and their result was worked out for each of its uses
    found = F.split(F.nullif(F.regexp_extract(words, DATE, 1), F.lit("")), " ")
    first, second, third = (F.get(found, F.lit(k)) for k in range(3))
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(second, 1, 3)), F.lit(0)).cast("string"), second)
    year_first = F.length(first) == 4
    year, day = F.when(year_first, first).otherwise(third), F.when(year_first, third).otherwise(first)
    return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def plain_number(token: Column) -> Column:
    """A token as money: digits, with commas between groups and up to two decimals; else null."""
    bare = F.translate(token, ",", "")
    fits = bare.rlike("^[0-9]") & (F.length(F.split_part(bare, F.lit("."), F.lit(2))) <= 2)
    return F.when(fits, bare.try_cast(MONEY))


def amount(value: Column) -> Column:
    """The first word that is a number, currency words aside; a minus before it or brackets around all make it negative."""
    spaced = F.regexp_replace(F.translate(F.lower(clean(value)), "₹", " "), r"([a-z])\.?([0-9])", "$1 $2")
    words = F.filter(F.split(spaced, " "), lambda w: (w != "") & ~letters(w).isin(*CURRENCY))
    whole = F.array_join(words, " ")
    tokens = F.split(F.regexp_replace(whole, "[-()]", " $0 "), " +")
    numbers = F.transform(tokens, lambda t: plain_number(F.btrim(t, F.lit(".,;:"))))
    at = F.array_position(F.transform(numbers, lambda n: n.isNotNull()), True).cast("int")
    number = F.get(numbers, at - 1)
    inside = F.startswith(whole, F.lit("(")) & F.endswith(whole, F.lit(")"))
    signed = F.when((F.get(tokens, at - 2) == "-") | inside, -number).otherwise(number)
    # a bare number, as most are, needs none of this
    return F.when(value.rlike(r"^[0-9][0-9,]*(\.[0-9]{1,2})?$"), F.translate(value, ",", "").try_cast(MONEY)).otherwise(signed)


def is_amount(value: Column) -> Column:
    """The whole text is a number in groups: up to three digits, then two or three to a group, up to two decimals."""
    v = clean(value)
    bare = F.when(F.startswith(v, F.lit("(")) & F.endswith(v, F.lit(")")), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    groups, decimals = F.split(F.split_part(bare, F.lit("."), F.lit(1)), ","), F.split_part(bare, F.lit("."), F.lit(2))
    right = F.forall(F.transform(groups, lambda g, i: g.rlike("^[0-9]+$") & F.length(g).between(F.when(i == 0, 1).otherwise(2), F.lit(3))), lambda ok: ok)
    fraction = ~F.contains(bare, F.lit(".")) | decimals.rlike("^[0-9][0-9]?$")
    return right & fraction & (F.size(F.split(bare, r"\.")) <= 2)


def indian(value: Column) -> Column:
    """1,14,360.00."""
    # money has two decimals: a comma goes before three digits and a point, and before each two digits to the left of it
    return F.regexp_replace(value.cast(MONEY).cast("string"), r"(?<=\d)(?=(\d\d)*\d{3}\.)", ",")


def cents(value: Column) -> Column:
    """Money to two places, half to even."""
    return F.bround(value, 2).cast(MONEY)


#: Words after a number that make it an age (our own choice).
YEARS = ("y", "yo", "yr", "yrs", "year", "years")


def age(value: Column) -> Column:
    """The first number of up to three digits before a word for years or a sex, else one at the very start; 1 to 129."""
    apart = F.regexp_replace(F.lower(clean(value)), "([0-9])([a-z])", "$1 $2")
    words = F.filter(F.split(apart, "[^a-z0-9]+"), lambda w: w != "")
    small = lambda w: w.rlike("^[0-9]{1,3}$")
    told = F.filter(words, lambda w, i: small(w) & F.coalesce(F.get(words, i + 1), F.lit("")).isin(*YEARS, *SEXES))
    begins = F.when(small(F.get(words, F.lit(0))) & apart.rlike("^[0-9]"), F.get(words, F.lit(0)))
    found = F.coalesce(F.get(told, F.lit(0)), begins).try_cast("int")
    return F.when((found > 0) & (found < 130), found)


def comparison(kind: Column, value: Column) -> Column:
    """Comparison form by kind of value; null where the value cannot be read."""
    return blank_to_null(
        F.when(kind.isin("name", "person"), person_key(value))
        .when(kind == "id", F.regexp_replace(squash(value), " ", ""))
        .when(kind == "date", date_of(value).cast("string"))
        .when(kind == "gender", gender(value))
        .when(kind == "integer", F.regexp_extract(clean(value), r"^(\d+)(\s|$)", 1))
        .when(kind == "amount", cents(amount(value)).cast("string"))
        .when(kind == "diagnosis", squash(without_icd10(value)))
        .otherwise(squash(value))
    )
