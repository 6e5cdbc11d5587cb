"""What a page says of itself: its type by headings and words, its identifiers, its place in a count of pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points and limits of the classification.
TITLE, KEYWORD, NEGATIVE, TITLE_LINES = 10.0, 1.5, -6.0, 12
COVERAGE, CAPITALS, COVERAGE_IN_CAPITALS, KEYWORDS_NEEDED = 0.70, 0.85, 0.35, 2
BY_TITLE, BY_KEYWORDS, MOST, CLOSE, TORN, UNREAD = (0.80, 0.02), (0.34, 0.06), 0.97, 0.25, 0.62, 0.2
#: Words that announce a number, the words between, and the shape of the number.
ANNOUNCED = {
    "bill number": (("bill", "invoice", "receipt"), ("no", "number", "num", "#")),
    "claim number": (("claim", "authorisation", "authorization", "pre-?auth"), ("no", "id", "number", "num", "#")),
    "report number": (("report", "lab", "sample", "specimen", "accession", "barcode"), ("no", "id", "number", "num", "#")),
}
NUMBER, DATE = r"\s*[:.\-]?\s*([A-Za-z0-9][A-Za-z0-9/\-]{2,31})", r"^\d{1,4}[/\-.]\d{1,2}([/\-.]\d{1,4})?$"
#: Lower-case pieces of which a text holds one wherever it announces such a number.
GUARDS = {"bill number": ("bill", "invoice", "receipt"), "claim number": ("claim", "auth"), "report number": ("report", "lab", "sample", "specimen", "accession", "barcode")}
#: The lines up to the last of TITLE_LINES that are not blank; possessive, so that no text makes it go back.
FIRST_LINES = rf"\A(?:[ \n]*+[^\n]++\n?){{0,{TITLE_LINES}}}"
COUNTER = r"(?i)page\s*(\d{1,3})\s*(?:of|/)\s*(\d{1,3})"
OTHER = "other"

Vocabulary = dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]]


def announced(label: str) -> str:
    words, between = ANNOUNCED[label]
    return rf"(?i)(?:{'|'.join(words)})\s*(?:{'|'.join(between)}){NUMBER}"


def bounded(phrase: str) -> str:
    """A pattern of a lower-case phrase between anything but letters and digits."""
    return rf"(^|[^\p{{L}}\p{{N}}]){re.escape(phrase)}($|[^\p{{L}}\p{{N}}])"


def says(body: Column, phrase: str) -> Column:
    # the cheap containment test guards the pattern
    return F.contains(body, F.lit(phrase)) & body.rlike(bounded(phrase))


def extracted(text: Column, body: Column, pieces: tuple[str, ...], pattern: str, i: int) -> Column:
    """A group of a pattern, empty if it is not there; sought only where the lower-case body holds one of the pieces that any match holds."""
    held = F.contains(body, F.lit(pieces[0]))
    for piece in pieces[1:]:
        held |= F.contains(body, F.lit(piece))
    return F.when(held, F.regexp_extract(text, pattern, i)).otherwise("")


def headings(text: Column) -> Column:
    """Cells of the first lines that are not blank, cut at bars and at gaps of two spaces; none is blank."""
    # only the first lines are cut: a text may have very many
    lines = F.filter(F.split(F.regexp_extract(text, FIRST_LINES, 0), "\n"), lambda x: F.trim(x) != "")
    cells = F.flatten(F.transform(lines, lambda x: F.split(x, r" \| |\s{2,}")))
    # trim takes a second argument, which transform would fill with the place
    return F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")


def is_title(cell: Column, phrase: str) -> Column:
    """Whether a phrase covers enough of the cell it stands in to be its title: less will do where the cell is in capitals."""
    share = F.lit(float(len(phrase))) / F.length(cell)
    letters = F.regexp_replace(cell, r"\P{L}", "")
    capitals = F.length(F.regexp_replace(letters, r"\P{Lu}", "")) / F.nullif(F.length(letters), F.lit(0))
    return (share >= COVERAGE) | ((F.coalesce(capitals, F.lit(0.0)) >= CAPITALS) & (share >= COVERAGE_IN_CAPITALS))


def _first_with(cells: Column, phrase: str) -> Column:
    return F.get(F.filter(cells, lambda c: says(F.lower(c), phrase)), F.lit(0))


def _told(names: tuple[str, ...], vocabulary: Vocabulary, cells: Column, body: Column) -> list[Column]:
    """A struct of (points with their sign turned, type, titles, keywords) for every type, in the row."""
    found = []
    for name in names:
        titles, keywords, negatives = vocabulary[name]
        # only the first cell with a phrase counts for it
        first = [_first_with(cells, p) for p in titles]
        strong = [F.coalesce(is_title(c, p), F.lit(False)) for c, p in zip(first, titles, strict=True)]
        n_titles = sum((s.cast("int") for s in strong), F.lit(0))
        mentions = sum(((c.isNotNull() & ~s).cast("int") for c, s in zip(first, strong, strict=True)), F.lit(0))
        n_words = sum((says(body, p).cast("int") for p in keywords), F.lit(0))
        against = sum((says(body, p).cast("int") for p in negatives), F.lit(0))
        points = n_titles * TITLE + (mentions + n_words) * KEYWORD + against * NEGATIVE
        found.append(F.struct((-points).alias("minus"), F.lit(name).alias("type"), n_titles.alias("titles"), n_words.alias("words")))
    return found


def read(pages: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The pages' other columns with type, confidence, method, runner_up, named, identifiers, at and total.

    pages: text and any others.  vocabulary: type -> (title phrases, keywords, words against it), lower-case.  A phrase is
    worth a title's points where it titles its cell, a keyword's where a cell only mentions it; keywords and words against
    are sought in the whole text, once each.  The type with most points (then by name) is taken if it has a title, or
    keywords enough; a runner-up within a quarter of its points caps the confidence.  A page names itself if a title of its
    type stands in its headings and nothing caps its confidence.  Identifiers: the first number that each label announces,
    in capitals, unless it reads as a date.  Null and empty texts are ``other``.  All of it is one pass over the row.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pages.withColumn("text", text).withColumn("__cells", headings(F.col("text"))).withColumn("__body", F.lower("text"))
    told = F.array_sort(F.array(*_told(tuple(vocabulary), vocabulary, F.col("__cells"), F.col("__body"))))
    rows = rows.withColumn("__told", told)
    best, second = F.col("__told")[0], F.get("__told", F.lit(1))
    points, next_points = -best["minus"], -second["minus"]
    titled, worded = (points > 0) & (best["titles"] > 0), (points > 0) & (best["words"] >= KEYWORDS_NEEDED)
    grown = F.when(titled, BY_TITLE[0] + BY_TITLE[1] * best["words"]).otherwise(BY_KEYWORDS[0] + BY_KEYWORDS[1] * best["words"])
    torn = F.coalesce((points - next_points) / points < CLOSE, F.lit(False))
    sure = F.round(F.when(torn, F.least(grown, F.lit(MOST), F.lit(TORN))).otherwise(F.least(grown, F.lit(MOST))), 4)
    known = titled | worded
    pairs = []
    for label in ANNOUNCED:
        value = F.upper(extracted(F.col("text"), F.col("__body"), GUARDS[label], announced(label), 1))
        pairs.append(F.when((value != "") & ~value.rlike(DATE), F.struct(F.lit(label), value)))
    place = lambda i: F.nullif(extracted(F.col("text"), F.col("__body"), ("page",), COUNTER, i), F.lit("")).cast("int")
    others = [c for c in pages.columns if c != "text"]
    return rows.select(
        *others,
        F.when(known, best["type"]).otherwise(OTHER).alias("type"), F.when(known, sure).otherwise(UNREAD).alias("confidence"),
        F.when(titled, "title").when(worded, "keywords").otherwise("none").alias("method"),
        F.when(known, second["type"]).when(points > 0, best["type"]).alias("runner_up"),
        (titled & (sure >= BY_TITLE[0])).alias("named"), F.map_from_entries(F.array_compact(F.array(*pairs))).alias("identifiers"),
        place(1).alias("at"), place(2).alias("total"),
    )
