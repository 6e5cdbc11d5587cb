"""Pages read from their text, and the documents that files of such pages hold.

A page is a whole document of the table under a printed head: titles, mentions of titles, numbers and counts of pages.  Forty
neighbours of one source are a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import folds, pages
from dossier.sources.tables import table

#: Our own types: title phrases, keywords, words against.
KINDS = {
    "discharge": (("discharge summary", "summary of stay"), ("the", "with", "und"), ("les",)),
    "invoice": (("tax invoice", "final bill"), ("of", "the", "que"), ("nicht",)),
    "report": (("lab report",), ("und", "les", "that"), ()),
    "letter": (("covering letter", "notice"), ("der", "para", "dans", "and"), ("license",)),
}
HEADS = ("TAX INVOICE", "Discharge Summary | Ward 3", "we enclose the tax invoice of this week", "", "Lab Report", "THE LAB REPORT OF TODAY", "Notice  Covering Letter", "summary of stay, see notice")
NUMBERS = ("''", "concat('Bill No: b', cast(floor(doc_id / 8) as bigint), '/x')", "'Report no. 12/05/2024'", "concat('claim id# c-', cast(floor(doc_id / 16) as bigint), '-00')", "concat('Sample number ', cast(1000 + doc_id % 3 as bigint))")
COUNTS = ("'Page 1 of 3'", "'page 2/3'", "''", "''", "'Page 3 of 3'")

#: One expression that both engines read.
_PRINTED = "concat({heads}, chr(10), chr(10), {numbers}, chr(10), {counts}, chr(10), coalesce(text, ''))".format(
    heads="CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END",
    numbers="CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(NUMBERS)) + " END",
    counts="CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(COUNTS)) + " ELSE '' END",
)


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    file = F.expr("concat(coalesce(source, ''), '/', cast(floor(doc_id / 40) as bigint))")
    return pages.read(docs.select("doc_id", file.alias("file"), (F.col("doc_id") % 40).cast("bigint").alias("page"), F.expr(_PRINTED).alias("text")), KINDS)


def page_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page says of itself."""
    numbers = [F.col("identifiers")[label].alias(label.replace(" ", "_")) for label in pages.ANNOUNCED]
    return _reads(spark, sf_dir).select("doc_id", "type", "confidence", "method", "runner_up", "named", *numbers, F.col("at").cast("bigint").alias("at"), F.col("total").cast("bigint").alias("total"))


def read_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents inside the files, placed by what their pages say."""
    return folds.placed_segments(_reads(spark, sf_dir))


def _says(body: str, phrase: str) -> str:
    return f"regexp_matches({body}, '{pages.bounded(phrase)}')".replace("\\ ", " ")


def _reads_sql() -> str:
    told = []
    for name, (titles, keywords, negatives) in KINDS.items():
        first = [f"list_filter(cells, lambda c: {_says('lower(c)', p)})[1]" for p in titles]
        share = [f"({len(p)} / CAST(length({c}) AS DOUBLE))" for c, p in zip(first, titles, strict=True)]
        capitals = [f"length(regexp_replace({c}, '\\P{{Lu}}', '', 'g')) / CAST(length(regexp_replace({c}, '\\P{{L}}', '', 'g')) AS DOUBLE)" for c in first]
        strong = [f"(CASE WHEN {s} >= {pages.COVERAGE} OR ({k} >= {pages.CAPITALS} AND {s} >= {pages.COVERAGE_IN_CAPITALS}) THEN 1 ELSE 0 END)" for s, k in zip(share, capitals, strict=True)]
        mentions = [f"(CASE WHEN {c} IS NOT NULL THEN 1 - {s} ELSE 0 END)" for c, s in zip(first, strong, strict=True)]
        words = [f"CAST({_says('body', p)} AS INT)" for p in keywords]
        against = [f"CAST({_says('body', p)} AS INT)" for p in negatives] or ["0"]
        told.append(f"SELECT doc_id, '{name}' AS type, {' + '.join(strong)} AS titles, {' + '.join(words)} AS words, {' + '.join(mentions)} AS mentions, {' + '.join(against)} AS against FROM h")
    number = lambda label: f"nullif(upper(regexp_extract(text, '{pages.announced(label)}', 1)), '')"
    numbers = ", ".join(f"CASE WHEN NOT regexp_matches({number(k)}, '{pages.DATE}') THEN {number(k)} END AS {k.replace(' ', '_')}" for k in pages.ANNOUNCED)
    return f"""
d AS (SELECT doc_id, concat(coalesce(source, ''), '/', CAST(floor(doc_id / 40) AS BIGINT)) AS file, CAST(doc_id % 40 AS BIGINT) AS page, {_PRINTED} AS text FROM documents),
h AS (SELECT doc_id, lower(text) AS body, list_filter(list_transform(flatten(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:{pages.TITLE_LINES}],
  lambda x: string_split_regex(x, ' \\| |\\s{{2,}}'))), lambda c: trim(c)), lambda c: c <> '') AS cells FROM d),
w AS ({' UNION ALL '.join(told)}),
s AS (SELECT *, titles * {pages.TITLE} + (mentions + words) * {pages.KEYWORD} + against * ({pages.NEGATIVE}) AS points FROM w),
r AS (SELECT *, row_number() OVER o AS rank, lead(type) OVER o AS second, lead(points) OVER o AS next_points FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY points DESC, type)),
b AS (SELECT *, points > 0 AND titles > 0 AS titled, points > 0 AND words >= {pages.KEYWORDS_NEEDED} AS worded,
  least({pages.MOST}, CASE WHEN points > 0 AND titles > 0 THEN {pages.BY_TITLE[0]} + {pages.BY_TITLE[1]} * words ELSE {pages.BY_KEYWORDS[0]} + {pages.BY_KEYWORDS[1]} * words END) AS grown FROM r WHERE rank = 1),
c AS (SELECT *, CAST(round(CASE WHEN points > 0 AND (points - next_points) / points < {pages.CLOSE} THEN least(grown, {pages.TORN}) ELSE grown END, 4) AS DOUBLE) AS sure FROM b),
e AS (SELECT doc_id, file, page, CASE WHEN titled OR worded THEN type ELSE 'other' END AS type, CASE WHEN titled OR worded THEN sure ELSE CAST({pages.UNREAD} AS DOUBLE) END AS confidence,
  CASE WHEN titled THEN 'title' WHEN worded THEN 'keywords' ELSE 'none' END AS method, CASE WHEN titled OR worded THEN second WHEN points > 0 THEN type END AS runner_up, titled AND sure >= {pages.BY_TITLE[0]} AS named,
  {numbers}, CAST(nullif(regexp_extract(text, '{pages.COUNTER}', 1), '') AS BIGINT) AS at, CAST(nullif(regexp_extract(text, '{pages.COUNTER}', 2), '') AS BIGINT) AS total FROM c JOIN d USING (doc_id))"""


PAGE_READS = f"WITH {_reads_sql()} SELECT * EXCLUDE (file, page) FROM e"

_LABELS = [k.replace(" ", "_") for k in pages.ANNOUNCED]
READ_BUNDLES = f"""
WITH RECURSIVE {_reads_sql()},
p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page) AS n FROM e),
f AS (
  SELECT file, page, n, CAST(0 AS BIGINT) AS segment, 'first_page' AS because, CASE WHEN named THEN type ELSE 'other' END AS o_type, {', '.join(f'{x} AS o_{x}' for x in _LABELS)}, total AS o_total, 1 AS o_pages FROM p WHERE n = 1
  UNION ALL
  SELECT file, page, n, segment + CASE WHEN begins THEN 1 ELSE 0 END, because,
    CASE WHEN begins THEN CASE WHEN named THEN type ELSE 'other' END WHEN o_type = 'other' AND named THEN type ELSE o_type END,
    {', '.join(f'CASE WHEN begins THEN {x} ELSE coalesce(o_{x}, {x}) END' for x in _LABELS)}, CASE WHEN begins THEN total ELSE coalesce(o_total, total) END, CASE WHEN begins THEN 1 ELSE o_pages + 1 END
  FROM (SELECT *, because IN ('counter_restarted', 'type_changed', 'identifier_changed') AS begins FROM (
    SELECT *, CASE WHEN "at" > 1 OR ("at" IS NOT NULL AND o_pages < coalesce(o_total, 0)) THEN 'counter' WHEN "at" IS NOT NULL AND total >= 1 THEN 'counter_restarted' WHEN named AND type <> o_type THEN 'type_changed'
      WHEN NOT agrees THEN 'identifier_changed' WHEN agrees THEN 'same_identifier' WHEN named OR (type <> 'other' AND type = o_type) THEN 'same_type' ELSE 'ambiguous' END AS because
    FROM (SELECT p.*, f.segment, o_type, {', '.join(f'o_{x}' for x in _LABELS)}, o_total, o_pages,
      CASE {' '.join(f'WHEN {x} IS NOT NULL AND o_{x} IS NOT NULL THEN {x} = o_{x}' for x in _LABELS)} END AS agrees FROM f JOIN p ON p.file = f.file AND p.n = f.n + 1)))
)
SELECT file, segment, min(page) AS first_page, max(page) AS last_page, max(because) FILTER (because IN ('first_page', 'counter_restarted', 'type_changed', 'identifier_changed')) AS because,
  count(*) FILTER (because = 'ambiguous') AS n_ambiguous, count(*) FILTER (because = 'ambiguous') > 0 AS uncertain FROM f GROUP BY file, segment
"""

CATALOGUE = {
    "page_reads": (page_reads, PAGE_READS),
    "read_bundles": (read_bundles, READ_BUNDLES),
}
