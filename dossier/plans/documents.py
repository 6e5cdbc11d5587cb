"""Queries over document texts: duplicate content, near duplicates, fingerprints, headings, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.text import squash
from dossier.operators.ranking import duplicate_groups
from dossier.operators.similar import near_pairs
from dossier.sources.tables import table

_SQUASHED = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and content_hash of documents that have content."""
    body = squash(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").filter(F.length(body) > 0).select("doc_id", F.sha2(body, 256).alias("content_hash"))


def dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two or more documents whose squashed text is the same."""
    return duplicate_groups(content(spark, sf_dir), "content_hash", "doc_id").select("content_hash", F.col("n").alias("n_docs"), F.col("first_member").alias("original_id"))


DUP_DOCUMENTS = f"""
SELECT sha256(body) AS content_hash, count(*) AS n_docs, min(doc_id) AS original_id
FROM (SELECT doc_id, {_SQUASHED} AS body FROM documents) WHERE length(body) > 0 GROUP BY 1 HAVING count(*) >= 2
"""


def dup_original_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's duplicate state: unique, the original of copies, or a copy of the earliest."""
    rows = content(spark, sf_dir)
    sizes = rows.groupBy("content_hash").agg(F.min("doc_id").alias("original_id"), F.count("*").alias("copies"))
    state = F.when(F.col("copies") == 1, "unique").when(F.col("doc_id") == F.col("original_id"), "has_duplicate").otherwise("duplicate")
    return rows.join(sizes, "content_hash").select("doc_id", state.alias("duplicate_state"), F.when(state == "duplicate", F.col("original_id")).alias("duplicate_of"))


DUP_ORIGINAL_COPY = f"""
WITH c AS (SELECT doc_id, sha256({_SQUASHED}) AS h FROM documents WHERE length({_SQUASHED}) > 0),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS o, count(*) OVER (PARTITION BY h) AS n FROM c)
SELECT doc_id, CASE WHEN n = 1 THEN 'unique' WHEN doc_id = o THEN 'has_duplicate' ELSE 'duplicate' END AS duplicate_state,
  CASE WHEN n > 1 AND doc_id <> o THEN o END AS duplicate_of FROM g
"""


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents inside a source and language (a claim's pages), identical texts compared once."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").withColumn("body", squash(F.col("text")))
    group = F.concat_ws("/", "source", "lang")
    once = docs.groupBy(group.alias("group"), "body").agg(F.min("doc_id").alias("page"))
    return near_pairs(once).select("group", F.col("a").alias("original_page"), F.col("b").alias("copy_page"), F.round("similarity", 6).alias("similarity"))


#: Type -> (title words, keywords, negative words): our own vocabulary for the invented texts.
TYPES = {
    "english": (("the", "and"), ("of", "with", "that"), ("der", "les")),
    "german": (("der", "die"), ("und", "nicht", "mit"), ("the", "les")),
    "french": (("les", "des"), ("dans", "que", "pour"), ("the", "und")),
    "spanish": (("los", "las"), ("que", "para", "una"), ("the", "und")),
    "licence": (("licensed", "copyright"), ("license", "rights", "apache"), ()),
}
TITLE, KEYWORD, NEGATIVE, HEADING_LINES = 10.0, 1.5, -6.0, 12


def _has(body: Column, word: str) -> Column:
    # the cheap containment test guards the pattern
    return F.contains(body, F.lit(word)) & body.rlike(rf"(^|[^\p{{L}}\p{{N}}]){word}($|[^\p{{L}}\p{{N}}])")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, doc_type, score: title words in the first lines, keywords and negatives anywhere."""
    body = F.lower(F.coalesce("text", F.lit("")))
    docs = docs.select("doc_id", body.alias("body"), F.array_join(F.slice(F.split(body, "\n"), 1, HEADING_LINES), "\n").alias("heading"))
    columns = []
    for name, (titles, keys, negatives) in TYPES.items():
        total = F.lit(0.0)
        for words, at, points in ((titles, "heading", TITLE), (keys, "body", KEYWORD), (negatives, "body", NEGATIVE)):
            for word in words:
                total = total + F.when(_has(F.col(at), word), points).otherwise(0.0)
        columns.append(F.struct(F.lit(name).alias("doc_type"), total.alias("score")))
    return docs.select("doc_id", F.explode(F.array(*columns)).alias("s")).select("doc_id", "s.doc_type", "s.score")


def _scores_sql() -> str:
    parts = []
    for name, (titles, keys, negatives) in TYPES.items():
        terms = [f"CASE WHEN regexp_matches({at}, '(^|[^\\p{{L}}\\p{{N}}]){w}($|[^\\p{{L}}\\p{{N}}])') THEN {points} ELSE 0.0 END" for words, at, points in ((titles, "heading", TITLE), (keys, "body", KEYWORD), (negatives, "body", NEGATIVE)) for w in words]
        parts.append(f"SELECT doc_id, '{name}' AS doc_type, CAST({' + '.join(terms)} AS DOUBLE) AS score FROM t")
    head = f"SELECT doc_id, lower(coalesce(text, '')) AS body, array_to_string(string_split(lower(coalesce(text, '')), chr(10))[1:{HEADING_LINES}], chr(10)) AS heading FROM documents"
    return f"t AS ({head}), s AS ({' UNION ALL '.join(parts)})"


def classify_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def classify_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best type with confidence, runner-up and margin; a margin under a quarter caps the confidence, no points mean other."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "doc_type")
    ranked = classify_scores(spark, sf_dir).withColumn("rank", F.row_number().over(order)).withColumn("next_type", F.lead("doc_type").over(order)).withColumn("next_score", F.lead("score").over(order))
    margin = F.when(F.col("score") > 0, (F.col("score") - F.col("next_score")) / F.col("score")).otherwise(0.0)
    confidence = F.least(F.lit(0.97), F.lit(0.34) + F.lit(0.02) * F.col("score"))
    capped = F.when(margin < 0.25, F.least(confidence, F.lit(0.62))).otherwise(confidence)
    best = F.when(F.col("score") > 0, F.col("doc_type")).otherwise("other")
    return ranked.filter("rank = 1").select(
        "doc_id", best.alias("doc_type"), F.round(F.when(F.col("score") > 0, capped).otherwise(0.2), 4).alias("confidence"),
        F.col("next_type").alias("runner_up"), F.round(margin, 4).alias("margin"),
    )


CLASSIFY_BEST = f"""
WITH {_scores_sql()}, r AS (
  SELECT *, row_number() OVER w AS rank, lead(doc_type) OVER w AS nt, lead(score) OVER w AS ns FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, doc_type)
), m AS (SELECT *, CASE WHEN score > 0 THEN (score - ns) / score ELSE 0.0 END AS margin, least(0.97, 0.34 + 0.02 * score) AS c FROM r WHERE rank = 1)
SELECT doc_id, CASE WHEN score > 0 THEN doc_type ELSE 'other' END AS doc_type,
  CAST(round(CASE WHEN score <= 0 THEN 0.2 WHEN margin < 0.25 THEN least(c, 0.62) ELSE c END, 4) AS DOUBLE) AS confidence, nt AS runner_up, CAST(round(margin, 4) AS DOUBLE) AS margin FROM m
"""


def classify_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by type and whether the type is clear of the next one."""
    best = classify_best(spark, sf_dir)
    return best.groupBy("doc_type", (F.col("margin") >= 0.25).alias("clear")).agg(F.count("*").alias("n"))


def labels_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier against the given language, as counts."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return classify_best(spark, sf_dir).join(docs, "doc_id").groupBy("lang", "doc_type").agg(F.count("*").alias("n"))


def heading_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the first twelve lines (blank lines count as lines), cut at bars and gaps of two spaces."""
    lines = F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, HEADING_LINES)
    cells = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r" \| |\s{2,}"))), lambda c: F.trim(c) != "")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.size(cells).cast("bigint").alias("n_cells"), F.coalesce(F.get(cells, F.lit(0)), F.lit("")).alias("first_cell"))


HEADING_CELLS = f"""
WITH c AS (
  SELECT doc_id, list_filter(flatten(list_transform(string_split(coalesce(text, ''), chr(10))[1:{HEADING_LINES}], lambda x: string_split_regex(x, ' \\| |\\s{{2,}}'))), lambda y: trim(y) <> '') AS cells FROM documents
)
SELECT doc_id, CAST(len(cells) AS BIGINT) AS n_cells, coalesce(cells[1], '') AS first_cell FROM c
"""


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled values of raw pages: title, first heading and page number, by label priority."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    found = pages.select("page_id", F.explode(F.array(*(
        F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in (
            ("heading", F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)),
            ("language", F.regexp_extract("html", r'<html lang="([a-z]+)"', 1)),
            ("number", F.regexp_extract("url", r"page=([0-9]+)", 1)),
            ("title", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)),
        )
    ))).alias("f"))
    return found.filter("f.value <> ''").select("page_id", "f.field", "f.value")


LABEL_VALUES = r"""
WITH f AS (
  SELECT page_id, 'heading' AS field, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS value FROM pages
  UNION ALL SELECT page_id, 'language', regexp_extract(html, '<html lang="([a-z]+)"', 1) FROM pages
  UNION ALL SELECT page_id, 'number', regexp_extract(url, 'page=([0-9]+)', 1) FROM pages
  UNION ALL SELECT page_id, 'title', regexp_extract(html, '(?s)<title>(.*?)</title>', 1) FROM pages
) SELECT * FROM f WHERE value <> ''
"""


def squash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(squash(F.col("text")), 256).alias("squashed_hash"), F.length(squash(F.col("text"))).cast("bigint").alias("squashed_length"))


SQUASH_TEXT = f"SELECT doc_id, sha256({_SQUASHED}) AS squashed_hash, CAST(length({_SQUASHED}) AS BIGINT) AS squashed_length FROM documents"


def implant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items (billed lines) none of whose long words stand in any document's text (the operative text)."""
    text = table(spark, sf_dir, "documents", "text")
    words = lambda c: F.filter(F.split(squash(F.col(c)), " "), lambda w: F.length(w) >= 6)
    known = text.select(F.explode(words("text")).alias("token")).distinct()
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    asked = items.select("item_id", F.explode(F.array_distinct(words("text"))).alias("token"))
    found = asked.join(known.withColumn("known", F.lit(1)), "token", "left")
    return found.groupBy("item_id").agg(F.count("*").alias("n_tokens"), F.count("known").alias("n_found"), F.min(F.when(F.col("known").isNull(), F.col("token"))).alias("first_missing"))


IMPLANT_TOKENS = """
WITH k AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM documents),
a AS (SELECT DISTINCT item_id, unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM benchmark)
SELECT item_id, count(*) AS n_tokens, count(k.token) AS n_found, min(CASE WHEN k.token IS NULL THEN a.token END) AS first_missing
FROM a LEFT JOIN k ON a.token = k.token WHERE length(a.token) >= 6 GROUP BY item_id
"""

CATALOGUE = {
    "dup_documents": (dup_documents, DUP_DOCUMENTS),
    "dup_original_copy": (dup_original_copy, DUP_ORIGINAL_COPY),
    "near_dup_pairs": (near_dup_pairs, None),
    "classify_scores": (classify_scores, f"WITH {_scores_sql()} SELECT * FROM s"),
    "classify_best": (classify_best, CLASSIFY_BEST),
    "classify_margin": (classify_margin, f"SELECT doc_type, margin >= 0.25 AS clear, count(*) AS n FROM ({CLASSIFY_BEST}) GROUP BY ALL"),
    "labels_confusion": (labels_confusion, f"SELECT lang, b.doc_type, count(*) AS n FROM ({CLASSIFY_BEST}) b JOIN documents USING (doc_id) GROUP BY ALL"),
    "heading_cells": (heading_cells, HEADING_CELLS),
    "label_values": (label_values, LABEL_VALUES),
    "squash_text": (squash_text, SQUASH_TEXT),
    "implant_tokens": (implant_tokens, IMPLANT_TOKENS),
}
