"""Scalar functions over columns of the tables: values are printed in many ways and read back.

The oracles never print: they compute what must come out from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.functions import values as V
from dossier.sources.tables import table

#: Every way to put a day, a month (as number, short or long name) and a year apart, two that begin with the year, and one that is no date to the parser.
PRINTED = [f"{day}{apart}{month}{apart}yyyy" for apart in (" / ", ".", "_", ", ") for month in ("MMMM", "MM", "MMM") for day in ("dd", "d")]
PRINTED += ["yyyy/MM/dd", "yyyy MM dd", "d 'day of' MMMM yyyy"]


def _ways(key: str, *ways):
    found = ways[-1]
    for k, way in list(enumerate(ways))[-2::-1]:
        found = F.when(F.col(key) % len(ways) == k, way).otherwise(found)
    return found


def dates_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates, printed in all ways inside a sentence; the last way is not read."""
    printed = _ways("o_orderkey", *(F.date_format("o_orderdate", f) for f in PRINTED))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ordered on "), printed, F.lit(" by post")).alias("v"))
    return rows.select("o_orderkey", V.date_of(F.col("v")).alias("day"))


def amounts_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals, printed in Indian grouping with currency words, minus signs and brackets."""
    shown = V.indian(F.col("o_totalprice"))
    printed = _ways("o_orderkey", F.concat(F.lit("Rs. "), shown, F.lit(" only")), F.concat(F.lit("-"), shown), F.concat(F.lit("("), shown, F.lit(")")), F.concat(F.lit("₹"), shown), F.concat(F.lit("INR "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), printed.alias("v"))
    return rows.select("o_orderkey", V.amount(F.col("v")).alias("amount"), V.is_amount(F.col("shown")).alias("grouped"), F.length("shown").cast("bigint").alias("width"))


def persons_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names with titles, qualifications, registrations and brackets around them."""
    name = F.regexp_replace("c_name", "#", " ")
    printed = _ways("c_custkey", F.concat(F.lit("Dr. "), name, F.lit(", MS (Surgery)")), F.concat(F.lit("Smt "), name, F.lit(" (wife)")), F.concat(F.lit("Prof "), name, F.lit(" · Reg. AB-1")), F.concat(name, F.lit(" Registration No: 77")), name)
    rows = table(spark, sf_dir, "customer").select("c_custkey", printed.alias("v"))
    return rows.select("c_custkey", T.person_key(F.col("v")).alias("key"))


def patients_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages and sexes printed together."""
    years, sex = (F.col("c_custkey") % 140).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "Male").otherwise("F")
    printed = _ways("c_custkey", F.concat(years, F.lit(" yrs / "), sex), F.concat(sex, F.lit(", "), years, F.lit("Y")), F.concat(years, F.lit("/"), sex))
    rows = table(spark, sf_dir, "customer").select("c_custkey", printed.alias("v"))
    return rows.select("c_custkey", V.age(F.col("v")).cast("bigint").alias("age"), T.gender(F.col("v")).alias("sex"))


def codes_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis codes made of part numbers, in and out of brackets, and the diagnosis without them."""
    code = F.concat(F.char(F.lit(65) + F.col("p_partkey") % 26), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), (F.col("p_partkey") % 10).cast("string"))).otherwise(""))
    printed = _ways("p_partkey", F.concat("p_name", F.lit(" ("), code, F.lit(")")), F.concat("p_name", F.lit(" (ICD-10: "), code, F.lit(")")), F.concat("p_name", F.lit(" ICD-10 "), code))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", printed.alias("v"))
    return rows.select("p_partkey", T.icd10(F.col("v")).alias("code"), (T.without_icd10(F.col("v")) == F.col("p_name")).alias("bare"))


def labels_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of printed two-column lines; where the left value is missing the right column is not borrowed."""
    from dossier.operators.extraction import Spec, fields

    left = F.when(F.col("c_custkey") % 3 == 0, F.lit("Name:   ")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Name:   "), "c_name", F.lit("   "))).otherwise(F.concat(F.lit("Name - "), "c_name", F.lit("   ")))
    line = F.concat(left, F.lit("Segment: "), "c_mktsegment")
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("line"), line.alias("text"), F.lit("text").alias("source"), F.lit(None).cast("double").alias("ocr_confidence"))
    return fields(spark, lines, [Spec("name", "id", ("name",)), Spec("segment", "text", ("segment",))]).select("doc", "key", "normal")


_MONEY = "CAST(o_totalprice AS DECIMAL(18,2))"
_PART = "chr(CAST(65 + p_partkey % 26 AS INTEGER)) || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN '.' || CAST(p_partkey % 10 AS VARCHAR) ELSE '' END"
CATALOGUE = {
    "dates_read_back": (dates_read_back, f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(PRINTED)} <> {len(PRINTED) - 1} THEN CAST(o_orderdate AS DATE) END AS day FROM orders"),
    "amounts_read_back": (
        amounts_read_back,
        f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2) THEN -{_MONEY} ELSE {_MONEY} END AS amount, true AS grouped,
        length(CAST({_MONEY} AS VARCHAR)) + CASE WHEN {_MONEY} < 1000 THEN 0 ELSE CAST(ceil((length(CAST(trunc({_MONEY}) AS BIGINT)::VARCHAR) - 3) / 2.0) AS BIGINT) END AS width FROM orders""",
    ),
    "persons_read_back": (persons_read_back, "SELECT c_custkey, replace(lower(c_name), '#', ' ') AS key FROM customer"),
    "patients_read_back": (patients_read_back, "SELECT c_custkey, CASE WHEN c_custkey % 140 BETWEEN 1 AND 129 THEN CAST(c_custkey % 140 AS BIGINT) END AS age, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM customer"),
    "codes_read_back": (codes_read_back, f"SELECT p_partkey, CASE WHEN p_partkey % 26 <> 20 THEN {_PART} END AS code, (p_partkey % 3 <> 0 OR p_partkey % 26 <> 20) AS bare FROM part"),
    "labels_read_back": (
        labels_read_back,
        """SELECT c_custkey AS doc, 'name' AS key, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS normal FROM customer WHERE c_custkey % 3 <> 0
        UNION ALL SELECT c_custkey, 'segment', lower(c_mktsegment) FROM customer""",
    ),
}
