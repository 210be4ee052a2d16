"""Verdict logs made of the given tables, in both forms: a DataFrame and SQL. They exercise the arithmetic; what they say
about the tables means nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

#: One verdict per labelled document: long texts fire, good ones should; some replies are unreadable.
DOCS_SQL = """docv AS (
  SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, l.quality, l.toxic,
    CASE WHEN d.n_chars % 17 = 0 THEN NULL ELSE d.n_chars > 1500 END AS fired, l.quality = 1 AS should_fire,
    CASE d.lang WHEN 'en' THEN 's' WHEN 'fr' THEN 'm' WHEN 'de' THEN 'l' ELSE 'xl' END AS band,
    CASE WHEN l.quality = 0 THEN d.lang END AS kind
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

#: Many verdicts per order: the lines of an order are repeats of a case, three orders in a row are a triple.
LINES_SQL = """linev AS (
  SELECT l_orderkey, l_linenumber, l_orderkey % 3 = 0 AS should_fire, l_orderkey // 3 AS triple, l_returnflag AS procedure, l_shipdate,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity > 25 END AS fired,
    CASE WHEN l_orderkey % 5 = 0 THEN []::VARCHAR[] WHEN l_orderkey % 2 = 0 THEN ['A','N'] ELSE ['R'] END AS routes,
    CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_discount > 0.05 END AS covers
  FROM lineitem)"""

#: Forecasts on a grid of eleven values against returned lines.
FORECAST_SQL = """fc AS (SELECT round(abs(l_discount) * 10, 2) AS f, (CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS o FROM lineitem)"""

#: Three raters per labelled document; the long form of their labels.
RATERS_SQL = """raters AS (
  SELECT l.doc_id AS unit, x.rater, CASE x.rater WHEN 0 THEN l.quality WHEN 1 THEN l.toxic ELSE (d.n_chars > 1500)::INT END AS label,
    (l.doc_id * 3 + x.rater) % 7 = 0 AS missing
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id, (VALUES (0), (1), (2)) x(rater))"""


def doc_verdicts(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id")
    band = F.when(F.col("lang") == "en", "s").when(F.col("lang") == "fr", "m").when(F.col("lang") == "de", "l").otherwise("xl")
    return rows.select(
        "doc_id", "source", "lang", "text", "n_chars", "quality", "toxic", F.col("doc_id").alias("case"), F.lit(0).alias("repeat"),
        F.when(F.col("n_chars") % 17 != 0, F.col("n_chars") > 1500).alias("fired"), (F.col("quality") == 1).alias("should_fire"),
        band.alias("band"), F.when(F.col("quality") == 0, F.col("lang")).alias("kind"),
    )


def line_verdicts(t: Tables) -> DataFrame:
    key = F.col("l_orderkey")
    routes = F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 2 == 0, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(F.lit("R")))
    return t.lineitem.select(
        key.alias("case"), F.col("l_linenumber").alias("repeat"), (key % 3 == 0).alias("should_fire"), F.floor(key / 3).alias("triple"), F.col("l_returnflag").alias("procedure"), "l_shipdate",
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") > 25).alias("fired"), routes.alias("routes"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_discount") > 0.05).alias("covers"),
    )


def forecasts(t: Tables) -> DataFrame:
    return t.lineitem.select(F.round(F.abs("l_discount") * 10, 2).alias("f"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("o"))


def ratings(t: Tables, gaps: bool = False) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    three = F.array(*[F.struct(F.lit(k).alias("rater"), v.alias("label")) for k, v in enumerate((F.col("quality"), F.col("toxic"), (F.col("n_chars") > 1500).cast("int")))])
    long = rows.select(F.col("doc_id").alias("unit"), F.explode(three).alias("x")).select("unit", "x.rater", "x.label")
    return long.withColumn("label", F.when((F.col("unit") * 3 + F.col("rater")) % 7 != 0, F.col("label"))) if gaps else long
