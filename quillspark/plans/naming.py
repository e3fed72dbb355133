"""Names: mentions in whole texts, names that hold one another, facts of companies named in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names
from ..session import spread_table, table
from . import facts


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to look for: nations, brands, and the first two words of each benchmark text."""
    words = F.split("text", " ")
    heads = table(spark, sf_dir, "benchmark").where(F.size(words) >= 2).select(F.concat_ws(" ", words[0], words[1]).alias("name"))
    return heads.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))).unionByName(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and turns of conversations."""
    docs = spread_table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("key"), "text")
    return docs.unionByName(table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("c"), "conv_id", "turn").alias("key"), "text"))


def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.mentions(texts(spark, sf_dir), listed(spark, sf_dir), "key")


def first_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first in order of the names that each user turn holds."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("key"), "text")
    return names.first_mention(names.mentions(turns, listed(spark, sf_dir), "key"), turns, "key")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("company"))


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names asked for without their zeros, or customers' with an ending, against all names of both."""
    known = _suppliers(spark, sf_dir).select("company").union(table(spark, sf_dir, "nation").select("n_name"))
    short = _suppliers(spark, sf_dir).select(F.substring("company", -6, 6).alias("x"))
    nations = table(spark, sf_dir, "nation")
    asked = short.union(nations.select(F.concat("n_name", F.lit(" Group")))).union(nations.select(F.left("n_name", F.lit(4))))
    return names.alike_names(asked, known)


def fact_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts asked for by a supplier's whole name, or, for the years 1995 on, by its last eight characters."""
    named = _named(spark, sf_dir)
    wanted = named.where("metric in ('revenue', 'equity')").select(F.when(F.col("year") >= 1995, F.substring("company", -8, 8)).otherwise(F.col("company")).alias("company"), "metric", "year").distinct()
    return names.fallback(wanted, named, ["metric", "year"]).select("company", "metric", "year", "matched", "value", "exact")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.long(spark, sf_dir).withColumnRenamed("company", "id")
    return rows.join(_suppliers(spark, sf_dir), F.col("id") == F.col("s_suppkey")).select("company", "metric", "year", "value")


def known_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of user turns as mentions: which of them a benchmark name accounts for."""
    found = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.split("text", " ")[0].alias("m"))
    return names.known_flags(found, listed(spark, sf_dir))


QUERIES = {"text_mentions": text_mentions, "first_named": first_named, "fuzzy_names": fuzzy_names, "fact_fallback": fact_fallback, "known_mentions": known_mentions}

_LISTED = """n AS MATERIALIZED (SELECT DISTINCT name FROM (SELECT string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS name FROM benchmark WHERE len(string_split(text, ' ')) >= 2
    UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_brand FROM part) WHERE name <> '')"""
_NEAR = "a.x <> k.x AND (contains(a.x, k.x) OR contains(k.x, a.x))"
ORACLE_SQL = {
    "text_mentions": f"""WITH {_LISTED}, t AS (SELECT 'd/' || doc_id AS key, text FROM documents UNION ALL SELECT 'c/' || conv_id || '/' || turn, text FROM conversations),
      h AS (SELECT key, name, text, unnest(range(0, length(text) - length(name) + 1)) AS "at" FROM t JOIN n ON contains(text, name))
      SELECT key, name, "at" FROM h WHERE substring(text, "at" + 1, length(name)) = name""",
    "first_named": f"""WITH {_LISTED}, t AS (SELECT conv_id || '/' || turn AS key, text FROM conversations WHERE role = 'user') SELECT key, min(name) AS name FROM t LEFT JOIN n ON contains(text, name) GROUP BY key""",
    "fuzzy_names": f"""WITH k AS (SELECT s_name AS x FROM supplier UNION SELECT n_name FROM nation), a AS (SELECT right(s_name, 6) AS x FROM supplier UNION SELECT n_name || ' Group' FROM nation UNION SELECT left(n_name, 4) FROM nation)
      SELECT a.x AS asked, k.x AS known FROM a JOIN k ON {_NEAR}""",
    "fact_fallback": f"""WITH f AS MATERIALIZED (SELECT s_name AS company, metric, year, value FROM ({facts.ORACLE_SQL['facts_unpivot']}) l JOIN supplier ON s_suppkey = l.company),
      w AS MATERIALIZED (SELECT DISTINCT CASE WHEN year >= 1995 THEN right(company, 8) ELSE company END AS company, metric, year FROM f WHERE metric IN ('revenue', 'equity')),
      e AS (SELECT w.company, metric, year, f.company AS matched, value, TRUE AS exact FROM w JOIN f USING (company, metric, year)),
      m AS (SELECT w.company, w.metric, w.year, min({{'matched': f.company, 'value': f.value}}) AS b FROM w JOIN f ON f.metric = w.metric AND f.year = w.year AND (contains(f.company, w.company) OR contains(w.company, f.company))
        WHERE (w.company, w.metric, w.year) NOT IN (SELECT (company, metric, year) FROM e) GROUP BY ALL)
      SELECT * FROM e UNION ALL SELECT company, metric, year, b.matched, b.value, FALSE FROM m""",
    "known_mentions": f"""WITH {_LISTED}, m AS (SELECT DISTINCT string_split(text, ' ')[1] AS mention FROM conversations WHERE role = 'user' AND coalesce(string_split(text, ' ')[1], '') <> '')
      SELECT mention, bool_or(contains(name, mention) OR contains(mention, name) OR (length(mention) >= 4 AND left(mention, 4) = left(name, 4))) AS is_known FROM m, n GROUP BY mention""",
}
