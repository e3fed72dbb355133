"""Questions understood and answers put together: plans over literal rows and over the driver's conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import advice, assembly, questions, reviews
from ..session import table
from . import advisory, facts, ingest
from .retrieval import _NUMBER, _PAIR, _answers, _sentences, _tokens


def named_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nation named in each user turn, of all nations in order."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("key"), F.upper("text").alias("text"))
    names = table(spark, sf_dir, "nation").select(F.left("n_name", F.lit(3)).alias("name"))
    return questions.first_named(turns, names, "key", "text", "name")


def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as evidence for the user turn before it: the sentence that answers best, if one does."""
    c = table(spark, sf_dir, "conversations")
    said = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text"))
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    rows = said.join(asked, ["conv_id", "turn"]).select(F.concat_ws("/", "conv_id", "turn").alias("query"), "question", F.lit("E1").alias("evidence_id"), F.lit("text").alias("kind"), "text")
    return assembly.chosen_sentences(rows, "query").where("place = 0").groupBy("query").agg(F.count("*").alias("n"), F.min(F.length("sentence")).alias("n_chars"))


def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as an answer to the user turn before it, which is also its evidence; the question's first two words are the phrases."""
    rows = _answers(spark, sf_dir).withColumn("evidence", F.array("question")).withColumn("phrases", F.slice(F.split("question", " "), 1, 2))
    out = assembly.faithfulness(rows, "answer", "question", "evidence")
    covered = F.round(assembly.keyphrase_coverage(F.col("answer"), F.col("phrases")), 6)
    return out.select("key", F.array_join(F.array_sort("unsupported_numbers"), ",").alias("unsupported"), "support_rate", "relevance", "faithful", covered.alias("coverage"))


#: Order lines that a task sorts, whatever the size of the table.
LINES_A_TASK = 1_000_000


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as scored children of orders, customers as queries: the best line of each order, the eight best orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES_A_TASK)
    own = lines.repartition(tasks, "l_orderkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = own.select(F.col("o_custkey").alias("query"), F.col("l_orderkey").alias("parent"), F.concat_ws("-", "l_orderkey", F.format_string("%02d", "l_linenumber")).alias("child"), F.col("l_quantity").alias("score"))
    return assembly.merged_evidence(rows, "query", "child", "parent", "score", tasks=tasks)


def sources_by_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("rank"))
    return assembly.sources_by_use(rows, "query", "source", "rank")


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("value") > 50).cast("double").alias("hit"), (F.col("value") > 80).cast("double").alias("base"), F.round("value", 4).alias("ms"))
    return assembly.evaluation(rows, "base", "hit", "ms")


def client_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of titled sections for each customer; sections without text are left out and count against completeness."""
    c = table(spark, sf_dir, "customer")
    sections = [("客户", F.col("c_name")), ("市场", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))), ("余额", F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("key "), F.col("c_custkey")))), ("说明", F.lit(" "))]
    return assembly.narrative(c, "c_custkey", sections)


def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value of each metric that rules read, as text."""
    return facts.values(spark, sf_dir).groupBy("metric").agg(F.max("value").alias("v")).select("metric", reviews.shown(F.col("metric"), F.col("v")).alias("shown"))


def variant_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.variant_coverage(advisory.counterfactual_diff(spark, sf_dir), "client_id", len(advice.VARIANTS) - 1)


def stress_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.stress_coverage(advice.stress(advisory.books(spark, sf_dir), advisory.BETAS, advisory.SHOCKS), "client_id")


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a client's case goes to a human: a veto, blocks, or more than three warnings."""
    rows = advisory.suitability_gate(spark, sf_dir)
    out = reviews.review_reasons(rows, "client_id", {"veto": F.col("veto"), "blocks": F.col("blocks") > 0, "warnings": F.col("warns") > 3})
    return out.withColumn("reasons", F.concat_ws(",", "reasons"))


def boilerplate_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fx.strip_boilerplate(F.col("text")).alias("stripped"))


def reply_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that wrap a JSON object, made from the event log: every third is broken."""
    body = F.concat(F.lit('Here: {"id": '), F.col("event_id"), F.when(F.col("event_id") % 3 == 0, F.lit(", }")).otherwise("}"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", fx.json_object(body).alias("object"))


QUERIES = {
    "answer_report": answer_report,
    "boilerplate_stripped": boilerplate_stripped, "reply_objects": reply_objects,
    "metric_texts": metric_texts, "variant_coverage": variant_coverage, "stress_coverage": stress_coverage, "review_reasons": review_reasons,
    "named_filters": named_filters, "answer_sentences": answer_sentences, 
    "evidence_merge": evidence_merge, "sources_by_use": sources_by_use, "evaluation_summary": evaluation_summary, "client_reports": client_reports,
}
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _bare(sentence: str) -> str:
    """A sentence without citation numbers, bracketed remarks and list marks."""
    for pattern in assembly.META:
        sentence = f"regexp_replace({sentence}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace({sentence}, '\\s{{2,}}', ' ', 'g'), {_BLANKS})"


_SHORT = "CASE WHEN contains(t, '.') THEN rtrim(rtrim(t, '0'), '.') ELSE t END"
ORACLE_SQL = {
    "answer_report": f"""WITH {_PAIR}, b AS MATERIALIZED (SELECT key, answer, question, trim(answer, {_BLANKS}) AS body FROM a),
        n AS (SELECT key, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(body, '{_NUMBER}'), lambda x: replace(x, ',', ''))),
          lambda t: NOT regexp_full_match(t, '\\d{{1,2}}') AND NOT regexp_full_match(t, '(19|20)\\d{{2}}') AND NOT contains(replace(question, ',', ''), t) AND NOT contains(replace(question, ',', ''), {_SHORT}))) AS missing FROM b),
        s AS MATERIALIZED (SELECT key, question, unnest(list_filter({_sentences('body')}, lambda s: length(s) >= {assembly.CHECKED})) AS s FROM b),
        t AS (SELECT key, list_distinct({_tokens(_bare('s'))}) AS own, list_distinct({_tokens('question')}) AS e FROM s),
        r AS (SELECT key, sum((len(own) = 0 OR (len(e) > 0 AND len(list_intersect(own, e)) >= 0.34::DOUBLE * len(own)))::INT)::DOUBLE / count(*) AS rate FROM t GROUP BY key),
        f AS (SELECT key, list_distinct({_tokens('body')}) AS x, list_distinct({_tokens('question')}) AS y, string_split(question, ' ')[1:2] AS phrases, answer FROM b)
        SELECT key, array_to_string(missing, ',') AS unsupported, round(coalesce(rate, 1), 6) AS support_rate, round(CASE WHEN len(list_intersect(x, y)) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6) AS relevance,
          len(missing) = 0 AND round(coalesce(rate, 1), 6) >= 0.8::DOUBLE AS faithful, round(len(list_filter(phrases, lambda p: p <> '' AND contains(b.answer, p)))::DOUBLE / len(phrases), 6) AS coverage
        FROM b JOIN n USING (key) JOIN f USING (key) LEFT JOIN r USING (key)""",
    "boilerplate_stripped": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), t AS (SELECT doc_id, trim(unnest(ls)) AS t FROM l),
        c AS (SELECT doc_id, t FROM t WHERE t <> '' AND length(t) <= 40 AND (NOT regexp_matches(t, '[。！？；，.!?;,]') OR regexp_matches(t, '^第?\\s*\\d+\\s*(页|/\\s*\\d+)?$')) GROUP BY doc_id, t HAVING count(*) >= 3), r AS (SELECT doc_id, list(t) AS r FROM c GROUP BY doc_id)
        SELECT doc_id, array_to_string(list_filter(ls, lambda x: NOT list_contains(coalesce(r, []), trim(x))), chr(10)) AS stripped FROM l LEFT JOIN r USING (doc_id)""",
    "reply_objects": """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN '{"id": ' || event_id || '}' END AS object FROM events""",
    "answer_sentences": f"""WITH {_PAIR}, s AS (SELECT DISTINCT key, unnest({_sentences('answer')}) AS s, {_tokens('question')} AS q FROM a), t AS (SELECT key, s, len(list_intersect(list_distinct(q), list_distinct({_tokens('s')}))) AS n FROM s WHERE length(s) >= 10)
        SELECT key AS query, 1::BIGINT AS n, length(s)::INT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, length(s), s) AS i FROM t WHERE n > 0) WHERE i = 1""",
    "metric_texts": f"""WITH m AS (SELECT metric, max(value) AS v FROM ({facts.ORACLE_SQL['risk_values']}) GROUP BY metric)
        SELECT metric, CASE WHEN metric IN ({', '.join(f"'{m}'" for m in reviews.AS_PERCENT)}) THEN printf('%.2f%%', v * 100) ELSE printf('%.2f', v) END AS shown FROM m""",
    "variant_coverage": f"SELECT client_id, round(count(DISTINCT variant) / 4, 6) AS coverage FROM ({advisory.ORACLE_SQL['counterfactual_diff']}) GROUP BY client_id",
    "stress_coverage": f"SELECT client_id, least(1, count(*) / 3) AS coverage FROM ({advisory.ORACLE_SQL['stress_test']}) GROUP BY client_id",
    "review_reasons": f"""SELECT client_id, concat_ws(',', CASE WHEN veto THEN 'veto' END, CASE WHEN blocks > 0 THEN 'blocks' END, CASE WHEN warns > 3 THEN 'warnings' END) AS reasons, veto OR blocks > 0 OR warns > 3 AS needed FROM ({advisory.ORACLE_SQL['suitability_gate']})""",
    "named_filters": """WITH n AS (SELECT DISTINCT left(n_name, 3) AS name FROM nation), t AS (SELECT conv_id || '/' || turn AS key, upper(text) AS text FROM conversations WHERE role = 'user')
        SELECT key, min(name) AS name FROM t LEFT JOIN n ON contains(text, name) GROUP BY key""",
    "evidence_merge": """WITH l AS (SELECT o_custkey AS query, o_orderkey AS parent, l_orderkey || '-' || format('{:02d}', l_linenumber) AS child, l_quantity AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        b AS (SELECT *, row_number() OVER (PARTITION BY query, parent ORDER BY score DESC, child) AS i FROM l), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, child) AS n FROM b WHERE i = 1)
        SELECT query, parent, child, score, 'E' || n AS evidence_no FROM t WHERE n <= 8""",
    "sources_by_use": """SELECT query, source, uses, row_number() OVER (PARTITION BY query ORDER BY uses DESC, first, source)::INT AS source_no FROM (SELECT l_orderkey AS query, l_returnflag AS source, count(*) AS uses, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)""",
    "evaluation_summary": """SELECT count(*) AS n_cases, round(avg((value > 50)::INT), 4) AS mean, round(avg((value > 80)::INT), 4) AS baseline, CASE WHEN avg((value > 80)::INT) <> 0 THEN round((avg((value > 50)::INT) - avg((value > 80)::INT)) / avg((value > 80)::INT), 4) END AS lift,
        min(round(value, 4)) AS least_ms, round(avg(round(value, 4)), 4) AS mean_ms, max(round(value, 4)) AS worst_ms FROM events""",
    "client_reports": """SELECT c_custkey, '## 客户' || chr(10) || c_name || CASE WHEN c_custkey % 3 <> 0 THEN chr(10) || chr(10) || '## 市场' || chr(10) || c_mktsegment ELSE '' END || CASE WHEN c_acctbal >= 0 THEN chr(10) || chr(10) || '## 余额' || chr(10) || 'key ' || c_custkey ELSE '' END AS report,
        round((1 + (c_custkey % 3 <> 0)::INT + (c_acctbal >= 0)::INT) / 4, 4) AS completeness FROM customer""",
}
