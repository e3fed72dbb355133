"""Long metric facts, look-ups, growth, ratios, risk rules and the evidence gate over the relational tables.

Queries are DataFrame plans of operators.facts; the SQL is written on its own, for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import facts as ops
from ..session import scratch_path, table

#: A supplier and year stand for a company's report; every fifth supplier is a bank. Four digits hold metrics exactly.
METRICS = tuple(ops.METRICS.values())


def _metrics(price: Column, discount: Column, tax: Column, quantity: Column, flag: Column, status: Column, number: Column) -> dict[str, Column]:
    revenue = F.sum(price * (1 - discount))
    return {
        "revenue": revenue, "gross_profit": F.sum(price * (0.25 - tax * 2)), "net_profit": revenue - F.sum(price * 0.9), "total_assets": F.sum(price),
        "total_liabilities": F.sum(price * (0.4 + tax * 5)), "equity": F.sum(price * (0.6 - tax * 5)), "receivables": F.sum(F.when(flag == "N", price).otherwise(0.0)) * 0.4,
        "operating_cash": F.sum(F.when(status == "F", price * 0.08).otherwise(price * 0.02)), "current_assets": F.sum(quantity) * 900, "current_liabilities": F.sum(quantity * discount) * 18000,
        "period_expense": F.sum(price * discount), "rnd": F.sum(F.when(number == 1, price).otherwise(0.0)) * 0.05, "guarantee": F.sum(price * tax * 2),
        "litigation": F.sum(F.when(flag == "R", price).otherwise(0.0)) * 0.03, "goodwill": F.sum(price * quantity) / 500,
    }


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each company and year, a column for each metric: one scan, one shuffle of partial sums."""
    lines = table(spark, sf_dir, "lineitem")
    sums = _metrics(*(F.col(f"l_{c}") for c in ("extendedprice", "discount", "tax", "quantity", "returnflag", "linestatus", "linenumber")))
    base = lines.groupBy(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("year")).agg(*(ops.steady(c, 4).alias(n) for n, c in sums.items()))
    company, year = F.col("company"), F.col("year")
    bank = lambda c: F.when(company % 5 == 0, c)
    told = {
        "pledge_pct": (20 + company % 45).cast("double"), "top5_pct": (35 + (company * 7 + year) % 30).cast("double"), "npl_pct": bank(1 + (company + year * 3) % 10 / 10),
        "provision_pct": bank((120 + (company * 3 + year) % 90).cast("double")), "capital_pct": bank((10 + company % 4).cast("double")), "nim_pct": bank(2 - (company * year) % 7 / 10),
    }
    return base.select("*", *(ops.steady(c, 4).alias(n) for n, c in told.items()))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unpivoted(wide(spark, sf_dir), list(METRICS))


def values(spark: SparkSession, sf_dir: str, w: DataFrame | None = None) -> DataFrame:
    return ops.risk_values(wide(spark, sf_dir) if w is None else w)


def fact_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir).groupBy("metric").agg(F.count_distinct("company").alias("companies"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wide(), written once for plans that read it many times."""
    rows, path = wide(spark, sf_dir), scratch_path(spark, "wide")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def findings(w: DataFrame) -> DataFrame:
    """Rule hits as findings: high ones cite the year's returned and accepted lines, others the open ones; growth cites nothing, goodwill names no metric."""
    hits = ops.rule_hits(ops.risk_values(w))
    name = lambda flag: F.concat(F.lit("E"), F.col("company"), F.lit("-"), F.col("year"), F.lit(f"-{flag}"))
    cited = F.when(F.col("rule_id") == "R-GROW-01", F.array().cast("array<string>")).when(F.col("level") == "high", F.array(name("R"), name("A"))).otherwise(F.array(name("N")))
    metrics = F.when(F.col("rule_id") == "R-GW-01", F.array().cast("array<string>")).otherwise(F.array("metric"))
    prior = w.select("company", (F.col("year") + 1).alias("year"), F.lit(True).alias("_prior"))
    return hits.join(prior, list(ops.KEY), "left").select(*ops.KEY, F.col("rule_id").alias("finding_id"), cited.alias("evidence_ids"), metrics.alias("metrics"), F.col("_prior").isNotNull().alias("checked"))


def gaps(spark: SparkSession, sf_dir: str, w: DataFrame) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("c"), F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("f")).distinct()
    evidence = lines.select(F.concat(F.lit("E"), "c", F.lit("-"), "y", F.lit("-"), "f").alias("evidence_id"), F.concat(F.lit("S"), "c").alias("source_id"))
    sources = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey").alias("source_id"))
    return ops.evidence_gaps(w.select(*ops.KEY), findings(w), evidence, sources, values(spark, sf_dir, w))


def reflection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = written(spark, sf_dir)
    report = ops.risk_report(values(spark, sf_dir, w)).select(*ops.KEY, "overall")
    counted = gaps(spark, sf_dir, w).groupBy(*ops.KEY).agg(F.count("*").alias("n"))
    rows = w.select(*ops.KEY).join(counted, list(ops.KEY), "left").join(report, list(ops.KEY), "left").withColumn("revision_round", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    n = F.coalesce("n", F.lit(0))
    return rows.select(*ops.KEY, "revision_round", n.alias("n_gaps"), ops.verdict(n, F.col("revision_round"), 2, F.col("overall")).alias("verdict"))


def evidence_gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(spark, sf_dir, written(spark, sf_dir)).groupBy("gap", "target").agg(F.count("*").alias("n"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's facts as a report (doc_id, company, source_id, raw): a markdown table, a row for each metric and a column for each year."""
    rows = long(spark, sf_dir).groupBy("company", "metric").agg(F.sort_array(F.collect_list(F.struct("year", "value"))).alias("e"))
    own = rows.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("metric", "e"))).alias("m"))
    own = own.withColumn("m", F.transform("m", lambda x: F.struct(x["metric"].alias("metric"), F.map_from_entries(x["e"]).alias("v"))))
    # Bounded by the metrics and the years of one company.
    own = fx.settled(own).withColumn("years", F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: F.map_keys(x["v"]))))))
    cells = lambda x: F.transform("years", lambda y: F.coalesce(F.format_string("%,.4f", F.try_element_at(x["v"], y)), F.lit("—")))
    line = lambda cs: F.concat(F.lit("| "), F.array_join(cs, " | "), F.lit(" |"))
    head = line(F.concat(F.array(F.lit("指标")), F.transform("years", lambda y: F.concat(y.cast("string"), F.lit("年"))), F.array(F.lit("单位"))))
    rule = line(F.transform(F.sequence(F.lit(0), F.size("years") + 1), lambda _: F.lit("---")))
    body = F.array_join(F.transform("m", lambda x: line(F.concat(F.array(x["metric"]), cells(x), F.array(F.lit("元"))))), "\n")
    raw = F.concat_ws("\n", F.lit("# 年度报告"), F.lit("## 主要指标"), head, rule, body, F.lit("以上数据未经审计。"))
    return own.select(F.concat(F.lit("R-"), "company").alias("doc_id"), F.concat(F.lit("S"), "company").alias("company"), F.concat(F.lit("F-"), "company").alias("source_id"), raw.alias("raw"))


def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts read back from the reports' tables."""
    return ops.table_facts(filings(spark, sf_dir)).select("doc_id", "company", "source_id", "section_title", "metric", "year", "period", "period_suffix", "unit", "value")


QUERIES = {
    "table_facts": table_facts,
    "facts_unpivot": long,
    "fact_lookup_latest": lambda spark, sf_dir: ops.latest_facts(long(spark, sf_dir)),
    "fact_catalog": fact_catalog,
    "yoy_growth": lambda spark, sf_dir: ops.growth(long(spark, sf_dir)),
    "ratios": lambda spark, sf_dir: ops.ratios(wide(spark, sf_dir)),
    "risk_values": values,
    "risk_rules": lambda spark, sf_dir: ops.rule_hits(values(spark, sf_dir)),
    "risk_overall": lambda spark, sf_dir: ops.risk_report(values(spark, sf_dir)),
    "outlier_rules": lambda spark, sf_dir: ops.outliers(values(spark, sf_dir)),
    "evidence_gaps": evidence_gap_counts,
    "reflection_gate": reflection_gate,
    
}

# The SQL, for DuckDB.

_WIDE = """
sums AS (
  SELECT l_suppkey AS company, CAST(year(l_shipdate) AS INT) AS year, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * (CAST(0.25 AS DOUBLE) - l_tax * 2)) AS gross_profit,
    sum(l_extendedprice * (1 - l_discount)) - sum(l_extendedprice * CAST(0.9 AS DOUBLE)) AS net_profit, sum(l_extendedprice) AS total_assets, sum(l_extendedprice * (CAST(0.4 AS DOUBLE) + l_tax * 5)) AS total_liabilities,
    sum(l_extendedprice * (CAST(0.6 AS DOUBLE) - l_tax * 5)) AS equity, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'N') * CAST(0.4 AS DOUBLE) AS receivables,
    sum(l_extendedprice * CASE l_linestatus WHEN 'F' THEN CAST(0.08 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END) AS operating_cash, sum(l_quantity) * 900 AS current_assets, sum(l_quantity * l_discount) * 18000 AS current_liabilities,
    sum(l_extendedprice * l_discount) AS period_expense, sum(l_extendedprice) FILTER (WHERE l_linenumber = 1) * CAST(0.05 AS DOUBLE) AS rnd, sum(l_extendedprice * l_tax * 2) AS guarantee,
    sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R') * CAST(0.03 AS DOUBLE) AS litigation, sum(l_extendedprice * l_quantity) / 500 AS goodwill
  FROM lineitem GROUP BY ALL
),
facts AS (
  SELECT company, year, metric, round(round(value, 8), 4) AS value FROM (
    SELECT company, year, revenue, gross_profit, net_profit, total_assets, total_liabilities, equity, coalesce(receivables, 0) AS receivables, operating_cash, current_assets, current_liabilities, period_expense,
      coalesce(rnd, 0) AS rnd, guarantee, coalesce(litigation, 0) AS litigation, goodwill, CAST(20 + company % 45 AS DOUBLE) AS pledge_pct, CAST(35 + (company * 7 + year) % 30 AS DOUBLE) AS top5_pct,
      CASE company % 5 WHEN 0 THEN CAST(1 + ((company + year * 3) % 10) / 10 AS DOUBLE) END AS npl_pct, CASE company % 5 WHEN 0 THEN CAST(120 + (company * 3 + year) % 90 AS DOUBLE) END AS provision_pct,
      CASE company % 5 WHEN 0 THEN CAST(10 + company % 4 AS DOUBLE) END AS capital_pct, CASE company % 5 WHEN 0 THEN CAST(2 - ((company * year) % 7) / 10 AS DOUBLE) END AS nim_pct FROM sums)
  UNPIVOT (value FOR metric IN (METRICS))
)""".replace("METRICS", ", ".join(METRICS))
_RATIO_PAIRS = " UNION ALL ".join(f"SELECT '{r}' AS ratio, '{n}' AS num, '{d}' AS den" for r, n, d in ops.RATIOS)
_TOLD = " UNION ALL ".join(f"SELECT company, year, '{r}' AS metric, value / 100 AS value FROM facts WHERE metric = '{p}'" for r, p in (*ops.DISCLOSED, ("pledge_ratio", "pledge_pct"), ("top5_customer_ratio", "top5_pct"), ("net_interest_margin", "nim_pct")))
_RULE_ROWS = ", ".join(f"('{r}', '{lv}', '{m}', {'NULL' if lo is None else lo}, {lo_in}, {'NULL' if hi is None else hi}, {hi_in}, '{e}')" for r, lv, m, lo, lo_in, hi, hi_in, e in ops.RISK_RULES)
_RISK = _WIDE + f""",
pairs AS ({_RATIO_PAIRS}),
quotients AS (SELECT n.company, n.year, p.ratio AS metric, CASE WHEN d.value <> 0 THEN n.value / d.value END AS value FROM pairs p JOIN facts n ON n.metric = p.num JOIN facts d ON d.metric = p.den AND d.company = n.company AND d.year = n.year),
grown AS (SELECT c.company, c.year, c.metric, c.value AS now, p.value AS before, CASE WHEN p.value <> 0 THEN round(round((c.value - p.value) / abs(p.value), 8), 4) END AS rate FROM facts c JOIN facts p ON (p.company, p.metric, p.year + 1) = (c.company, c.metric, c.year)),
kinds AS (SELECT company, year, CASE WHEN bool_or(metric IN ('npl_pct', 'provision_pct')) THEN 'financial' ELSE 'other' END AS entity FROM facts GROUP BY ALL),
vals AS (
  SELECT k.company, k.year, k.entity, v.metric, v.value FROM kinds k JOIN (
    SELECT company, year, metric, round(round(value, 8), 4) AS value FROM quotients WHERE metric IN ('debt_to_asset', 'net_margin', 'gross_margin', 'current_ratio', 'cash_conversion')
    UNION ALL SELECT company, year, CASE metric WHEN 'revenue' THEN 'revenue_growth' ELSE 'receivable_growth' END, rate FROM grown WHERE metric IN ('revenue', 'receivables')
    UNION ALL SELECT a.company, a.year, 'ar_gap', round(round(a.rate - r.rate, 8), 4) FROM grown a JOIN grown r ON (a.company, a.year) = (r.company, r.year) AND a.metric = 'receivables' AND r.metric = 'revenue'
    UNION ALL SELECT s.company, s.year, s.metric || '_ratio', CASE WHEN e.value <> 0 THEN round(round(s.value / e.value, 8), 4) END FROM facts s JOIN facts e ON (e.company, e.year) = (s.company, s.year) AND e.metric = 'equity' WHERE s.metric IN ('guarantee', 'litigation', 'goodwill')
    UNION ALL SELECT company, year, metric, round(round(value, 8), 4) FROM ({_TOLD})
    UNION ALL SELECT company, year, CASE metric WHEN 'npl_pct' THEN 'npl_delta' ELSE 'nim_delta' END, round(round((now - before) / 100, 10), 6) FROM grown WHERE metric IN ('npl_pct', 'nim_pct')
  ) v ON (v.company, v.year) = (k.company, k.year) WHERE v.value IS NOT NULL
),
rules(rule_id, level, metric, lo, lo_in, hi, hi_in, entity) AS (VALUES {_RULE_ROWS}),
hits AS (
  SELECT company, year, rule_id, level, v.metric, value FROM vals v JOIN rules r USING (metric, entity)
  WHERE CASE WHEN lo IS NULL THEN TRUE WHEN lo_in THEN value >= lo ELSE value > lo END AND CASE WHEN hi IS NULL THEN TRUE WHEN hi_in THEN value <= hi ELSE value < hi END
),
report AS (
  SELECT company, year, entity, count(DISTINCT r.rule_id) AS evaluated, count(DISTINCT h.rule_id) AS n_hits, count(DISTINCT h.rule_id) FILTER (WHERE h.level IN ('medium', 'high')) AS n_shown,
    CASE WHEN bool_or(h.level = 'high') THEN 'high' WHEN bool_or(h.level = 'medium') THEN 'medium' ELSE 'info' END AS overall
  FROM vals v JOIN rules r USING (metric, entity) LEFT JOIN (SELECT company, year, rule_id, level FROM hits) h USING (company, year) GROUP BY ALL
),
outside AS (SELECT company, year, metric, value FROM vals WHERE (metric = 'cash_conversion' AND value < 0.5) OR (metric = 'debt_to_asset' AND value > 0.65) OR (metric = 'revenue_growth' AND value < 0) OR (metric = 'gross_margin' AND value < 0.15) OR (metric = 'current_ratio' AND value < 1.2)),
evidence AS (SELECT DISTINCT 'E' || l_suppkey || '-' || year(l_shipdate) || '-' || l_returnflag AS evidence_id, l_suppkey AS owner FROM lineitem),
found AS (
  SELECT h.*, EXISTS (SELECT 1 FROM sums p WHERE p.company = h.company AND p.year = h.year - 1) AS checked, rule_id <> 'R-GW-01' AS measured,
    CASE WHEN rule_id = 'R-GROW-01' THEN [] WHEN level = 'high' THEN ['R', 'A'] ELSE ['N'] END AS flags FROM hits h
),
cites AS (SELECT f.company, f.year, f.rule_id, e.owner FROM (SELECT company, year, rule_id, unnest(flags) AS flag FROM found) f JOIN evidence e ON e.evidence_id = 'E' || f.company || '-' || f.year || '-' || f.flag),
gaps AS (
  SELECT s.company, s.year, 'GAP-NO-FINDING' AS gap, '-' AS target FROM sums s WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE (h.company, h.year) = (s.company, s.year))
  UNION ALL SELECT company, year, 'GAP-EVIDENCE', rule_id FROM found f WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE (c.company, c.year, c.rule_id) = (f.company, f.year, f.rule_id))
  UNION ALL SELECT company, year, 'GAP-TRACE', rule_id FROM cites WHERE owner NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
  UNION ALL SELECT company, year, 'GAP-METRIC', rule_id FROM found WHERE NOT measured
  UNION ALL SELECT company, year, 'GAP-XCHECK', metric FROM (SELECT company, year, metric FROM outside UNION ALL SELECT company, year, 'cash_conversion' FROM vals WHERE metric = 'ar_gap' AND value > 0.1) o
    WHERE EXISTS (SELECT 1 FROM hits h WHERE (h.company, h.year) = (o.company, o.year)) AND NOT EXISTS (SELECT 1 FROM found f WHERE (f.company, f.year, f.metric) = (o.company, o.year, o.metric) AND f.checked AND f.measured)
)"""

ORACLE_SQL = {
    "table_facts": f"""WITH {_WIDE} SELECT 'R-' || company AS doc_id, 'S' || company AS company, 'F-' || company AS source_id, '主要指标' AS section_title, metric, year, year || '年' AS period, '' AS period_suffix, '元' AS unit, value FROM facts""",
    "facts_unpivot": f"WITH {_WIDE} SELECT company, year, metric, value FROM facts",
    "fact_lookup_latest": f"WITH {_WIDE} SELECT company, metric, max(year) AS year, arg_max(value, year) AS value FROM facts GROUP BY ALL",
    "fact_catalog": f"WITH {_WIDE} SELECT metric, count(DISTINCT company) AS companies, min(year) AS first_year, max(year) AS last_year FROM facts GROUP BY ALL",
    "yoy_growth": f"WITH {_RISK} SELECT company, year, metric, rate AS growth FROM grown",
    "ratios": f"WITH {_RISK} SELECT company, year, metric AS ratio, round(round(value, 8), 4) AS value FROM (SELECT * FROM quotients UNION ALL SELECT * FROM ({_TOLD}) WHERE metric IN ('npl_ratio', 'provision_coverage', 'capital_adequacy'))",
    "risk_values": f"WITH {_RISK} SELECT * FROM vals",
    "risk_rules": f"WITH {_RISK} SELECT * FROM hits",
    "risk_overall": f"WITH {_RISK} SELECT * FROM report",
    "outlier_rules": f"WITH {_RISK} SELECT * FROM outside",
    "evidence_gaps": f"WITH {_RISK} SELECT gap, target, count(*) AS n FROM gaps GROUP BY ALL",
    "reflection_gate": f"""WITH {_RISK} SELECT s.company, s.year, r.revision_round, coalesce(g.n, 0) AS n_gaps,
        CASE WHEN coalesce(g.n, 0) > 0 AND r.revision_round < 2 THEN 'revise' WHEN coalesce(g.n, 0) > 0 OR p.overall = 'high' THEN 'escalate' ELSE 'pass' END AS verdict
        FROM sums s CROSS JOIN (VALUES (0), (1), (2)) r(revision_round) LEFT JOIN (SELECT company, year, count(*) AS n FROM gaps GROUP BY ALL) g USING (company, year) LEFT JOIN report p USING (company, year)""",
}
