"""Clients, products, screening, portfolios, suitability, stress, versions: plans over the relational tables.

Queries are DataFrame plans of operators.advice and operators.versions; the SQL is written on its own, for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advice, versions
from ..session import dealt, scratch_path, table
from ..sources import stores
from .shared import plain

CLIENTS = """
clients AS (
  SELECT c_custkey AS client_id, CAST(20 + c_custkey % 60 AS INT) AS age, CAST(1 + c_custkey % 5 AS INT) AS risk_capacity,
    CAST(c_custkey % 10 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS horizon, CAST(c_custkey % 4 AS DOUBLE) / 10 AS liquidity_floor,
    CAST(2 + c_custkey % 3 AS DOUBLE) / 10 AS single_cap, CAST(5 + c_custkey % 3 AS DOUBLE) / 10 AS class_cap, CAST(3 + c_custkey % 3 AS DOUBLE) / 10 AS issuer_cap,
    CAST(10000 AS DOUBLE) + abs(c_acctbal) * 20 AS amount, CASE WHEN c_custkey % 7 = 0 THEN 'USD' ELSE 'CNY' END AS currency,
    CASE WHEN c_custkey % 6 = 0 THEN 'equity' WHEN c_custkey % 11 = 0 THEN 'derivative' ELSE 'none' END AS prohibited_class,
    c_custkey % 4 = 0 AS qualified, c_custkey % 3 = 0 AS experienced, c_custkey % 2 = 0 AS dual_recorded,
    CAST(c_custkey % 5 AS DOUBLE) / 500 AS fee_budget, CAST(abs(c_acctbal) AS DOUBLE) AS tax_quota
  FROM {customer}
)"""
_CLASS = "CASE p_size % 5 WHEN 0 THEN 'derivative' WHEN 1 THEN 'cash_fund' WHEN 2 THEN 'bond' WHEN 3 THEN 'mixed' ELSE 'equity' END"
#: One product for each issuer (brand) and class: a catalogue whose size does not depend on the scale.
PRODUCTS = f"""
products AS (
  SELECT p_brand || '/' || {_CLASS} AS product_id, {_CLASS} AS asset_class, p_brand AS issuer,
    CASE {_CLASS} WHEN 'cash_fund' THEN 1 WHEN 'bond' THEN 2 WHEN 'mixed' THEN 3 WHEN 'equity' THEN 4 ELSE 5 END AS risk_level,
    CAST(min(p_size) AS DOUBLE) / 5 AS horizon, CAST(min(p_size) * 1000 AS DOUBLE) AS min_investment,
    round(CAST(0.02 AS DOUBLE) + avg(p_size) / 1000, 6) AS expected_return, round(avg(p_retailprice) / 10000, 6) AS volatility,
    CAST(min(p_size) % 10 AS DOUBLE) / 10 AS liquidity, CAST(max(p_size) % 7 AS DOUBLE) / 500 AS fee,
    CASE WHEN min(p_size) % 7 = 0 THEN 'USD' ELSE 'CNY' END AS currency,
    {_CLASS} = 'derivative' AS is_derivative, {_CLASS} = 'derivative' AS needs_experience, min(p_size) % 9 = 0 AS qualified_only, max(p_size) % 2 = 0 AS tax_advantaged
  FROM {{part}} GROUP BY p_brand, {_CLASS}
)"""
#: Reason codes, each judged by itself; comparisons of ratios allow 1e-9.
_REASONS = (
    ("C-RISK", "p.risk_level > c.risk_capacity"), ("C-HORIZON", "p.horizon > c.horizon + CAST(1e-9 AS DOUBLE)"), ("C-PROHIBITED-CLASS", "p.asset_class = c.prohibited_class"),
    ("C-DERIVATIVE-BAN", "p.is_derivative AND c.prohibited_class = 'derivative'"), ("C-CURRENCY", "p.currency <> c.currency"),
    ("C-EXPERIENCE", "p.needs_experience AND NOT c.experienced"), ("C-ENTRY", "p.min_investment > c.amount + CAST(1e-9 AS DOUBLE)"), ("C-QUALIFIED", "p.qualified_only AND NOT c.qualified"),
)
_CODES = " || ".join(f"CASE WHEN {cond} THEN '{code};' ELSE '' END" for code, cond in _REASONS)
SCREENED = CLIENTS + "," + PRODUCTS + f""",
screened AS (SELECT c.client_id, p.product_id, {_CODES} AS reasons FROM clients c JOIN products p ON TRUE)"""
#: What clients hold: order lines by issuer and class, 5 % of the client's total in cash.
HOLDINGS = CLIENTS + "," + PRODUCTS + f""",
held AS (
  SELECT o.o_custkey AS client_id, p.p_brand || '/' || {_CLASS} AS product_id, sum(l.l_extendedprice) AS value
  FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey JOIN {{part}} p ON p.p_partkey = l.l_partkey GROUP BY 1, 2
),
holdings AS (
  SELECT h.client_id, h.product_id, round(CAST(0.95 AS DOUBLE) * h.value / t.total, 9) AS weight
  FROM held h JOIN (SELECT client_id, sum(value) AS total FROM held GROUP BY client_id) t ON t.client_id = h.client_id
),
cash AS (SELECT client_id, round(1 - sum(weight), 9) AS weight FROM holdings GROUP BY client_id)"""
METRICS = HOLDINGS + """,
metrics AS (
  SELECT h.client_id, count(*) AS holding_count, round(sum(h.weight * p.expected_return) + max(k.weight) * CAST(0.015 AS DOUBLE), 6) AS expected_return,
    round(sqrt(sum(h.weight * p.volatility * h.weight * p.volatility)), 6) AS volatility, round(sum(h.weight * p.fee), 6) AS fee,
    round(sum(h.weight * p.liquidity) + max(k.weight), 6) AS liquidity, round(max(h.weight), 6) AS max_single,
    round(sum(h.weight * p.risk_level) + max(k.weight), 6) AS weighted_risk, round(max(k.weight), 6) AS cash_weight
  FROM holdings h JOIN products p ON p.product_id = h.product_id JOIN cash k ON k.client_id = h.client_id GROUP BY h.client_id
)"""
_EPS = "CAST(1e-9 AS DOUBLE)"
#: Rules about one holding at a time: one pass over holdings judges them all.
_HOLDING_RULES = (
    ("S-RISK-MATCH", "block", "risk_level > risk_capacity"),
    ("S-HORIZON", "block", f"horizon > client_horizon + {_EPS}"),
    ("S-CONC-SINGLE", "block", f"weight > single_cap + {_EPS}"),
    ("S-ENTRY", "block", f"min_investment > amount + {_EPS} OR weight * amount + {_EPS} < min_investment"),
    ("S-ELDERLY", "block", f"age >= 65 AND (risk_level >= 4 OR weight > least(single_cap, CAST(0.2 AS DOUBLE)) + {_EPS})"),
    ("S-EXPERIENCE", "block", "needs_experience AND NOT experienced"),
    ("S-CURRENCY", "block", "currency <> client_currency"),
    ("S-QUALIFIED", "block", "qualified_only AND NOT qualified"),
    ("S-PROHIBITED", "block", "asset_class = prohibited_class"),
    ("S-DERIVATIVE-BAN", "block", "is_derivative AND prohibited_class = 'derivative'"),
    ("S-COOLING", "warn", "horizon >= 1 AND liquidity < CAST(0.3 AS DOUBLE)"),
    ("S-CONCENTRATION-WARNING", "warn", f"weight > single_cap * CAST(0.8 AS DOUBLE) + {_EPS}"),
)
_RULE_VALUES = ", ".join(f"('{r}', '{s}')" for r, s, _ in _HOLDING_RULES)
_RULE_CASE = "CASE r.rule_id " + " ".join(f"WHEN '{r}' THEN {c}" for r, _, c in _HOLDING_RULES) + " END"
VIOLATIONS = METRICS + f""",
joined AS (SELECT h.client_id, h.weight, p.*, c.age, c.risk_capacity, c.horizon AS client_horizon, c.single_cap, c.class_cap, c.issuer_cap, c.liquidity_floor, c.amount, c.currency AS client_currency,
    c.prohibited_class, c.qualified, c.experienced, c.dual_recorded, c.fee_budget, c.tax_quota
  FROM holdings h JOIN products p ON p.product_id = h.product_id JOIN clients c ON c.client_id = h.client_id),
violations AS (
  SELECT j.client_id, r.rule_id, r.severity, j.product_id AS subject FROM joined j JOIN (SELECT * FROM (VALUES {_RULE_VALUES}) AS v(rule_id, severity)) r ON {_RULE_CASE}
  UNION ALL SELECT client_id, 'S-CONC-CLASS', 'block', asset_class FROM joined GROUP BY client_id, asset_class HAVING round(sum(weight), 8) > max(class_cap) + {_EPS}
  UNION ALL SELECT client_id, 'S-CONCENTRATION-ISSUER', 'block', issuer FROM joined GROUP BY client_id, issuer HAVING round(sum(weight), 8) > max(issuer_cap) + {_EPS}
  UNION ALL SELECT h.client_id, 'S-WEIGHT', 'block', '' FROM holdings h JOIN cash k ON k.client_id = h.client_id GROUP BY h.client_id HAVING abs(sum(h.weight) + max(k.weight) - 1) > CAST(1e-6 AS DOUBLE) OR max(k.weight) < -{_EPS} OR min(h.weight) < -{_EPS}
  UNION ALL SELECT m.client_id, 'S-LIQUIDITY', 'block', '' FROM metrics m JOIN clients c ON c.client_id = m.client_id WHERE m.liquidity + {_EPS} < c.liquidity_floor
  UNION ALL SELECT client_id, 'S-DUAL-RECORD', 'warn', '' FROM joined GROUP BY client_id HAVING max(age) >= 65 OR max(risk_level) >= 4 OR bool_or(is_derivative)
  UNION ALL SELECT m.client_id, 'S-FEE-DISCLOSE', 'warn', '' FROM metrics m JOIN clients c ON c.client_id = m.client_id WHERE m.fee > c.fee_budget + {_EPS}
  UNION ALL SELECT client_id, 'S-TAX', 'warn', '' FROM joined WHERE tax_advantaged GROUP BY client_id HAVING round(sum(weight * amount), 4) > max(tax_quota) + CAST(1e-6 AS DOUBLE)
  UNION ALL SELECT client_id, 'S-CASH-RESERVE', 'warn', '' FROM cash WHERE weight < CAST(0.03 AS DOUBLE) - {_EPS}
  UNION ALL SELECT client_id, 'S-DIVERSIFICATION', 'warn', '' FROM metrics WHERE holding_count <= 2
)"""
GATE = VIOLATIONS + f""",
feasible AS (SELECT c.client_id, count(p.product_id) AS n FROM clients c LEFT JOIN products p
    ON NOT (p.risk_level > c.risk_capacity OR p.horizon > c.horizon + {_EPS} OR p.asset_class = c.prohibited_class OR (p.is_derivative AND c.prohibited_class = 'derivative')
      OR p.currency <> c.currency OR (p.needs_experience AND NOT c.experienced) OR p.min_investment > c.amount + {_EPS} OR (p.qualified_only AND NOT c.qualified)) GROUP BY c.client_id),
gate AS (
  SELECT m.client_id, coalesce(v.blocks, 0) AS blocks, coalesce(v.warns, 0) AS warns, f.n = 0 AS veto
  FROM metrics m JOIN feasible f ON f.client_id = m.client_id
  LEFT JOIN (SELECT client_id, count(*) FILTER (WHERE severity = 'block') AS blocks, count(*) FILTER (WHERE severity = 'warn') AS warns FROM violations GROUP BY client_id) v ON v.client_id = m.client_id
)"""
TIGHTEN = VIOLATIONS + """,
tightened AS (
  SELECT v.client_id,
    min(CASE WHEN v.rule_id = 'S-RISK-MATCH' THEN greatest(1, p.risk_level - 1) WHEN v.rule_id = 'S-ELDERLY' THEN 3 END) AS risk_cap,
    min(CASE WHEN v.rule_id = 'S-HORIZON' THEN greatest(CAST(0.1 AS DOUBLE), p.horizon * CAST(0.5 AS DOUBLE)) END) AS horizon_cap,
    min(CASE WHEN v.rule_id = 'S-CONC-SINGLE' THEN round(greatest(CAST(0.01 AS DOUBLE), c.single_cap * CAST(0.8 AS DOUBLE)), 9) WHEN v.rule_id = 'S-ELDERLY' THEN CAST(0.2 AS DOUBLE) END) AS single_cap,
    min(CASE WHEN v.rule_id = 'S-CONC-CLASS' THEN round(greatest(CAST(0.01 AS DOUBLE), c.class_cap * CAST(0.8 AS DOUBLE)), 9) END) AS class_cap,
    min(CASE WHEN v.rule_id = 'S-CONCENTRATION-ISSUER' THEN round(greatest(CAST(0.01 AS DOUBLE), c.issuer_cap * CAST(0.8 AS DOUBLE)), 9) END) AS issuer_cap,
    max(CASE WHEN v.rule_id = 'S-LIQUIDITY' THEN round(c.liquidity_floor + CAST(0.05 AS DOUBLE), 9) END) AS liquidity_floor,
    count(DISTINCT CASE WHEN v.rule_id IN ('S-ENTRY', 'S-EXPERIENCE', 'S-CURRENCY', 'S-QUALIFIED', 'S-PROHIBITED', 'S-DERIVATIVE-BAN') THEN v.subject END) AS n_excluded
  FROM violations v JOIN clients c ON c.client_id = v.client_id LEFT JOIN products p ON p.product_id = v.subject
  WHERE v.severity = 'block' GROUP BY v.client_id
)"""
_VARIANTS = "(VALUES ('base', 0, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)), ('risk_down', 1, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)), ('horizon_half', 0, CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)), ('cap_down', 0, CAST(1 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(0 AS DOUBLE)), ('liquidity_up', 0, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0.1 AS DOUBLE))) AS v(variant, risk_step, horizon_factor, cap_factor, liquidity_step)"
VARIANTS = HOLDINGS + f""",
varied AS (
  SELECT c.client_id, v.variant, greatest(1, c.risk_capacity - v.risk_step) AS risk_capacity, greatest(CAST(0.25 AS DOUBLE), c.horizon * v.horizon_factor) AS horizon,
    greatest(CAST(0.01 AS DOUBLE), c.single_cap * v.cap_factor) AS single_cap, least(CAST(1 AS DOUBLE), c.liquidity_floor + v.liquidity_step) AS liquidity_floor
  FROM clients c JOIN (SELECT * FROM {_VARIANTS}) v ON TRUE),
allowed AS (SELECT v.client_id, v.variant, h.product_id, round(least(h.weight, v.single_cap), 9) AS weight
  FROM varied v JOIN holdings h ON h.client_id = v.client_id JOIN products p ON p.product_id = h.product_id WHERE p.risk_level <= v.risk_capacity AND p.horizon <= v.horizon + {_EPS}),
with_cash AS (SELECT * FROM allowed UNION ALL
  SELECT v.client_id, v.variant, 'cash', round(1 - coalesce(a.invested, 0), 9) FROM varied v JOIN (SELECT DISTINCT client_id FROM holdings) h USING (client_id)
    LEFT JOIN (SELECT client_id, variant, sum(weight) AS invested FROM allowed GROUP BY ALL) a USING (client_id, variant))"""
VERSIONS = """
versions AS (
  SELECT user_id AS client_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_id, event_type AS status, value
  FROM {events})"""

SHARED = {
    "screen_products": f"WITH {SCREENED} SELECT client_id, product_id, reasons, reasons = '' AS included FROM screened",
    "screen_summary": f"WITH {SCREENED} SELECT client_id, count(*) AS n_products, count(*) FILTER (WHERE reasons = '') AS n_included, round(CAST(count(*) FILTER (WHERE reasons = '') AS DOUBLE) / count(*), 6) AS included_ratio FROM screened GROUP BY client_id",
    "score_to_band": """WITH bands AS (SELECT * FROM (VALUES (0, 19, 1, 'conservative'), (20, 39, 2, 'steady'), (40, 59, 3, 'balanced'), (60, 79, 4, 'growth'), (80, 100, 5, 'bold')) AS v(lo, hi, level, label)),
      scored AS (SELECT c_custkey AS client_id, CAST(floor((c_acctbal + 1000) / 11000 * 100) AS INT) AS score, CAST(1 + c_custkey % 5 AS INT) AS archived FROM {customer})
      SELECT s.client_id, s.score, b.level, b.label, least(s.archived, b.level) AS effective_level FROM scored s LEFT JOIN bands b ON s.score BETWEEN b.lo AND b.hi""",
    "class_issuer_concentration": f"""WITH {HOLDINGS} SELECT h.client_id, p.asset_class, p.issuer, round(sum(h.weight), 4) AS weight FROM holdings h JOIN products p ON p.product_id = h.product_id
      GROUP BY GROUPING SETS ((h.client_id, p.asset_class), (h.client_id, p.issuer))""",
    "portfolio_metrics": f"WITH {METRICS} SELECT * FROM metrics",
    "suitability_rules": f"WITH {VIOLATIONS} SELECT client_id, rule_id, severity, subject FROM violations",
    "suitability_gate": f"""WITH {GATE} SELECT client_id, blocks, warns, veto, CASE WHEN veto THEN 'reject' WHEN blocks > 0 THEN 'reoptimize' ELSE 'pass' END AS directive,
      CASE WHEN veto OR blocks > 0 THEN 'reject' ELSE 'pass' END AS last_round_directive FROM gate""",
    "tighten": f"WITH {TIGHTEN} SELECT * FROM tightened",
    "stress_test": f"""WITH {HOLDINGS},
      betas AS (SELECT * FROM (VALUES ('cash_fund', 'rate', CAST(-0.2 AS DOUBLE)), ('bond', 'rate', CAST(-4.0 AS DOUBLE)), ('bond', 'credit_spread', CAST(-3.0 AS DOUBLE)), ('mixed', 'rate', CAST(-2.0 AS DOUBLE)), ('mixed', 'equity', CAST(0.5 AS DOUBLE)), ('mixed', 'credit_spread', CAST(-1.0 AS DOUBLE)), ('equity', 'equity', CAST(1.0 AS DOUBLE)), ('derivative', 'equity', CAST(1.5 AS DOUBLE)), ('derivative', 'rate', CAST(-1.0 AS DOUBLE))) AS v(asset_class, factor, beta)),
      shocks AS (SELECT * FROM (VALUES ('rates_up', 'rate', CAST(0.02 AS DOUBLE)), ('rates_up', 'equity', CAST(-0.05 AS DOUBLE)), ('equity_crash', 'equity', CAST(-0.3 AS DOUBLE)), ('equity_crash', 'credit_spread', CAST(0.01 AS DOUBLE)), ('credit', 'credit_spread', CAST(0.03 AS DOUBLE)), ('credit', 'equity', CAST(-0.1 AS DOUBLE))) AS v(scenario, factor, shock)),
      impact AS (SELECT h.client_id, s.scenario, round(sum(h.weight * b.beta * s.shock), 6) AS impact FROM holdings h JOIN products p ON p.product_id = h.product_id JOIN betas b ON b.asset_class = p.asset_class JOIN shocks s ON s.factor = b.factor GROUP BY h.client_id, s.scenario)
      SELECT client_id, scenario, impact, round(greatest(CAST(0 AS DOUBLE), -impact) * CAST(1.15 AS DOUBLE), 8) AS drawdown, impact = min(impact) OVER (PARTITION BY client_id) AS worst FROM impact""",
    "counterfactual_coverage": f"WITH {VARIANTS} SELECT client_id, variant, count(*) AS n_products, round(sum(weight), 6) AS invested FROM allowed GROUP BY client_id, variant",
    "version_chain": f"WITH {VERSIONS} SELECT client_id, version, lag(version) OVER (PARTITION BY client_id ORDER BY version) AS parent_version, status, value, version + 1 AS next_version FROM versions",
    "version_diff": f"""WITH {VERSIONS} SELECT coalesce(a.client_id, b.client_id) AS client_id, a.version AS version, b.version AS previous, a.status AS status, b.status AS previous_status, round(a.value - b.value, 6) AS delta
      FROM versions a JOIN versions b ON b.client_id = a.client_id AND b.version = a.version - 1 WHERE abs(a.value - b.value) > {_EPS} OR a.status <> b.status""",
    "trace_summary": "SELECT event_type AS step, count(*) AS n, round(sum(value), 4) AS total_ms, round(avg(value), 4) AS mean_ms, max(value) AS worst_ms, count(DISTINCT user_id) AS runs FROM {events} GROUP BY event_type",
}
#: A variant's weights count plus, the base's minus, once for each other variant.
SHARED["counterfactual_diff"] = f"""WITH {VARIANTS.replace("held AS (", "held AS MATERIALIZED (").replace("allowed AS (", "allowed AS MATERIALIZED (").replace("with_cash AS (", "with_cash AS MATERIALIZED (")},
      signed AS (SELECT client_id, variant, product_id, weight FROM with_cash WHERE variant <> 'base'
        UNION ALL SELECT b.client_id, n.variant, b.product_id, -b.weight FROM with_cash b JOIN (SELECT variant FROM {_VARIANTS} WHERE variant <> 'base') n ON TRUE WHERE b.variant = 'base')
      SELECT client_id, variant, product_id, round(sum(weight), 9) AS delta FROM signed GROUP BY client_id, variant, product_id HAVING abs(round(sum(weight), 9)) > {_EPS}"""
_MADE = VARIANTS.replace("held AS (", "held AS MATERIALIZED (").replace("allowed AS (", "allowed AS MATERIALIZED (").replace("with_cash AS (", "with_cash AS MATERIALIZED (")
SHARED["snapshot_diff"] = f"""WITH {_MADE},
      own AS MATERIALIZED (SELECT v.* FROM varied v JOIN (SELECT DISTINCT client_id FROM holdings) h USING (client_id)),
      sums AS MATERIALIZED (SELECT o.client_id, o.variant, count(a.product_id) AS n, coalesce(sum(a.weight), 0) AS invested, coalesce(sum(a.weight * p.expected_return), 0) AS er, coalesce(sum(a.weight * p.fee), 0) AS fee, coalesce(max(a.weight), 0) AS top
        FROM own o LEFT JOIN allowed a USING (client_id, variant) LEFT JOIN products p USING (product_id) GROUP BY ALL),
      facts AS (SELECT client_id, variant, 'weights' AS part, product_id AS name, weight AS value FROM with_cash
        UNION ALL SELECT client_id, variant, 'metrics', unnest(['n_products', 'invested', 'expected_return', 'fee', 'max_single']),
          unnest([CAST(n AS DOUBLE), round(invested, 6), round(er + round(1 - invested, 9) * CAST(0.015 AS DOUBLE), 6), round(fee, 6), round(top, 6)]) FROM sums
        UNION ALL SELECT client_id, variant, 'constraints', unnest(['risk_capacity', 'horizon', 'single_cap', 'liquidity_floor']), unnest([CAST(risk_capacity AS DOUBLE), horizon, single_cap, liquidity_floor]) FROM own
        UNION ALL SELECT client_id, variant, 'rules', 'S-CASH-RESERVE', 1 FROM sums WHERE round(1 - invested, 9) < CAST(0.03 AS DOUBLE) - {_EPS}
        UNION ALL SELECT client_id, variant, 'rules', 'S-DIVERSIFICATION', 1 FROM sums WHERE n <= 2),
      numbered AS (SELECT f.*, list_position(['base', 'risk_down', 'horizon_half', 'cap_down', 'liquidity_up'], variant) AS version FROM facts f),
      sides AS (SELECT client_id, version, part, name, NULL AS before, value AS after FROM numbered WHERE version > 1 UNION ALL SELECT client_id, version + 1, part, name, value, NULL FROM numbered WHERE version < 5),
      both_ AS (SELECT client_id, version, part, name, max(before) AS before, max(after) AS after FROM sides GROUP BY ALL)
      SELECT client_id, CAST(version AS INT) AS version, CAST(version - 1 AS INT) AS previous, part, name, round(before, 9) AS before, round(after, 9) AS after FROM both_ WHERE before IS NULL OR after IS NULL OR abs(before - after) > {_EPS}"""
ORACLE_SQL = {name: plain(sql) for name, sql in SHARED.items()}


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, balance = F.col("c_custkey"), F.abs("c_acctbal")
    tenth = lambda least, steps: (least + key % steps).cast("double") / 10
    return table(spark, sf_dir, "customer").select(
        key.alias("client_id"), (20 + key % 60).cast("int").alias("age"), (1 + key % 5).cast("int").alias("risk_capacity"), ((key % 10).cast("double") + 0.5).alias("horizon"),
        tenth(F.lit(0), 4).alias("liquidity_floor"), tenth(F.lit(2), 3).alias("single_cap"), tenth(F.lit(5), 3).alias("class_cap"), tenth(F.lit(3), 3).alias("issuer_cap"),
        (10000.0 + balance * 20).alias("amount"), F.when(key % 7 == 0, "USD").otherwise("CNY").alias("currency"),
        F.when(key % 6 == 0, "equity").when(key % 11 == 0, "derivative").otherwise("none").alias("prohibited_class"), (key % 4 == 0).alias("qualified"), (key % 3 == 0).alias("experienced"),
        (key % 2 == 0).alias("dual_recorded"), ((key % 5).cast("double") / 500).alias("fee_budget"), balance.cast("double").alias("tax_quota"),
    )


def _class_of(size):
    return F.element_at(F.array(*map(F.lit, ("derivative", *advice.CLASSES[:4]))), (size % 5 + 1).cast("int"))


def _product_of():
    return F.concat_ws("/", "p_brand", _class_of(F.col("p_size")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product for each brand and class: 125 rows at most, whatever the scale."""
    low, high = F.min("p_size"), F.max("p_size")
    kind = F.col("asset_class")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("issuer"), _class_of(F.col("p_size")).alias("asset_class")).agg(
        low.alias("low"), high.alias("high"), F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price")
    )
    low, high = F.col("low"), F.col("high")
    return rows.select(
        F.concat_ws("/", "issuer", kind).alias("product_id"), "asset_class", "issuer", F.array_position(F.array(*map(F.lit, advice.CLASSES)), kind).cast("int").alias("risk_level"),
        (low.cast("double") / 5).alias("horizon"), (low * 1000).cast("double").alias("min_investment"), advice.steady(0.02 + F.col("size") / 1000, 6).alias("expected_return"),
        advice.steady(F.col("price") / 10000, 6).alias("volatility"), ((low % 10).cast("double") / 10).alias("liquidity"), ((high % 7).cast("double") / 500).alias("fee"),
        F.when(low % 7 == 0, "USD").otherwise("CNY").alias("currency"), (kind == "derivative").alias("is_derivative"), (kind == "derivative").alias("needs_experience"),
        (low % 9 == 0).alias("qualified_only"), (high % 2 == 0).alias("tax_advantaged"),
    )


def held_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (client_id, product_id, value), dealt by client: order lines by issuer and class, one scan of each table, the large joins once."""
    lines, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    parts = part.select("p_partkey", _product_of().alias("product_id"))
    held = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    # Sums by client and product hardly fold the lines: they are dealt by client once, and the sums, the portfolios and their join stay where they are.
    own = held.select(F.col("o_custkey").alias("client_id"), "product_id", "l_extendedprice").repartition("client_id")
    return own.groupBy("client_id", "product_id").agg(F.sum("l_extendedprice").alias("value"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios of order lines by issuer and class."""
    return advice.portfolios(clients(spark, sf_dir), products(spark, sf_dir), held_values(spark, sf_dir))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.violations(advice.portfolio_metrics(books(spark, sf_dir)))


def screen_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = advice.screen(dealt(clients(spark, sf_dir)), products(spark, sf_dir))
    return pairs.select("*", (F.col("reasons") == "").alias("included"))


def screen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = advice.screen_counts(dealt(clients(spark, sf_dir)), products(spark, sf_dir))
    return counts.select("*", advice.steady(F.col("n_included").cast("double") / F.col("n_products"), 6).alias("included_ratio"))


#: Least and greatest score, level, label.
BANDS = ((0, 19, 1, "conservative"), (20, 39, 2, "steady"), (40, 59, 3, "balanced"), (60, 79, 4, "growth"), (80, 100, 5, "bold"))


def score_to_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), F.floor((F.col("c_acctbal") + 1000) / 11000 * 100).cast("int").alias("score"), (1 + F.col("c_custkey") % 5).cast("int").alias("archived"))
    rows = rows.withColumn("b", advice.score_band(F.col("score"), BANDS))
    return rows.select("client_id", "score", "b.level", "b.label", F.least("archived", "b.level").alias("effective_level"))


def class_issuer_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = books(spark, sf_dir).select("client_id", F.explode(F.concat(
        F.transform(advice.class_weights(F.col("held")), lambda s: F.struct(s["name"].alias("asset_class"), F.lit(None).cast("string").alias("issuer"), s["weight"].alias("weight"))),
        F.transform(advice.issuer_weights(F.col("held")), lambda s: F.struct(F.lit(None).cast("string").alias("asset_class"), s["name"].alias("issuer"), s["weight"].alias("weight"))),
    )).alias("s"))
    return both.select("client_id", "s.asset_class", "s.issuer", advice.steady(F.col("s.weight"), 4).alias("weight"))


def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.portfolio_metrics(books(spark, sf_dir)).select("client_id", "holding_count", "expected_return", "volatility", "fee", "liquidity", "max_single", "weighted_risk", "cash_weight")


def suitability_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("client_id", F.inline("violations")).select("client_id", "rule_id", "severity", "subject")


def suitability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    feasible = screen_summary(spark, sf_dir).select("client_id", F.col("n_included").alias("n"))
    # Only counts are asked for: no portfolio is put together as an array.
    return advice.directives(advice.violation_counts(clients(spark, sf_dir), products(spark, sf_dir), held_values(spark, sf_dir)), feasible)


#: Fixed values of the stress tables: class betas by factor, shocks by scenario.
BETAS = {"cash_fund": {"rate": -0.2}, "bond": {"rate": -4.0, "credit_spread": -3.0}, "mixed": {"rate": -2.0, "equity": 0.5, "credit_spread": -1.0}, "equity": {"equity": 1.0}, "derivative": {"equity": 1.5, "rate": -1.0}}
SHOCKS = {"rates_up": {"rate": 0.02, "equity": -0.05}, "equity_crash": {"equity": -0.3, "credit_spread": 0.01}, "credit": {"credit_spread": 0.03, "equity": -0.1}}


def counterfactual_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = advice.clipped(books(spark, sf_dir)).where(F.size("kept") > 0)
    return rows.select("client_id", "variant", F.size("kept").cast("long").alias("n_products"), advice.steady(advice.total(F.col("kept"), lambda x: x["weight"]), 6).alias("invested"))


def counterfactual_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a variant changes about the base, among present holdings and cash."""
    rows = advice.clipped(books(spark, sf_dir))
    cash = F.struct(F.lit("cash").alias("product_id"), advice.steady(1 - advice.total(F.col("kept"), lambda x: x["weight"]), 9).alias("weight"))
    weights = F.transform("kept", lambda x: F.struct(x["product_id"].alias("product_id"), x["weight"].alias("weight")))
    return advice.weight_changes(rows.select("client_id", "variant", F.inline(F.array_append(weights, cash))))


#: Numbers of a variant's snapshot in a client's chain.
ORDER = {v[0]: i for i, v in enumerate(advice.VARIANTS, 1)}


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (client_id, version, status, weights, metrics, constraints, rules): each variant's portfolio as a snapshot of maps."""
    rows, kept = advice.clipped(books(spark, sf_dir)), F.col("kept")
    total = lambda part: advice.total(kept, part)
    cash = advice.steady(1 - total(lambda x: x["weight"]), 9)
    named = lambda pairs: F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("key"), c.cast("double").alias("value")) for n, c in pairs.items())))
    weights = F.map_from_entries(F.array_append(F.transform(kept, lambda x: F.struct(x["product_id"].alias("key"), x["weight"].alias("value"))), F.struct(F.lit("cash").alias("key"), cash.alias("value"))))
    metrics = {"n_products": F.size(kept), "invested": advice.steady(total(lambda x: x["weight"]), 6), "expected_return": advice.steady(total(lambda x: x["weight"] * x["expected_return"]) + cash * advice.CASH_RETURN, 6), "fee": advice.steady(total(lambda x: x["weight"] * x["fee"]), 6), "max_single": advice.steady(F.coalesce(F.array_max(F.transform(kept, lambda x: x["weight"])), F.lit(0.0)), 6)}
    limits = {c: F.col(c) for c in ("risk_capacity", "horizon", "single_cap", "liquidity_floor")}
    rules = F.array_compact(F.array(F.when(cash < advice.RESERVE - advice.EPS, F.lit("S-CASH-RESERVE")), F.when(F.size(kept) <= 2, F.lit("S-DIVERSIFICATION"))))
    version = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))[F.col("variant")]
    return rows.select("client_id", version.alias("version"), F.col("variant").alias("status"), weights.alias("weights"), named(metrics).alias("metrics"), named(limits).alias("constraints"), rules.alias("rules"))


def saved_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots appended to a log in the shared folder, with the hash of their payload, and read back."""
    rows = snapshots(spark, sf_dir)
    path = scratch_path(spark, "snapshots")
    payload = ("weights", "metrics", "constraints", "rules")
    stores.append_lines(rows.withColumn("hash", versions.snapshot(versions.canonical(list(payload), [F.col(c) for c in payload]))), path)
    return stores.parsed_lines(spark.read.text(path), "client_id long, version int, status string, weights map<string,double>, metrics map<string,double>, constraints map<string,double>, rules array<string>, hash string")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each saved snapshot changed against the one before it: weights, metrics, constraints and rules."""
    changed = versions.map_changes(saved_snapshots(spark, sf_dir), "client_id", ["weights", "metrics", "constraints"], ("rules",))
    return changed.select("client_id", "version", "previous", "part", "name", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"))


def tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.tighten(judged(spark, sf_dir)).drop("excluded", "excluded_classes")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.numbered(table(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), "ts", "event_id", F.col("event_type").alias("status"), "value"), "client_id", "ts", "event_id")


def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.chain(chain(spark, sf_dir), "client_id").select("client_id", "version", "parent_version", "status", "value", "next_version")


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.changes(chain(spark, sf_dir), "client_id", "status", "value")


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(
        F.count("*").alias("n"), advice.steady(F.sum("value"), 4).alias("total_ms"), advice.steady(F.avg("value"), 4).alias("mean_ms"), F.max("value").alias("worst_ms"), F.count_distinct("user_id").alias("runs")
    )


QUERIES = {
    "screen_products": screen_products, "screen_summary": screen_summary, "score_to_band": score_to_band, "class_issuer_concentration": class_issuer_concentration,
    "portfolio_metrics": portfolio_metrics, "suitability_rules": suitability_rules, "suitability_gate": suitability_gate, "tighten": tighten,
    "stress_test": lambda spark, sf_dir: advice.stress(books(spark, sf_dir), BETAS, SHOCKS), "counterfactual_coverage": counterfactual_coverage,
    "counterfactual_diff": counterfactual_diff, "snapshot_diff": snapshot_diff, "version_chain": version_chain, "version_diff": version_diff, "trace_summary": trace_summary,
}
