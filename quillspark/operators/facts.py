"""Financial facts: numbers from markdown tables, derived metrics, risk rules, the evidence gate.

Facts are rows (company, year, metric, value), one for each; metrics have the names of METRICS. Rule tables are data:
small DataFrames joined to long metric values, so a rule is a row and not a branch of code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Spellings of metrics in filings and the name under which they are kept.
ALIASES = {
    "营收": "营业收入", "收入": "营业收入", "主营业务收入": "营业收入", "销售毛利": "毛利润", "毛利": "毛利润", "净利": "净利润",
    "归母净利": "归母净利润", "归属于母公司股东的净利润": "归母净利润", "总资产": "资产总额", "资产": "资产总额", "总负债": "负债总额",
    "负债": "负债总额", "净资产": "所有者权益", "股东权益": "所有者权益", "股东权益合计": "所有者权益", "经营现金流": "经营活动现金流净额",
    "经营活动产生的现金流量净额": "经营活动现金流净额", "经营性现金流": "经营活动现金流净额", "研发投入": "研发费用", "应收款": "应收账款",
    "应收": "应收账款", "不良率": "不良贷款率", "拨备率": "拨备覆盖率", "资本充足率": "资本充足率", "息差": "净息差",
    "质押比例": "控股股东股权质押比例", "担保余额": "对外担保余额", "诉讼金额": "未决诉讼涉案金额", "客户集中度": "前五大客户销售占比",
    "商誉": "商誉账面价值", "股本": "总股本",
}
#: Names in filings and the metric names used here; the last six are percentages as disclosed.
METRICS = {
    "营业收入": "revenue", "毛利润": "gross_profit", "净利润": "net_profit", "资产总额": "total_assets", "负债总额": "total_liabilities",
    "所有者权益": "equity", "应收账款": "receivables", "经营活动现金流净额": "operating_cash", "流动资产": "current_assets",
    "流动负债": "current_liabilities", "期间费用合计": "period_expense", "研发费用": "rnd", "对外担保余额": "guarantee",
    "未决诉讼涉案金额": "litigation", "商誉账面价值": "goodwill", "控股股东股权质押比例": "pledge_pct", "前五大客户销售占比": "top5_pct",
    "不良贷款率": "npl_pct", "拨备覆盖率": "provision_pct", "资本充足率": "capital_pct", "净息差": "nim_pct",
}
#: Ratio, numerator, denominator.
RATIOS = (
    ("net_margin", "net_profit", "revenue"), ("gross_margin", "gross_profit", "revenue"), ("debt_to_asset", "total_liabilities", "total_assets"),
    ("current_ratio", "current_assets", "current_liabilities"), ("roe", "net_profit", "equity"), ("roa", "net_profit", "total_assets"),
    ("asset_turnover", "revenue", "total_assets"), ("expense_ratio", "period_expense", "revenue"), ("rnd_intensity", "rnd", "revenue"),
    ("cash_conversion", "operating_cash", "net_profit"), ("equity_multiplier", "total_assets", "equity"),
)
#: Disclosed percentages that count as ratios.
DISCLOSED = (("npl_ratio", "npl_pct"), ("provision_coverage", "provision_pct"), ("capital_adequacy", "capital_pct"))
#: Rule, level, metric, lower bound and whether it belongs, upper bound and whether it belongs, kind of company.
RISK_RULES = (
    ("R-DEBT-01", "high", "debt_to_asset", 0.7, False, None, False, "other"), ("R-DEBT-02", "medium", "debt_to_asset", 0.6, False, 0.7, True, "other"),
    ("R-PROFIT-01", "high", "net_margin", None, False, 0.0, False, "other"), ("R-CASH-01", "high", "cash_conversion", None, False, 0.5, False, "other"),
    ("R-CASH-02", "medium", "cash_conversion", 0.5, True, 0.8, False, "other"), ("R-AR-01", "high", "ar_gap", 0.1, False, None, False, "other"),
    ("R-AR-02", "medium", "ar_gap", 0.0, False, 0.1, True, "other"), ("R-PLEDGE-01", "high", "pledge_ratio", 0.5, True, None, False, "other"),
    ("R-PLEDGE-02", "medium", "pledge_ratio", 0.3, True, 0.5, False, "other"), ("R-GUAR-01", "high", "guarantee_ratio", 0.3, False, None, False, "other"),
    ("R-GUAR-02", "medium", "guarantee_ratio", 0.1, False, 0.3, True, "other"), ("R-LIT-01", "high", "litigation_ratio", 0.05, False, None, False, "other"),
    ("R-LIT-02", "medium", "litigation_ratio", 0.01, False, 0.05, True, "other"), ("R-CONC-01", "medium", "top5_customer_ratio", 0.5, True, None, False, "other"),
    ("R-GW-01", "medium", "goodwill_ratio", 0.2, False, None, False, "other"), ("R-LIQ-01", "high", "current_ratio", None, False, 1.0, False, "other"),
    ("R-GROW-01", "high", "revenue_growth", None, False, 0.0, False, "other"), ("R-BANK-01", "medium", "npl_delta", 0.0, False, None, False, "financial"),
    ("R-BANK-02", "high", "provision_coverage", None, False, 1.5, False, "financial"), ("R-BANK-03", "medium", "nim_delta", None, False, 0.0, False, "financial"),
)
#: Metric, bound, and the side of it that is an outlier.
OUTLIERS = (("cash_conversion", 0.5, -1), ("debt_to_asset", 0.65, 1), ("revenue_growth", 0.0, -1), ("gross_margin", 0.15, -1), ("current_ratio", 1.2, -1))
LEVELS = ("info", "low", "medium", "high")
KEY = ("company", "year")


def steady(x: Column, digits: int) -> Column:
    """Rounded by way of four digits more, so that the order of a sum's addends does not show."""
    return F.round(F.round(x, digits + 4), digits)


# Numbers from markdown tables.


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_number(cell: Column) -> Column:
    """A cell's number without thousands separators and percent sign (not divided by 100); null for placeholders and other text."""
    text = F.regexp_replace(F.regexp_replace(stripped(cell), ",", ""), "％", "%")
    bare = F.regexp_replace(text, "%$", "")
    return F.when(text.isin("", "-", "--", "—", "不适用", "N/A", "n/a"), None).otherwise(F.when(bare.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), bare.try_cast("double")))


def canonical_metric(name: Column) -> Column:
    """The kept name of a spelling; other names stay, trimmed."""
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(known[stripped(name)], stripped(name))


def row_cells(line: Column) -> Column:
    """Cells of a markdown row, trimmed; one bar at either edge is no cell."""
    inner = F.regexp_replace(F.regexp_replace(stripped(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: stripped(c))


def is_separator(cells: Column) -> Column:
    return F.forall(cells, lambda c: c.rlike("^[-: ]*$")) & F.exists(cells, lambda c: c != "")


def table_facts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, company, source_id, section_title, metric, year, period, period_suffix, unit, value) of documents (doc_id, company, source_id, raw).

    A table is a run of lines that begin with a bar. Its head is the first line that a separator follows and that names a year; later lines
    are its rows, separators left out. The unit is that of a last column so headed. Cells without a number, and missing ones, give nothing.
    The section is the last heading above the table's head. Null text gives no rows; lines of one document are ordered within it only.
    """
    order = Window.partitionBy("doc_id").orderBy("at")
    lines = docs.select("doc_id", "company", "source_id", F.posexplode(F.split("raw", r"\r\n|\r|\n")).alias("at", "line"))
    row = stripped(F.col("line")).startswith("|")
    title = F.nullif(stripped(F.regexp_replace(stripped(F.col("line")), "^#+", "")), F.lit(""))
    marked = lines.select("*", row.alias("row"), F.sum((~row).cast("int")).over(order).alias("run"), F.last(F.when(stripped(F.col("line")).startswith("#"), title), ignorenulls=True).over(order).alias("section"), F.lead("line").over(order).alias("after"))
    rows = marked.where("row").withColumn("cells", row_cells(F.col("line")))
    dated = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), c.alias("period"), F.regexp_extract(c, r"^(\d{4})\s*年\s*(.*)$", 1).alias("year"), F.trim(F.regexp_extract(c, r"^(\d{4})\s*年\s*(.*)$", 2)).alias("suffix"))), lambda c: (c["i"] > 0) & (c["year"] != ""))
    unit_at = F.when(F.element_at("cells", -1).isin("单位", "币种", "计量单位"), F.size("cells") - 1)
    # The head comes to each of its run's lines as a value carried down, not by a join.
    down = Window.partitionBy("doc_id", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col("after").contains("|") & is_separator(row_cells(F.col("after"))) & (F.size(dated) > 0)
    head = F.struct("at", "section", dated.alias("dated"), unit_at.alias("unit_at"))
    body = rows.withColumn("head", F.first(F.when(is_head, head), ignorenulls=True).over(down)).where((F.col("at") > F.col("head.at") + 1) & ~is_separator(F.col("cells")))
    cells = body.select("doc_id", "company", "source_id", F.coalesce("head.section", F.lit("正文")).alias("section_title"), canonical_metric(F.col("cells")[0]).alias("metric"), F.coalesce(F.get("cells", F.col("head.unit_at")), F.lit("")).alias("unit"), "cells", F.explode("head.dated").alias("d"))
    valued = cells.select("doc_id", "company", "source_id", "section_title", "metric", F.col("d.year").cast("int").alias("year"), F.col("d.period").alias("period"), F.col("d.suffix").alias("period_suffix"), "unit", parse_number(F.get("cells", F.col("d.i"))).alias("value"))
    return valued.where(F.col("value").isNotNull() & (F.col("metric") != ""))


# Derived metrics.


def metric_columns(facts: DataFrame) -> DataFrame:
    """One row (company, year, a column for each of METRICS): the facts of a company and year, pivoted over the fixed names."""
    return facts.groupBy(*KEY).pivot("metric", list(METRICS.values())).agg(F.first("value"))


def unpivoted(wide: DataFrame, names: list[str]) -> DataFrame:
    """Rows (company, year, metric, value) of the named columns that have a value."""
    return wide.unpivot(list(KEY), names, "metric", "value").where("value is not null")


def latest_facts(facts: DataFrame) -> DataFrame:
    """Each company's newest value of each metric."""
    return facts.groupBy("company", "metric").agg(F.max(F.struct("year", "value")).alias("newest")).select("company", "metric", "newest.year", "newest.value")


def growth(facts: DataFrame) -> DataFrame:
    """Rows (company, year, metric, growth) where the year before is known; growth is null where its value was 0."""
    before = facts.select("company", "metric", (F.col("year") + 1).alias("year"), F.col("value").alias("_before"))
    rate = F.when(F.col("_before") != 0, steady((F.col("value") - F.col("_before")) / F.abs("_before"), 4))
    return facts.join(before, ["company", "metric", "year"]).select("company", "year", "metric", rate.alias("growth"))


def ratios(wide: DataFrame) -> DataFrame:
    """Rows (company, year, ratio, value) of metric_columns(): value is null where the denominator is 0, a ratio with a missing part is left out."""
    both = [F.when(F.col(n).isNotNull() & F.col(d).isNotNull(), F.struct(F.lit(r).alias("ratio"), F.when(F.col(d) != 0, steady(F.col(n) / F.col(d), 4)).alias("value"))) for r, n, d in RATIOS]
    told = [F.when(F.col(p).isNotNull(), F.struct(F.lit(r).alias("ratio"), steady(F.col(p) / 100, 4).alias("value"))) for r, p in DISCLOSED]
    return wide.select(*KEY, F.explode(F.array_compact(F.array(*both, *told))).alias("r")).select(*KEY, "r.ratio", "r.value")


def risk_values(wide: DataFrame) -> DataFrame:
    """Rows (company, year, entity, metric, value): all metrics that rules read, from a year's columns and those of the year before.

    A company that discloses bad loans or their coverage is financial. Missing parts, and denominators of 0, give no value.
    """
    prior = wide.select("company", (F.col("year") + 1).alias("year"), *(F.col(c).alias(f"_{c}") for c in ("revenue", "receivables", "npl_pct", "nim_pct")))
    both = wide.join(prior, list(KEY), "left")
    over = lambda n, d: F.when(F.col(d) != 0, steady(F.col(n) / F.col(d), 4))
    rate = lambda c: F.when(F.col(f"_{c}") != 0, steady((F.col(c) - F.col(f"_{c}")) / F.abs(f"_{c}"), 4))
    values = {
        **{r: over(n, d) for r, n, d in RATIOS if r in ("debt_to_asset", "net_margin", "gross_margin", "current_ratio", "cash_conversion")},
        "revenue_growth": rate("revenue"), "receivable_growth": rate("receivables"), "ar_gap": steady(rate("receivables") - rate("revenue"), 4),
        "guarantee_ratio": over("guarantee", "equity"), "litigation_ratio": over("litigation", "equity"), "goodwill_ratio": over("goodwill", "equity"),
        "pledge_ratio": steady(F.col("pledge_pct") / 100, 4), "top5_customer_ratio": steady(F.col("top5_pct") / 100, 4),
        "npl_ratio": steady(F.col("npl_pct") / 100, 4), "npl_delta": steady((F.col("npl_pct") - F.col("_npl_pct")) / 100, 6),
        "provision_coverage": steady(F.col("provision_pct") / 100, 4), "capital_adequacy": steady(F.col("capital_pct") / 100, 4),
        "net_interest_margin": steady(F.col("nim_pct") / 100, 4), "nim_delta": steady((F.col("nim_pct") - F.col("_nim_pct")) / 100, 6),
    }
    entity = F.when(F.col("npl_pct").isNotNull() | F.col("provision_pct").isNotNull(), "financial").otherwise("other")
    return both.select(*KEY, entity.alias("entity"), *(c.alias(n) for n, c in values.items())).unpivot([*KEY, "entity"], list(values), "metric", "value").where("value is not null")


# Rules and gates.


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RISK_RULES), "rule_id string, level string, metric string, lo double, lo_in boolean, hi double, hi_in boolean, entity string")


def rule_hits(values: DataFrame) -> DataFrame:
    """Rows (company, year, rule_id, level, metric, value): rules of the company's kind whose range holds the metric's value."""
    low = F.col("lo").isNull() | (F.col("value") > F.col("lo")) | (F.col("lo_in") & (F.col("value") == F.col("lo")))
    high = F.col("hi").isNull() | (F.col("value") < F.col("hi")) | (F.col("hi_in") & (F.col("value") == F.col("hi")))
    return values.join(F.broadcast(rule_table(values.sparkSession)), ["metric", "entity"]).where(low & high).select(*KEY, "rule_id", "level", "metric", "value")


def rank_of(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int")


def risk_report(values: DataFrame, least: str = "medium") -> DataFrame:
    """Rows (company, year, entity, evaluated, n_hits, n_shown, overall): the highest level over all hits, `info` without any; least bounds n_shown only."""
    judged = values.join(F.broadcast(rule_table(values.sparkSession).select("metric", "entity", "rule_id")), ["metric", "entity"]).groupBy(*KEY, "entity").agg(F.count("*").alias("evaluated"))
    found = rule_hits(values).groupBy(*KEY).agg(F.count("*").alias("n_hits"), F.count_if(rank_of(F.col("level")) >= LEVELS.index(least) + 1).alias("n_shown"), F.max(rank_of(F.col("level"))).alias("rank"))
    return judged.join(found, list(KEY), "left").select(
        *KEY, "entity", "evaluated", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_shown", F.lit(0)).alias("n_shown"), F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce("rank", F.lit(1))).alias("overall")
    )


def outliers(values: DataFrame) -> DataFrame:
    """Rows (company, year, metric, value) on the wrong side of their bound."""
    limits = values.sparkSession.createDataFrame(list(OUTLIERS), "metric string, bound double, side int")
    return values.join(F.broadcast(limits), "metric").where((F.col("value") - F.col("bound")) * F.col("side") > 0).select(*KEY, "metric", "value")


def evidence_gaps(scope: DataFrame, findings: DataFrame, evidence: DataFrame, sources: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (company, year, gap, target): what is missing behind the findings of each (company, year) of scope.

    findings: (company, year, finding_id, evidence_ids, metrics, checked), the last whether it was cross-checked. evidence: (evidence_id, source_id).
    Without findings only GAP-NO-FINDING is reported. GAP-EVIDENCE: no evidence, or none that is known. GAP-TRACE: a known evidence row whose
    source is not among sources, one gap for each. GAP-METRIC: no metric. GAP-XCHECK: an outlier, or receivables outgrowing revenue by
    more than 0.1, whose metric no checked finding names.
    """
    none = scope.join(findings, list(KEY), "left_anti").select(*KEY, F.lit("GAP-NO-FINDING").alias("gap"), F.lit("-").alias("target"))
    cited = findings.select(*KEY, "finding_id", F.explode_outer("evidence_ids").alias("evidence_id")).join(evidence.withColumn("_known", F.lit(True)), "evidence_id", "left")
    bare = cited.groupBy(*KEY, "finding_id").agg(F.count("_known").alias("n")).where("n = 0").select(*KEY, F.lit("GAP-EVIDENCE").alias("gap"), F.col("finding_id").alias("target"))
    lost = cited.where("_known and source_id <> ''").join(sources.select("source_id").distinct(), "source_id", "left_anti").select(*KEY, F.lit("GAP-TRACE").alias("gap"), F.col("finding_id").alias("target"))
    unmeasured = findings.where(F.coalesce(F.size("metrics"), F.lit(0)) <= 0).select(*KEY, F.lit("GAP-METRIC").alias("gap"), F.col("finding_id").alias("target"))
    gap = values.where("metric = 'ar_gap' and value > 0.1").select(*KEY, F.lit("cash_conversion").alias("metric"))
    suspects = outliers(values).select(*KEY, "metric").unionByName(gap).join(findings.select(*KEY).distinct(), list(KEY), "left_semi")
    checked = findings.where("checked").select(*KEY, F.explode("metrics").alias("metric")).distinct()
    open_ = suspects.join(checked, [*KEY, "metric"], "left_anti").select(*KEY, F.lit("GAP-XCHECK").alias("gap"), F.col("metric").alias("target"))
    return none.unionByName(bare).unionByName(lost).unionByName(unmeasured).unionByName(open_)


def verdict(gaps: Column, round_index: Column, most_rounds: int, overall: Column) -> Column:
    """revise while gaps and rounds are left, escalate when gaps outlast the rounds or the level is high, else pass."""
    return F.when((gaps > 0) & (round_index < most_rounds), "revise").when((gaps > 0) | (overall == "high"), "escalate").otherwise("pass")
