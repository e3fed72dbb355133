"""The suitability gate counts violations without arrays."""

from __future__ import annotations

import oracle
from pyspark.sql import functions as F

from quillspark.operators import advice
from quillspark.plans import advisory, dialogue


def test_counts_are_those_of_the_violations(spark):
    """Counts of plain rows equal those of the arrays, for clients with one holding, with many, repeated or worthless ones, and for missing figures."""
    clients = advisory.clients(spark, oracle.SMALL).withColumn("tax_quota", F.when(F.col("client_id") % 5 > 0, F.col("tax_quota") / 50))
    goods = advisory.products(spark, oracle.SMALL)
    rows = goods.crossJoin(spark.range(60).select((F.col("id") * 2 + 1).alias("client_id"))).where("pmod(hash(product_id, client_id), 2 + client_id % 60) = 0")
    values = rows.select("client_id", "product_id", F.when(F.hash("product_id") % 9 != 0, F.pmod(F.hash("client_id", "product_id"), F.lit(10000)) + 1.0).otherwise(0.5).alias("value"))
    values = values.union(values.where("client_id % 7 = 0")).union(spark.sql("SELECT 1L, 'none', 5.0D UNION ALL SELECT NULL, 'none', 5.0D UNION ALL SELECT 999999L, 'none', 5.0D"))
    count = lambda kind: F.size(F.filter("violations", lambda v: v["severity"] == kind)).cast("long")
    judged = advice.violations(advice.portfolio_metrics(advice.portfolios(clients, goods, values)))
    want = sorted(map(tuple, judged.select("client_id", count("block"), count("warn")).collect()))
    got = sorted(map(tuple, advice.violation_counts(clients, goods, values).collect()))
    assert got == want and len(got) > 40 and len({r[1:] for r in got}) > 15


def test_reasons_put_no_portfolio_together(spark):
    plan = dialogue.review_reasons(spark, oracle.SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "sort_array" not in plan
