"""Allocation over the admissible products of every client, what-if variants of it, and the check that no limit is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advice, tightening
from ..operators.allocation import allocate, weights
from .advisory import clients, products


def solve_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(allocate(clients(spark, sf_dir), products(spark, sf_dir)).where("n_open > 0"))


def solve_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken limits of solved portfolios, admissibility, entry amounts and liquidity among them: there are none."""
    limits = ("single_cap", "class_cap", "issuer_cap", "liquidity_floor", "amount")
    people = clients(spark, sf_dir)
    books = allocate(people, products(spark, sf_dir)).where("n_open > 0").join(people.select("client_id", *limits), "client_id")
    held = F.transform("held", lambda x: F.struct(x["weight"].alias("weight"), *(x["p"][c].alias(c) for c in ("asset_class", "issuer"))))
    single = lambda code, test: F.transform(F.filter("held", test), lambda x: F.lit(code))
    closed = lambda x: ~F.exists("open", lambda p: p["product_id"] == x["p"]["product_id"])
    liquid = F.col("cash") + advice.total(F.col("held"), lambda x: x["weight"] * x["p"]["liquidity"])
    whole = F.col("cash") + advice.total(F.col("held"), lambda x: x["weight"])
    beyond = lambda sums, cap, code: F.transform(F.filter(sums, lambda x: x["weight"] > F.col(cap) + 1e-6), lambda x: F.lit(code))
    codes = F.concat(
        single("C-CLOSED", closed), single("C-SINGLE", lambda x: x["weight"] > F.col("single_cap") + 1e-6), single("C-NEGATIVE", lambda x: x["weight"] < 0),
        single("C-ENTRY", lambda x: (x["weight"] + 1e-6) * F.col("amount") < x["p"]["min_investment"]),
        beyond(advice.class_weights(held), "class_cap", "C-CLASS"), beyond(advice.issuer_weights(held), "issuer_cap", "C-ISSUER"),
        F.array_compact(F.array(
            F.when(F.col("cash") < 0, F.lit("C-NEGATIVE")), F.when(F.col("cash") > 1 + 1e-6, F.lit("C-SINGLE")),
            F.when(F.abs(whole - 1) > 1e-6, F.lit("C-TOTAL")), F.when(liquid + 1e-6 < F.col("liquidity_floor"), F.lit("C-LIQUIDITY")),
        )),
    )
    return books.select("client_id", F.explode(codes).alias("code"))


def variant_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios of every client and variant, screened and solved anew; without an open product all is cash."""
    keys = ("client_id", "variant")
    return weights(allocate(advice.varied(clients(spark, sf_dir)), products(spark, sf_dir), keys), keys)


def counterfactual_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each variant changes when clients are screened and solved again: products that enter or leave, and cash."""
    return advice.weight_changes(variant_weights(spark, sf_dir))


def tightened_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client's settled portfolio: the round it was settled in, the verdict, rules that are left, holdings, limits that bind."""
    rows = tightening.final(tightening.settle(clients(spark, sf_dir), products(spark, sf_dir)))
    joined = lambda c: F.array_join(c, ",").alias(c)
    held = F.array_join(F.transform("held", lambda x: F.concat_ws("=", x["product_id"], F.format_string("%.6f", x["weight"]))), ",")
    return rows.select("client_id", "round", "directive", "escalated", "n_open", joined("blocks"), joined("warns"), joined("binding"), held.alias("held"), F.round("cash", 6).alias("cash"))


def tightening_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each further round did to the rules that a client's portfolio hit."""
    rows = tightening.rule_changes(tightening.settle(clients(spark, sf_dir), products(spark, sf_dir)))
    return rows.select("client_id", "round", *(F.array_join(c, ",").alias(c) for c in ("resolved", "introduced", "common")))


QUERIES = {"solve_weights": solve_weights, "solve_violations": solve_violations, "counterfactual_solved": counterfactual_solved, "tightened_portfolios": tightened_portfolios, "tightening_rules": tightening_rules}
ORACLE_SQL = {"solve_violations": "SELECT c_custkey AS client_id, 'x' AS code FROM customer WHERE FALSE"}
