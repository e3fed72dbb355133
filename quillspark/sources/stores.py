"""Stores of rows: append-only logs, vector collections, client and product files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_bad_line"


def append_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines: a version log, a trace, feedback. Earlier lines stay as they are."""
    rows.write.mode("append").json(path)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of the schema from lines (value); lines that are no JSON object, and blank ones, are left out."""
    rows = lines.select(F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    return rows.where(F.col("r").isNotNull() & F.col(f"r.{BAD}").isNull()).select("r.*").drop(BAD)


TRACE = "run_id string, step string, agent string, status string, latency_ms double, ts string"


def read_trace(spark: SparkSession, path: str, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(steps, summaries) of a trace log, those of one run if given: a run id matches whole or by its ending. Bad lines are left out."""
    return split_trace(parsed_lines(spark.read.text(path), TRACE), run)


def split_trace(rows: DataFrame, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    own = rows if run is None else rows.where(F.col("run_id").endswith(run))
    return own.where("step is null or step <> 'summary'"), own.where("step = 'summary'")


def runs(rows: DataFrame) -> DataFrame:
    """Rows (run_id, steps, errors, total_ms, first_ts, last_ts), one for each run."""
    return rows.groupBy("run_id").agg(F.count("*").alias("steps"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.sum("latency_ms"), 4).alias("total_ms"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def upsert(collection: DataFrame, fresh: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """The collection with fresh rows put in place of those with the same key; a fresh vector of another dimension is an error.

    Of fresh rows with one key any one may win, so callers give each key once.
    """
    sized = fresh.withColumn(vector, F.when(F.size(vector) == dimension, F.col(vector)).otherwise(F.raise_error(F.format_string("a vector has %d dimensions, not %d", F.size(vector), F.lit(dimension)))))
    return collection.join(fresh.select(key), key, "left_anti").select(*collection.columns).unionByName(sized.dropDuplicates([key]).select(*collection.columns))


def delete(collection: DataFrame, predicate: Column | None = None) -> DataFrame:
    """The collection without the rows for which the predicate is true; without a predicate, none is left."""
    return collection.limit(0) if predicate is None else collection.where(~F.coalesce(predicate, F.lit(False)))


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """rows, whose keys must differ: the first repeated or missing one ends the job with an error that names it."""
    counted = rows.groupBy(key).agg(F.count("*").alias("_n"))
    checked = counted.select(key, F.when(F.col(key).isNull() | (F.col("_n") > 1), F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(True).alias("_ok"))
    return rows.join(checked, key).where("_ok").select(*rows.columns)


CLIENT = "client_id string, display_name string, age int, risk_capacity int, investment_horizon_years double, liquidity_floor_ratio double, max_single_product_ratio double, max_single_class_ratio double, max_single_issuer_ratio double, investable_amount double, currency string, prohibited_categories array<string>, experienced_categories array<string>, qualified_investor boolean, dual_record_completed boolean, eval_sample boolean, annual_fee_budget_ratio double, tax_advantaged_quota double, risk_questionnaire_score int"
PRODUCT = "product_id string, name string, asset_class string, issuer string, currency string, risk_level int, horizon_years double, min_investment double, expected_return double, volatility double, liquidity_ratio double, fee_rate double, is_derivative boolean, qualified_investor_only boolean, tax_advantaged boolean, principal_protected boolean, requires_experience array<string>"


def records(spark: SparkSession, path: str, field: str, schema: str, key: str) -> DataFrame:
    """Rows of the list `field` of JSON files, read by a schema, with unique keys: clients, products, questionnaires, scenarios."""
    files = spark.read.json(path, schema=f"{field} array<struct<{', '.join(': '.join(c.strip().split(' ', 1)) for c in schema.split(','))}>>", multiLine=True)
    return keyed(files.select(F.inline(field)), key)


def eval_clients(clients: DataFrame) -> DataFrame:
    """Clients marked as samples."""
    return clients.where("eval_sample")
