"""Plans whose SQL both engines read: tables are named in braces and bound to DataFrames in Spark."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

_NAME = re.compile(r"\{(\w+)\}")


def steady(sql: str) -> str:
    """The SQL with each round(x, d) as round(round(x, d + 4), d).

    Sums of one set of numbers differ in their last bits by the order of addition. The inner rounding takes
    that away, so a value halfway between two results goes the same way every time and in both engines.
    """
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        out.append(sql[at:i])
        depth, comma, j = 1, None, i + 6
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = j
            j += 1
        inner, digits = steady(sql[i + 6 : comma]), int(sql[comma + 1 : j - 1])
        out.append(f"round(round({inner}, {digits + 4}), {digits})")
        at = j
    return "".join(out) + sql[at:]


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """The SQL as a query over a directory's tables; Catalyst sees scans, not views."""
    sql = steady(sql)
    names = sorted(set(_NAME.findall(sql)))
    return lambda spark, sf_dir: spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The SQL with bare table names."""
    return _NAME.sub(r"\1", steady(sql))
