"""Connected components by alternating star contraction over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds after which a graph that still changes is reported as an error; rounds grow with the logarithm of its size.
MOST_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for each node of edges; component is the smallest node that it reaches.

    Loops and repeated edges do no harm; edges with a null end are ignored; no edges give no rows.
    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours too,
    and writes the result; hubs are aggregated before the shuffle and their joins can be split.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now = scratch.write(now, "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            # Stars: every edge leads from a node to its component's smallest.
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        before = state
        both = now.union(now.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.write(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        scratch.drop(now)
        now = after
    raise RuntimeError("components did not settle")
