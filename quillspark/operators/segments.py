"""An index kept up to date: segments of postings that are never changed, tombstones, and compaction.

Each upsert writes a segment and a tombstone for every key it replaces; a deletion writes tombstones alone. A row counts if no tombstone of its
key is younger than its segment. Counts of documents and terms are sums over segments, less those of dead rows; only dead rows are
read for that. compacted() writes the living rows as one segment. Segments are folders; the list of them is the caller's state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical


@dataclass(frozen=True)
class Segments:
    """The segments of one index: version numbers that have a folder of postings, and the newest version."""

    path: str
    key: str
    postings: tuple[int, ...] = ()
    newest: int = 0


def _tombstones(spark: SparkSession, state: Segments, after: int = 0) -> DataFrame | None:
    """Rows (key, dead_at): the newest tombstone of each key, of those younger than a version; None if there can be none."""
    if state.newest <= after:
        return None
    return spark.read.parquet(f"{state.path}/tombstones").where((F.col("version") <= state.newest) & (F.col("version") > after)).groupBy(state.key).agg(F.max("version").alias("dead_at"))


def upsert(state: Segments, docs: DataFrame, text: str = "text", metadata: tuple[str, ...] = (), prune: tuple[str, ...] = ()) -> Segments:
    """The index with docs put in place of those with the same keys; each key is given once."""
    version = state.newest + 1
    lexical.write_index(docs, state.key, f"{state.path}/segment-{version}", text, metadata, prune)
    docs.select(state.key, F.lit(version).alias("version"), F.lit(False).alias("gone")).write.mode("append").parquet(f"{state.path}/tombstones")
    return Segments(state.path, state.key, (*state.postings, version), version)


def delete(state: Segments, keys: DataFrame) -> Segments:
    """The index without the documents of these keys; keys that it lacks do no harm."""
    version = state.newest + 1
    keys.select(state.key, F.lit(version).alias("version"), F.lit(True).alias("gone")).write.mode("append").parquet(f"{state.path}/tombstones")
    return Segments(state.path, state.key, state.postings, version)


class View(lexical.Index):
    """The living rows of an index, for search as in one written at once."""

    def __init__(self, spark: SparkSession, state: Segments):
        # Tombstones that are not younger than the oldest segment harm no row.
        self.key, dead = state.key, _tombstones(spark, state, min(state.postings))
        parts = [spark.read.parquet(f"{state.path}/segment-{v}/postings").withColumn("_segment", F.lit(v)) for v in state.postings]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        terms = [spark.read.parquet(f"{state.path}/segment-{v}/terms") for v in state.postings]
        every = terms[0]
        for t in terms[1:]:
            every = every.unionByName(t)
        sums = [spark.read.parquet(f"{state.path}/segment-{v}/totals").select("n", (F.col("n") * F.coalesce("avgdl", F.lit(0.0))).alias("length")) for v in state.postings]
        if dead is None:
            self.rows, total = rows.drop("_segment"), sums.pop()
        else:
            # Keys of the newest segment that wrote them are not dead at their own version, but at any younger one.
            late = dead.withColumnRenamed(self.key, "_key")
            gone = (F.col(self.key) == F.col("_key")) & (F.col("dead_at") > F.col("_segment"))
            self.rows = rows.join(late, gone, "left_anti").drop("_segment")
            lost = rows.join(late, gone, "left_semi")
            every = every.unionByName(lost.where("bucket >= 0").groupBy("bucket", "term").agg((-F.count("*")).alias("df")))
            total = lost.where("bucket = -1").agg((-F.count("*")).cast("double").alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).cast("double").alias("length"))
        self.terms = every.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
        for s in sums:
            total = total.unionByName(s)
        self.totals = total.agg(F.sum("n").alias("n"), F.sum("length").alias("length")).select("n", (F.col("length") / F.nullif(F.col("n"), F.lit(0.0))).alias("avgdl"))
        self.buckets = spark.read.parquet(f"{state.path}/segment-{state.postings[0]}/totals").first()["buckets"]


def compacted(spark: SparkSession, state: Segments, prune: tuple[str, ...] = ()) -> Segments:
    """The same index as one segment: living rows are written once more, without reading a text."""
    view, version = View(spark, state), state.newest + 1
    at = f"{state.path}/segment-{version}"
    folders = [*prune, "bucket"]
    view.rows.repartition(*folders).sortWithinPartitions(*folders, "term").write.partitionBy(*folders).parquet(f"{at}/postings")
    view.terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/terms")
    view.totals.withColumn("buckets", F.lit(view.buckets)).coalesce(1).write.parquet(f"{at}/totals")
    return Segments(state.path, state.key, (version,), version)
