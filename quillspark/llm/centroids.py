"""Exact integer centroid clustering whose assignment is an annulus search.

Centroids are sorted by norm. By the triangle inequality a centroid nearer to a vector than some bound has a norm
within that bound of the vector's own. The bound is the exact distance to the centroid of nearest norm; bisection
of the sorted norms gives the run of centroids in the annulus, and only those are compared, exactly, a centroid
on the boundary included. Norms are roots in floating point, so the annulus is opened a little; what it lets
in needlessly is compared exactly and loses.

Each round is one pass over the written vectors: a task sums its vectors for each cluster and sends
clusters x (components + 1) numbers, which Spark adds up. The driver holds centroids and sums only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Largest magnitude of a scaled component, so that squared distances fit 64 bits.
MOST = 1 << 27
#: Up to this magnitude all sums of products are exact in doubles.
EXACT = 1 << 22


class Annulus:
    """Centroids sorted by norm, and the nearest one of each vector."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(axis=1)
        self.number = np.lexsort((np.arange(len(centroids)), squares))
        self.centroids, self.squares = centroids[self.number], squares[self.number]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.small = bool(np.abs(centroids).max(initial=0) <= EXACT)

    def bounds(self, norms: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of the centroids whose norms lie within each radius of each norm, the boundary included."""
        slack = 1e-6 + 1e-9 * (norms + radii)
        return np.searchsorted(self.norms, norms - radii - slack), np.searchsorted(self.norms, norms + radii + slack, side="right")

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; of several, the smallest number."""
        exact = np.float64 if self.small and np.abs(vectors).max(initial=0) <= EXACT else np.int64
        x, c = vectors.astype(exact), self.centroids.astype(exact)
        own = (vectors * vectors).sum(axis=1)
        norms = np.sqrt(own.astype(np.float64))
        after = np.clip(np.searchsorted(self.norms, norms), 1, max(1, len(c) - 1))
        first = after - 1 if len(c) > 1 else np.zeros(len(x), np.int64)
        if len(c) > 1:
            first = np.where(self.norms[after] - norms < norms - self.norms[first], after, first)
        gap = vectors - self.centroids[first]
        best, number = (gap * gap).sum(axis=1), self.number[first]
        low, high = self.bounds(norms, np.sqrt(best.astype(np.float64)))
        for place in range(int(low.min(initial=0)), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= place) & (place < high) & (first != place))
            if not len(rows):
                continue
            far = own[rows] + self.squares[place] - 2 * (x[rows] @ c[place]).astype(np.int64)
            closer = (far < best[rows]) | ((far == best[rows]) & (self.number[place] < number[rows]))
            best[rows[closer]], number[rows[closer]] = far[closer], self.number[place]
        return number, best


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
    if np.abs(values).max(initial=0) > MOST or (values == np.iinfo(np.int64).min).any():
        raise ValueError(f"a scaled component lies beyond {MOST}: squared distances would not fit 64 bits")
    return values


def integer_vectors(vectors: DataFrame, key: str, vector: str, components: int, scale: int) -> DataFrame:
    """Rows (_key, _x) of the vectors with exactly so many components, none null or non-finite, as floor(scale * x)."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    kept = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_v")).where((F.size("_v") == components) & F.forall("_v", finite))
    return kept.select("_key", F.transform("_v", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")).alias("_x"))


def first_centroids(kept: DataFrame, clusters: int, components: int, seed: int) -> np.ndarray:
    """The vectors whose keys have the smallest hashes, in that order; a null key is written as nothing, equal keys go by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("h"), "_x").orderBy("h", "_x").limit(clusters).collect()
    return np.array([r["_x"] for r in rows], np.int64).reshape(-1, components)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floored means of the vectors nearest to each; an empty cluster's stays."""
    clusters, components = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums = Annulus(centroids), np.zeros((clusters, components + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0), components)
            number, _ = search.nearest(x)
            order = np.argsort(number, kind="stable")
            found, begins = np.unique(number[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(np.hstack([x, np.ones((len(x), 1), np.int64)])[order], begins, axis=0)
        used = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, components + 1)), pa.array(np.tile(np.arange(components + 1), len(used))), pa.array(sums[used].ravel())], names=["cluster", "place", "total"]
        )

    out = centroids.tolist()
    totals: dict[int, dict[int, int]] = {}
    for r in kept.select("_x").mapInArrow(run, "cluster long, place long, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
        totals.setdefault(r["cluster"], {})[r["place"]] = r["total"]
    for cluster, of in totals.items():
        out[cluster] = [of[i] // of[components] for i in range(components)]
    return np.array(out, np.int64)


def cluster_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """Rows (key, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each kept vector.

    Vectors that are null, of another size, or with a null or non-finite component are left out, as contracted. Repeated
    rows count each; a null key counts as an empty one where the first centroids are chosen. With fewer vectors than
    clusters every vector starts one. A tie goes to the smaller cluster number. An empty table gives no rows. Other
    columns are not read. A scaled component beyond 2**27 is an error, as its squared distances may not fit a long.
    """
    spark, scratch = vectors.sparkSession, common.Scratch(vectors.sparkSession, "centroids")
    kept = scratch.write(integer_vectors(vectors, key, vector, components, scale), "vectors")
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    centroids = first_centroids(kept, clusters, components, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            number, distance = search.nearest(_matrix(b.column(1), components))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=schema.names)

    assigned = scratch.write(kept.mapInArrow(run, schema), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, d, sum(inertia.values()), digest[c]) for c, d in sorted(inertia.items())]
    # At most `clusters` rows.
    each = spark.createDataFrame(rows, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(each), F.col("cluster") == F.col("_cluster")).select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB SQL of the same clustering by plain search, a pair of steps for each round."""
    steps = [
        f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
v AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, unnest(range(1, {COMPONENTS + 1})) AS i FROM kept),
f AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k FROM kept QUALIFY k < {clusters}),
c0 AS MATERIALIZED (SELECT k, unnest(x) AS x, unnest(range(1, {COMPONENTS + 1})) AS i FROM f)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT vec_id, k, CAST(sum((v.x - c{r}.x) * (v.x - c{r}.x)) AS BIGINT) AS d FROM v JOIN c{r} USING (i) GROUP BY vec_id, k),
a{r} AS MATERIALIZED (SELECT vec_id, d, k FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""
s{r} AS MATERIALIZED (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, c{r}.i, CASE WHEN n IS NULL THEN x ELSE (s - (((s % n) + n) % n)) // n END AS x FROM c{r} LEFT JOIN s{r} ON c{r}.k = s{r}.k AND c{r}.i = s{r}.i)""")
    last = rounds
    return f"""{",".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{last} JOIN h USING (k)"""
