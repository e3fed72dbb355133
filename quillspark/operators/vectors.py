"""Dense and sparse vector scores and rankings."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as fx
from . import lexical


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """COSINE (0 for a zero vector), IP, or L2 as a negated distance."""
    if metric == "IP":
        return dot(a, b)
    if metric == "L2":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    if metric == "COSINE":
        n = norm(a) * norm(b)
        return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    raise ValueError(f"unknown metric {metric}")


#: Bytes of query vectors that go to every task at most; more queries take a pass over the vectors for each part of them.
BROADCAST_BYTES = 16 << 20
#: Queries that are multiplied with a batch of vectors at a time.
BLOCK = 512
#: Vectors of a batch that are multiplied, and texts that are embedded, at a time: what a task's Python holds beside the queries.
VECTORS, TEXTS = 2048, 256


def dense_top(queries: DataFrame, vectors: DataFrame, metric: str, k: int, query: str = "query_id", key: str = "vec_id", text: str | None = None) -> DataFrame:
    """The k nearest vectors of each query: (query, key, score, rank). No cut at 0; ties by key.

    With text, vectors has texts in that column, and their hash_embeddings(), of the queries' dimension, are made where they are multiplied: one
    Python worker for each task holds a few of them at a time, where two would hold batches of all.

    A stated query set against all vectors, in blocks: each task multiplies BLOCK queries with a batch of vectors at a time and keeps its own k
    best of each query, so neither memory nor rows grow with the pairs. Query vectors go to the tasks; they are measured first, and beyond
    BROADCAST_BYTES they are dealt into parts of that size, each with a pass of its own.
    """
    n, size = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    # A part holds a query at least.
    parts = max(1, min(n, -(-8 * n * size // max(1, BROADCAST_BYTES))))
    best = Window.partitionBy(query).orderBy(F.desc("score"), key)
    scored = None
    for i in range(parts):
        own = _best_of_part(queries if parts == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(parts)) == i), vectors, metric, k, query, key, text)
        scored = own if scored is None else scored.unionByName(own)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best_of_part(queries: DataFrame, vectors: DataFrame, metric: str, k: int, query: str, key: str, text: str | None) -> DataFrame:
    """Rows (query, key, score): each task's k best vectors of each query."""
    found = queries.select(query, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").toArrow()
    names = found.column(query).combine_chunks()
    left = _rows(found.column("embedding").combine_chunks())
    schema = T.StructType([queries.schema[query], vectors.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, pa.Array, np.ndarray]] = {}
        for batch in (b.slice(low, VECTORS) for b in batches for low in range(0, b.num_rows, VECTORS)):
            if not len(names):
                continue
            right, keys = _rows(batch.column("v")) if text is None else _embedded(batch.column("v"), left.shape[1]), batch.column(key)
            for at in range(0, len(names), BLOCK):
                scores = np.round(_similarities(left[at : at + BLOCK], right, metric), lexical.DIGITS)
                n = scores.shape[1]
                least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
                rows, cols = np.nonzero(scores >= least[:, None])
                new = (rows, keys.take(pa.array(cols)), scores[rows, cols])
                if at in held:
                    old = held[at]
                    new = (np.concatenate([old[0], new[0]]), pa.concat_arrays([old[1], new[1]]), np.concatenate([old[2], new[2]]))
                held[at] = _k_best(*new, k)
        for at, (rows, keys, scores) in held.items():
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows + at)), keys, pa.array(scores)], names=[query, key, "score"])

    if text is not None:
        return vectors.select(key, fx.tokenize(F.col(text)).alias("v")).mapInArrow(run, schema)
    return vectors.where("embedding is not null").select(key, F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, schema)


def _rows(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix, from its flat buffer."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists_of(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists, of its own buffer."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _k_best(rows: np.ndarray, keys: pa.Array, scores: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of entries (row, key, score) the k best of each row, ties by key."""
    plain = keys.to_numpy(zero_copy_only=False)
    by_key = np.empty(len(plain), np.int64)
    by_key[np.argsort(plain, kind="stable")] = np.arange(len(plain))
    order = np.lexsort((by_key, -scores, rows))
    ordered = rows[order]
    first = np.searchsorted(ordered, ordered)
    order = order[np.arange(len(order)) - first < k]
    return rows[order], keys.take(pa.array(order)), scores[order]


def _similarities(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """similarity() of each row of a with each row of b."""
    dots = a @ b.T
    if metric == "IP":
        return dots
    x, y = (a * a).sum(axis=1), (b * b).sum(axis=1)
    if metric == "L2":
        return -np.stack([np.sqrt(((b - row) ** 2).sum(axis=1)) for row in a])
    if metric == "COSINE":
        norms = np.sqrt(x)[:, None] * np.sqrt(y)[None, :]
        return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    raise ValueError(f"unknown metric {metric}")


@lru_cache(1 << 17)
def _place(token: str, dimension: int) -> tuple[int, float]:
    """The place of a token and its sign, both from its hash."""
    raw = hashlib.blake2b(token.encode(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "big") % dimension, 1.0 if raw[8] & 1 else -1.0


def _embedded(tokens: pa.Array, dimension: int) -> np.ndarray:
    """A vector of length 1, or 0, for each list of tokens."""
    out = np.zeros((len(tokens), dimension))
    for i, row in enumerate(out):
        listed = tokens[i].values
        if listed is None or not len(listed):
            continue
        # Each distinct token once, in order of first appearance; they are added in that order.
        counted = pc.value_counts(listed)
        placed = [_place(token, dimension) for token in counted.field("values").to_numpy(zero_copy_only=False).tolist()]
        weights = [sign * (1.0 + math.log(n)) for (_, sign), n in zip(placed, counted.field("counts").to_numpy().tolist(), strict=True)]
        row += np.bincount([place for place, _ in placed], weights, dimension)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def hash_embeddings(docs: DataFrame, key: str, text: str = "text", dimension: int = 512) -> DataFrame:
    """Rows (key, embedding): each distinct token adds plus or minus 1 + ln tf at a place, both from its BLAKE2b hash; vectors of length 1.

    Null texts and texts without tokens have a zero vector.
    """
    schema = T.StructType([docs.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, TEXTS) for b in batches for low in range(0, b.num_rows, TEXTS)):
            out = _embedded(batch.column("_tokens"), dimension)
            yield pa.RecordBatch.from_arrays([batch.column(key), _lists_of(out)], names=[key, "embedding"])

    return docs.select(key, fx.tokenize(F.col(text)).alias("_tokens")).mapInArrow(run, schema)


def sparse_embeddings(rows: DataFrame, tokens: str, place: str, weight: str, dimension: int = 512) -> DataFrame:
    """rows with the places, rising, and weights of the numbers other than 0 in the hash_embeddings() of the array `tokens`."""

    @F.arrow_udf("struct<place:array<int>,weight:array<double>>")
    def embed(tokens: pa.Array) -> pa.Array:
        out = []
        for low in range(0, len(tokens), TEXTS):
            for row in _embedded(tokens.slice(low, TEXTS), dimension):
                at = np.nonzero(row)[0]
                out.append({"place": at, "weight": row[at]})
        return pa.array(out, pa.struct([("place", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))]))

    kept = [F.col(c) for c in rows.columns]
    return rows.select(*kept, embed(F.col(tokens)).alias("_e")).select(*kept, F.col("_e.place").alias(place), F.col("_e.weight").alias(weight))


def sparse_weights(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, term, w): 1 + ln tf."""
    counted = lexical.query_terms(docs, key, text)
    return counted.select(key, "term", (1.0 + F.log(F.col("qtf").cast("double"))).alias("w"))
