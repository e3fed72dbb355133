"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

A sketch of fraction 1 / s estimates Jaccard likeness and containment without a size limit, so a short
document can be compared with a very long one, and the union of two sketches is the sketch of the union,
whatever their sizes. The upper 32 bits of each kept hash are stored. Beside them stands the smallest
hash of the whole set, kept or not, which tells small sets without a kept hash apart and merges as a minimum.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .shingles import shingles, text_bytes

#: 1 / fraction of the hashes that are kept: one for all sets.
SCALE = 2
BATCH_BYTES = 1 << 20


@dataclass(frozen=True, slots=True)
class Sketch:
    """Upper halves of the kept hashes, rising, and the set's smallest hash (none: an empty set)."""

    kept: np.ndarray
    least: int | None


def sketches(column: pa.Array, scale: int = SCALE) -> list[Sketch]:
    """The sketch of each text; null counts as empty."""
    flat, at = shingles(*text_bytes(column))
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = flat[lo:hi]  # rising
        high = (own[: np.searchsorted(own, np.uint64((1 << 64) // scale))] if scale > 1 else own) >> np.uint64(32)
        out.append(Sketch(np.unique(high.astype(np.uint32)), int(own[0]) if hi > lo else None))
    return out


def written(sketch: Sketch) -> str:
    """The sketch as text: the smallest hash in hex, a colon, and base64 of little-endian 32-bit numbers."""
    return f"{'' if sketch.least is None else format(sketch.least, '016x')}:{base64.b64encode(sketch.kept.astype('<u4').tobytes()).decode()}"


def parsed(text: str) -> Sketch:
    least, _, body = text.partition(":")
    return Sketch(np.frombuffer(base64.b64decode(body), "<u4"), int(least, 16) if least else None)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard likeness; if neither has a kept hash, 1 for the same smallest hash and else 0."""
    if not len(a.kept) and not len(b.kept):
        return float(a.least == b.least)
    both = len(np.intersect1d(a.kept, b.kept, assume_unique=True))
    return both / (len(a.kept) + len(b.kept) - both)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has; if nothing of a is kept, 1 for the same smallest hash and else 0."""
    if not len(a.kept):
        return float(a.least is not None and a.least == b.least)
    return len(np.intersect1d(a.kept, b.kept, assume_unique=True)) / len(a.kept)


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of the union of both sets."""
    return Sketch(np.union1d(a.kept, b.kept), min((x for x in (a.least, b.least) if x is not None), default=None))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """Rows (key, fingerprint), one for every row of docs; null text counts as empty, whose sketch has no hashes."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices_by_bytes(batches, "_text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(map(written, sketches(b.column("_text"), scale)), pa.string())], names=[key, "fingerprint"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def compare(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with the columns likeness and containment (of left in right) of two fingerprint columns.

    Null fingerprints give null. Other columns, also of these names, are refused rather than overwritten.
    """
    if {"likeness", "containment"} & set(pairs.columns):
        raise ValueError("pairs already has a column likeness or containment")

    @F.pandas_udf(T.StructType([T.StructField("likeness", T.DoubleType()), T.StructField("containment", T.DoubleType())]))
    def run(a, b):
        import pandas as pd

        rows = [(None, None) if x is None or y is None else (likeness(p := parsed(x), q := parsed(y)), containment(p, q)) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["likeness", "containment"])

    return pairs.withColumn("_c", run(F.col(left), F.col(right))).select("*", "_c.likeness", "_c.containment").drop("_c")


#: Keys are compared as whole numbers; a null one counts as the smallest.
LEAST_KEY = -(1 << 63)


def _range_of(cuts: np.ndarray):
    """A column function: the number of cuts below each key, found by bisection in Arrow batches of the keys."""

    @F.arrow_udf(T.IntegerType())
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, keys.to_numpy(zero_copy_only=False)).astype(np.int32))

    return run


def _ranges_of(firsts: np.ndarray, parts: np.ndarray):
    """A column function: the ranges that a key belongs to, its own and, if it is the first of one, the range before.

    firsts and parts: the smallest key and the number of each range that has rows, rising.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(keys: pa.Array) -> pa.Array:
        key = keys.to_numpy(zero_copy_only=False)
        at = np.searchsorted(firsts, key, side="right") - 1
        head = firsts[at] == key
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(1 + head)]), pa.int32()), pa.array(_woven(parts[at], parts[at - 1], head), pa.int32()))

    return run


def _woven(own: np.ndarray, before: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Each own number, followed by the one before it where head is set."""
    both = np.stack([own, before], axis=1)
    return both[np.stack([np.ones(len(head), bool), head], axis=1)]


def by_ranges(docs: DataFrame, key: str, parts: int) -> DataFrame:
    """docs with the columns _part, _head: every row in its own range of keys, and the first key's rows of a range also in
    the range before (those of the first range in the last), where they only serve as the successor.

    The driver holds at most `parts` bounds and as many smallest keys; tasks find a key's range by bisection.
    """
    slot = F.coalesce(F.col(key), F.lit(LEAST_KEY))
    cuts = np.zeros(0, np.int64)
    if parts > 1:
        found = docs.select(F.percentile_approx(key, F.array(*(F.lit(i / parts) for i in range(1, parts))), max(10_000, 20 * parts))).first()[0]
        cuts = np.unique(np.array(found or [], np.int64))
    firsts = docs.select(_range_of(cuts)(slot).alias("p"), slot.alias("k")).groupBy("p").agg(F.min("k").alias("k")).orderBy("k").collect()
    if not firsts:
        return docs.select("*", F.lit(0).alias("_part"), F.lit(False).alias("_head"))
    ranges = _ranges_of(np.array([r["k"] for r in firsts], np.int64), np.array([r["p"] for r in firsts], np.int32))
    return docs.withColumn("_ranges", ranges(slot)).select(*docs.columns, F.posexplode("_ranges").alias("_nth", "_part")).select(*docs.columns, "_part", (F.col("_nth") == 1).alias("_head"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE, parts: int | None = None) -> DataFrame:
    """Rows (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document in rising key order, the first after the last; equal keys are ordered by text, a null key comes
    first, null text is empty. A single row is its own successor. An empty table gives no rows. The key is a
    whole number. Other columns are not read. Texts move once, by ranges of keys (`parts`, else as many as shuffle
    partitions); a very long text is read whole and does not weigh on others of its range.
    """
    parts = parts or common.shuffle_partitions(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ordered = by_ranges(source, "_key", parts).repartitionById(parts, "_part").sortWithinPartitions("_part", "_head", F.col("_key").asc_nulls_first(), "_text")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [T.LongType(), T.LongType(), *[T.StringType()] * 3, *[T.DoubleType()] * 2], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # (key, part, head, text, sketch) of the last row so far
        for b in common.slices_by_bytes(batches, "_text", BATCH_BYTES):
            rows = list(zip(b.column("_key").to_pylist(), b.column("_part").to_pylist(), b.column("_head").to_pylist(), common.strings(b.column("_text")), sketches(b.column("_text"), scale), strict=True))
            if carried is not None:
                rows.insert(0, carried)
            carried = rows[-1]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[2] and x[1] == y[1]]
            edited = [x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2] for x, y in pairs]
            after = sketches(pa.array(edited, pa.large_string()), scale)
            columns = zip(*((x[0], len(x[3]), hashlib.sha256(e.encode()).hexdigest(), written(x[4]), written(s), likeness(x[4], s), likeness(x[4], y[4])) for (x, y), e, s in zip(pairs, edited, after, strict=True)), strict=True)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, schema)
