"""Spelling variants by a trie with one erratum, whose light subtrees are merged along heavy paths.

Each word is a path of a trie. Of a node's children the one with most words is heavy, all others are light, also the
end of a word at the node; so a word leaves at most log2(words) heavy paths. Two words that differ by one code point
part at one node, and at least one of them leaves it by a light child: merging a node's light subtrees, one code
point replaced, skipped or inserted, into the rest of the node's subtree finds every such pair exactly once:

* both light: the same rest behind different code points (a wildcard in the merged subtree);
* one light, one heavy: the rest behind the heavy code point instead of its own;
* the light one is longer: its rest without the code point (only where the rest goes on differently);
* the light one is shorter: its rest behind an inserted heavy code point.

A merged terminal is a whole string, so coinciding terminals are equal strings and need no check. Nodes are 64-bit
hashes of prefixes: two prefixes that collide share a heavy code point, which changes work, not results.

Nodes that hold many words, at most FREQUENT of them, go to the tasks as a list; the words at all other nodes
are few, and they meet their node in a join. Words themselves are counted in the tasks before they are shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import mix, text_bytes

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
#: A run loses a code point where the hash of its document and itself is a multiple of this.
ERRATA = 31
#: Nodes held by every task at most: each has more than 1 / FREQUENT of all (word, node) rows.
FREQUENT = 4096
BATCH_BYTES = 1 << 20
#: Distinct words and their bytes that a task counts before it sends them on.
MOST_HELD = 200_000
MOST_HELD_BYTES = 16 << 20
#: Stands for any code point in a merged key; no word has it.
WILD = "*"

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and code points of every maximal run [A-Za-z\\u00C0-\\u00FF]+ in UTF-8 texts laid end to end.

    U+00C0 to U+00FF are the byte C3 and one of 80 to BF.
    """
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >> 6 == 2)
    tail = np.concatenate([[False], lead[:-1]])
    inside = _LETTER[data] | lead | tail
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    left, right = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    begins, ends = np.flatnonzero(inside & (~left | first[:-1])), np.flatnonzero(inside & (~right | first[1:])) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return begins, ends, ends - begins - (leads[ends] - leads[begins])


def with_errata(key: str, word: bytes) -> bytes:
    """The word, without one code point where the hash of its document and itself says so."""
    h = zlib.crc32(word, zlib.crc32(key.encode() + b":"))
    if h % ERRATA:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n) of all texts' words; null texts have none, a null key is written as nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            size = 0
            return out

        for b in common.slices_by_bytes(batches, "_text", BATCH_BYTES):
            data, offsets = text_bytes(b.column("_text"))
            begins, ends, points = letter_runs(data, offsets)
            long = points >= least_length
            begins, ends = begins[long], ends[long]
            raw, cuts = _FOLD[data].tobytes(), np.searchsorted(begins, offsets)
            for doc, lo, hi in zip(b.column("_key").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found = Counter(raw[x:y] for x, y in zip(begins[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True))
                for word, n in found.items():
                    word = with_errata(doc or "", word)
                    if word not in held:
                        size += len(word)
                    held[word] += n
                if len(held) >= MOST_HELD or size >= MOST_HELD_BYTES:
                    yield flush()
        if held:
            yield flush()

    source = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _paths(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every prefix of every word, the whole word included: the word's row, the prefix's length and hash, the next code point (0 at the end)."""
    latin = [w.encode("latin-1") + b"\0" for w in column.to_pylist()]
    sizes = np.fromiter(map(len, latin), np.int64, len(latin))
    chars = np.frombuffer(b"".join(latin), np.uint8)
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(latin)), sizes)
    place = np.arange(len(chars)) - begins[row]
    # A prefix is the set of its (place, code point) pairs.
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(chars.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8))), dtype=np.uint64)])
    node = mix(total[:-1] - total[begins][row]).view(np.int64)
    return row, place, node, chars


def heavy_children(found: DataFrame) -> DataFrame:
    """Rows (node, heavy, size): the code point that most words at a node go on with (of several, the smallest), and the words there.

    Only nodes with at least two children, an end of a word among them, have light ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices_by_bytes(batches, "word", BATCH_BYTES // 8):
            _, _, node, char = _paths(b.column("word"))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(char.astype(np.int32))], names=["node", "char"])

    children = found.select("word").mapInArrow(run, "node long, char int").groupBy("node", "char").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("char") > 0, F.struct("n", (-F.col("char")).alias("c"))))
    nodes = children.groupBy("node").agg(F.count("*").alias("kinds"), F.sum("n").alias("size"), best.alias("best"))
    return nodes.where("kinds > 1").select("node", (-F.col("best.c")).alias("heavy"), "size")


def light_edges(found: DataFrame, nodes: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows (word, n, at, heavy): each node that a word leaves by a light child, as the length of its prefix and the heavy code point there."""
    rows = found.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    most = rows // frequent
    # Fewer than `frequent` nodes can hold so many of the rows.
    top = nodes.where(F.col("size") > most).select("node", "heavy").orderBy("node").collect()
    top_nodes, top_heavy = np.array([r["node"] for r in top], np.int64), np.array([r["heavy"] for r in top], np.int32)

    def split(frequent_ones: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices_by_bytes(batches, "word", BATCH_BYTES // 8):
                row, place, node, char = _paths(b.column("word"))
                at = np.minimum(np.searchsorted(top_nodes, node), max(0, len(top_nodes) - 1))
                known = top_nodes[at] == node if len(top_nodes) else np.zeros(len(node), bool)
                if frequent_ones:
                    use = np.flatnonzero(known)
                    use = use[top_heavy[at[use]] != char[use]]
                    last = pa.array(top_heavy[at[use]])
                else:
                    use = np.flatnonzero(~known)
                    last = pa.array(char[use].astype(np.int32))
                words_, counts = (c.take(pa.array(row[use])) for c in (b.column("word"), b.column("n")))
                arrays = [words_, counts, pa.array(place[use].astype(np.int32)), last] + ([] if frequent_ones else [pa.array(node[use])])
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n", "at", "heavy" if frequent_ones else "char"] + ([] if frequent_ones else ["node"]))

        return run

    shallow = found.select("word", "n").mapInArrow(split(True), "word string, n long, at int, heavy int")
    deep = found.select("word", "n").mapInArrow(split(False), "word string, n long, at int, char int, node long")
    met = deep.join(nodes.where(F.col("size") <= most).select("node", "heavy"), "node").where("char != heavy")
    return shallow.unionByName(met.select("word", "n", "at", "heavy"))


def near_words(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (word, near, best): each word's near words, counted, and the one of largest n as a struct of -n and word.

    No pair is found twice. Words that share a merged terminal are counted together, not paired.
    """
    head, tail = F.substring("word", F.lit(1), F.col("at")), F.col("word").substr(F.col("at") + 2, F.length("word"))
    own, heavy = F.col("word").substr(F.col("at") + 1, F.lit(1)), F.decode(F.unhex(F.lpad(F.hex(F.col("heavy").cast("long")), 2, "0")), "ISO-8859-1")
    light = edges.withColumn("v", head).withColumn("own", own).withColumn("s", tail).withColumn("h", heavy)
    ends = F.col("own") == ""
    skipped = F.when(~ends & (F.substring("s", 1, 1) != F.col("own")), F.concat("v", "s"))
    merged = F.array(
        F.when(~ends, F.concat("v", "h", "s")),  # replaced by the heavy one
        skipped,
        F.concat("v", "h", "own", "s"),  # the heavy one inserted
        F.when(~ends, F.concat("v", F.lit(WILD), "s")),  # replaced by any light one
    )
    keys = light.select("word", "n", F.explode(merged).alias("key")).where(F.length("key") >= F.lit(1))
    least = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))
    wild = keys.where(F.contains("key", F.lit(WILD))).groupBy("key").agg(F.collect_list(least).alias("all")).where(F.size("all") > 1)
    # At most one word for each code point, so about ninety.
    ranked = wild.select(F.sort_array("all").alias("all"))
    shared = ranked.select(F.posexplode("all").alias("i", "x"), (F.size("all") - 1).alias("near"), F.when(F.col("i") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best")).select(
        F.col("x.w").alias("word"), F.col("near").cast("long").alias("near"), "best"
    )
    pairs = keys.where(~F.contains("key", F.lit(WILD))).join(found.select(F.col("word").alias("other"), F.col("n").alias("other_n")), F.col("key") == F.col("other"))
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("word"), (-F.col("other_n")).alias("m"), F.col("other").alias("w")),
                F.struct(F.col("other").alias("word"), (-F.col("n")).alias("m"), F.col("word").alias("w")),
            )
        ).alias("p")
    ).select("p.word", F.lit(1).cast("long").alias("near"), F.struct("p.m", "p.w").alias("best"))
    return shared.unionByName(both).groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: common.Scratch, most_count: int, factor: int) -> DataFrame:
    """Rows (word, root): the last word of each chain of forms, found by doubling the steps of every word."""
    now = forms.select("word", F.col("form").alias("root"))
    if not most_count:
        return now
    # Counts grow by the factor with each step, so chains are no longer than this.
    longest = 1 + math.ceil(math.log(most_count) / math.log(factor))
    for _ in range(math.ceil(math.log2(longest))):
        onward = now.toDF("_from", "_to")
        now = scratch.write(now.join(onward, F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root")), "roots")
    return now


def spelling_variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = FACTOR,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word that occurs `least_count` times or more.

    A word's form is its near word of largest n, of several the smallest in code-point order, if that n is `factor`
    times its own or more; root follows forms to the last. Null and empty texts have no words; a null key is written
    as nothing where errata are drawn; repeated rows count each. No words give no rows. Other columns are not
    read. A very long text is one task's work, a very long run of letters is one word. factor: above 1.
    """
    if factor <= 1:
        raise ValueError("factor must be above 1, else forms could go round")
    scratch = common.Scratch(docs.sparkSession, "spelling")
    found = scratch.write(words(docs, key, text, least_length, least_count), "words")
    nodes = scratch.write(heavy_children(found), "nodes")
    near = near_words(found, light_edges(found, nodes, frequent))
    takes = F.col("form_n") >= factor * F.col("n")
    judged = found.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.m")).alias("form_n"), F.col("best.w").alias("form"))
    judged = scratch.write(judged.select("word", "n", "n_near", F.when(takes, F.col("form_n")).alias("form_n"), F.when(takes, F.col("form")).alias("form")), "forms")
    most = judged.agg(F.max("n")).first()[0] or 0
    ends = roots(judged.where(F.col("form").isNotNull()), scratch, most, factor)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
