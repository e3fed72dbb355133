"""Exact Jaccard self-join of word-shingle sets, as connected components, by adaptive multi-match prefixes.

1. Every document becomes its set of distinct shingle hashes. Blocks of documents send each distinct hash
   once to its range of the hash space; ranges report back which hashes another block has too. Equal
   sets inside a block travel once, and a hash that several sets of a block share travels once, so no
   shingle, however common, brings a range more than one entry per block.
2. A partner shares at least ceil(t * size) of a set's hashes. Sets that have fewer shared hashes than
   that can link with nothing and leave here. The others, one for each class of equal sets, are the nodes.
3. Hashes that lie in the same nodes (the hashes of a passage that documents repeat, say) become one token, with
   their number as its weight; a second exchange between blocks and ranges finds them by adding up node digests.
4. A node's tokens are ordered from rare to frequent. If two nodes reach the threshold, then their prefixes
   for l have at least l tokens in common, where the prefix for l ends when the weight behind it and the l - 1
   heaviest tokens inside it fall short of the needed overlap. Each node picks the l with the lowest estimated
   cost of candidates: a longer prefix, but only nodes that share l of its tokens at once are looked at.
   Every l tokens of a prefix make a key; a node with l also gives its keys for less, for partners that chose less.
5. Nodes of a key and of a band of sizes, one of which chose that key's l, meet its smallest node (no pairs are made), and
   meetings give clusters outside of which no link is possible. One meeting of each node, that of the most
   keys, is verified exactly, which already makes one component of almost every group of near copies.
6. Clusters are then compared completely, but only across components: blocks of at most 2 * SIDE nodes meet
   in a task, which adds up the weights of common tokens. In a cluster of more than SIDE nodes the largest component
   is never compared with itself, so a large group of near copies costs its stragglers times its size, not its
   square. No row is made for a pair: tasks return the links that joined something.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components
from .shingles import WIDTH, mix, set_digests, shingles, text_bytes

#: Bytes of text in a block, and in one go of the hashing inside it.
BLOCK_BYTES = 4 << 20
HASH_BYTES = 1 << 20
#: Ranges of the hash space for each shuffle partition.
RANGES = 4
#: Bytes of shared hashes in a block of nodes.
NODE_BYTES = 4 << 20
#: The largest l, the cost of a candidate in keys, and the keys of a node for which an l over 1 is still chosen. Every l finds all
#: links: with more keys than that a node takes the next smaller one, at last l = 1 with a key for each token of its prefix.
MOST_MATCHES = 3
CANDIDATE_COST = 20.0
MOST_KEYS = 128
#: Parts that a cluster's rows are dealt to when its sizes are joined to them.
SALTS = 64
#: Hashes are compared by their upper 48 bits.
DROPPED = np.uint64(16)
SHARED = 0xFFFFFFFF


def _need(size, percent: int):
    """The least overlap with any partner: ceil(percent * size / 100)."""
    return (percent * size + 99) // 100


def _packed(tokens: np.ndarray) -> bytes:
    """Rising values as first value and differences, 32-bit ones if they fit."""
    steps = np.diff(tokens, prepend=np.uint64(0))
    if len(steps) > 1 and int(steps[1:].max()) < 1 << 32:
        return b"4" + steps[:1].tobytes() + steps[1:].astype("<u4").tobytes()
    return b"8" + steps.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if blob[:1] == b"4":
        steps = np.concatenate([np.frombuffer(blob, "<u8", 1, 1), np.frombuffer(blob, "<u4", -1, 9).astype(np.uint64)]) if len(blob) > 9 else np.frombuffer(blob, "<u8", 1, 1)
    else:
        steps = np.frombuffer(blob, "<u8", -1, 1)
    return np.cumsum(steps, dtype=np.uint64)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype("<u2") if not len(values) or int(values.max()) < 1 << 16 else values.astype("<u4")


def _home(block: int, ranges: int) -> int:
    """The range that a block's own row travels by."""
    return int(mix(np.array([block], np.uint64))[0]) % ranges


def _ranges_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return (tokens // np.uint64((1 << 48) // ranges + 1)).astype(np.int64)


_MOVED = T.StructType([T.StructField("dest", T.LongType()), T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("payload", T.BinaryType())])


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.dataType]) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def _split(percent: int, width: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        first, number = TaskContext.get().partitionId() << 32, 0
        for block in common.slices_by_bytes(batches, "_text", BLOCK_BYTES):
            flats, sizes, one, two = [], [], [], []
            for part in common.slices_by_bytes(iter([block]), "_text", HASH_BYTES):
                flat, at = shingles(*text_bytes(part.column("_text")), width)
                d1, d2 = set_digests(flat, at)
                flats.append(flat), sizes.append(np.diff(at)), one.append(d1), two.append(d2)
            flat, size = np.concatenate(flats) >> DROPPED, np.concatenate(sizes)
            d1, d2 = np.concatenate(one), np.concatenate(two)
            keys = block.column("_key")
            key = np.asarray(keys.fill_null(0), dtype=np.int64)
            null = np.asarray(keys.is_null())
            # The document with the smallest key stands for its class of equal sets; empty sets and null keys for none.
            order = np.lexsort((key, null, d2, d1))
            lead = np.concatenate([[True], (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])])
            stands = np.zeros(len(key), bool)
            stands[order[lead]] = True
            stands &= ~null & (size > 0)
            at = np.concatenate([[0], np.cumsum(size)])
            chosen = np.flatnonzero(stands)
            own = np.repeat(np.arange(len(chosen)), size[chosen])
            tokens = np.concatenate([flat[at[i] : at[i + 1]] for i in chosen]) if len(chosen) else flat[:0]
            del flat, flats
            by = np.argsort(tokens, kind="stable")
            tokens, own = tokens[by], own[by]
            edge = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
            begins = np.flatnonzero(edge)
            runs = np.diff(np.append(begins, len(tokens)))
            several = np.repeat(runs > 1, runs)
            info = (key, null, size, d1, d2, chosen, tokens[several], own[several].astype(np.uint32))
            block_id = first + number
            number += 1
            rows = [(_home(block_id, ranges), block_id, 0, pickle.dumps(info, 5))]
            once, who = tokens[begins], np.where(runs > 1, SHARED, own[begins]).astype(np.uint32)
            where = _ranges_of(once, ranges)
            cuts = np.flatnonzero(np.diff(where, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(once)) if len(once) else cuts, strict=True):
                few = len(chosen) < 0xFFFF
                names = np.where(who[lo:hi] == SHARED, 0xFFFF, who[lo:hi]).astype("<u2") if few else who[lo:hi].astype("<u4")
                rows.append((int(where[lo]), block_id, 1, (b"2" if few else b"4") + len(names).to_bytes(4, "little") + names.tobytes() + _packed(once[lo:hi])))
            yield _rows(rows, _MOVED)

    return run


def _entries(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Names and hashes of one block in one range."""
    wide, n = int(payload[:1]), int.from_bytes(payload[1:5], "little")
    names = np.frombuffer(payload, f"<u{wide}", n, 5).astype(np.uint32)
    return np.where(names == 0xFFFF, SHARED, names).astype(np.uint32) if wide == 2 else names, _unpacked(payload[5 + n * wide :])


def _by(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(value, rows (block, kind, payload)) of each run of equal values; one run is held at a time."""
    held: list[tuple[int, int, bytes]] = []
    now = None
    for batch in batches:
        for dest, block, kind, payload in zip(batch.column(column).to_pylist(), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if dest != now:
                if held:
                    yield now, held
                held, now = [], dest
            held.append((block, kind, payload))
    if held:
        yield now, held
    del held
    common.trim()


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which hashes of a block another block has: per range, back to the block."""
    for _, rows in _by(batches, "dest"):
        for block, _, payload in (r for r in rows if r[1] == 0):
            yield _rows([(block, block, 0, payload)], _MOVED)
        blocks = [r[0] for r in rows if r[1]]
        parts = [_entries(r[2]) for r in rows if r[1]]
        if not parts:
            continue
        names, tokens = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        at = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        by = np.argsort(tokens, kind="stable")
        sorted_tokens = tokens[by]
        begins = np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]]))
        runs = np.diff(np.append(begins, len(by)))
        common_run = (runs > 1) | np.logical_or.reduceat(names[by] == SHARED, begins)
        shared = np.zeros(len(by), bool)
        shared[by] = np.repeat(common_run, runs)
        shared &= names != SHARED  # those their block knows about
        for i, block in enumerate(blocks):
            picked = np.flatnonzero(shared[at[i] : at[i + 1]]) + at[i]
            if len(picked):
                yield _rows([(block, block, 1, pickle.dumps((_narrow(names[picked]), _packed(tokens[picked])), 5))], _MOVED)


_SETS = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "size", "d1", "d2")] + [T.StructField("tokens", T.BinaryType())])


def _regroup(percent: int):
    """Back in one place, a block's documents with the shared hashes of those that can have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by(batches, "block"):
            key, null, size, d1, d2, chosen, tokens, own = pickle.loads(next(p for _, k, p in parts if k == 0))
            back = [pickle.loads(p) for _, k, p in parts if k == 1]
            tokens = np.concatenate([tokens, *(_unpacked(p) for _, p in back)])
            own = np.concatenate([own, *(n.astype(np.uint32) for n, _ in back)])
            by = np.lexsort((tokens, own))
            tokens, own = tokens[by], own[by]
            at = np.searchsorted(own, np.arange(len(chosen) + 1))
            blobs: list[bytes | None] = [None] * len(key)
            for j, i in enumerate(chosen.tolist()):
                if at[j + 1] - at[j] >= _need(int(size[i]), percent):
                    blobs[i] = tokens[at[j] : at[j + 1]].astype("<u8").tobytes()
            columns = [pa.array(key, mask=null), *(pa.array(x.astype(np.int64)) for x in (size, d1, d2)), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_SETS.names)

    return run


def _exchanged(moved: DataFrame, match, regroup, schema: T.StructType, parts: int) -> DataFrame:
    """Rows of blocks to their ranges, matched there, and back to their blocks; one range or block is held at a time."""
    matched = moved.repartition(parts, "dest").sortWithinPartitions("dest").mapInArrow(match, _MOVED)
    return matched.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(regroup, schema)


def shared_sets(docs: DataFrame, scratch: common.Scratch, key: str, text: str, percent: int, width: int) -> DataFrame:
    """Rows (key, size, d1, d2, tokens): set sizes and digests of all rows; tokens, the shared hashes, for possible nodes."""
    parts = common.shuffle_partitions(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return scratch.write(_exchanged(source.mapInArrow(_split(percent, width, RANGES * parts), _MOVED), _match, _regroup(percent), _SETS, parts), "sets")


def _counted(ranges: int):
    """Blocks of nodes tell each range how many of their nodes have a hash, and the sum of those nodes' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        first, number = TaskContext.get().partitionId() << 32, 0
        for part in common.slices_by_bytes(batches, "tokens", NODE_BYTES):
            block = first + number
            number += 1
            blobs = part.column("tokens").to_pylist()
            tokens = np.concatenate([np.frombuffer(b, "<u8") for b in blobs])
            counts = np.array([len(b) // 8 for b in blobs])
            node, size, d1, d2 = (part.column(n).to_numpy() for n in ("node", "size", "d1", "d2"))
            digest = np.repeat(mix(d1.view(np.uint64) ^ mix(d2.view(np.uint64))), counts)
            known, which = np.unique(tokens, return_inverse=True)
            by = np.argsort(which, kind="stable")
            begins = np.searchsorted(which[by], np.arange(len(known)))
            sums = np.add.reduceat(digest[by], begins)
            often = np.diff(np.append(begins, len(tokens)))
            yield _rows([(_home(block, ranges), block, 0, pickle.dumps((node, size, counts, which.astype(np.uint32)), 5))], _MOVED)
            where = _ranges_of(known, ranges)
            cuts = np.flatnonzero(np.diff(where, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(known)), strict=True):
                yield _rows([(int(where[lo]), block, 1, pickle.dumps((known[lo:hi], sums[lo:hi], often[lo:hi].astype(np.uint32)), 5))], _MOVED)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over all blocks, per range, back to each block in the order of its hashes."""
    for dest, rows in _by(batches, "dest"):
        for block, _, payload in (r for r in rows if r[1] == 0):
            yield _rows([(block, block, 0, payload)], _MOVED)
        blocks = [r[0] for r in rows if r[1]]
        parts = [pickle.loads(r[2]) for r in rows if r[1]]
        if not parts:
            continue
        tokens, sums, often = (np.concatenate([p[i] for p in parts]) for i in range(3))
        _, which = np.unique(tokens, return_inverse=True)
        total, n = np.zeros(which.max() + 1, np.uint64), np.zeros(which.max() + 1, np.int64)
        np.add.at(total, which, sums)
        np.add.at(n, which, often)
        ends = np.cumsum([len(p[0]) for p in parts])
        for block, own in zip(blocks, np.split(which, ends[:-1]), strict=True):
            # The kind keeps the order of ranges, which is that of hashes.
            yield _rows([(block, block, 1 + dest, pickle.dumps((total[own], n[own].astype(np.uint32)), 5))], _MOVED)


_NODES = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "size")] + [T.StructField("tokens", T.BinaryType())])
#: A token: the sum of the digests of the nodes that have it, its weight, and their number.
_TOKEN = np.dtype([("often", "<u4"), ("weight", "<u4"), ("name", "<u8")])


def _weighed(percent: int):
    """Nodes with their tokens, from rare to frequent; those whose tokens cannot reach the needed overlap leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by(batches, "block"):
            node, size, counts, which = pickle.loads(parts[0][2])
            back = [pickle.loads(p) for _, k, p in parts if k]
            total, often = (np.concatenate([b[i] for b in back]) for i in range(2))
            ends = np.cumsum(counts)
            rows = []
            for k, s, lo, hi in zip(node.tolist(), size.tolist(), ends - counts, ends, strict=True):
                own = which[lo:hi]
                own = own[often[own] > 1]
                if len(own) < _need(s, percent):
                    continue
                names, at, weight = np.unique(total[own], return_index=True, return_counts=True)
                tokens = np.empty(len(names), _TOKEN)
                tokens["often"], tokens["weight"], tokens["name"] = often[own][at], weight, names
                rows.append((k, s, tokens[np.lexsort((names, tokens["often"]))].tobytes()))
            if rows:
                yield _rows(rows, _NODES)

    return run


def weighed_nodes(sets: DataFrame, scratch: common.Scratch, percent: int) -> DataFrame:
    """Rows (node, size, tokens) from rows (node, size, d1, d2, tokens), one for each different set."""
    parts = common.shuffle_partitions(sets.sparkSession)
    return scratch.write(_exchanged(sets.mapInArrow(_counted(RANGES * parts), _MOVED), _summed, _weighed(percent), _NODES, parts), "nodes")


def _expected(often: np.ndarray, matches: int, nodes: int) -> float:
    """Nodes that have some `matches` of these tokens, were tokens spread over the nodes independently."""
    one, two, three = (float((often.astype(float) ** k).sum()) for k in (1, 2, 3))
    sums = (one, (one * one - two) / 2, (one**3 - 3 * one * two + 2 * three) / 6)
    return sums[matches - 1] / nodes ** (matches - 1)


def prefixes(size: int, tokens: np.ndarray, percent: int) -> list[int]:
    """The length of the prefix for each l = 1, 2, .. that there is one for; tokens run from rare to frequent."""
    weight = tokens["weight"].astype(np.int64)
    slack = _need(size, percent) - (weight.sum() - np.cumsum(weight))  # needed overlap less the weight behind
    first = np.maximum.accumulate(weight)
    second = np.maximum.accumulate(np.minimum(weight, np.concatenate([[0], first[:-1]])))
    out = []
    for heaviest in (0, first, first + second)[:MOST_MATCHES]:
        enough = slack > heaviest
        if not enough.any():
            break
        out.append(int(enough.argmax()) + 1)
    return out


def chosen_matches(lengths: list[int], tokens: np.ndarray, nodes: int) -> int:
    """The l of the lowest estimated cost: keys given, for l and for less, and candidates read."""
    keys, best = 0, (float("inf"), 1)
    for matches, n in enumerate(lengths, 1):
        keys += comb(n, matches)
        if matches > 1 and keys > MOST_KEYS:
            break
        best = min(best, (keys + CANDIDATE_COST * _expected(tokens["often"][:n], matches, nodes), matches))
    return best[1]


def _names(tokens: np.ndarray, matches: int) -> np.ndarray:
    """A key for each `matches` of the tokens."""
    names = mix(tokens["name"] + np.uint64(matches))
    if matches == 1:
        return names
    out = np.zeros(comb(len(names), matches), np.uint64)
    for place in np.array(list(combinations(range(len(names)), matches))).T:
        out = mix(out ^ names[place])
    return out


_KEYS = T.StructType([T.StructField("key", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("wanted", T.BooleanType())])


def _keys(percent: int, nodes: int):
    """Rows (key, band, nodes, wanted), one for each key and band of a batch of nodes; wanted: one of them chose that key's l."""
    step = 1.0001 * np.log(100 / percent) if percent < 100 else 1e-9  # sizes that may link lie in one band or in two that adjoin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, wanted = [], [], []
            nodes_of, sizes = batch.column("node").to_numpy(), batch.column("size").to_numpy()
            for size, blob in zip(sizes.tolist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(blob, _TOKEN)
                lengths = prefixes(size, tokens, percent)
                matches = chosen_matches(lengths, tokens, nodes)
                own = [_names(tokens[: lengths[m - 1]], m) for m in range(1, matches + 1)]
                keys += own
                wanted += [np.full(len(k), m == matches) for m, k in enumerate(own, 1)]
                counts.append(sum(map(len, own)))
            if not keys:
                continue
            key, band = np.concatenate(keys).view(np.int64), np.repeat((np.log(sizes) / step).astype(np.int64) if percent < 100 else sizes, counts).astype(np.int32)
            by = np.lexsort((band, key))
            key, band = key[by], band[by]
            begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(key)), pa.int32()), pa.array(np.repeat(nodes_of, counts)[by]))
            yield pa.RecordBatch.from_arrays([pa.array(key[begins]), pa.array(band[begins]), lists, pa.array(np.logical_or.reduceat(np.concatenate(wanted)[by], begins))], names=_KEYS.names)

    return run


def _meetings(keys: DataFrame) -> DataFrame:
    """Rows (a, b, n): nodes b that meet a, the smallest node of a key and band, over n keys; bands that adjoin meet through theirs.

    Only keys that one of their nodes chose count. Counts and minima are taken before rows are shuffled.
    """
    bands = keys.groupBy("key", "band").agg(F.min(F.array_min("nodes")).alias("a"), F.max("wanted").alias("wanted"), F.sum(F.size("nodes")).alias("n"))
    live = bands.groupBy("key").agg(F.max("wanted").alias("wanted"), F.sum("n").alias("n")).where("wanted and n > 1").select("key")
    bands = bands.join(live, "key").select("key", "band", "a")
    own = keys.join(bands, ["key", "band"]).select("a", F.explode("nodes").alias("b"))
    across = bands.join(bands.select("key", (F.col("band") - 1).alias("band"), F.col("a").alias("b")), ["key", "band"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return own.unionByName(across).where("a != b").groupBy("a", "b").agg(F.count("*").alias("n"))


_MET = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


class _Union:
    """Union-find over 0 .. n - 1; the smallest number of a set leads it."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


#: Sets of one side of a block.
SIDE = 512


def _blocks(nodes: DataFrame, clusters: DataFrame, stars: DataFrame) -> DataFrame:
    """Rows (block, node, group, size, tokens): every two nodes of a cluster that lie in different components meet in a block."""
    placed = clusters.join(stars.select("node", F.col("component").alias("group")), "node", "left").select("node", F.col("component").alias("cluster"), F.coalesce("group", "node").alias("group"))
    groups = placed.groupBy("cluster", "group").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("cluster").agg(F.sum("n").alias("k"), F.max(F.struct("n", "group")).alias("top"), F.count("*").alias("groups"))
    sizes = sizes.where("groups > 1").select("cluster", "k", F.col("top.group").alias("top"), F.ceil((F.col("k") - F.col("top.n")) / SIDE).cast("int").alias("s"), F.ceil(F.col("top.n") / SIDE).cast("int").alias("g"))
    # A cluster may hold a large share of the nodes: its sizes are laid out under SALTS keys.
    salts = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salts, ["cluster", "salt"])
    rest = F.col("group") != F.col("top")
    mine = F.pmod(F.xxhash64("node"), F.when(rest, F.col("s")).otherwise(F.col("g"))).cast("int")
    name = lambda i, kind, j: F.struct(F.col("cluster"), i.cast("int").alias("i"), F.lit(kind).alias("kind"), j.cast("int").alias("j"))
    one = F.array(name(F.lit(0), 0, F.lit(0)))
    own = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: name(F.least(mine, j), 1, F.greatest(mine, j)))
    to_top = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: name(mine, 2, j))
    as_top = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda i: name(i, 2, mine))
    block = F.when(F.col("k") <= SIDE, one).when(rest, F.concat(own, to_top)).otherwise(as_top)
    wanted = at.select("node", "group", F.explode(block).alias("block"))
    return wanted.join(nodes.select("node", "size", "tokens"), "node").select(F.xxhash64("block").alias("block"), F.to_json("block").alias("name"), "node", "group", "size", "tokens")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The weight of the common tokens of each two of these token arrays."""
    k = len(sets)
    own = np.repeat(np.arange(k), [len(t) for t in sets])
    flat = np.concatenate(sets)
    by = np.argsort(flat["name"], kind="stable")
    own, names, weight = own[by], flat["name"][by], flat["weight"][by].astype(float)
    begins = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    runs = np.diff(np.append(begins, len(names)))
    out = np.zeros((k, k))
    few = runs <= 16
    for n in np.unique(runs[few & (runs > 1)]).tolist():
        at = begins[runs == n]
        lists = own[at[:, None] + np.arange(n)]
        np.add.at(out, (lists[:, :, None], lists[:, None, :]), weight[at][:, None, None])
    many = np.flatnonzero(~few)
    for part in np.array_split(many, -(-len(many) // 256)) if len(many) else []:
        column = np.repeat(np.arange(len(part)), runs[part])
        place = np.concatenate([np.arange(b, b + n) for b, n in zip(begins[part], runs[part], strict=True)])
        there = np.zeros((k, len(part)))
        there[own[place], column] = 1
        out += (there * weight[begins[part]]) @ there.T
    return out


def _block_links(percent: int):
    """Links of each block that join two components, one for each two that they join."""

    def links(node: np.ndarray, group: np.ndarray, size: np.ndarray, tokens: list[np.ndarray]) -> list[tuple[int, int]]:
        both = overlaps(tokens)
        ok = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        ok &= group[:, None] != group[None, :]
        known, place = np.unique(group, return_inverse=True)
        left, right = np.nonzero(np.triu(ok, 1))
        pairs, at = np.unique(np.sort(np.stack([place[left], place[right]]), axis=0), axis=1, return_index=True)
        sets, found = _Union(len(known)), []
        for x, y, i in zip(*pairs.tolist(), at.tolist(), strict=True):
            if sets.join(x, y):
                ends = int(node[left[i]]), int(node[right[i]])
                found.append((min(ends), max(ends)))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                node, group, size, blobs = zip(*held, strict=True)
                got = links(np.array(node), np.array(group), np.array(size), [np.frombuffer(b, _TOKEN) for b in blobs])
                if got:
                    yield _rows(got, _MET)

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("name", "node", "group", "size", "tokens")), strict=True):
                if row[0] != name:
                    yield from done()
                    held, name = [], row[0]
                held.append(row[1:])
        yield from done()

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach the threshold, by the exact weight of their common tokens."""
    side = lambda n, s: nodes.select(F.col("node").alias(n), F.col("size").alias(f"size_{s}"), F.col("tokens").alias(f"tokens_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, ta, nb, tb in zip(*(batch.column(n).to_pylist() for n in ("size_a", "tokens_a", "size_b", "tokens_b")), strict=True):
                x, y = np.frombuffer(ta, _TOKEN), np.frombuffer(tb, _TOKEN)
                _, i, _ = np.intersect1d(x["name"], y["name"], assume_unique=True, return_indices=True)
                both = int(x["weight"][i].sum())
                keep.append(100 * both >= percent * (na + nb - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("b", "b"), "b").join(side("a", "a"), "a").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, width: int = WIDTH) -> DataFrame:
    """Rows (key, n_shingles, component_id), one for every row of docs.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest key reachable by links, itself included. Null or empty text, or text without words: size 0,
    linked with nothing, its own component. Rows with equal sets link, repeated rows among them. A row with a
    null key links with nothing and has a null component. An empty table gives no rows. Columns other than
    key (a whole number) and text are not read.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "jaccard")
    sets = shared_sets(docs, scratch, key, text, percent, width)
    info = sets.select("key", "size", "d1", "d2")
    classes = info.where("size > 0 and key is not null").groupBy("d1", "d2", "size").agg(F.min("key").alias("node"))
    classes = scratch.write(classes, "classes")
    nodes = sets.where("tokens is not null").join(classes.select("d1", "d2", F.col("node").alias("key")), ["d1", "d2", "key"], "left_semi")
    # A key that repeats with equal texts is one node.
    nodes = weighed_nodes(nodes.select(F.col("key").alias("node"), "d1", "d2", "size", "tokens").dropDuplicates(["node", "d1", "d2"]), scratch, percent)
    labels = _components_of(nodes, scratch, percent)
    known = classes.join(labels, "node", "left").select("d1", "d2", "size", F.coalesce("component", "node").alias("component"))
    alone = F.col("size").eqNullSafe(0) | F.col("key").isNull()
    linked = info.where(~alone).join(known, ["d1", "d2", "size"]).select("key", "size", "component")
    out = linked.unionByName(info.where(alone).select("key", "size", F.col("key").alias("component")))
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def _components_of(nodes: DataFrame, scratch: common.Scratch, percent: int) -> DataFrame:
    """Rows (node, component) for nodes with a link."""
    parts = common.shuffle_partitions(nodes.sparkSession)
    keys = scratch.write(nodes.mapInArrow(_keys(percent, max(1, nodes.count())), _KEYS), "keys")
    met = scratch.write(_meetings(keys), "met")
    clusters = scratch.write(components(met, scratch), "clusters")
    nearest = met.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    links = scratch.write(_verified(nearest, nodes, percent), "links")
    stars = scratch.write(components(links, scratch), "stars")
    blocks = _blocks(nodes, clusters, stars).repartition(parts, "block").sortWithinPartitions("block", "name")
    bridges = scratch.write(blocks.drop("block").mapInArrow(_block_links(percent), _MET), "links")
    for table in (keys, met, clusters, links):
        scratch.drop(table)
    if bridges.isEmpty():
        return stars
    return components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).union(bridges), scratch)
