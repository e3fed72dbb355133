"""Hierarchical multi-length packing of token ids.

Every document's ids are routed by length: whole windows of the longest context become sequences of
their own, the rest of r < longest ids goes to the tier with the smallest context >= r. Each tier is
packed from the longest down: a document opens a window of its tier, the window's gap takes the
largest rests of shorter tiers that fit, and what is still open takes the head of one more rest, cut
there. When only unfilled windows are left, their rests are joined and cut into windows once more, and
the last partial window is laid out as sequences of descending powers of two, so nothing is padded.
Step groups hold sequences of one context, at most STEP_TOKENS tokens. A context's sequences are dealt over the
least number of groups in serpentine order of their attention cost (the sum of the squared lengths of
their pieces), so groups differ by one sequence at most and cost about the same.

Work is done for one bounded block of ids at a time, inside the scan's partitions: no shuffle, no
global order, and no state beyond a block. A recomputed partition gives the same rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .segments import WordPieces

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Ids packed together, tokens of a step group, and bytes of text encoded in one go.
BLOCK_TOKENS = 500_000
STEP_TOKENS = 65_536
BATCH_BYTES = 1 << 20
#: Sequence numbers of one partition.
SEQUENCES = 1 << 36


class Rests:
    """Rests of documents, ordered by length; the largest that fits a gap is found by bisection."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, int]] = []

    def add(self, length: int, doc: int, start: int) -> None:
        insort(self.items, (length, doc, start))

    def fitting(self, gap: int) -> tuple[int, int, int] | None:
        at = bisect_right(self.items, (gap, 1 << 62, 1 << 62))
        return self.items.pop(at - 1) if at else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (context, [(document, start, length), ...]) that hold every id once; lengths are per document."""
    longest, done, rests = tiers[-1], [], []
    for doc, n in enumerate(lengths):
        whole = n // longest * longest
        done += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            rests.append((n - whole, doc, whole))
    route: dict[int, Rests] = {t: Rests() for t in tiers}
    rests.sort()
    for length, doc, start in rests:
        tier = next(t for t in tiers if t >= length)
        if length == tier:
            done.append((tier, [(doc, start, length)]))
        else:
            route[tier].items.append((length, doc, start))
    open_rests: list[tuple[int, int, int]] = []
    for i in range(len(tiers) - 1, -1, -1):
        tier, shorter = tiers[i], [route[t] for t in reversed(tiers[:i])]
        while route[tier].items:
            length, doc, start = route[tier].items.pop()
            window, gap = [(doc, start, length)], tier - length
            for pool in [*shorter, route[tier]] if i == 0 else shorter:
                while gap and (x := pool.fitting(gap)):
                    window.append((x[1], x[2], x[0]))
                    gap -= x[0]
            if gap:
                pool = next((p for p in reversed(shorter) if p.items), None) or (route[tier] if route[tier].items else None)
                if pool is None:
                    open_rests += window
                    continue
                length, doc, start = pool.items.pop()
                window.append((doc, start, gap))
                left = length - gap
                route[next(t for t in tiers if t >= left)].add(left, doc, start + gap)
            done.append((tier, window))
    return done + recut(open_rests, tiers)


def recut(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Lay pieces end to end and cut: the longest context first, then descending powers of two."""
    left, done, pieces = sum(p[2] for p in pieces), [], list(reversed(pieces))
    while left:
        size = tiers[-1] if left >= tiers[-1] else 1 << (left.bit_length() - 1)
        window, gap = [], size
        while gap:
            doc, start, length = pieces.pop()
            took = min(gap, length)
            window.append((doc, start, took))
            if took < length:
                pieces.append((doc, start + took, length - took))
            gap -= took
        done.append((size, window))
        left -= size
    return done


def _offsets(window: list[tuple[int, int, int]]) -> list[int]:
    return [0, *accumulate(n for _, _, n in window)][: len(window)]


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], most: int = STEP_TOKENS) -> list[int]:
    """A group number for each sequence, from 0 on, the groups of the shortest context first."""
    of, first = [0] * len(sequences), 0
    by_context: dict[int, list[tuple[int, int]]] = {}
    for i, (context, window) in enumerate(sequences):
        by_context.setdefault(context, []).append((-sum(n * n for _, _, n in window), i))
    for context in sorted(by_context):
        own = sorted(by_context[context])
        groups = -(-len(own) // max(1, most // context))
        for place, (_, i) in enumerate(own):
            turn, at = divmod(place, groups)
            of[i] = first + (groups - 1 - at if turn % 2 else at)
        first += groups
    return of


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    end_id: int | None = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Rows (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group[, ids]), one per piece.

    tokenizer: path of the word-level BPE file. Null or empty text: the end id alone. Repeated rows are
    packed each. An empty table gives no rows. Other columns are not read. A very long text is encoded whole and
    cut into windows; it is the only thing that makes a block larger than BLOCK_TOKENS ids.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    fields = [T.StructField(key, docs.schema[key].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group")]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    names = [f.name for f in fields]
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = common.kept(WordPieces, tokenizer)
        first = TaskContext.get().partitionId() * SEQUENCES
        number = step = 0

        def flush(keys: list[pa.Array], ids: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal number, step
            lengths = [len(x) // 4 for x in ids]
            sequences = pack(lengths, tiers)
            groups = step_groups(sequences)
            pieces = np.array([(doc, start, length, number + i, at) for i, (_, window) in enumerate(sequences) for (doc, start, length), at in zip(window, _offsets(window), strict=True)], np.int64)
            doc, start, length, sequence, offset = pieces.T
            own = [ids[d][4 * b : 4 * (b + n)] for d, b, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            context = np.array([c for c, _ in sequences])[sequence - number]
            group = np.array(groups)[sequence - number] + step
            number, step = number + len(sequences), step + max(groups) + 1
            key_of = pa.chunked_array(keys).combine_chunks() if len(keys) > 1 else keys[0]
            arrays = [start, length, np.fromiter(map(zlib.crc32, own), np.int64, len(own)), np.array(lengths)[doc], first + sequence, offset, context, first + group]
            yield pa.RecordBatch.from_arrays([key_of.take(pa.array(doc)), *map(pa.array, arrays)] + [pa.array(own, pa.binary())] * with_ids, names=names)

        keys: list[pa.Array] = []
        ids: list[bytes] = []
        held = 0
        for batch in common.slices_by_bytes(batches, "_text", BATCH_BYTES):
            got = [x + end for x in coder.encode(common.strings(batch.column("_text")))]
            keys.append(batch.column("_key"))
            ids += got
            held += sum(map(len, got)) // 4
            if held >= BLOCK_TOKENS:
                yield from flush(keys, ids)
                keys, ids, held = [], [], 0
        if ids:
            yield from flush(keys, ids)
        common.trim()

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, T.StructType(fields))
