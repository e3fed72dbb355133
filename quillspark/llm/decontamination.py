"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The automaton holds every run of consecutive words of every item. Training words are streamed through it: its state
is the longest run of words ending here that some item has. From WINDOW words on the last WINDOW are a window of an
item; an item of fewer words is one window, found by the nearest state on the chain of suffixes that ends such an
item. The items of a window are those stored with the state that stands for exactly these words.

Only stretches in which every word, and every pair of neighbours, is in some item can reach a window; they are
found in Arrow batches by hashed words (compared byte by byte where known) and sorted pairs, and only they are streamed.

Items are cut into pieces that overlap by WINDOW - 1 words, and dealt into blocks of about BLOCK_WORDS words, so an
automaton has a bounded size whatever the test set's: one block is shipped with the tasks; more take a pass over the
written documents each, whose hits are joined by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .shingles import text_bytes, word_hashes

WINDOW = 10
#: Words of one automaton, and of one piece of an item.
BLOCK_WORDS = 200_000
PIECE_WORDS = 2_000
BATCH_BYTES = 1 << 20
#: Of a document's words, the share that may be hit before it is removed whole.
MOST_COVERAGE = 0.5

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of digits, ASCII letters and non-ASCII bytes in texts laid end to end."""
    inside = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    left, right = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~left | first[:-1])), np.flatnonzero(inside & (~right | first[1:])) + 1


class Automaton:
    """The generalised suffix automaton of pieces (item number, words, whether shorter than a window)."""

    def __init__(self, pieces: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in pieces if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extended(last, w)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: The state that stands for the last window of each state's words; 0 if it has fewer words.
        self.of_window = [0] * len(self.link)
        for s in order:
            if self.length[s] >= window:
                self.of_window[s] = self.of_window[self.link[s]] or s
        self.items: list[set[int]] = [set() for _ in self.link]
        self.ends_short = [False] * len(self.link)
        for item, words in coded:
            self._marked(item, words)
        #: The nearest state on the chain of suffixes, itself included, that ends an item shorter than a window.
        self.short = [0] * len(self.link)
        for s in order:
            self.short[s] = s if self.ends_short[s] else self.short[self.link[s]]
        self.least = min((len(w) for _, w in coded), default=window)
        self.least = min(self.least, window)
        pairs = {(a, b) for _, words in coded for a, b in zip(words, words[1:], strict=False)}
        self.pairs = np.array(sorted(a * len(self.ids) + b for a, b in pairs), np.int64)
        known = list(self.ids)
        raw = np.frombuffer(b"".join(known), np.uint8)
        sizes = np.array([len(w) for w in known], np.int64)
        ends = np.cumsum(sizes)
        hashes = word_hashes(raw, ends - sizes, ends) if known else np.zeros(0, np.uint64)
        # Of known words with one hash, look-ups would meet the first only.
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two words of the items have the same 64-bit hash")
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], order.astype(np.int64)
        self.sizes, self.begins, self.raw = sizes, ends - sizes, raw

    def _extended(self, last: int, w: int) -> int:
        """The state of the words so far and w; states are split where needed."""
        at = self.next[last].get(w)
        if at is not None and self.length[at] == self.length[last] + 1:
            return at
        if at is not None:
            return self._split(last, at, w)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _state(self, length: int, onward: dict[int, int]) -> int:
        self.next.append(onward)
        self.length.append(length)
        self.link.append(-1)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _marked(self, item: int, words: list[int]) -> None:
        """Store the item with the states of its windows, or of itself if it is shorter."""
        state = 0
        for w in words:
            state = self.next[state][w]
            at = self.of_window[state]
            if at:
                self.items[at].add(item)
        if len(words) < self.window:
            self.ends_short[state] = True
            self.items[state].add(item)

    def stretches(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words (-1: in no item), and begin and end of the stretches that could hold a window.

        firsts: the places of words that begin a text.
        """
        ids = np.full(len(begins), -1, np.int64)
        if not len(self.hashes) or not len(begins):
            return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = word_hashes(data, begins, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        met = np.flatnonzero(self.hashes[at] == hashes)
        found = self.hash_ids[at[met]]
        same = self.sizes[found] == ends[met] - begins[met]
        met, found = met[same], found[same]
        # Byte by byte, for all words that still have a byte there.
        equal, left, k = np.ones(len(met), bool), np.arange(len(met)), 0
        while len(left):
            equal[left] &= _FOLD[data[begins[met[left]] + k]] == self.raw[self.begins[found[left]] + k]
            k += 1
            left = left[self.sizes[found[left]] > k]
        ids[met[equal]] = found[equal]
        joined = np.zeros(len(ids) + 1, bool)  # whether a word goes on from the one before
        if len(self.pairs):
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            pair = ids[both] * len(self.ids) + ids[both + 1]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[place] == pair] + 1] = True
        joined[firsts[firsts < len(ids)]] = False
        known = ids >= 0
        lows = np.flatnonzero(known & ~joined[:-1])
        highs = np.flatnonzero(known & ~joined[1:]) + 1
        long = highs - lows >= self.least
        return ids, lows[long], highs[long]

    def spans(self, ids: list[int], base: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words in a stretch that begins at place base, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = length = 0
        for at, w in enumerate(ids, base + 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            onward = self.next[state].get(w)
            if onward is None:
                length = 0
                continue
            state, length = onward, length + 1
            hit = 0
            if length >= self.window:
                items |= self.items[self.of_window[state]]
                hit = length
            # A short item ends here if its words are among the matched ones.
            near = self.short[state if length == self.length[state] else self.link[state]] if state else 0
            hit = max(hit, self.length[near])
            while near:
                items |= self.items[near]
                near = self.short[self.link[near]]
            if hit:
                begin = at - hit
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at))
        return spans, items


def item_pieces(items: DataFrame, key: str, text: str, window: int, piece_words: int) -> DataFrame:
    """Rows (id, words, n): the items' words in pieces that overlap by window - 1 words; items without words have none.

    A null id is written as nothing.
    """
    if piece_words < window:
        raise ValueError("a piece must hold a window")
    schema = "id string, words array<binary>, n long"
    step = piece_words - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices_by_bytes(batches, "_text", BATCH_BYTES):
            data, offsets = text_bytes(b.column("_text"))
            begins, ends = word_bounds(data, offsets)
            raw, cuts = _FOLD[data].tobytes(), np.searchsorted(begins, offsets)
            ids, words = [], []
            for key_, lo, hi in zip(b.column("_key").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = [raw[x:y] for x, y in zip(begins[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                for at in range(0, max(1, len(own) - window + 1), step):
                    if own:
                        ids.append(key_ or "")
                        words.append(own[at : at + piece_words])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.list_(pa.binary())), pa.array(map(len, words), pa.int64())], names=["id", "words", "n"])

    return items.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def _hits(docs: DataFrame, pieces: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """Rows (the columns of docs but _text, n_words, begins, ends, items): merged spans of hit words and the items met, for each row of docs."""
    names = sorted({i for i, _ in pieces})
    number = {name: i for i, name in enumerate(names)}
    coded = tuple((number[i], tuple(w)) for i, w in pieces)
    kept = [c for c in docs.columns if c != "_text"]
    fields = [docs.schema[c] for c in kept] + [T.StructField("n_words", T.LongType())]
    fields += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("begins", "ends")] + [T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([(i, list(w)) for i, w in coded], window)
        for b in common.slices_by_bytes(batches, "_text", BATCH_BYTES):
            data, offsets = text_bytes(b.column("_text"))
            begins, ends = word_bounds(data, offsets)
            cuts = np.searchsorted(begins, offsets)
            ids, lows, highs = machine.stretches(data, begins, ends, cuts[:-1])
            doc_of = np.searchsorted(cuts, lows, side="right") - 1
            los: list[list[int]] = [[] for _ in range(b.num_rows)]
            his: list[list[int]] = [[] for _ in range(b.num_rows)]
            met: list[set[int]] = [set() for _ in range(b.num_rows)]
            for doc, lo, hi in zip(doc_of.tolist(), lows.tolist(), highs.tolist(), strict=True):
                spans, items = machine.spans(ids[lo:hi].tolist(), lo - int(cuts[doc]))
                los[doc] += [x for x, _ in spans]
                his[doc] += [y for _, y in spans]
                met[doc] |= items
            found = [sorted(names[i] for i in m) for m in met]
            arrays = [pa.array(np.diff(cuts)), pa.array(los, pa.list_(pa.int64())), pa.array(his, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def _merged(spans) -> F.Column:
    """Sorted spans (array of structs b, e), those that touch or overlap joined."""
    empty = F.array().cast("array<struct<b:bigint,e:bigint>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= x["b"])
        wider = F.struct(last["b"].alias("b"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    piece_words: int = PIECE_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (key, n_words, spans, items[, keep...]), one for every row of docs.

    spans: the hit words as an array of structs (b, e), word numbers from b up to but not e, rising and apart; items: the
    ids, as rising distinct strings, of the items with an occurring window. Null and empty texts have no words; items with
    no words have no window; a null item id is written as nothing, rows of one id are one item; repeated documents count
    each. An empty table of documents gives no rows, one of items leaves all clean. Other columns are not read, but for
    `keep`. A very long text is one task's work; spans grow with it.
    """
    spark, scratch = docs.sparkSession, common.Scratch(docs.sparkSession, "decontamination")
    pieces = scratch.write(item_pieces(items, item_key, item_text, window, piece_words), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    source = docs.select(F.col(key), F.col(text).alias("_text"), *keep)
    taken = lambda i: [(r["id"], [bytes(w) for w in r["words"]]) for r in pieces.where(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == i).collect()]
    together = F.arrays_zip(F.col("begins").alias("b"), F.col("ends").alias("e"))
    if blocks == 1:
        return _hits(source, taken(0), window).select(key, "n_words", together.alias("spans"), "items", *keep)
    rows = scratch.write(source.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = [scratch.write(_hits(rows.select("_row", "_text"), taken(i), window), "hits") for i in range(blocks)]
    every = parts[0].select("_row", "n_words")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    found = hits.where(F.size("items") > 0).groupBy("_row").agg(_merged(F.flatten(F.collect_list(together))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<struct<b:bigint,e:bigint>>")
    judged = every.join(found, "_row", "left").select("_row", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows.drop("_text").join(judged, "_row").select(key, "n_words", "spans", "items", *keep)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, n_words, n_hit, n_items, items_sha256, contaminated) of contamination()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["b"])
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", most_coverage: float = MOST_COVERAGE, **options) -> DataFrame:
    """docs without test items: hit words go, with what stands between the words of a span.

    A document of which more than most_coverage of the words are hit goes whole. Rows without hits stay as they are,
    null texts included. docs must not have the columns n_words, spans, items.
    """
    if {"n_words", "spans", "items"} & {c.lower() for c in docs.columns}:
        raise ValueError("docs already has a column n_words, spans or items")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["b"])
    others = tuple(c for c in docs.columns if c != key)
    found = contamination(docs, items, key, text, keep=others, **options).where((hit == 0) | (hit <= most_coverage * F.col("n_words")))

    @F.arrow_udf(T.StringType())
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for raw, own in zip(texts.cast(pa.large_binary()).to_pylist(), spans.to_pylist(), strict=True):
            if not own:
                out.append(raw)
                continue
            data = np.frombuffer(raw, np.uint8)
            begins, ends = word_bounds(data, np.array([0, len(data)]))
            left, at = [], 0
            for span in own:
                left.append(raw[at : begins[span["b"]]])
                at = ends[span["e"] - 1]
            out.append(b"".join([*left, raw[at:]]))
        return pa.array(out, pa.binary()).cast(pa.string())

    return found.withColumn(text, F.when(F.size("spans") > 0, without(F.col(text), F.col("spans"))).otherwise(F.col(text))).select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH i AS MATERIALIZED (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
s AS MATERIALIZED (SELECT item, w, least({WINDOW}, len(w)) AS m FROM i WHERE len(w) > 0),
g AS MATERIALIZED (SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM s)),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
n AS MATERIALIZED (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS p, w FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m),
k AS MATERIALIZED (SELECT r, p, g.m, item FROM (SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS gram FROM n) AS o JOIN g ON o.gram = g.gram AND o.m = g.m),
x AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM k) GROUP BY r),
y AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)
"""
