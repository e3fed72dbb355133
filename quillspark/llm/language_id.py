"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams, one to four characters long, of words padded with a
mark at both ends. A document's distance to a language is the sum, over the document's own profile, of
how far each n-gram's rank lies from its rank in the language's profile; n-grams that the language's
profile lacks count as PROFILE places. The nearest language wins.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: n-grams of a profile, characters of the longest n-gram, labelled documents of each language that are learned from, and
#: languages; the last two are parameters of learn() and bound what is learned from labelled rows.
PROFILE = 400
LONGEST = 4
LEARNED = 1_000
LANGUAGES = 1_000
BATCH_BYTES = 1 << 20
#: Share of held-out documents that least_score() takes for outliers.
LOW = 0.01
UNKNOWN = "und"
PAD = 1


@cache
def _letters() -> np.ndarray:
    """For each code point of the basic plane, itself if it is a letter or a mark on one, else the pad."""
    return np.array([c if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LM" else PAD for c in range(1 << 16)], np.uint32)


def _codes(text: str) -> np.ndarray:
    """The text's letters as numbers below 2**16, lower-cased, any run of other characters as one pad, pads at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(raw) and raw.max() > 0xFFFF:
        # Letters beyond the basic plane share its private-use area; profiles need them apart only roughly.
        high = raw > 0xFFFF
        alpha = np.array([chr(c).isalpha() for c in raw[high].tolist()])
        small = _letters()[np.where(high, 0, raw)]
        small[high] = np.where(alpha, 0xE000 + raw[high] % 0x1900, PAD)
    else:
        small = _letters()[raw]
    padded = np.concatenate([[PAD], small, [PAD]]).astype(np.uint64)
    return padded[np.concatenate([[True], (padded[1:] != PAD) | (padded[:-1] != PAD)])]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the text as 64-bit numbers, and their counts. Without a letter there are none."""
    c = _codes(text)
    if len(c) < 3 or not any(map(str.isalpha, text)):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, grams = [c[c != PAD]], c
    for n in range(2, LONGEST + 1):
        if len(c) < n:
            break
        grams = (grams[: len(c) - n + 1] << np.uint64(16)) | c[n - 1 :]
        inner = np.ones(len(grams), bool)
        for k in range(1, n - 1):  # a pad only at either end: an n-gram stays within one word
            inner &= c[k : k + len(grams)] != PAD
        found.append(grams[inner])
    every = np.sort(np.concatenate(found))
    begins = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[begins], np.diff(np.append(begins, len(every)))


def profile(text: str, size: int = PROFILE) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, equal counts in rising order of their numbers."""
    grams, counts = ngrams(text)
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        few = counts >= least
        grams, counts = grams[few], counts[few]
    return grams[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    """Languages in alphabetical order, and the rank of every profile's n-grams in each."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(ranked), size
        self.grams = np.unique(np.array([g for v in ranked.values() for g in v], np.uint64))
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, np.int64)
        for i, name in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.grams, np.array(ranked[name], np.uint64))] = np.arange(len(ranked[name]))

    def only(self, languages: list[str]) -> Profiles:
        """The profiles of these languages."""
        some = object.__new__(Profiles)
        some.languages, some.size, some.grams = sorted(languages), self.size, self.grams
        some.ranks = self.ranks[[self.languages.index(n) for n in some.languages]]
        return some

    def nearest(self, text: str) -> tuple[str, float]:
        """The nearest language, the first of equally near ones, and 1 - its distance / the largest possible one."""
        own = profile(text, self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == own), at, len(self.grams))
        there = self.ranks[:, at]
        away = np.where(there < 0, self.size, np.abs(there - np.arange(len(own)))).sum(axis=1)
        best = int(away.argmin())
        return self.languages[best], float(1 - away[best] / (self.size * len(own)))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 1 modulo 3; a null key counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learned: int = LEARNED, languages: int = LANGUAGES) -> Profiles:
    """Profiles from labelled documents that are not held out: of each language about `learned`, by the lowest hashes of the key.

    A language with n documents takes those whose hash lies in the lowest learned / n of the range, so choosing needs
    no sort and no join. The `languages` most frequent labels are learned; as many counts, and PROFILE rows for each,
    reach the driver.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    rows = rows.select(F.xxhash64(F.col(key)).alias("_hash"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    counts = rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(languages).collect()
    if not counts:
        return Profiles({})
    highest = {r["_lang"]: min(2**63 - 1, -(2**63) + (learned << 64) // r["n"]) for r in counts}
    limit = F.create_map(*(F.lit(x) for pair in highest.items() for x in pair))[F.col("_lang")]
    source = rows.where(F.col("_hash") <= limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for name, t in zip(batch.column("_lang").to_pylist(), common.strings(batch.column("_text")), strict=True):
                grams, counts = ngrams(t)
                own = total.setdefault(name, {})
                for g, n in zip(grams.view(np.int64).tolist(), counts.tolist(), strict=True):
                    own[g] = own.get(g, 0) + n
        for name, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = source.select("_lang", "_text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list[int]] = {}
    for name, gram, _ in sorted(counted.withColumn("r", F.row_number().over(top)).where(F.col("r") <= PROFILE).select("lang", "gram", "r").collect(), key=lambda r: (r[0], r[2])):
        ranked.setdefault(name, []).append(gram & ((1 << 64) - 1))
    return Profiles(ranked)


def identify(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (key, held_out, lang_pred, score) for every row of docs, from the whole text and nothing else.

    Null text or text without a letter: `und`, score 0; so is all text if no language was learned. Repeated rows
    are judged each, alike. An empty table gives no rows. Other columns are not read. With keep, rows are the columns
    named there, lang_pred and score, under common.unused names, so that a filter needs no join.
    """
    added = [common.unused(n, keep or []) for n in ("lang_pred", "score")]
    judged = [T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())]
    if keep is not None:

        def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.release()
            for batch in common.slices_by_bytes(batches, text, BATCH_BYTES):
                names, scores = zip(*map(profiles.nearest, common.strings(batch.column(text))), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *added])

        return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(carry, T.StructType([*(docs.schema[c] for c in keep), *judged]))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices_by_bytes(batches, "_text", BATCH_BYTES):
            got = [profiles.nearest(t) for t in common.strings(batch.column("_text"))]
            names, scores = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(F.col(key).alias("_key"), held_out(F.col(key)).alias("_out"), F.col(text).alias("_text")).mapInArrow(run, schema)


def least_score(docs: DataFrame, profiles: Profiles, least: float, key: str = "doc_id", text: str = "text", lang: str = "lang") -> float:
    """The score that parts text in a learned language from other text, `least` at the lowest.

    Every held-out document with a learned label and a letter is scored against its own language and against all others, as if
    its own had not been learned. The result lies halfway between the LOW quantile of the first and the 1 - LOW quantile
    of the second (0 if no other language is learned), in thousandths; it is `least` if there is no such document. Two
    counts for each thousandth reach the driver.
    """
    alone = {n: profiles.only([n]) for n in profiles.languages}
    others = {n: profiles.only([m for m in profiles.languages if m != n]) for n in profiles.languages}
    rows = docs.where(held_out(F.col(key)) & F.col(lang).isin(profiles.languages)).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        total = np.zeros((2, 1001), np.int64)
        for batch in batches:
            for name, t in zip(batch.column("_lang").to_pylist(), common.strings(batch.column("_text")), strict=True):
                if alone[name].nearest(t)[0] != UNKNOWN:
                    for i, p in enumerate((alone[name], others[name])):
                        total[i, round(1000 * p.nearest(t)[1])] += 1
        i, at = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(at, pa.int64()), pa.array(total[i, at], pa.int64())], names=["i", "at", "n"])

    counts = np.zeros((2, 1001), np.int64)
    for i, at, n in rows.mapInArrow(run, "i long, at long, n long").groupBy("i", "at").agg(F.sum("n")).collect():
        counts[i, at] = n
    if not counts.any():
        return least
    own, other = (int(np.searchsorted(c.cumsum(), q * c.sum())) for c, q in zip(counts, (LOW, 1 - LOW), strict=True))
    return max(least, (own + other) / 2000)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learned: int = LEARNED, languages: int = LANGUAGES) -> DataFrame:
    """identify() with profiles learned from the same table's labelled documents that are not held out, `learned` of each of `languages` at most."""
    return identify(docs, learn(docs, key, text, lang, learned, languages), key, text)


def is_held_out(key: object) -> bool:
    """held_out() for one key, in Python."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % 3 == 1
