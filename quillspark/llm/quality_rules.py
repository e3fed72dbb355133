"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Every document's words and word pairs fall into BUCKETS hash buckets. Two multinomials over the buckets
are counted, one over all documents, one over trusted ones; a document's score is the sum of its
n-grams' log ratios divided by their number, and every document with a score under THRESHOLD is
rejected, always alike. Only DataFrame functions are used: one pass counts (a few thousand rows per
task leave it), one pass scores inside each row; no document is shuffled.

With a language column there is a second, balanced score. Its trusted multinomial is put together language
by language, each with the share it has of all n-grams and with its part of the prior, so that a language whose
share of the trusted text is smaller than that of all text is not marked down for it. It equals the first if
the shares are equal, and in a language without trusted text n-grams have the ratio 0, but for shared buckets.

Ratios are rounded to millionths, so a score is a sum of whole numbers and does not depend on any order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash buckets (a power of two), prior n-grams per bucket, drawn as the raw text has them, and the least mean log ratio.
BUCKETS = 1 << 14
PRIOR = 8
THRESHOLD = -0.06
#: Defaults of quality_rules(): trusted documents that are used at most, which bounds what is broadcast, and languages that are
#: balanced each, the rarer ones and rows without one as one more, which bounds what reaches the driver.
MOST_TRUSTED = 20_000
STRATA = 64
UNIT = 1_000_000

_SPACE = " \t\n\x0b\x0c\r"
_GAP = "[\\x20\\x09-\\x0D]+"


def word_list(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; none for null."""
    inner = F.btrim(text, F.lit(_SPACE))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAP))


def _bucket(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trusted_keys(labels: DataFrame, key: str = "doc_id", quality: str = "quality", most: int = MOST_TRUSTED) -> DataFrame:
    """Keys of documents labelled good (quality 1), at most `most`, by the lowest hashes."""
    good = labels.where(F.col(quality) == 1).select(F.col(key).alias("_trusted")).where("_trusted is not null").distinct()
    return good.orderBy(F.xxhash64("_trusted"), "_trusted").limit(most)


def _grams(docs: DataFrame, trusted: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """Rows (t, b) and the columns of more: each n-gram's bucket, and 1 if its document is trusted."""
    names = [f"_more{i}" for i in range(len(more))]
    carried = [c.alias(n) for c, n in zip(more, names, strict=True)]
    rows = docs.select(F.col(key).alias("_key"), word_list(F.col(text)).alias("_w"), *carried).join(F.broadcast(trusted), F.col("_key") == F.col("_trusted"), "left")
    hashes = rows.select(F.col("_trusted").isNotNull().cast("int").alias("t"), F.transform("_w", lambda w: F.xxhash64(w)).alias("h"), *names)
    pairs = hashes.select("t", F.explode(F.arrays_zip(F.col("h"), F.slice(F.col("h"), F.lit(2), F.size("h")).alias("after"))).alias("p"), *names).select("t", F.col("p.h").alias("x"), F.col("p.after").alias("y"), *names)
    return pairs.select("t", F.explode(F.array(_bucket(F.col("x")), F.when(F.col("y").isNotNull(), _bucket(F.col("x"), F.col("y"))))).alias("b"), *names).where("b is not null")


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> list[int]:
    """The log ratio of each bucket in millionths; all 0 if no trusted document has a word. BUCKETS rows reach the driver."""
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for b, n, t in _grams(docs, trusted, key, text).groupBy("b").agg(F.count("*"), F.sum("t")).collect():
        raw[b], good[b] = n, t
    return _ratios(raw, good)


def _ratios(raw: list[int], good: list[int]) -> list[int]:
    total, trusted_total = sum(raw) + BUCKETS, sum(good)
    if not trusted_total:
        return [0] * BUCKETS
    shares = [(n + 1) / total for n in raw]
    prior = PRIOR * BUCKETS
    return [round(UNIT * math.log((n + prior * p) / ((trusted_total + prior) * p))) for n, p in zip(good, shares, strict=True)]


def balanced_log_ratios(docs: DataFrame, trusted: DataFrame, lang: str, key: str = "doc_id", text: str = "text", strata: int = STRATA) -> tuple[list[int], list[int]]:
    """log_ratios(), and the same with trusted counts balanced by language. (strata + 1) * BUCKETS rows at most reach the driver."""
    frequent = [r[0] for r in docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("_lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(strata).collect()]
    places = F.create_map(*(F.lit(x) for pair in zip(frequent, range(1, strata + 1), strict=False) for x in pair)) if frequent else None
    stratum = F.coalesce(places[F.col(lang).cast("string")], F.lit(0)) if frequent else F.lit(0)
    raw, good = np.zeros((strata + 1, BUCKETS), np.int64), np.zeros((strata + 1, BUCKETS), np.int64)
    found = _grams(docs, trusted, key, text, stratum).groupBy("_more0", "b").agg(F.count("*").alias("n"), F.sum("t").alias("t")).toArrow()
    s, b = (found.column(c).to_numpy() for c in ("_more0", "b"))
    raw[s, b], good[s, b] = (found.column(c).to_numpy() for c in ("n", "t"))
    plain = _ratios(raw.sum(axis=0).tolist(), good.sum(axis=0).tolist())
    if not good.any():
        return plain, plain
    raw, good = raw[raw.any(axis=1)], good[raw.any(axis=1)]
    share, prior = raw.sum(axis=1) / raw.sum(), PRIOR * BUCKETS
    # Each language's trusted text and prior, as its raw text is distributed; then all languages by their raw shares.
    p = (raw + share[:, None]) / (raw.sum() + BUCKETS)
    ours = share[:, None] * (good + prior * p) / (good.sum(axis=1) + prior * share)[:, None]
    return plain, [round(UNIT * x) for x in np.log(ours.sum(axis=0) / p.sum(axis=0)).tolist()]


def _repeated_words(hashes: Column, n: Column) -> Column:
    """Words in windows of three that occur twice or more."""
    windows = F.when(n >= 3, F.transform(F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]).eqNullSafe(True) | (e["x"] == F.get(s, j + 1)["x"]).eqNullSafe(True))
        places = F.sort_array(F.transform(_let(placed, twice), lambda e: e["i"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
        add = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, add, lambda a: a["n"])

    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)))


def _score(hashes: Column, n: Column, ratios: list[int]) -> Column:
    return F.aggregate(_each(hashes, n, ratios), F.lit(0).cast("bigint"), lambda a, x: a + x)


def _scores(hashes: Column, n: Column, ratios: list[int], balanced: list[int]) -> Column:
    """_score() by either table, as a struct (score, balanced_score). Both ratios share one number, so each n-gram is looked up once."""
    high = lambda x: F.shiftright(x + F.lit(1 << 31), 32)
    low = lambda x: F.shiftright(F.shiftleft(x, 32), 32)
    total = lambda e, part: F.aggregate(e, F.lit(0).cast("bigint"), lambda a, x: a + part(x))
    each = _each(hashes, n, [(a << 32) + b for a, b in zip(ratios, balanced, strict=True)])
    return _let(each, lambda e: F.struct(total(e, high).alias("score"), total(e, low).alias("balanced_score")))


def _each(hashes: Column, n: Column, ratios: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")  # folded to one literal
    mask = F.lit(BUCKETS - 1)
    one = lambda x: F.get(table, F.xxhash64(x).bitwiseAND(mask).cast("int"))
    two = lambda x, i: F.get(table, F.xxhash64(x, F.get(hashes, i + 1)).bitwiseAND(mask).cast("int"))
    return F.transform(hashes, lambda x, i: one(x) + F.when(i + 1 < n, two(x, i)).otherwise(F.lit(0)))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    keep: list[str] | None = None,
    lang: str | None = None,
    most_trusted: int = MOST_TRUSTED,
    strata: int = STRATA,
) -> DataFrame:
    """Rows (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for every row of docs.

    labels has the key and quality (1: trusted). base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words.
    score is the mean log ratio of the document's words and word pairs; kept: not base_failed and score >= threshold.
    Null, empty or blank text: all counts 0, base_failed, score 0. Without trusted documents every score is 0. Repeated
    rows are judged each, alike. An empty table gives no rows. Other columns are not read. With keep, rows are
    the columns named there and the verdict, as common.unused("kept", keep), so that a filter needs no join.

    With lang, the name of a column of docs, rows also have balanced_score, the mean of log ratios balanced by that
    column, and plain_kept, the verdict by score; kept, also with keep, is then the verdict by balanced_score.

    The trusted multinomial is fitted on at most `most_trusted` documents; raw counts and verdicts cover all. The `strata` most frequent
    values of lang are balanced each, all others together: none is left out.
    """
    trusted = trusted_keys(labels, most=most_trusted)
    if lang is None:
        ratios = log_ratios(docs, trusted, key, text)
    else:
        ratios, balanced = balanced_log_ratios(docs, trusted, lang, key, text, strata)
        if keep is not None:
            ratios = balanced
    carried = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep or [])]
    names = [f"_keep{i}" for i in range(len(carried))]
    source = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *carried)
    worded = source.select("_key", "_text", *names, word_list(F.col("_text")).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    hashed = worded.select(
        "_key",
        *names,
        F.size("_w").alias("_n"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    n = F.col("_n")
    mean = lambda x: F.when(F.col("n_words") > 0, x / (F.lit(float(UNIT)) * (2 * F.col("n_words") - 1))).otherwise(F.lit(0.0))
    both = lang is not None and keep is None
    found = F.struct(
        n.cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeated_words(F.col("_h"), n).alias("n_repeat_words"),
        (_scores(F.col("_h"), n, ratios, balanced) if both else F.struct(_score(F.col("_h"), n, ratios).alias("score"))).alias("sums"),
    )
    # A generator, so that a filter on the verdict is not moved below and its arrays computed again for each element.
    judged = hashed.select("_key", *names, F.explode(F.array(found)).alias("_f")).select("_key", *names, "_f.*")
    judged = judged.select("*", *(mean(F.col(f"sums.{c}")).alias(c) for c in ("score", "balanced_score")[: 1 + both]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = (~failed & (F.col("balanced_score" if both else "score") >= threshold)).alias(common.unused("kept", keep or []))
    if keep is not None:
        return judged.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), verdict)
    plain = [F.col("balanced_score"), (~failed & (F.col("score") >= threshold)).alias("plain_kept")] if both else []
    return judged.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), verdict, "score", *plain,
    )
