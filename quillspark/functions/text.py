"""Text functions as Spark columns: normalising, tokens, sentences, masking, set likeness."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Punctuation that counts as a space when tokens are made.
CJK_PUNCTUATION = "，。、；：？！（）《》“”‘’【】—…·　"
#: What is masked, in this order; the last four characters stay.
MASKS = (
    ("ID", r"\b\d{17}[\dXx]\b"),
    ("PHONE", r"\b1[3-9]\d{9}\b"),
    ("BANK", r"\b\d{16,19}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
)
#: Token patterns.
CJK_RUN = "[一-鿿]+"
ASCII_WORD = r"[A-Za-z0-9](?:[A-Za-z0-9_%.\-]*[A-Za-z0-9])?"  # a run of word characters without . - _ % at either end
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d+"
CLAUSE = "第\\s*[0-9一二三四五六七八九十百零]+\\s*条(?:之[一二三四五六七八九十])?"
DOTTED_CLAUSE = r"\b\d+(?:\.\d+){1,3}\b"
CODE = r"\b[A-Z]{2,}[A-Z0-9]*(?:-\d{2,})+\b"
#: CODE for Java: what a run has taken it does not give back, as a hyphen must follow.
_CODE = r"\b[A-Z]{2,}+[A-Z0-9]*+(?:-\d{2,})+\b"
#: Line ends of the white-space rules.
BLANKS = "[ \\t\\r\\f\\x0b]+"
STRIPPED = " \t\n\r\x0b\x0c"


#: BLANKS but for single spaces, which would be replaced by themselves.
_BLANKS_TO_CHANGE = " [ \\t\\r\\f\\x0b]+|[\\t\\r\\f\\x0b][ \\t\\r\\f\\x0b]*"


def _tidied(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(text, _BLANKS_TO_CHANGE, " "), "\\n{3,}", "\n\n"), F.lit(STRIPPED))


def _base(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " ﻿​", " ")


def normalize_text(text: Column) -> Column:
    """For tokens: CJK punctuation becomes a space, blanks single, three or more line ends two, trimmed."""
    return _tidied(F.translate(_base(text), CJK_PUNCTUATION, " " * len(CJK_PUNCTUATION)))


def normalize_whitespace(text: Column) -> Column:
    """For display: only white space changes."""
    return _tidied(F.translate(_base(text), "　", " "))


def ascii_words(normal: Column) -> Column:
    """Lower-case words without . - _ % at either end; repeated words stay repeated."""
    return F.transform(F.regexp_extract_all(normal, F.lit(ASCII_WORD), F.lit(0)), F.lower)


def cjk_grams(normal: Column) -> Column:
    """Each character of a CJK run and each two neighbours in it."""
    runs = F.regexp_extract_all(normal, F.lit(CJK_RUN), F.lit(0))

    def grams(run: Column) -> Column:
        single = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))
        double = F.when(F.length(run) >= 2, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(single, double)

    return F.flatten(F.transform(runs, grams))


def let(value: Column, use) -> Column:
    """use(value) with value computed once, also where use needs it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _absent(base: Column, more: Column) -> Column:
    """base with those of more that it lacks, each once."""
    return F.concat(base, F.array_except(more, base))


def tokenize(text: Column, clauses: bool = True) -> Column:
    """CJK grams, words, then numbers, and with clauses also clause references and codes, where not there yet."""
    plain = lambda x: F.replace(x, F.lit(","), F.lit(""))
    parts = lambda x: F.when(F.contains(x, F.lit(".")), F.array(x, F.substring_index(x, ".", 1))).otherwise(F.array(x))

    def numbered(n: Column, base: Column) -> Column:
        # A number that is new brings its integer part along.
        fresh = F.array_except(F.transform(F.regexp_extract_all(n, F.lit(NUMBER), F.lit(0)), plain), base)
        return _absent(base, F.flatten(F.transform(fresh, parts)))

    def coded(n: Column, base: Column) -> Column:
        extra = F.concat(
            F.transform(F.regexp_extract_all(n, F.lit(CLAUSE), F.lit(0)), lambda x: F.replace(x, F.lit(" "), F.lit(""))),
            F.regexp_extract_all(n, F.lit(DOTTED_CLAUSE), F.lit(0)),
            F.transform(F.regexp_extract_all(F.upper(n), F.lit(_CODE), F.lit(0)), F.lower),
        )
        return _absent(base, extra)

    def all_of(n: Column) -> Column:
        found = let(F.concat(cjk_grams(n), ascii_words(n)), lambda base: numbered(n, base))
        return let(found, lambda base: coded(n, base)) if clauses else found

    return let(normalize_text(text), all_of)


def split_sentences(text: Column) -> Column:
    """Sentences of each line, cut after 。！？；!?; and trimmed."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, "(?<=[。！？；!?;])")))
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(STRIPPED))), lambda s: s != "")


def split_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.btrim(s, F.lit(STRIPPED))), lambda s: s != "")


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def first_sentence(text: Column, limit: int = 120) -> Column:
    return truncate(F.coalesce(F.get(split_sentences(text), F.lit(0)), F.lit("")), limit)


#: MASKS with the last four characters of a match as a group.
_TAILS = (
    ("ID", r"\b\d{14}(\d{3}[\dXx])\b"),
    ("PHONE", r"\b1[3-9]\d{5}(\d{4})\b"),
    ("BANK", r"\b\d{12,15}(\d{4})\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@(?=[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b)[A-Za-z0-9.-]*([A-Za-z0-9.-]{4})(?<=\.[A-Za-z]{2,64})\b"),
)


def mask_sensitive(text: Column) -> Column:
    """Identity numbers, phones, cards and mail addresses become [KIND:****tail], tail the last four characters."""
    out = F.coalesce(text, F.lit(""))
    for label, pattern in _TAILS:
        out = F.regexp_replace(out, pattern, f"[{label}:****$1]")
    return out


def amount_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def shingles(tokens: Column, n: int = 2) -> Column:
    """Distinct joins of n neighbouring tokens; of fewer tokens, the tokens themselves."""

    def of(t: Column) -> Column:
        # Neighbours by their places: a slice for each would copy the array every time.
        joined = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat(*(F.get(t, i + k) for k in range(n))))
        return F.array_distinct(F.when(F.size(t) >= n, joined).otherwise(t))

    return let(tokens, of)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two token arrays; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of both shares of common distinct tokens; 0 without any."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(both == 0, F.lit(0.0)).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def settled(df):
    """df behind a generator: columns are computed once, where the optimizer would compute them again for each element of a lambda that reads them."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_settled")).select("_settled.*")


def exploded(df, keep: list, array: Column, name: str):
    """Rows of df's columns keep with one element of array each.

    The outer generator keeps the optimizer from adding a filter on the array's size below, which would
    compute the array twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def pos_exploded(df, keep: list, array: Column, pos: str, name: str):
    """exploded() with each element's position, from 0."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(name).isNotNull())


def digest(text: Column, limit: int = 60) -> Column:
    """A short hash and a preview."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")
    return F.concat(F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(12)), F.lit(":"), truncate(flat, limit))


#: Letters that scans confuse with digits, between two digits.
SCAN_DIGITS = (("[Oo]", "0"), ("[lI]", "1"), ("[Ss]", "5"), ("[Bb]", "8"))


def repair_scan(text: Column) -> Column:
    """Letters between digits that stand for digits."""
    out = F.coalesce(text, F.lit(""))
    for pattern, digit in SCAN_DIGITS:
        out = F.regexp_replace(out, f"(?<=\\d){pattern}(?=\\d)", digit)
    return out


def scan_suspects_apart(text: Column) -> Column:
    """Letters between two digits of their own, so `1O2O3` has one where scan_suspects finds two; null of null."""
    return reduce(lambda a, b: a + b, (F.regexp_count(text, F.lit(f"\\d{pattern}\\d")) for pattern, _ in SCAN_DIGITS))


def scan_suspects(text: Column) -> Column:
    total = F.lit(0)
    for pattern, _ in SCAN_DIGITS:
        total = total + F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?<=\\d){pattern}(?=\\d)"))
    return total


def stable_hash(text: Column, size: int = 8) -> Column:
    """The BLAKE2b hash of `size` bytes in hex; null counts as empty. Spark has no such function: Arrow batches of the column alone."""

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.blake2b((v or "").encode(), digest_size=size).hexdigest() for v in values.to_pylist()], pa.string())

    return run(text)


def preview(value: Column, most: int = 240) -> Column:
    """A value as JSON text with single spaces, cut to `most` characters."""
    return F.left(F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r"\s+", " "), F.lit(most))


def json_object(text: Column) -> Column:
    """The JSON object between the first and the last brace of a text, such as a model's reply; null if there is none that parses."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def looks_like_header(line: Column) -> Column:
    """Whether a short line is a page number, or has no mark that ends or parts a sentence."""
    bare = F.btrim(line)
    return bare.rlike(r"^第?\s*\d+\s*(页|/\s*\d+)?$") | ~bare.rlike("[。！？；，.!?;,]")


def strip_boilerplate(text: Column, least: int = 3, longest: int = 40) -> Column:
    """The text without lines of at most `longest` characters that it repeats `least` times or more and that look like headers.

    Lines are grouped by sorting them once, so a long text costs its lines times their logarithm.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    ordered = F.array_sort(F.filter(F.transform(lines, lambda x: F.btrim(x)), lambda x: (x != "") & (F.length(x) <= longest)))
    repeated = let(ordered, lambda o: F.array_distinct(F.filter(o, lambda x, i: F.get(o, i + (least - 1)) == x)))
    return let(F.filter(repeated, lambda x: looks_like_header(x)), lambda r: F.array_join(F.filter(lines, lambda x: ~F.array_contains(r, F.btrim(x))), "\n"))
