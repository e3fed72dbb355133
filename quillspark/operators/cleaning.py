"""Cleaning of a corpus: scan errors, watermarks, template lines of a document and lines that many documents share; quality before and after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx

#: Words that scans get wrong, and the words they stand for.
CONFUSIONS = {"己经": "已经", "末来": "未来", "帐号": "账号", "登陆": "登录", "收溢": "收益", "年俩": "年限", "风验": "风险", "期现": "期限", "份客": "份额", "担供": "提供"}
#: A line of spaced-out characters, a page number, words of template lines, and marks that a header does not have.
WATERMARK = "^(?:[一-鿿]\\s){1,5}[一-鿿]$"
PAGE = "^(第\\s*\\d+\\s*页(?:\\s*[/共]\\s*\\d+\\s*页)?|[-—\\s]*\\d{1,3}[-—\\s]*)$"
HINTS = ("内部资料", "机密", "保密", "请勿外传", "样本", "仅供", "版权所有", "翻版必究")
MARKS = "[。；：:]"
#: What lowers quality, by how much each and at most: scan errors, template lines, empty sections; no source id, scanned text.
SUSPECT, TEMPLATE, EMPTY, NO_SOURCE, SCANNED = (0.02, 0.25), (0.01, 0.15), (0.02, 0.10), 0.05, 0.05
REPEATS, LONGEST, HINTED = 3, 40, 24
#: Documents that share a line, and characters of a line, from which and up to which it is a watermark of the corpus.
SHARED_BY, SHARED_CHARS = 10, 80


def suspects(text: Column) -> Column:
    """How many confused words and letters between digits a text has."""
    body = F.coalesce(text, F.lit(""))
    return reduce(lambda a, b: a + b, (F.regexp_count(body, F.lit(w)) for w in CONFUSIONS), fx.scan_suspects(text))


def clean_text(text: Column) -> Column:
    """Confused words and digits set right, lines of spaced-out characters dropped, white space tidied."""
    out = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), CONFUSIONS.items(), fx.repair_scan(text))
    lines = F.filter(F.split(out, "\n"), lambda x: ~F.btrim(x, F.lit(fx.STRIPPED)).rlike(WATERMARK))
    return fx.normalize_whitespace(F.array_join(lines, "\n"))


def header_like(line: Column) -> Column:
    return line.rlike(PAGE) | ~line.rlike(MARKS)


def template_lines(lines: Column) -> Column:
    """Of trimmed lines without blank ones, those that are templates: repeated short ones, and shorter ones with a template's word that look like a header."""
    repeated = fx.let(F.array_sort(F.filter(lines, lambda x: F.length(x) <= LONGEST)), lambda o: F.array_distinct(F.filter(o, lambda x, i: F.get(o, i + (REPEATS - 1)) == x)))
    hinted = lambda x: (F.length(x) <= HINTED) & x.rlike("|".join(HINTS)) & header_like(x)
    return F.filter(lines, lambda x: F.array_contains(repeated, x) | hinted(x))


def empty_sections(lines: Column) -> Column:
    """Of trimmed lines without blank ones, the headings that another heading or the end follows."""
    heading = lambda x: x.rlike("^#{1,6}\\s")
    return F.size(F.filter(lines, lambda x, i: heading(x) & heading(F.coalesce(F.get(lines, i + 1), F.lit("# ")))))


def quality(n_chars: Column, n_suspects: Column, n_template: Column, n_empty: Column, source: Column, scanned: Column) -> Column:
    """1 less the penalties, 0 at least; a text without characters has 0."""
    capped = lambda n, of: F.least(n * of[0], F.lit(of[1]))
    cost = F.when(n_chars == 0, 1.0).otherwise(0.0) + capped(n_suspects, SUSPECT) + capped(n_template, TEMPLATE) + capped(n_empty, EMPTY)
    cost = cost + F.when(F.coalesce(source, F.lit("")) == "", NO_SOURCE).otherwise(0.0) + F.when(scanned, SCANNED).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), 1.0 - cost), 6)


def shared_lines(docs: DataFrame, key: str, text: str = "text", least: int = SHARED_BY, longest: int = SHARED_CHARS) -> DataFrame:
    """Rows (line, n): header-like lines of at most `longest` characters that at least `least` documents have; a document counts once for each.

    Lines are counted in the tasks before they are shuffled, so a line of every document is no hot key.
    """
    own = F.array_distinct(F.filter(fx.split_paragraphs(F.col(text)), lambda x: (F.length(x) <= longest) & header_like(x)))
    return fx.exploded(docs, [key], own, "line").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def clean_corpus(docs: DataFrame, key: str, text: str = "text", source: str = "source", scanned: Column | None = None, least: int = SHARED_BY) -> DataFrame:
    """Rows (key, cleaned, n_template, n_shared, n_suspects, n_empty, score_before, score), one for every document; keys differ.

    Blank lines go, lines are trimmed; template lines and lines shared by many documents go; the rest is cleaned line by line. n_template, n_suspects,
    n_empty and score_before are of the text as it came, score of the cleaned one. Null text counts as empty.
    """
    scanned = F.lit(True) if scanned is None else scanned
    rows = docs.select(key, F.col(text).alias("_text"), F.col(source).alias("_source"), F.explode(F.array(fx.split_paragraphs(F.col(text)))).alias("_lines"))
    shared = shared_lines(docs, key, text, least)
    candidates = F.array_distinct(F.filter("_lines", lambda x: (F.length(x) <= SHARED_CHARS) & header_like(x)))
    # Only the shared lines that a document has come back to it.
    met = fx.exploded(rows, [key], candidates, "line").join(shared, "line").groupBy(key).agg(F.collect_set("line").alias("_shared"))
    none = F.array().cast("array<string>")
    both = fx.settled(rows.join(met, key, "left").withColumn("_shared", F.coalesce("_shared", none)).withColumn("_template", template_lines(F.col("_lines"))))
    left = F.filter("_lines", lambda x: ~F.array_contains("_template", x) & ~F.array_contains("_shared", x))
    gone = F.filter("_lines", lambda x: F.array_contains("_shared", x) & ~F.array_contains("_template", x))
    cleaned = both.withColumn("_left", F.filter(F.transform(left, clean_text), lambda x: x != "")).withColumn("_gone", F.size(gone).cast("long"))
    cleaned = fx.settled(cleaned).withColumn("cleaned", F.array_join("_left", "\n"))
    chars = lambda lines: F.length(F.array_join(lines, ""))
    before = quality(chars("_lines"), suspects(F.col("_text")), F.size("_template"), empty_sections(F.col("_lines")), F.col("_source"), scanned)
    after = quality(chars("_left"), suspects(F.col("cleaned")), F.size(template_lines(F.col("_left"))), empty_sections(F.col("_left")), F.col("_source"), scanned)
    return cleaned.select(
        key, "cleaned", F.size("_template").cast("long").alias("n_template"), F.col("_gone").alias("n_shared"), suspects(F.col("_text")).cast("long").alias("n_suspects"),
        empty_sections(F.col("_lines")).cast("long").alias("n_empty"), before.alias("score_before"), after.alias("score"),
    )
