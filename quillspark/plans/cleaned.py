"""Corpus cleaning over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import cleaning
from ..session import spread_table

#: Documents of one source stand for scans.
SCANS = "src2"


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.shared_lines(spread_table(spark, sf_dir, "documents"), "doc_id")


def cleaned_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    return cleaning.clean_corpus(docs, "doc_id", scanned=F.coalesce(F.col("_source") == SCANS, F.lit(False)))


QUERIES = {"shared_lines": shared_lines, "cleaned_corpus": cleaned_corpus}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_PARAGRAPHS = lambda c: f"list_filter(list_transform(string_split(coalesce({c}, ''), chr(10)), lambda s: trim(s, {_BLANKS})), lambda s: s <> '')"
_HEADER = lambda x: f"(regexp_matches({x}, '{cleaning.PAGE}') OR NOT regexp_matches({x}, '{cleaning.MARKS}'))"
_CANDIDATES = lambda ls: f"list_distinct(list_filter({ls}, lambda x: length(x) <= {cleaning.SHARED_CHARS} AND {_HEADER('x')}))"
_HINTED = lambda x: f"(length({x}) <= {cleaning.HINTED} AND regexp_matches({x}, '{'|'.join(cleaning.HINTS)}') AND {_HEADER(x)})"
_HEADING = lambda x: f"regexp_matches({x}, '^#{{1,6}}\\s')"
_EMPTY = lambda ls: f"len(list_filter({ls}, lambda x, i: {_HEADING('x')} AND {_HEADING(f'coalesce({ls}[i + 1], chr(35) || chr(32))')}))"


def _suspects(c: str) -> str:
    words = " + ".join(f"((length({c}) - length(replace({c}, '{w}', ''))) // 2)" for w in cleaning.CONFUSIONS)
    # Letters between digits become a mark, twice as matches may share a digit; the marks are counted.
    marked = lambda p: f"regexp_replace(regexp_replace({c}, '(\\d){p}(\\d)', '\\1' || chr(1) || '\\2', 'g'), '(\\d){p}(\\d)', '\\1' || chr(1) || '\\2', 'g')"
    letters = " + ".join(f"(length({marked(p)}) - length(replace({marked(p)}, chr(1), '')))" for p, _ in fx.SCAN_DIGITS)
    return f"({words} + {letters})"


def _cleaned(c: str) -> str:
    for pattern, digit in fx.SCAN_DIGITS:
        # Twice: matches may share a digit.
        c = f"regexp_replace(regexp_replace({c}, '(\\d){pattern}(\\d)', '\\1{digit}\\2', 'g'), '(\\d){pattern}(\\d)', '\\1{digit}\\2', 'g')"
    for wrong, right in cleaning.CONFUSIONS.items():
        c = f"replace({c}, '{wrong}', '{right}')"
    c = f"CASE WHEN regexp_matches(trim({c}, {_BLANKS}), '{cleaning.WATERMARK}') THEN '' ELSE {c} END"
    return f"trim(regexp_replace(replace(replace({c}, chr(160), ' '), chr(12288), ' '), '[ \\t\\r\\f\\x0b]+', ' ', 'g'), {_BLANKS})"


def _quality(lines: str, suspects: str, template: str, empty: str) -> str:
    return f"""round(greatest(0, 1 - (CASE WHEN length(array_to_string({lines}, '')) = 0 THEN 1.0::DOUBLE ELSE 0 END + least({suspects} * 0.02::DOUBLE, 0.25::DOUBLE) + least({template} * 0.01::DOUBLE, 0.15::DOUBLE) + least({empty} * 0.02::DOUBLE, 0.10::DOUBLE)
      + CASE WHEN coalesce(source, '') = '' THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN coalesce(source = '{SCANS}', FALSE) THEN 0.05::DOUBLE ELSE 0 END)), 6)"""


_SHARED = f"""l AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text, {_PARAGRAPHS('text')} AS ls FROM documents),
  sh AS MATERIALIZED (SELECT line, count(*) AS n FROM (SELECT doc_id, unnest({_CANDIDATES('ls')}) AS line FROM l) GROUP BY line HAVING count(*) >= {cleaning.SHARED_BY})"""
ORACLE_SQL = {
    "shared_lines": f"WITH {_SHARED} SELECT line, n FROM sh",
    "cleaned_corpus": f"""WITH {_SHARED}, x AS MATERIALIZED (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM l),
      j AS MATERIALIZED (SELECT doc_id, i, x, sh.line IS NOT NULL AS shared, (length(x) <= {cleaning.LONGEST} AND count(*) OVER (PARTITION BY doc_id, x) >= {cleaning.REPEATS}) OR {_HINTED('x')} AS template FROM x LEFT JOIN sh ON x = line),
      c AS MATERIALIZED (SELECT doc_id, i, x FROM (SELECT doc_id, i, {_cleaned('x')} AS x FROM j WHERE NOT shared AND NOT template) WHERE x <> ''),
      u AS (SELECT doc_id, count(*) FILTER (WHERE (length(x) <= {cleaning.LONGEST} AND k >= {cleaning.REPEATS}) OR {_HINTED('x')}) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM c) GROUP BY doc_id),
      r AS (SELECT doc_id, list(x ORDER BY i) AS rest FROM c GROUP BY doc_id),
      n AS (SELECT doc_id, count(*) FILTER (WHERE template) AS n_template, count(*) FILTER (WHERE shared AND NOT template) AS n_shared FROM j GROUP BY doc_id),
      g AS MATERIALIZED (SELECT l.doc_id, source, text, ls, coalesce(rest, []) AS rest, coalesce(n_template, 0) AS nt, coalesce(n_shared, 0) AS ns, coalesce(u.n, 0) AS na, array_to_string(coalesce(rest, []), chr(10)) AS cleaned
        FROM l LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN u USING (doc_id))
      SELECT doc_id, cleaned, nt AS n_template, ns AS n_shared, {_suspects('text')}::BIGINT AS n_suspects, {_EMPTY('ls')} AS n_empty,
        {_quality('ls', _suspects('text'), 'nt', _EMPTY('ls'))} AS score_before, {_quality('rest', _suspects('cleaned'), 'na', _EMPTY('rest'))} AS score FROM g""",
}
