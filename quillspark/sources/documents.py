"""Files of a document folder as rows: markdown, text, CSV tables, JSON records, question lists.

A file is one row (path, raw); parsing is column expressions and one window over a document's lines, so files spread
over the cluster. A file that cannot be parsed becomes a document with an issue, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fx
from ..operators.facts import stripped

#: Canonical field names and the spellings that count as them, in any case.
ALIASES = {
    "source_id": ("source_id", "资料编号", "文档编号", "编号", "id", "doc_no"), "title": ("title", "文档标题", "标题", "名称"),
    "doc_type": ("doc_type", "资料类型", "文档类型", "类型", "category"), "institution": ("institution", "机构名称", "机构", "公司", "org", "organization", "issuer"),
    "product": ("product", "产品名称", "产品", "product_name"), "product_code": ("product_code", "产品代码", "代码", "code"), "industry": ("industry", "行业", "所属行业", "sector"),
    "effective_date": ("effective_date", "生效日期", "发布日期", "日期", "date", "publish_date"), "version": ("version", "版本", "版本号", "ver"),
    "confidentiality": ("confidentiality", "密级", "保密级别", "security_level"), "region": ("region", "地区", "区域", "area"),
}
#: Formats by suffix, the document type of each where none is given, and the section title before any heading.
FORMATS = {"md": "markdown", "markdown": "markdown", "txt": "text", "csv": "csv", "json": "json"}
DEFAULT_TYPES = {"text": "OCR文本", "csv": "产品要素表", "json": "结构化记录"}
NO_SECTION = "正文"
_BREAK = r"\r\n|\r|\n"
_HEADING, _SEPARATES = r"^#{1,6}\s+.*$", r"^\s*\|?[\s:\-|]+\|[\s:\-|]*$"
_EMPTY = "map<string,string>"


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, raw) of the files directly in a folder, text as UTF-8 (invalid bytes replaced) without a byte order mark; other suffixes are left out.

    Spark does not schedule files of no bytes, so they give no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "").alias("raw"))
    return files.where(_suffix(F.col("path")).isin(*FORMATS))


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _stem(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), r"\+", "%2B"))


def map_fields(raw: Column) -> Column:
    """A map with canonical keys: known spellings renamed, the last of several wins, others as x_key, the first of several wins; blank values go."""
    known = F.create_map(*(F.lit(x) for name, spelled in ALIASES.items() for s in spelled for x in (s.lower(), name)))
    entries = F.filter(F.transform(F.map_entries(raw), lambda e: F.struct(stripped(e["key"]).alias("k"), stripped(e["value"]).alias("v"))), lambda e: F.coalesce(e["v"], F.lit("")) != "")
    named = F.transform(entries, lambda e: F.struct(F.coalesce(known[F.lower(e["k"])], F.concat(F.lit("x_"), e["k"])).alias("key"), e["v"].alias("value")))
    fold = lambda items, last: F.aggregate(items, F.array().cast("array<struct<key:string,value:string>>"), lambda a, e: F.when(F.exists(a, lambda x: x["key"] == e["key"]), F.transform(a, lambda x: F.when((x["key"] == e["key"]) & last(x), e).otherwise(x))).otherwise(F.array_append(a, e)))
    return F.map_from_entries(fold(named, lambda x: ~x["key"].startswith("x_")))


def _pairs(lines: Column) -> Column:
    """A map of `key: value` lines; lines without a colon, and comments, are left out; the last of equal keys wins."""
    told = F.filter(F.transform(lines, lambda x: stripped(x)), lambda x: x.contains(":") & ~x.startswith("#"))
    entries = F.transform(told, lambda x: F.struct(stripped(F.substring_index(x, ":", 1)).alias("key"), stripped(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    return F.map_from_entries(_last_of(entries))


def _last_of(entries: Column) -> Column:
    """entries without those whose key comes again."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + F.lit(2), F.size(entries)), lambda o: o["key"] == e["key"]))


def front_matter(raw: Column) -> tuple[Column, Column]:
    """(the key: value pairs between lines of three dashes at the very start, the text behind them); without them no pairs and all of the text."""
    pattern = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
    there = raw.rlike(pattern)
    meta = F.when(there, _pairs(F.split(F.regexp_extract(raw, pattern, 1), _BREAK))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return meta, F.when(there, F.regexp_replace(raw, pattern, "")).otherwise(raw)


def table_cells(line: Column) -> Column:
    """Cells of a markdown row, trimmed, bars at the edges dropped."""
    return F.transform(F.split(F.regexp_replace(stripped(line), r"^\|+|\|+$", ""), r"\|", -1), lambda c: stripped(c))


def sections(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, section_order, section_title, level, block_order, kind, text, rows) of markdown bodies (doc_id, body).

    A heading of one to six # begins a section; lines that begin with a bar make a table, other lines that are not blank a paragraph, each up to
    the next of another sort. A table's second line is left out if it only separates; rows without any text too. Sections without a block are
    not counted. Null bodies give no rows.
    """
    order = Window.partitionBy("doc_id").orderBy("at")
    lines = docs.select("doc_id", F.posexplode(F.split("body", _BREAK)).alias("at", "line"))
    heading = stripped(F.col("line")).rlike(_HEADING)
    sort = F.when(heading, "heading").when(stripped(F.col("line")) == "", "blank").when(stripped(F.col("line")).startswith("|"), "table").otherwise("paragraph")
    marked = lines.select("*", sort.alias("kind")).withColumn("new", (F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) != F.col("kind")) | (F.col("kind") == "heading")).cast("int"))
    text = stripped(F.col("line"))
    headed = marked.select(
        "doc_id", "at", "line", "kind", F.sum("new").over(order).alias("run"), F.sum((F.col("kind") == "heading").cast("int")).over(order).alias("sec"),
        F.last(F.when(F.col("kind") == "heading", F.struct(stripped(F.regexp_extract(text, r"^#{1,6}\s+(.*)$", 1)).alias("title"), F.length(F.regexp_extract(text, "^(#+)", 1)).alias("level"))), ignorenulls=True).over(order).alias("head"),
    )
    runs = headed.where(F.col("kind").isin("table", "paragraph")).groupBy("doc_id", "sec", "run", "kind").agg(F.first("head").alias("head"), F.sort_array(F.collect_list(F.struct("at", "line"))).alias("own"))
    own = F.transform("own", lambda x: x["line"])
    rows = F.filter(F.transform(F.filter(own, lambda x, i: ~((i == 1) & x.rlike(_SEPARATES))), table_cells), lambda c: F.exists(c, lambda x: x != ""))
    blocks = runs.select("doc_id", "sec", "run", "kind", "head", F.when(F.col("kind") == "table", F.concat_ws("\n", own)).otherwise(stripped(F.concat_ws("\n", own))).alias("text"), F.when(F.col("kind") == "table", rows).alias("rows"))
    blocks = blocks.where((F.col("kind") == "paragraph") | (F.size("rows") > 0))
    return blocks.select(
        "doc_id", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("sec")) - 1).alias("section_order"), F.coalesce("head.title", F.lit(NO_SECTION)).alias("section_title"), F.coalesce("head.level", F.lit(1)).alias("level"),
        (F.row_number().over(Window.partitionBy("doc_id", "sec").orderBy("run")) - 1).alias("block_order"), "kind", "text", "rows",
    )


def csv_rows(raw: Column) -> Column:
    """Cells of each line that is not blank, trimmed; quoted cells may hold commas and doubled quotes, but no line break."""
    cell = r'(?:^|(?<=,))(?:"((?:[^"]|"")*)"|([^,"]*))(?=,|$)'
    cells = lambda x: F.transform(F.regexp_extract_all(x, F.lit(cell), F.lit(0)), lambda c: stripped(F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')).otherwise(c)))
    return F.filter(F.transform(F.split(raw, _BREAK), cells), lambda r: F.exists(r, lambda c: c != ""))


def _titled(meta: Column, stem: Column) -> Column:
    return F.coalesce(meta["title"], stem)


def documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks) of files (path, raw); documents: (doc_id, source_id, title, path, fmt, meta, issues, raw), blocks as sections().

    Markdown titles: the first heading of one #, else the front matter's, else the file's name. CSV files: lines `#key: value` at the
    top are meta, the rest is one table. JSON files with a list `records`: one table of all keys in the order they first come, and one
    paragraph for each record; JSON with `faq` is no document, see faq(); other JSON neither. Values keep JSON's own spelling.
    """
    base = files.select("path", F.coalesce("raw", F.lit("")).alias("raw"), _stem(F.col("path")).alias("stem"), F.create_map(*(F.lit(x) for p in FORMATS.items() for x in p))[_suffix(F.col("path"))].alias("fmt"))
    # Files are told apart before they are parsed, so that no kind of block parses the others' files; tables and what records say come from one parsing.
    texts = sections(_parsed(base.where(F.col("fmt").isin("markdown", "text"))).select("doc_id", "body"))
    rows = _parsed(base.where(F.col("fmt").isin("csv", "json"))).where(F.size("issues") == 0)
    block = lambda order, kind, text, cells: F.struct(order.cast("int").alias("block_order"), F.lit(kind).alias("kind"), text.alias("text"), cells.cast("array<array<string>>").alias("rows"))
    keys = F.array_distinct(F.flatten(F.transform("records", lambda r: F.map_keys(r))))
    listed = fx.settled(rows.select("doc_id", "title", "fmt", "table", "records", keys.alias("keys")))
    there = lambda r, k: stripped(F.coalesce(r[k], F.lit("")))
    grid = F.concat(F.array("keys"), F.transform("records", lambda r: F.transform("keys", lambda k: there(r, k))))
    said = lambda r: F.concat_ws("；", F.transform(F.filter("keys", lambda k: there(r, k) != ""), lambda k: F.concat(k, F.lit(": "), r[k])))
    spoken = F.filter(F.transform("records", lambda r, i: block(i + 1, "paragraph", said(r), F.lit(None))), lambda x: x["text"] != "")
    ended = F.transform(spoken, lambda x: x.withField("text", F.concat(x["text"], F.lit("。"))))
    whole = F.array(block(F.lit(0), "table", F.lit(""), F.when(F.col("fmt") == "csv", F.col("table")).otherwise(grid)))
    own = F.when(F.col("fmt") == "csv", whole).otherwise(F.concat(whole, ended))
    tables = listed.select("doc_id", F.lit(0).alias("section_order"), F.col("title").alias("section_title"), F.lit(1).alias("level"), F.inline(own))
    shape = ("doc_id", "section_order", "section_title", "level", "block_order", "kind", "text", "rows")
    return _parsed(base).drop("body", "table", "records"), texts.select(*shape).unionByName(tables.select(*shape))


def tallies(files: DataFrame) -> DataFrame:
    """Rows (path, fmt, issue, n_blocks, n_tables), one for each document of documents(): how many blocks it has, without making any.

    Each file is counted by itself, in one pass and without a shuffle, also where two files name one source.
    """
    fmt, marked = F.col("fmt"), _is("markdown", "text")
    rows = files.select("path", F.coalesce("raw", F.lit("")).alias("raw"), F.create_map(*(F.lit(x) for p in FORMATS.items() for x in p))[_suffix(F.col("path"))].alias("fmt"))
    rows = fx.settled(rows.select("path", "fmt", F.when(marked, _line_kinds(front_matter(F.col("raw"))[1])).alias("kinds"), F.when(fmt == "csv", F.size(csv_rows(F.col("raw")))).alias("cells"), F.when(fmt == "json", F.from_json("raw", _EMPTY)).alias("payload")))
    rows = rows.where(~F.coalesce(F.map_contains_key("payload", "faq") | (F.col("payload").isNotNull() & ~F.map_contains_key("payload", "records")), F.lit(False)))
    rows = fx.settled(rows.select("path", "fmt", "kinds", "cells", F.from_json(F.col("payload")["records"], f"array<{_EMPTY}>").alias("records")))
    issue = F.coalesce((fmt == "csv") & (F.col("cells") == 0) | (fmt == "json") & (F.coalesce(F.size("records"), F.lit(-1)) <= 0), F.lit(False))
    # Records speak by the keys of all records, so none does where one of them is null.
    speaks = lambda r: F.exists(F.map_values(r), lambda v: stripped(F.coalesce(v, F.lit(""))) != "")
    spoken = F.when(F.exists("records", lambda r: r.isNull()), 0).otherwise(F.size(F.filter("records", speaks)))
    # A table that holds nothing has lines without a cell, and perhaps the one that separates, in its second place.
    tables = F.regexp_count("kinds", F.lit("[fes]+")) - F.regexp_count("kinds", F.lit("(?<![fes])es?e*(?![fes])"))
    n_tables = F.when(marked, tables).when(fmt.isin("csv", "json") & ~issue, 1).otherwise(0)
    others = F.when(marked, F.regexp_count("kinds", F.lit("p+"))).when((fmt == "json") & ~issue, spoken).otherwise(0)
    return rows.select("path", "fmt", issue.alias("issue"), (n_tables + others).cast("long").alias("n_blocks"), n_tables.cast("long").alias("n_tables"))


def _is(*names: str) -> Column:
    return F.coalesce(F.col("fmt").isin(*names), F.lit(False))


def _line_kinds(body: Column) -> Column:
    """A letter for each line of a markdown body, as sections() tells them apart: h heading, b blank, p paragraph; in tables s for a line that separates, e without text, f other."""
    lines = F.transform(F.split(body, _BREAK), lambda x: F.struct(x.alias("line"), stripped(x).alias("bare")))
    cells = lambda x: F.when(~F.exists(table_cells(x["line"]), lambda c: c != ""), "e").when(x["line"].rlike(_SEPARATES), "s").otherwise("f")
    sort = lambda x: F.when(x["bare"] == "", "b").when(x["bare"].startswith("|"), cells(x)).when(x["bare"].startswith("#") & x["bare"].rlike(_HEADING), "h").otherwise("p")
    return F.array_join(F.transform(lines, sort), "")


def _parsed(base: DataFrame) -> DataFrame:
    """Rows (doc_id, source_id, title, path, fmt, meta, issues, raw, body, table, records) of files (path, raw, stem, fmt)."""
    payload = F.when(F.col("fmt") == "json", F.from_json("raw", _EMPTY))
    front, body = front_matter(F.col("raw"))
    cells = F.when(F.col("fmt") == "csv", csv_rows(F.col("raw")))
    rows = fx.settled(base.select("*", payload.alias("payload"), front.alias("front"), body.alias("body"), cells.alias("cells")))
    rows = rows.where(~F.coalesce(F.map_contains_key("payload", "faq") | (F.col("payload").isNotNull() & ~F.map_contains_key("payload", "records")), F.lit(False)))
    # CSV: comment lines up to the first that is none.
    first = F.coalesce(F.array_position(F.transform("cells", lambda r: ~r[0].startswith("#")), True) - 1, F.lit(0)).cast("int")
    comments = F.when(F.col("fmt") == "csv", F.slice("cells", 1, F.when(first >= 0, first).otherwise(F.size("cells"))))
    told = F.transform(comments, lambda r: F.regexp_replace(stripped(r[0]), r"^#+\s*", ""))
    records = F.from_json(F.col("payload")["records"], f"array<{_EMPTY}>")
    plain = F.map_filter("payload", lambda k, v: (k != "records") & ~v.rlike(r"^\s*[\[{]"))
    raw_meta = F.when(F.col("fmt") == "csv", _pairs(told)).when(F.col("fmt") == "json", F.coalesce(plain, F.create_map().cast(_EMPTY))).otherwise(F.col("front"))
    meta = map_fields(raw_meta)
    kind = F.create_map(*(F.lit(x) for p in DEFAULT_TYPES.items() for x in p))[F.col("fmt")]
    rows = fx.settled(rows.select("*", meta.alias("own"), F.slice("cells", F.size(comments) + 1, F.size("cells")).alias("table"), records.alias("records")))
    full = F.when(kind.isNotNull() & ~F.map_contains_key("own", "doc_type"), F.map_concat("own", F.create_map(F.lit("doc_type"), kind))).otherwise(F.col("own"))
    issue = F.when((F.col("fmt") == "csv") & (F.size("cells") == 0), "解析失败：CSV 为空").when((F.col("fmt") == "json") & F.col("payload").isNull(), "解析失败：JSON").when((F.col("fmt") == "json") & (F.coalesce(F.size("records"), F.lit(-1)) <= 0), "解析失败：JSON 缺少 records 列表")
    rows = rows.select("path", "raw", "stem", "fmt", F.when(issue.isNull(), full).otherwise(F.create_map().cast(_EMPTY)).alias("meta"), "body", "table", "records", issue.alias("issue"))
    source = F.coalesce(F.col("meta")["source_id"], F.col("stem"))
    top = F.nullif(stripped(F.regexp_extract("body", r"(?m)^[^\S\n]*#[^\S\n]+(.*)$", 1)), F.lit(""))
    title = F.when(F.col("fmt") == "markdown", F.coalesce(top, _titled(F.col("meta"), F.col("stem")))).otherwise(_titled(F.col("meta"), F.col("stem")))
    return rows.select(source.alias("doc_id"), source.alias("source_id"), title.alias("title"), "path", "fmt", "meta", F.array_compact(F.array("issue")).alias("issues"), "raw", "body", "table", "records")


def faq(files: DataFrame) -> DataFrame:
    """Rows (path, faq_id, question, answer, category, updated_at, source_id) of JSON files with a list `faq`; entries without question or answer go.

    An entry without an id is named by its place in the list, so what is left out leaves a gap.
    """
    listed = files.where(_suffix(F.col("path")) == "json").select("path", F.from_json(F.from_json("raw", _EMPTY)["faq"], f"array<{_EMPTY}>").alias("faq"))
    rows = listed.select("path", F.posexplode("faq").alias("at", "e"))
    text = lambda name: stripped(F.coalesce(F.col("e")[name], F.lit("")))
    named = F.coalesce(F.nullif(F.col("e")["faq_id"], F.lit("")), F.format_string("FAQ-%03d", F.col("at") + 1))
    return rows.select("path", named.alias("faq_id"), *(text(n).alias(n) for n in ("question", "answer", "category", "updated_at", "source_id"))).where("question <> '' and answer <> ''")


def sidecar_text(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (path, text, page_count, confidence) of images (path) with a text file of the same name beside them: a form feed ends a page."""
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    told = texts.where(_suffix(F.col("path")) == "txt").select(base.alias("_base"), F.col("raw").alias("text"))
    return images.withColumn("_base", base).join(told, "_base").select("path", "text", F.size(F.split("text", "\f")).alias("page_count"), F.lit(0.99).alias("confidence"))


def locate(docs: DataFrame, source_id: str, needle: str) -> DataFrame:
    """The document of that source id if its text has the needle, with the place of its first character (from 0)."""
    return docs.where((F.col("source_id") == source_id) & F.col("raw").contains(needle)).select("*", (F.locate(needle, F.col("raw")) - 1).alias("at"))


def section_text(blocks: DataFrame, keyword: str) -> DataFrame:
    """Rows (doc_id, section_title, text): each document's first section whose title has the keyword, its blocks a line break apart."""
    found = blocks.where(F.col("section_title").contains(keyword)).groupBy("doc_id", "section_order", "section_title").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("block_order", "text"))), lambda x: x["text"])).alias("text"))
    return found.groupBy("doc_id").agg(F.min_by(F.struct("section_title", "text"), "section_order").alias("s")).select("doc_id", "s.section_title", "s.text")
