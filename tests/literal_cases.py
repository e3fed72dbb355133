"""Cases of literal rows: each function's result against the rows that it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import assembly, questions, reviews
from quillspark.operators import facts as ops
from quillspark.sources import documents


QUESTIONS = (
    (1, "请问私募基金合格投资者的准入条件是什么？"), (2, "有没有类似的处罚案例"), (3, "前五大客户集中度怎么算，比例是多少？"), (4, "第 三 条怎么理解"), (5, "产品 ABX-2024-01 的费率"),
    (6, "你好"), (7, "2023年的适当性管理办法有哪些要求"), (8, "示例集团2024年之后的收益"), (9, "2022 年之前处罚过谁"), (10, None), (11, "规定 多少"),
)

EVIDENCE = (
    (1, "合格投资者 门槛 是多少", "E1", "text", "合格投资者的门槛为净资产三百万元。短句。与此无关的另一段文字没有共同内容XYZ。"),
    (1, "合格投资者 门槛 是多少", "E2", "text", "合格投资者的门槛为净资产三百万元。合格投资者应当具备两年以上投资经历。"),
    (1, "合格投资者 门槛 是多少", "E3", "table", "投资者: 合格投资者；门槛: 300万元。"),
    (2, "nothing in common", "E9", "text", "完全不相干的一句话在这里。"),
)

SOURCES = (("E1", "甲 · 办法", "S-1", "2024-01-01", "V2"), ("E2", "乙 · 细则", "S-2", "2023-05-01", ""), ("E3", "丙 · 表", "S-3", "2022-01-01", None))

ANSWERS = (
    (1, "【结论】\n合格投资者的门槛为净资产 300 万元 [1]\n【出处与时效】\n[1] 2020 年 9999", "合格投资者 门槛", ["合格投资者的门槛为净资产300万元。"], ["合格投资者", "门槛", "缺失"]),
    (2, "销售额增长到 4567 万元。", "销售额", ["销售额没有披露。"], []),
    (3, "", "x", None, None),
)

def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "id int, question string")


def question_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions.plan(_questions(spark), "id", "question")
    return rows.select("id", "route", F.concat_ws("|", "queries").alias("queries"), "bm25", "dense", "sparse", "years.year_gte", "years.year_lte", "years.year", "years.promotable", questions.promoted_year(F.col("years"), [2023]).alias("hard_year"))


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*map(F.lit, ("甲乙科技股份有限公司", "示例银行", "丙集团有限公司")))
    rows = spark.createDataFrame([("甲乙科技",), ("甲乙科技有限公司",), ("示例银行股份有限公司",), ("丙公司",), ("不存在公司",), ("",)], "asked string")
    return rows.select("asked", questions.core_name(F.col("asked")).alias("core"), questions.resolved_company(F.col("asked"), known).alias("resolved"), F.concat_ws(",", questions.unknown_names(F.array("asked"), known)).alias("unknown"))


def extracted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = spark.createDataFrame(list(EVIDENCE), "query int, question string, evidence_id string, kind string, text string")
    sources = spark.createDataFrame(list(SOURCES), "evidence_id string, label string, source_id string, updated_at string, version string")
    return assembly.extracted_answers(assembly.citations(assembly.chosen_sentences(evidence, "query"), "query"), sources, "query")


def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(ANSWERS), "id int, answer string, question string, evidence array<string>, phrases array<string>")
    out = assembly.faithfulness(rows, "answer", "question", "evidence")
    return out.select("id", F.concat_ws(",", "unsupported_numbers").alias("unsupported"), "support_rate", "faithful", F.round(assembly.keyphrase_coverage(F.col("answer"), F.col("phrases")), 6).alias("coverage"))


FAQS = (
    ("合格投资者门槛是多少", "合格投资者的门槛", 0.8, 0.5, 0.7), ("产品A12的费率", "产品A13的费率", 0.9, 0.8, 0.95), ("产品A12的费率", "产品A12费率是多少", 0.9, 0.6, 0.9), ("天气", "合格投资者的门槛", 0.0, 0.0, -0.3),
)

def faq_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(FAQS), "asked string, stored string, coverage double, likeness double, cosine double")
    return questions.faq_answers(questions.faq_scores(rows), "asked", "stored").select("asked", "stored", "score", "rank")


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.corpus_stats(*parsed(spark)).withColumn("formats", F.concat_ws(",", "formats"))


_FALSE = "NULL::INT, NULL::INT, NULL::INT, FALSE, NULL::INT"

#: Small files of every format: path and text.
FILES = (
    ("/data/rules.md", "---\n资料编号: R-1\n机构: 甲行\n# comment\nno colon\nx: y: z\n---\n前言\n第二行\n\n# 规则\n| A | B |\n| --- | :-: |\n| 1 | 2 |\n|  |  |\n尾段\n## 空节\n## 末节\n只有一段\n"),
    ("/data/scan.txt", "---\ntitle: 扫描件\n---\n正文一\n# 章\n正文二"),
    ("/data/table.csv", '#编号: T-9\n# 版本 : v2\n代码,名称\nP1,"甲, 乙"\n\nP2,"a ""b"""\n,\n'),
    ("/data/empty.csv", "\n \n"),
    ("/data/records.json", '{"标题": "产品库", "records": [{"code": "P1", "rate": 1.50}, {"code": "P2", "name": "乙", "rate": ""}], "extra": {"a": 1}}'),
    ("/data/none.json", '{"records": []}'),
    ("/data/faq.json", '{"faq": [{"question": "问?", "answer": " 答 "}, {"question": "", "answer": "x"}, {"faq_id": "F-7", "question": "q", "answer": "a", "category": "c"}, {"question": "三", "answer": "3"}]}'),
    ("/data/other.json", '{"a": 1}'),
    ("/data/plain.md", "没有标题"),
)

def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILES), "path string, raw string")


def parsed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return documents.documents(_files(spark))


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = documents.documents(_files(spark))
    meta = F.concat_ws(";", F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))
    return docs.select("doc_id", "title", "fmt", meta.alias("meta"), F.concat_ws(";", "issues").alias("issues"))


def ingest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, blocks = documents.documents(_files(spark))
    rows = F.concat_ws("/", F.transform("rows", lambda r: F.concat_ws(",", r)))
    return blocks.select("doc_id", "section_order", "section_title", "level", "block_order", "kind", F.when(F.col("kind") == "table", rows).otherwise(F.col("text")).alias("content"))


def ingest_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.faq(_files(spark)).drop("path")


#: Reports as text: heads with other year columns, a unit column or none, placeholders, short rows, aliases, a bar in prose.
FILINGS = (
    ("D1", "甲公司", "A-2024", "# 年报\n## 主要指标\n| 指标 | 2024年 | 2023年 | 单位 |\n| --- | :--: | --- | --- |\n| 营收 | 1,200.5 | 1,000 | 万元 |\n| 净利 | -30 | — | 万元 |\n| --- | --- | --- | --- |\n| 不良率 | 1.42% | 1.5％ | % |\n| 商誉 | 5\n正文 A | B\n| 序号 | 数值 |\n| - | - |\n| 1 | 2 |"),
    ("D2", "乙公司", "B-2024", "| 指标 | 2024年前三季度 | 备注 |\n|---|---|---|\n| 总资产 | 99 | x |\n|  | 7 | y |\n# 附录\n| 非表头 | 2020年 |\n| 指标 | 2022 年 | 2021年 |\n| -- | -- | -- |\n| 毛利 | 3e2 | N/A |\n| 应收 | 12a | +4.5 |"),
    ("D3", "丙公司", "C-2024", None),
    ("D4", "丁公司", "D-2024", ""),
)

def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(d, c, s, t) for d, c, s, t in FILINGS], "doc_id string, company string, source_id string, raw string")
    return ops.table_facts(docs)


CASES = {"company_names": company_names, "extracted_answers": extracted_answers, "answer_report": answer_report, "faq_hits": faq_hits, "ingest_stats": ingest_stats, "question_plan": question_plan, "ingest_documents": ingest_documents, "ingest_blocks": ingest_blocks, "ingest_faq": ingest_faq, "table_facts": table_facts}
ROWS = {
    "faq_hits": "SELECT * FROM (VALUES ('合格投资者门槛是多少', '合格投资者的门槛', 0.755::DOUBLE, 1), ('产品A12的费率', '产品A12费率是多少', 0.9::DOUBLE, 1)) v(asked, stored, score, rank)",
    "ingest_stats": "SELECT 7::BIGINT AS n_documents, 2::BIGINT AS n_issues, 'csv,json,markdown,text' AS formats, 11::BIGINT AS n_blocks, 3::BIGINT AS n_tables",
    "question_plan": f"""SELECT * FROM (VALUES
        (1, 'clause', '请问私募基金合格投资者的准入条件是什么？|私募基金合格投资者的准入条件', 0.55::DOUBLE, 0.20::DOUBLE, 0.25::DOUBLE, {_FALSE}), (2, 'case', '有没有类似的处罚案例', 0.20, 0.55, 0.25, {_FALSE}),
        (3, 'metric', '前五大客户集中度怎么算，比例是多少？|前五大客户集中度怎么算，比例是多少', 0.35, 0.30, 0.35, {_FALSE}), (4, 'clause', '第 三 条怎么理解|第三条', 0.55, 0.20, 0.25, {_FALSE}),
        (5, 'clause', '产品 ABX-2024-01 的费率|ABX-2024-01', 0.55, 0.20, 0.25, NULL, NULL, 2024, FALSE, NULL), (6, 'general', '你好', 0.34, 0.33, 0.33, {_FALSE}),
        (7, 'clause', '2023年的适当性管理办法有哪些要求|2023年的适当性管理办法要求', 0.55, 0.20, 0.25, NULL, NULL, 2023, TRUE, 2023), (8, 'metric', '示例集团2024年之后的收益', 0.35, 0.30, 0.35, 2024, NULL, NULL, FALSE, NULL),
        (9, 'case', '2022 年之前处罚过谁', 0.20, 0.55, 0.25, NULL, 2022, NULL, FALSE, NULL), (10, 'general', '', 0.34, 0.33, 0.33, {_FALSE}), (11, 'clause', '规定 多少', 0.55, 0.20, 0.25, {_FALSE})
        ) v(id, route, queries, bm25, dense, sparse, year_gte, year_lte, year, promotable, hard_year)""",
    "company_names": """SELECT * FROM (VALUES ('甲乙科技', '甲乙科技', '甲乙科技股份有限公司', ''), ('甲乙科技有限公司', '甲乙科技', '甲乙科技股份有限公司', ''), ('示例银行股份有限公司', '示例银行', '示例银行', ''),
        ('丙公司', '丙', '丙集团有限公司', '丙公司'), ('不存在公司', '不存在', NULL, '不存在公司'), ('', '', NULL, '')) v(asked, core, resolved, unknown)""",
    "extracted_answers": """SELECT 1 AS query, '【结论】' || chr(10) || '合格投资者的门槛为净资产三百万元。 [1]' || chr(10) || chr(10) || '【依据】' || chr(10) || '- （条款/表格｜丙 · 表）投资者: 合格投资者；门槛: 300万元。 [2]' || chr(10) || '- （原文｜乙 · 细则）合格投资者应当具备两年以上投资经历。 [3]'
        || chr(10) || chr(10) || '【出处与时效】' || chr(10) || '[1] 甲 · 办法（资料编号 S-1，更新/生效日期 2024-01-01，版本 V2）' || chr(10) || '[2] 丙 · 表（资料编号 S-3，更新/生效日期 2022-01-01）' || chr(10) || '[3] 乙 · 细则（资料编号 S-2，更新/生效日期 2023-05-01）' AS answer, 3 AS n_citations""",
    "answer_report": "SELECT * FROM (VALUES (1, '', 1.0::DOUBLE, TRUE, round(2.0::DOUBLE / 3, 6)), (2, '4567', 0.0, FALSE, 1.0), (3, '', 1.0, TRUE, 1.0)) v(id, unsupported, support_rate, faithful, coverage)",
    "ingest_documents": """SELECT * FROM (VALUES ('R-1', '规则', 'markdown', 'institution=甲行;source_id=R-1;x_x=y: z', ''), ('scan', '扫描件', 'text', 'doc_type=OCR文本;title=扫描件', ''),
        ('T-9', 'table', 'csv', 'doc_type=产品要素表;source_id=T-9;version=v2', ''), ('empty', 'empty', 'csv', '', '解析失败：CSV 为空'), ('records', '产品库', 'json', 'doc_type=结构化记录;title=产品库', ''),
        ('none', 'none', 'json', '', '解析失败：JSON 缺少 records 列表'), ('plain', 'plain', 'markdown', '', '')) v(doc_id, title, fmt, meta, issues)""",
    "ingest_blocks": """SELECT * FROM (VALUES ('R-1', 0, '正文', 1, 0, 'paragraph', '前言' || chr(10) || '第二行'), ('R-1', 1, '规则', 1, 0, 'table', 'A,B/1,2'), ('R-1', 1, '规则', 1, 1, 'paragraph', '尾段'), ('R-1', 2, '末节', 2, 0, 'paragraph', '只有一段'),
        ('scan', 0, '正文', 1, 0, 'paragraph', '正文一'), ('scan', 1, '章', 1, 0, 'paragraph', '正文二'), ('T-9', 0, 'table', 1, 0, 'table', '代码,名称/P1,甲, 乙/P2,a "b"'),
        ('records', 0, '产品库', 1, 0, 'table', 'code,rate,name/P1,1.5,/P2,,乙'), ('records', 0, '产品库', 1, 1, 'paragraph', 'code: P1；rate: 1.5。'), ('records', 0, '产品库', 1, 2, 'paragraph', 'code: P2；name: 乙。'),
        ('plain', 0, '正文', 1, 0, 'paragraph', '没有标题')) v(doc_id, section_order, section_title, level, block_order, kind, content)""",
    "ingest_faq": "SELECT * FROM (VALUES ('FAQ-001', '问?', '答', '', '', ''), ('F-7', 'q', 'a', 'c', '', ''), ('FAQ-004', '三', '3', '', '', '')) v(faq_id, question, answer, category, updated_at, source_id)",
    "table_facts": """SELECT * FROM (VALUES
        ('D1', '甲公司', 'A-2024', '主要指标', '营业收入', 2024, '2024年', '', '万元', CAST(1200.5 AS DOUBLE)), ('D1', '甲公司', 'A-2024', '主要指标', '营业收入', 2023, '2023年', '', '万元', 1000),
        ('D1', '甲公司', 'A-2024', '主要指标', '净利润', 2024, '2024年', '', '万元', -30), ('D1', '甲公司', 'A-2024', '主要指标', '不良贷款率', 2024, '2024年', '', '%', 1.42),
        ('D1', '甲公司', 'A-2024', '主要指标', '不良贷款率', 2023, '2023年', '', '%', 1.5), ('D1', '甲公司', 'A-2024', '主要指标', '商誉账面价值', 2024, '2024年', '', '', 5),
        ('D2', '乙公司', 'B-2024', '正文', '资产总额', 2024, '2024年前三季度', '前三季度', '', 99), ('D2', '乙公司', 'B-2024', '附录', '毛利润', 2022, '2022 年', '', '', 300), ('D2', '乙公司', 'B-2024', '附录', '应收账款', 2021, '2021年', '', '', 4.5)
        ) v(doc_id, company, source_id, section_title, metric, year, period, period_suffix, unit, value)""",
}
