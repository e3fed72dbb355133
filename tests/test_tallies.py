"""Documents and blocks counted without making any block, against the blocks themselves."""

from __future__ import annotations

from itertools import product

from quillspark.operators import reviews
from quillspark.sources import documents


def test_tallies_are_those_of_the_blocks(spark):
    lines = ["", "p", "# h", "|a|", "| |", "|-|", "||"]
    bodies = ["\n".join(x) for n in range(4) for x in product(lines, repeat=n)]
    bodies += ["p\r\n\r\n|a|\r|-|\n|b|", "---\n编号: Q\n---\n# t\nx", "---\n编号: Q2\n---\n", " # h\n\u3000\n#no heading\n|| |\n| - | : |\n|a", None]
    csv = ["a,b\n1,2", "#编号: Z\na,b\n", "", '""\n , ', "#x: y", None]
    json = ['{"records": [{"a": "1"}, {"a": " "}, {"b": null}, {"a": {"c": 1}}]}', '{"records": [{"a": "1"}, null]}', '{"records": [{}]}', '{"records": []}', '{"records": 3}', '{"faq": []}', '{"x": 1}', "broken", "[1]", None]
    rows = [(f"/d/{kind}{i}.{kind}", raw) for kind, raws in (("md", bodies), ("txt", bodies[:60]), ("csv", csv), ("json", json), ("pdf", ["x"])) for i, raw in enumerate(raws)]
    files = spark.createDataFrame(rows, "path string, raw string")
    docs, blocks = documents.documents(files)
    assert reviews.tally_stats(documents.tallies(files)).first() == reviews.corpus_stats(docs, blocks).first()
    paths = {r["doc_id"]: r["path"] for r in docs.select("doc_id", "path").collect()}
    want = {}
    for r in blocks.select("doc_id", "kind").collect():
        n, tables = want.get(paths[r["doc_id"]], (0, 0))
        want[paths[r["doc_id"]]] = (n + 1, tables + (r["kind"] == "table"))
    got = documents.tallies(files)
    assert "Exchange" not in got.select("n_blocks")._jdf.queryExecution().executedPlan().toString()
    assert {r["path"]: (r["n_blocks"], r["n_tables"]) for r in got.collect() if r["n_blocks"]} == want
