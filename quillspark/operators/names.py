"""Names in texts and names like names: mentions by one automaton over whole texts, and a substring join by rare grams."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Characters of names that one automaton holds; more names take a pass over the texts for each block of so many.
BLOCK_CHARS = 4_000_000
#: Characters of a gram.
GRAM = 3
#: Endings that mark a company or institution in running text.
SUFFIXES = ("股份有限公司", "有限责任公司", "有限公司", "集团", "公司", "银行", "证券", "基金", "研究所", "研究院")
ENTITY = "[\\u4e00-\\u9fa5A-Za-z0-9（）()]{2,20}?(?:" + "|".join(SUFFIXES) + ")"


def entities(text: Column) -> Column:
    """Names that end like a company's, in order, each once; null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0))
    return F.array_distinct(F.transform(found, F.trim))


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (key, name, at) of every occurrence of every name in every text, at its offset in code points from 0; they may overlap.

    Names are distinct; null and empty ones, and null texts, have no mentions. Each text is read once, whatever the number of names: they
    are one automaton, shipped to the tasks. Names beyond block_chars characters are dealt into blocks, each with a pass of its own, so
    an automaton's size is bounded.
    """
    distinct = names.select(F.col(name).alias("_n")).where(F.coalesce("_n", F.lit("")) != "").distinct()
    total = distinct.agg(F.sum(F.length("_n"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    schema = T.StructType([texts.schema[key], T.StructField(name, T.StringType()), T.StructField("at", T.LongType())])
    source = texts.select(key, F.col(text).alias("_text")).where("_text is not null")

    def found(listed: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for n in listed:
                machine.add_word(n, n)
            machine.make_automaton()
            for b in batches:
                rows, which, at = [], [], []
                for row, value in enumerate(b.column("_text").to_pylist()):
                    for end, n in machine.iter(value):
                        rows.append(row)
                        which.append(n)
                        at.append(end - len(n) + 1)
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows)), pa.array(which, pa.string()), pa.array(at, pa.int64())], names=schema.names)

        return source.mapInArrow(run, schema)

    out = None
    for i in range(blocks):
        listed = [r["_n"] for r in distinct.where(F.pmod(F.xxhash64("_n"), F.lit(blocks)) == i).collect()] if total else []
        part = found(listed) if listed else None
        out = part if out is None else out if part is None else out.unionByName(part)
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)


def first_mention(found: DataFrame, texts: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Rows (key, name): for every text the first in order of the names it mentions; null if none."""
    return texts.select(key).distinct().join(found.groupBy(key).agg(F.min(name).alias(name)), key, "left")


def _grams(value: Column, size: int) -> Column:
    return F.array_distinct(F.when(F.length(value) >= size, F.transform(F.sequence(F.lit(1), F.length(value) - size + 1), lambda i: F.substring(value, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def contained(short: DataFrame, long: DataFrame, gram: int = GRAM) -> DataFrame:
    """Rows (s, l) of every string s of `short` that is part of a string l of `long`; both have one column, distinct and not empty.

    A short string is found by the rarest of its grams among the long ones only, so common grams do not gather candidates; strings
    shorter than a gram are their own. Candidates are then compared exactly.
    """
    s, l = short.toDF("s"), long.toDF("l")
    sizes = range(1, gram + 1)
    parts = l.select("l", F.explode(F.concat(*(_grams(F.col("l"), n) for n in sizes))).alias("g"))
    counts = parts.groupBy("g").agg(F.count("*").alias("n"))
    own = s.select("s", F.explode(F.when(F.length("s") >= gram, _grams(F.col("s"), gram)).otherwise(F.array("s"))).alias("g"))
    # A gram that no long string has rules its string out at once; the rarest is among the rest.
    rare = own.join(counts, "g", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0").select("s", F.col("r.g").alias("g"))
    return rare.join(parts, "g").where(F.contains("l", F.col("s"))).select("s", "l")


def alike_names(asked: DataFrame, known: DataFrame, gram: int = GRAM) -> DataFrame:
    """Rows (asked, known) of different names of which one holds the other; either has one column. Null and empty names have none."""
    a, k = (df.toDF("x").where(F.coalesce("x", F.lit("")) != "").distinct() for df in (asked, known))
    both = contained(a, k, gram).select(F.col("s").alias("asked"), F.col("l").alias("known")).unionByName(contained(k, a, gram).select(F.col("l").alias("asked"), F.col("s").alias("known")))
    return both.where("asked <> known").distinct()


def fallback(requests: DataFrame, facts: DataFrame, keys: list[str], name: str = "company") -> DataFrame:
    """requests joined to facts on keys and name, and those without such a fact by the first name in order that holds theirs or is held by it.

    Adds the facts' other columns, `matched` (the fact's name) and `exact`; requests without any fact are left out. Each request is told
    apart by its own columns. Only misses take the substring join, on distinct names.
    """
    same = facts.withColumn("matched", F.col(name))
    exact = requests.join(same, [*keys, name]).withColumn("exact", F.lit(True))
    missed = requests.join(facts.select(*keys, name), [*keys, name], "left_anti")
    pairs = alike_names(missed.select(name), facts.select(name)).withColumnsRenamed({"asked": name, "known": "matched"})
    near = missed.join(pairs, name).join(facts.withColumnRenamed(name, "matched"), [*keys, "matched"])
    others = [c for c in facts.columns if c not in (*keys, name)]
    best = near.groupBy(*requests.columns).agg(F.min(F.struct("matched", *others)).alias("b")).select(*requests.columns, "b.*", F.lit(False).alias("exact"))
    return exact.select(*requests.columns, *others, "matched", "exact").unionByName(best.select(*requests.columns, *others, "matched", "exact"))


def known_flags(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (mention, is_known) of distinct mentions: one of the known names holds it, is held by it, or begins with the same four characters."""
    m = found.toDF("mention").where(F.coalesce("mention", F.lit("")) != "").distinct()
    k = known.toDF("known").where(F.coalesce("known", F.lit("")) != "").distinct()
    near = alike_names(m, k).select(F.col("asked").alias("mention")).unionByName(m.join(k, F.col("mention") == F.col("known"), "left_semi"))
    head = m.where(F.length("mention") >= 4).join(k.select(F.left("known", F.lit(4)).alias("h")).distinct(), F.left("mention", F.lit(4)) == F.col("h"), "left_semi")
    met = near.unionByName(head).distinct().withColumn("is_known", F.lit(True))
    return m.join(met, "mention", "left").select("mention", F.coalesce("is_known", F.lit(False)).alias("is_known"))


def busiest(found: DataFrame, name: str = "name", most: int = 10) -> DataFrame:
    """A report of the `most` names with most mentions; ties by name."""
    order = Window.orderBy(F.desc("n"), name)
    return found.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(most).withColumn("rank", F.row_number().over(order))
