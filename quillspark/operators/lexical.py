"""BM25: index statistics, scoring of query sets and ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fx

K1, B = 1.5, 0.75
#: Scores are rounded before they are ranked, so that the order of summation does not decide ties.
DIGITS = 9
#: Rows of question terms that are broadcast at most; beyond it postings and questions meet by a shuffle on terms.
BROADCAST_TERMS = 1_000_000
#: Folders that an index deals its terms over.
BUCKETS = 32


def tokens_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(F.col(key), fx.tokenize(F.col(text)).alias("tokens"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def build(tokens: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings (key, term, tf), terms (term, df, idf), totals (n, avgdl))."""
    postings = fx.exploded(tokens, [key], F.col("tokens"), "term").groupBy(key, "term").agg(F.count("*").alias("tf"))
    totals = tokens.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(totals), how="cross").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    return postings, terms, totals


def query_terms(queries: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows (query, term, qtf)."""
    return fx.exploded(tokens_of(queries, query, text), [query], F.col("tokens"), "term").groupBy(query, "term").agg(F.count("*").alias("qtf"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, key: str, path: str, text: str = "text", metadata: tuple[str, ...] = (), prune: tuple[str, ...] = (), buckets: int = BUCKETS, splits: int = 1) -> None:
    """Write the postings of docs, from one reading of the texts, and the terms with their document counts.

    postings: (key, dl, *metadata, *prune, bucket, term, tf), in folders of the columns `prune` and of a term's bucket, sorted by term:
    the terms of a question and a condition on the document leave out folders, and row groups within them. A row without a term, in
    bucket -1, stands for each document, so that counts and the mean length are those of all documents, whether they have tokens or not.
    A term's documents are dealt over `splits` tasks: as many as a term of all documents needs.
    """
    kept = [key, *(c for c in (*metadata, *prune) if c != key)]
    tokens = docs.select(*kept, F.explode(F.array(F.struct(fx.tokenize(F.col(text)).alias("t")))).alias("_x"))
    rows = tokens.select(*kept, F.size("_x.t").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("_x.t"))).alias("term"))
    dealt = rows.withColumns({"bucket": F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term"), buckets)), "_split": F.pmod(F.xxhash64(key), F.lit(splits)).cast("int")})
    # Without a term, all of a document's one row; its key spreads these rows as a split does.
    dealt = dealt.withColumn("_split", F.when(F.col("term").isNull(), F.pmod(F.xxhash64(key), F.lit(max(buckets, splits))).cast("int")).otherwise(F.col("_split")))
    counted = dealt.repartition("bucket", "_split").groupBy("bucket", "_split", "term", *kept, "dl").agg(F.count("term").alias("tf")).drop("_split")
    folders = [*prune, "bucket"]
    counted.sortWithinPartitions(*folders, "term").write.partitionBy(*folders).parquet(f"{path}/postings")
    order = [*(c for c in counted.columns if c not in folders), *folders]
    postings = docs.sparkSession.read.schema(counted.select(order).schema).parquet(f"{path}/postings")
    # Each key and term is one row.
    terms = postings.where("bucket >= 0").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    postings.where("bucket = -1").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/totals")


class Index:
    """A written index: its postings serve BM25 and sparse search, masks on metadata, and any number of question sets.

    Document counts and the mean length are those of all documents, whatever the mask.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.key = key
        self.rows, self.terms, self.totals = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "totals"))
        self.buckets = self.totals.first()["buckets"]

    def documents(self) -> DataFrame:
        """One row for each document with its metadata and length."""
        return self.rows.where("bucket = -1").drop("term", "tf", "bucket")

    def asked(self, queries: DataFrame, query: str, text: str = "text", same: dict[str, str] | None = None) -> tuple[DataFrame, int, Column]:
        """Rows (query, bucket, term, qw, qn, avgdl, w, _want_<column>) of the questions' terms that the index has, the number of the questions' terms,
        and the condition on folders that hold them."""
        wants = list((same or {}).keys())
        q = query_terms(queries, query, text).withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        n, used = q.agg(F.count("*"), F.collect_set("bucket")).first()
        near = F.col("bucket").isin(*used) if used else F.lit(False)
        qn = Window.partitionBy(query)
        q = q.withColumn("qw", 1.0 + F.log(F.col("qtf").cast("double"))).withColumn("qn", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(qn)))
        if wants:
            q = q.join(queries.select(query, *(F.col(c).alias(f"_want_{c}") for c in wants)), query)
        q = q.join(self.terms.where(near), ["bucket", "term"]).join(F.broadcast(self.totals.select("n", "avgdl")), how="cross")
        q = q.select(query, "bucket", "term", "qw", "qn", "avgdl", (idf(F.col("n"), F.col("df")) * F.col("qw")).alias("w"), *(f"_want_{c}" for c in wants))
        return q, n, near

    def scores(self, queries: DataFrame, query: str, text: str = "text", mask: Column | None = None, same: dict[str, str] | None = None) -> DataFrame:
        """Rows (query, key, bm25, sparse) of every pair with a common term, both scores from one reading of the postings.

        bm25 sums idf times 1 + ln of the question's term count times the saturated term count; sparse is the dot product of 1 + ln tf weights over the question's length. mask: a condition on the documents'
        metadata. same: a column of the documents for each column of queries that must equal it; a null there means any.
        The questions' terms are counted first: their buckets, at most as many as the index has, become folders to read, and if the terms are
        few they are broadcast, so a term of most documents does not gather them in one task.
        """
        q, n, near = self.asked(queries, query, text, same)
        small = F.broadcast if n <= BROADCAST_TERMS else (lambda df: df)
        hits = self.rows.where(near & (F.lit(True) if mask is None else mask)).join(small(q), ["bucket", "term"])
        for column, field in (same or {}).items():
            hits = hits.where(F.col(f"_want_{column}").isNull() | (F.col(f"_want_{column}") == F.col(field)))
        tf = F.col("tf").cast("double")
        part = F.col("w") * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))
        dot = (1.0 + F.log(tf)) * F.col("qw")
        sums = hits.groupBy(query, self.key, "qn").agg(F.sum(part).alias("bm25"), F.sum(dot).alias("raw"))
        return sums.select(query, self.key, F.round("bm25", DIGITS).alias("bm25"), F.round(F.col("raw") / F.when(F.col("qn") == 0, 1.0).otherwise(F.col("qn")), DIGITS).alias("sparse"))

    def bm25(self, queries: DataFrame, query: str, text: str = "text", **options) -> DataFrame:
        """Rows (query, key, score) of every pair with a common term."""
        return self.scores(queries, query, text, **options).select(query, self.key, F.col("bm25").alias("score"))

    def sparse(self, queries: DataFrame, query: str, text: str = "text", **options) -> DataFrame:
        """Rows (query, key, score): 1 + ln tf weights, the dot product over the query's length."""
        return self.scores(queries, query, text, **options).select(query, self.key, F.col("sparse").alias("score"))


def routes_of(scored: DataFrame, query: str, key: str, k: int, routes: tuple[str, ...] = ("bm25", "sparse")) -> DataFrame:
    """Rows (query, key, route, score, rank): the k best of each route with a score above 0, from one scored table; ties by key."""
    listed = scored.select(query, key, F.explode(F.array(*(F.struct(F.lit(r).alias("route"), F.col(r).alias("score")) for r in routes))).alias("_r")).select(query, key, "_r.route", "_r.score")
    best = Window.partitionBy(query, "route").orderBy(F.desc("score"), key)
    return listed.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top(scored: DataFrame, group: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each group with score > 0 and their rank from 1; ties by key."""
    best = Window.partitionBy(group).orderBy(F.desc(score), key)
    return scored.where(F.col(score) > 0).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_terms(ranked: DataFrame, docs: DataFrame, queries: DataFrame, key: str, query: str, text: str = "text") -> DataFrame:
    """ranked with the common terms, distinct and rising, of each of its pairs."""
    d = tokens_of(docs.join(ranked.select(key).distinct(), key, "left_semi"), key, text).withColumnRenamed("tokens", "_d")
    q = tokens_of(queries, query, text).withColumnRenamed("tokens", "_q")
    return ranked.join(q, query).join(d, key).withColumn("terms", F.array_sort(F.array_intersect("_q", "_d"))).drop("_q", "_d")
