"""Search: the written index, masks that leave out files, near duplicates merged, reranking, segments; names."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as fx
from quillspark.operators import fusion, lexical, names, ranking, segments
from quillspark.plans import search
from quillspark.session import scratch_path

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def corpus(spark, n=40, seed=1):
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.choices(WORDS[: 3 + i % 8], k=draw.randint(0, 12))), draw.choice(["en", "de", None]), i * 10) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, text string, lang string, size long")


def bm25(rows, question):
    docs = {i: t.split() for i, t, *_ in rows}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for t in docs.values() for w in set(t))
    out = {}
    for i, t in docs.items():
        tf, score = Counter(t), 0.0
        for w, q in Counter(question.split()).items():
            if tf[w]:
                score += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (1 + math.log(q)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean))
        if set(t) & set(question.split()):
            out[i] = round(score, 6)
    return out


def found(df):
    return {r["id"]: round(r["score"], 6) for r in df.collect()}


def test_index_equals_brute_force_under_masks(spark):
    rows, docs = corpus(spark)
    path = scratch_path(spark, "test")
    lexical.write_index(docs, "id", path, metadata=("size",), prune=("lang",), buckets=4, splits=3)
    index, q = lexical.Index(spark, path, "id"), "alpha alpha theta kappa"
    asked = spark.createDataFrame([(1, q, "de"), (2, q, None)], "q int, text string, want string")
    want = bm25(rows, q)
    assert found(index.bm25(asked.where("q = 1"), "q")) == want
    german = {i: s for i, s in want.items() if rows[i][2] == "de"}
    assert found(index.bm25(asked.where("q = 1"), "q", mask=F.col("lang") == "de")) == german
    assert found(index.bm25(asked.where("q = 1"), "q", same={"want": "lang"})) == german
    assert found(index.bm25(asked.where("q = 2"), "q", same={"want": "lang"}, mask=F.col("size") >= 200)) == {i: s for i, s in want.items() if i >= 20}
    assert index.documents().count() == len(rows)


def test_masks_and_terms_leave_out_folders(spark):
    _, docs = corpus(spark)
    path = scratch_path(spark, "test")
    lexical.write_index(docs, "id", path, prune=("lang",), buckets=8)
    index = lexical.Index(spark, path, "id")
    plan = index.bm25(spark.createDataFrame([(1, "alpha")], "q int, text string"), "q", mask=F.col("lang") == "de")._jdf.queryExecution().optimizedPlan().toString()
    assert "lang" in plan
    physical = index.bm25(spark.createDataFrame([(1, "alpha")], "q int, text string"), "q", mask=F.col("lang") == "de")._jdf.queryExecution().executedPlan().toString()
    partition_filters = [m for m in re.findall(r"PartitionFilters: \[([^\]]*)\]", physical) if "bucket" in m]
    assert any("lang" in m for m in partition_filters), physical


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_equal_a_rebuild(spark, seed):
    draw = random.Random(seed)
    rows, _ = corpus(spark, 30, seed)
    living = {i: t for i, t, *_ in rows}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id long, text string")
    state = segments.upsert(segments.Segments(scratch_path(spark, "segments"), "id"), frame(living))
    for step in range(3):
        fresh = {draw.randint(0, 35): " ".join(draw.choices(WORDS, k=6)) for _ in range(5)}
        state = segments.upsert(state, frame(fresh))
        living |= fresh
        gone = draw.sample(sorted(living), 3) + [999]
        state = segments.delete(state, spark.createDataFrame([(g,) for g in gone], "id long"))
        living = {i: t for i, t in living.items() if i not in gone}
        if step == 1:
            state = segments.compacted(spark, state)
    q = "alpha beta kappa"
    asked, want = spark.createDataFrame([(1, q)], "q int, text string"), bm25([(i, t) for i, t in living.items()], q)
    assert found(segments.View(spark, state).bm25(asked, "q")) == want
    assert found(segments.View(spark, segments.compacted(spark, state)).bm25(asked, "q")) == want


def grams(t):
    return {a + b for a, b in zip(t, t[1:], strict=False)} if len(t) > 1 else set(t)


def test_near_duplicates_merge_routes_and_keep_the_protected(spark):
    rows = [
        (1, 1, "a b c d e f", 0.9, {"bm25": 1}, False), (1, 2, "a b c d e f", 0.8, {"sparse": 4, "bm25": 7}, False), (1, 3, "x y z", 0.7, {"dense": 2}, False), (1, 4, "a b c d e f", 0.6, {"dense": 5}, True),
        (1, 5, "a b c d e f", 0.5, {"dense": 9}, False), (2, 6, "a b c d e f", 0.1, {"bm25": 3}, False), (3, 7, "", 0.2, {"bm25": 1}, None), (3, 8, None, 0.2, {"bm25": 2}, None),
    ]
    df = spark.createDataFrame(rows, "q int, k int, t string, s double, routes map<string,int>, keep boolean")
    got = {(r["q"], r["k"]): (r["routes"], r["merged"]) for r in fusion.merge_near_duplicates(df, "q", "k", "t", "s", protected="keep").collect()}
    assert got == {
        (1, 1): ({"bm25": 1, "sparse": 4, "dense": 9}, [2, 5]), (1, 3): ({"dense": 2}, []), (1, 4): ({"dense": 5}, []), (2, 6): ({"bm25": 3}, []), (3, 7): ({"bm25": 1}, []), (3, 8): ({"bm25": 2}, []),
    }


def test_near_duplicates_of_searches_equal_brute_force(spark):
    rows = search._with_texts(search._fused(spark, oracle.SMALL), spark, oracle.SMALL).where("question like 'b/1%'")
    tokens = {r["doc_id"]: r["t"] for r in rows.select("doc_id", fx.tokenize(F.col("text")).alias("t")).distinct().collect()}
    listed = defaultdict(list)
    for r in rows.collect():
        listed[r["question"]].append((-r["rrf"], r["doc_id"], {k: tuple(v) for k, v in r["routes"].items()}))
    want = set()
    for question, items in listed.items():
        kept = []
        for _, doc, routes in sorted(items, key=lambda x: x[:2]):
            own = grams(tokens[doc])
            like = next((k for k in kept if own and k[1] and len(own & k[1]) / len(own | k[1]) >= 0.82), None)
            if like is None:
                kept.append((doc, own, dict(routes), []))
            else:
                like[2].update({k: v for k, v in routes.items() if k not in like[2]})
                like[3].append(doc)
        want |= {(question, doc, tuple(sorted(routes.items())), tuple(merged)) for doc, _, routes, merged in kept}
    merged = fusion.merge_near_duplicates(rows, "question", "doc_id", "text", "rrf").collect()
    assert {(r["question"], r["doc_id"], tuple(sorted((k, tuple(v)) for k, v in r["routes"].items())), tuple(r["merged"])) for r in merged} == want


def test_features_and_final_scores(spark):
    rows = [(1, 1, "rate 1234 of a", "rate 1234 of a", 0.8, 0.5, 0.5, 0.02), (1, 2, "rate 1234 of a", "other", 0.4, 1.0, 0.0, 0.01), (2, 3, "", "", 0.5, 1.0, 1.0, 0.3)]
    df = spark.createDataFrame(rows, "g int, k int, q string, t string, dense double, quality double, metadata double, rrf double")
    got = {r["k"]: r for r in fusion.final_scores(fusion.pair_features(df, "q", "t"), "g").collect()}
    length = lambda n: min(n, 220) / max(n, 220)
    first = 0.34 + 0.16 + 0.26 * 0.8 + 0.14 + 0.05 * length(14) + 0.05 * 0.5
    assert got[1]["cross"] == pytest.approx(first) and got[1]["final"] == pytest.approx(0.55 * first + 0.30 + 0.15 * 0.5)
    second = 0.26 * 0.4 + 0.05 * length(5) + 0.05
    assert got[2]["cross"] == pytest.approx(second) and got[2]["final"] == pytest.approx(0.55 * second)
    assert got[3]["cross"] == pytest.approx(0.26 * 0.5 + 0.14 * 0.75 + 0.05) and got[3]["final"] == pytest.approx(0.55 * got[3]["cross"] + 0.15)


def test_rerank_is_the_best_of_the_merged_candidates(spark):
    best = search.rerank(spark, oracle.SMALL).collect()
    kept = {(r["question"], r["doc_id"]) for r in search.dedup_near(spark, oracle.SMALL).collect()}
    assert {(r["question"], r["doc_id"]) for r in best} <= kept
    by = defaultdict(list)
    for r in best:
        by[r["question"]].append(r)
    counts = Counter(q for q, _ in kept)
    assert set(by) == set(counts)
    for question, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 1 + min(search.BEST, counts[question])))
        assert [r["final"] for r in own] == sorted((r["final"] for r in own), reverse=True)


# Names.


def test_mentions_overlap_and_come_in_blocks(spark):
    texts = spark.createDataFrame([(1, "aaa ab"), (2, None), (3, ""), (4, "été aa"), (None, "ab")], "k int, text string")
    listed = spark.createDataFrame([("aa",), ("ab",), ("a",), ("",), (None,), ("aa",), ("é",)], "name string")
    want = {(1, "a", 0), (1, "a", 1), (1, "a", 2), (1, "a", 4), (1, "aa", 0), (1, "aa", 1), (1, "ab", 4), (4, "é", 0), (4, "é", 2), (4, "a", 4), (4, "a", 5), (4, "aa", 4), (None, "ab", 0), (None, "a", 0)}
    for block in (names.BLOCK_CHARS, 2):
        got = [tuple(r) for r in names.mentions(texts, listed, "k", block_chars=block).collect()]
        assert len(got) == len(want) and set(got) == want
    assert names.mentions(texts, listed.limit(0), "k").count() == 0 and names.mentions(texts.limit(0), listed, "k").count() == 0
    assert {(r["k"], r["name"]) for r in names.first_mention(names.mentions(texts, listed, "k"), texts.where("k is not null"), "k").collect()} == {(1, "a"), (2, None), (3, None), (4, "a")}


@pytest.mark.parametrize("seed", range(3))
def test_names_that_hold_one_another(spark, seed):
    draw = random.Random(seed)
    make = lambda n: ["".join(draw.choices("abc", k=draw.randint(0, 7))) for _ in range(n)] + [None]
    asked, known = make(60), make(60)
    got = {tuple(r) for r in names.alike_names(spark.createDataFrame([(x,) for x in asked], "x string"), spark.createDataFrame([(x,) for x in known], "x string")).collect()}
    assert got == {(a, k) for a in asked if a for k in known if k and a != k and (a in k or k in a)}


def test_no_nested_loop_joins_names(spark):
    df = spark.createDataFrame([("abc",), ("abcd",)], "x string")
    plan = names.alike_names(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fallback_takes_exact_facts_first(spark):
    facts = spark.createDataFrame([("甲乙科技", "r", 1.0), ("甲乙科技集团", "r", 2.0), ("乙", "q", 3.0)], "company string, metric string, value double")
    asked = spark.createDataFrame([("甲乙科技", "r"), ("甲乙", "r"), ("乙行", "q"), ("丁", "q"), ("甲乙", "q")], "company string, metric string")
    got = {(r["company"], r["metric"]): (r["matched"], r["value"], r["exact"]) for r in names.fallback(asked, facts, ["metric"]).collect()}
    assert got == {("甲乙科技", "r"): ("甲乙科技", 1.0, True), ("甲乙", "r"): ("甲乙科技", 1.0, False), ("乙行", "q"): ("乙", 3.0, False), ("甲乙", "q"): ("乙", 3.0, False)}
    row = spark.createDataFrame([("示例银行与甲乙科技股份有限公司，示例银行",)], "t string").select(names.entities(F.col("t")).alias("e")).first()
    assert row["e"] == ["示例银行", "与甲乙科技股份有限公司"]




def test_ranking_in_blocks_is_that_of_all_pairs(spark, tmp_path, monkeypatch):
    from quillspark.operators import lexical, ranking

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randint(0, 25))), rng.choice(["en", "de", None])) for i in range(120)]
    asks = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.choice(["en", "de", None])) for i in range(40)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(asks, "q string, text string, want string")
    lexical.write_index(d, "doc_id", f"{tmp_path}/index", metadata=("lang",))
    index = lexical.Index(spark, f"{tmp_path}/index", "doc_id")
    rows = lambda df: sorted((r["q"], r["route"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in df.collect())
    monkeypatch.setattr(ranking, "BLOCK", 16)
    for options in ({}, {"same": {"want": "lang"}}, {"mask": F.col("lang") == "de"}):
        want = rows(lexical.routes_of(index.scores(q, "q", **options), "q", "doc_id", 4))
        assert want and rows(ranking.ranked(index, q, "q", 4, **options)) == want
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 2000)
    assert rows(ranking.ranked(index, q, "q", 4)) == rows(lexical.routes_of(index.scores(q, "q"), "q", "doc_id", 4))
    assert ranking.ranked(index, q.limit(0), "q", 4).count() == 0


def test_weighted_fusion_in_blocks_is_that_of_all_pairs(spark, monkeypatch):
    rows, docs = corpus(spark, 150, seed=9)
    path = scratch_path(spark, "test")
    lexical.write_index(docs, "id", path, prune=("lang",), buckets=4)
    index = lexical.Index(spark, path, "id")
    asked = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=1 + i % 4))) for i in range(11)] + [(11, "nowhere"), (12, "")], "q int, text string")
    monkeypatch.setattr(ranking, "BLOCK", 4)
    monkeypatch.setattr(ranking, "DOCUMENTS", 16)
    got = ranking.weighted(index, asked, "q", 5, F.col("lang") == "en")
    pairs = index.scores(asked, "q").withColumnsRenamed({"sparse": "cosine"}).join(docs.select("id", F.coalesce((F.col("lang") == "en").cast("double"), F.lit(0.0)).alias("metadata")), "id")
    want = fusion.weighted(pairs.withColumn("hit_ratio", F.least(F.lit(1.0), F.col("cosine"))), "q", "id", 5)
    plain = lambda df: sorted(tuple(r) for r in df.select("q", "id", "score", "rank").collect())
    assert plain(got) == plain(want)
    assert len({r[0] for r in plain(got)}) == 11


def test_nearest_entries_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    draw = lambda most: [rng.choice(WORDS) for _ in range(rng.randint(0, most))]
    asks, told = [(i, draw(7)) for i in range(30)] + [(30, ["nowhere"]), (31, None)], [(i, draw(9)) for i in range(60)] + [(60, None)]
    q, e = spark.createDataFrame(asks, "q int, a array<string>"), spark.createDataFrame(told, "k long, d array<string>")
    pairs = lambda t: set(map("".join, zip(t, t[1:], strict=False))) if len(t) > 1 else set(t)
    want = {}
    for i, a in asks:
        scored = []
        for k, d in told:
            if a and d and set(a) & set(d):
                x, y = pairs(a), pairs(d)
                scored.append((-round(0.55 * max(len(set(a) & set(d)) / len(set(a)), len(x & y) / len(x | y)) + 1e-12, 6), k))
        if scored:
            want[i] = (min(scored)[1], -min(scored)[0])
    for block, bytes_ in ((8, 1 << 20), (512, 800)):
        monkeypatch.setattr(ranking, "BLOCK", block)
        monkeypatch.setattr(ranking, "DOCUMENTS", 16)
        monkeypatch.setattr(ranking, "BROADCAST_BYTES", bytes_)
        assert {r["q"]: (r["k"], r["score"]) for r in ranking.nearest_entry(q, e, "q", "k", "a", "d", 0.55).collect()} == want
    assert ranking.nearest_entry(q.limit(0), e, "q", "k", "a", "d", 0.55).count() == 0


def test_a_compacted_index_is_read_without_its_old_tombstones(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "id long, text string")
    state = segments.upsert(segments.Segments(scratch_path(spark, "segments"), "id"), docs)
    state = segments.compacted(spark, segments.delete(state, docs.where("id = 2").select("id")))
    view = segments.View(spark, state)
    assert "Join" not in view.rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["term"], r["df"]) for r in view.terms.collect()) == [("a", 1), ("b", 1), ("c", 1)]
    assert tuple(view.totals.first()) == (2.0, 1.5)
    again = segments.View(spark, segments.delete(state, docs.where("id = 3").select("id")))
    assert sorted((r["term"], r["df"]) for r in again.terms.collect()) == [("a", 1), ("b", 1)]
