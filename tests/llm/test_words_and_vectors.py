"""Spelling variants, centroid clustering and decontamination: edge rows, brute force, whole queries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from quillspark.llm import centroids, common, decontamination, queries, spelling

LONG = "Letter " * 30_000 + "x" * 40_000
DOCS = [(1, "Spelling spelling speling SPELLINGS"), (2, None), (3, ""), (4, " \n 12 "), (5, LONG), (1, "Spelling spelling speling SPELLINGS"), (None, "straße ÀÉÎÕÜ÷ñandú straßen straßen"), (6, LONG)]


@pytest.fixture(scope="module")
def con():
    return oracle.database()


# Spelling variants


def occurrences(rows, least=spelling.LEAST_LENGTH):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % spelling.ERRATA == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= 2}


def variants(n, factor=spelling.FACTOR):
    near, shared, form = defaultdict(set), defaultdict(set), {}
    for w in n:
        for i in range(len(w)):
            shared[w[:i] + "*" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    for group in shared.values():
        for w in group if len(group) > 1 else ():
            near[w] |= group - {w}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_spelling_edge_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, word string, n int").repartition(3)
    assert got(spelling.spelling_variants(docs)) == variants(occurrences([(k, t) for k, t in DOCS]))
    assert got(spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert got(spelling.spelling_variants(docs.limit(0))) == []


@pytest.mark.parametrize("letters,longest,frequent", [("ab", 9, 1), ("abcß", 8, 4096), ("aé", 12, 20)])
def test_spelling_equals_brute_force(spark, letters, longest, frequent):
    draw = random.Random(longest)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(5, longest))) for _ in range(700)]
    rows = [(i, " ".join(draw.choices(words[: 10 ** draw.randint(1, 3)], k=60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(spelling.spelling_variants(docs, least_length=5, factor=2, frequent=frequent)) == variants(occurrences(rows, 5), 2)


def test_spelling_on_documents(spark):
    docs = common.read(spark, oracle.SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op11_spelling_variants"](spark, oracle.SMALL).select("word", "form", "root", "n", "n_near", "form_n")) == variants(occurrences(rows))


def test_forms_chain_to_their_root(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aaaaaaa"] * 3 + ["aaaaaab"] * 40 + ["aaaaabb"] * 500 + ["aaaabbb"] * 6000)], "doc_id long, text string")
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_variants(docs).collect()}
    n = occurrences([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found == {w: (f, r) for w, f, r, *_ in variants(n)}
    assert found["aaaaaaa"] == ("aaaaaab", "aaaabbb")


# Centroid clustering


def test_clustering_agrees_with_sql(spark, con):
    assert oracle.differences(queries.QUERIES["op12_centroid_clustering"](spark, oracle.SMALL), con, queries.ORACLE_SQL["op12_centroid_clustering"]) == ""


def lloyd(rows, k, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{centroids.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, own in groups.items():
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


@pytest.mark.parametrize("wide", [4, 1 << 25])
def test_clustering_equals_brute_force(spark, wide):
    draw = random.Random(wide)
    # Few different values: ties between centroids, repeated vectors, equal norms.
    rows = [(i % 90 if i else None, [float(draw.randint(-wide, wide) if wide > 9 else draw.choice([-1, 0, 1, 2])) for _ in range(3)]) for i in range(120)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, _x string").repartition(5)
    assert got(centroids.cluster_vectors(frame, clusters=9, rounds=4, components=3, scale=1)) == lloyd(rows, 9, 4, 1)


def test_clustering_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (6, [nan, 0.0]), (7, [-inf, 0.0]), (1, [1.0, 2.0]), (None, [0.001, -0.001]), (8, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, -0.003])]
    assert got(centroids.cluster_vectors(frame, components=2)) == lloyd(kept, 40, 5, 256)
    assert got(centroids.cluster_vectors(frame.limit(0), components=2)) == []
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), components=1).collect()


def test_annulus_leaves_out_what_is_too_far_and_keeps_the_boundary():
    c = np.array([[0, 1], [0, 10], [0, 100], [0, -3]], np.int64)
    search = centroids.Annulus(c)
    low, high = search.bounds(np.array([2.0]), np.array([1.0]))
    assert [search.number[i] for i in range(low[0], high[0])] == [0, 3]
    number, far = search.nearest(np.array([[0, 99], [0, -1], [0, 0]]))
    assert number.tolist() == [2, 0, 0] or number.tolist() == [2, 3, 0]
    assert far.tolist() == [1, 4, 1] and number[1] == 0


# Decontamination


def test_decontamination_agrees_with_sql(spark, con):
    assert oracle.differences(queries.QUERIES["op13_decontamination"](spark, oracle.SMALL), con, queries.ORACLE_SQL["op13_decontamination"]) == ""


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def judged(docs, items, window=decontamination.WINDOW):
    grams = defaultdict(set)
    for i, t in items:
        w = split(t)
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if w else 0):
            grams[tuple(w[p : p + m])].add("" if i is None else str(i))
    sizes, out = {len(g) for g in grams}, []
    for i, t in docs:
        w, hit, met = split(t), set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if (g := tuple(w[p : p + m])) in grams:
                    hit |= set(range(p, p + m))
                    met |= grams[g]
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("letters,block,piece", [("ab", 10**6, 2000), ("ab", 40, 12), ("abcdé", 300, 10), ("abcdefgh", 10**6, 11)])
def test_decontamination_equals_brute_force(spark, letters, block, piece):
    draw = random.Random(block + piece)
    say = lambda n: " ".join(draw.choice(letters) for _ in range(n))
    items = [(i % 25, say(draw.choice([0, 2, 4, 6, 9, 10, 11, 30]))) for i in range(40)] + [(None, say(12)), (7, None)]
    docs = [(i, " . ".join([say(draw.randint(0, 9)), draw.choice(items)[1] or "", say(5), (draw.choice(items)[1] or "").upper()])) for i in range(60)]
    docs += [(None, docs[0][1]), (1, docs[1][1]), (98, None), (99, "")]
    d = spark.createDataFrame([(*x, 0, "y") for x in docs], "doc_id long, text string, n_words int, items string").repartition(4)
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, id int")
    found = decontamination.contamination(d, b, block_words=block, piece_words=piece)
    assert got(decontamination.digests(found)) == judged(docs, items)


def test_decontamination_edge_rows(spark):
    docs = [(1, "one two three four five six seven eight nine ten " * 4_000), (2, None), (3, ""), (None, "x " * 50_000), (1, "Ten, NINE")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for items in ([], [(1, None), (2, "...")], [(1, "ten nine")], [(5, "TWO three four five six seven eight nine ten one two")]):
        b = spark.createDataFrame(items, "item_id long, text string")
        assert got(decontamination.digests(decontamination.contamination(d, b))) == judged(docs, items)
    assert got(decontamination.contamination(d.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string"))) == []


def test_spans_leave_the_text_or_the_document_goes(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    around = "words before it that are nobody's item and go on for a while, "
    docs = [(1, around + item.upper() + "! and after.", "a"), (2, item, "b"), (3, "clean", None), (4, None, "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = {r["doc_id"]: (r["text"], r["source"]) for r in decontamination.decontaminate(d, b).collect()}
    assert left == {1: (around + "! and after.", "a"), 3: ("clean", None), 4: (None, "c")}
    with pytest.raises(ValueError, match="spans"):
        decontamination.decontaminate(d.withColumnRenamed("source", "Spans"), b)
