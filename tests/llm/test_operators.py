"""Operators over small tables: edge rows, brute force, and whole queries on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F
from test_core import shingle_set

from quillspark.llm import chat_format, common, fingerprints, html_extraction, jaccard_join, language_id, packing, piece_encoding, quality_rules, queries, token_counts, warc
from quillspark.llm.components import components

LONG = "word " * 60_000
EDGE = [(1, "plain text with several words in it"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (1, "plain text with several words in it"), (6, "日本語 тест é"), (None, "no key here")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def edge(spark):
    # Extra columns with clashing names.
    return spark.createDataFrame([(*r, "x", 0, "y") for r in EDGE], SCHEMA + ", n_tokens string, length long, _text string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string")


def texts(spark):
    return {r["doc_id"]: r["text"] for r in common.read(spark, oracle.SMALL, "documents").collect()}


def langs(spark):
    return {r["doc_id"]: r["lang"] for r in common.read(spark, oracle.SMALL, "documents").collect()}


def test_token_counts(spark, edge, empty):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    from quillspark.llm.segments import load

    t = load(path)
    want = sorted((k or -1, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for k, x in EDGE)
    rows = token_counts.count_tokens(edge, path).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert token_counts.count_tokens(empty, path).count() == 0


def check_pieces(rows, ids_of):
    """Every document's ids once, sequences gapless and at most 2048 long; the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    pad = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad


def test_packing(spark, edge, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    from quillspark.llm.segments import load

    t = load(path)
    rows = [r for r in packing.pack_documents(edge.dropDuplicates(["doc_id"]), path).collect()]
    assert check_pieces(rows, {k: t.encode(x or "", add_special_tokens=False).ids + [1] for k, x in dict(EDGE).items()}) == 0
    assert packing.pack_documents(empty, path).count() == 0
    docs = texts(spark)
    rows = queries.op7_packing(spark, oracle.SMALL).collect()
    assert check_pieces(rows, {k: t.encode(x, add_special_tokens=False).ids + [1] for k, x in docs.items()}) == 0
    with_ids = packing.pack_documents(edge, path, with_ids=True).where("doc_id = 3").first()
    assert bytes(with_ids["ids"]) == (1).to_bytes(4, "little")


def test_packing_of_repeated_keys(spark):
    """Each of several rows with one key is packed whole: pieces chain up to the rows' own lengths."""
    path = queries.tokenizer_path("word_bpe_49k.json")
    texts_of = ["same key " * 900, "same key " * 900, "another text " * 700, None, "short"]
    rows = packing.pack_documents(spark.createDataFrame([(7, t) for t in texts_of], SCHEMA).repartition(2), path).collect()
    t = packing.WordPieces(path).tokenizer
    want = Counter(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in texts_of)
    assert sum(r["length"] for r in rows) == sum(n * c for n, c in want.items())
    for n, copies in want.items():
        own = [r for r in rows if r["doc_tokens"] == n]
        assert sum(r["length"] for r in own) == n * copies and sum(r["start"] == 0 for r in own) == copies
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]


def test_pieces(spark, edge, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    p = piece_encoding.model(path).processor
    rows = piece_encoding.encode_pieces(edge, path, digests=True).collect()
    want = sorted((k or -1, len(i := p.encode(x or "") + [p.eos_id()]), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(p.decode(i).encode()).hexdigest(), len((x or "").encode())) for k, x in EDGE)
    assert sorted((r["doc_id"] or -1, *r[1:5]) for r in rows) == want
    # Spans by the library's own byte offsets, for texts without characters that it takes apart.
    for k, x in EDGE:
        pieces = p.encode(x or "", return_type="proto").pieces
        if all(not q.piece.startswith("<0x") for q in pieces):
            end = len((x or "").encode())
            span = np.array([*((q.begin, q.end) for q in pieces), (end, end)], "<i8")
            assert hashlib.sha256(span.tobytes()).hexdigest() in {r["spans_sha256"] for r in rows if r["doc_id"] == k}
    full = piece_encoding.encode_pieces(edge, path)
    back = {r["doc_id"]: r["text"] for r in piece_encoding.decode_pieces(full, path).collect()}
    assert back[6] == EDGE[6][1] and back[2] == ""
    assert piece_encoding.encode_pieces(empty, path).count() == 0


def test_fingerprints(spark, edge, empty):
    rows = fingerprints.edited_fingerprints(edge).collect()
    order = sorted(((k, x or "") for k, x in EDGE), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (k, x) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(x) // 2
        want[k, len(x), hashlib.sha256((x[: len(x) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert fingerprints.edited_fingerprints(empty).count() == 0
    docs = texts(spark)
    keys = sorted(docs)
    for r in queries.op9_fingerprints(spark, oracle.SMALL).collect():
        x, after = docs[r["doc_id"]], docs[keys[(keys.index(r["doc_id"]) + 1) % len(keys)]]
        edited = x[: len(x) - len(x) // 2] + after[: len(x) // 2]
        a, b, c = shingle_set(x), shingle_set(edited), shingle_set(after)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for got, x, y in ((r["near_edited"], a, b), (r["near_next"], a, c)):
            true, n = len(x & y) / max(1, len(x | y)), max(1, len(x | y))
            # Half of the union's n shingles are drawn: four and a half standard errors, and one shingle.
            assert abs(got - true) <= 4.5 * math.sqrt(true * (1 - true) / n) + 1.5 / n or n < 12
    pairs = fingerprints.fingerprint(edge).where("doc_id = 1").selectExpr("fingerprint as a", "fingerprint as b")
    assert fingerprints.compare(pairs, "a", "b").first()["containment"] == 1.0


def test_fingerprints_over_many_ranges(spark):
    """More ranges than rows, repeated and null keys: the same rows as with one range, and no expression that grows."""
    rows = [(i * i % 97, f"text {i} " * (i % 5)) for i in range(120)] + [(None, "none a"), (None, "none b"), (3, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = Counter(tuple(r) for r in fingerprints.edited_fingerprints(df, parts=1).collect())
    for parts in (7, 2000):
        assert Counter(tuple(r) for r in fingerprints.edited_fingerprints(df, parts=parts).collect()) == want


def brute_groups(rows, percent=75):
    sets = [(k, shingle_set(t)) for k, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = defaultdict(list)
    for i, (k, s) in enumerate(sets):
        met = Counter(j for x in s for j in seen[x])
        for x in s:
            seen[x].append(i)
        for j, n in met.items():
            if k is not None and sets[j][0] is not None and 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    return sorted(((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets)), key=repr)


def groups(df, **options):
    return sorted((tuple(r) for r in jaccard_join.near_duplicates(df, **options).collect()), key=repr)


def near_copies(seed):
    import random

    rng, rows, k = random.Random(seed), [], 0
    words = [f"w{i}" for i in range(30)]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 8, 12, 40, 100]))]
        for _ in range(rng.randint(1, 25)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            k += rng.randint(1, 3)
            rows.append((k, " ".join(t)))
    rng.shuffle(rows)
    return rows


def test_jaccard_join(spark, edge, empty, monkeypatch):
    assert groups(edge) == brute_groups(EDGE)
    assert groups(empty) == []
    rows = near_copies(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert groups(df) == brute_groups(rows)
    # Small blocks: clusters larger than a side meet piecewise.
    monkeypatch.setattr(jaccard_join, "SIDE", 4)
    monkeypatch.setattr(jaccard_join, "NODE_BYTES", 2_000)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 2_000)
    assert groups(df) == brute_groups(rows)


def test_jaccard_join_with_every_number_of_matches(spark, monkeypatch):
    rows = near_copies(8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_groups(rows)
    for lowest in (1, 2, 3):  # the more matches, the cheaper
        monkeypatch.setattr(jaccard_join, "chosen_matches", lambda lengths, tokens, nodes, lowest=lowest: min(lowest, len(lengths)))
        assert groups(df) == want


def test_templates_do_not_meet(spark, monkeypatch):
    """Documents of 4 of 120 passages: links are found, and blocks compare few of the documents, each of them once."""
    import random

    compared = []
    blocks = jaccard_join._blocks

    def counting(*args):
        out = blocks(*args)
        compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_blocks", counting)
    rng = random.Random(6)
    passages = [" ".join(f"p{i}w{rng.randrange(900)}" for _ in range(60)) for i in range(120)]
    rows = [(i, "\n".join(rng.sample(passages, 4))) for i in range(1600)]
    rows += [(5000 + i, rows[i][1] + " tail") for i in range(40)]
    for n in (800, 1640):
        part = rows[:n] if n == 800 else rows
        assert groups(spark.createDataFrame(part, SCHEMA).repartition(3)) == brute_groups(part)
    assert compared[0] < 800 / 2 and compared[1] < 1640 / 2


def test_jaccard_join_on_documents(spark):
    docs = texts(spark)
    got = sorted((tuple(r) for r in queries.op5_jaccard_join(spark, oracle.SMALL).collect()), key=repr)
    assert got == brute_groups(sorted(docs.items()))


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (None, 1), (100, 5)] + [(i, i + 1) for i in range(200, 240)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {tuple(r) for r in components(df, common.Scratch(spark, "test")).collect()}
    assert got == {(k, 2) for k in (2, 3, 4, 5, 100)} | {(8, 8), (9, 8)} | {(i, 200) for i in range(200, 241)}
    assert components(df.limit(0), common.Scratch(spark, "test")).count() == 0


def brute_quality(docs, good, lang):
    """Counting rules and scores in Python, with Spark's xxhash64; lang: each document's language, by which the verdict is balanced."""
    gap = re.compile(r"[^\x20\x09-\x0D]+")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = {}

    def h(w):
        if w not in word:
            word[w] = xxhash.xxh64_intdigest(w.encode(), 42)
        return word[w]

    def longs(*xs):
        seed = 42
        for x in xs:
            seed = xxhash.xxh64_intdigest((x & ((1 << 64) - 1)).to_bytes(8, "little"), seed)
        return signed(seed)

    def buckets(ws):
        hs = [h(w) for w in ws]
        return [longs(x) & (quality_rules.BUCKETS - 1) for x in hs] + [longs(x, y) & (quality_rules.BUCKETS - 1) for x, y in zip(hs, hs[1:])]

    own = {k: buckets(gap.findall(t or "")) for k, t in docs}
    raw, target = defaultdict(Counter), defaultdict(Counter)
    for k, b in own.items():
        raw[lang[k]].update(b)
        if k in good:
            target[lang[k]].update(b)
    every, trusted = sum(raw.values(), Counter()), sum(target.values(), Counter())
    total, mass, prior = sum(every.values()), sum(trusted.values()), quality_rules.PRIOR * quality_rules.BUCKETS
    plain = lambda b: round(quality_rules.UNIT * math.log((trusted[b] + prior * (p := (every[b] + 1) / (total + quality_rules.BUCKETS))) / ((mass + prior) * p)))

    def fair(b):
        ours = 0.0
        for x, n in raw.items():
            share = sum(n.values()) / total
            ours += share * (target[x][b] + prior * (n[b] + share) / (total + quality_rules.BUCKETS)) / (sum(target[x].values()) + prior * share)
        return round(quality_rules.UNIT * math.log(ours / ((every[b] + 1) / (total + quality_rules.BUCKETS))))

    known = {f: {b: f(b) if mass else 0 for b in every} for f in (plain, fair)}
    out = {}
    for k, t in docs:
        t = t or ""
        w = gap.findall(t)
        lines = [x for x in t.split("\n") if gap.search(x)]
        c = Counter(zip(w, w[1:], w[2:]))
        inside = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        score, balanced = (sum(map(known[f].__getitem__, own[k])) / (quality_rules.UNIT * (2 * len(w) - 1)) if w else 0.0 for f in (plain, fair))
        out[k] = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(inside), failed, not failed and balanced >= quality_rules.THRESHOLD, round(score, 9))
    return out


def test_quality_rules(spark, edge, empty):
    docs = texts(spark)
    labels = common.read(spark, oracle.SMALL, "labels")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    want = brute_quality(sorted(docs.items()), good, langs(spark))
    for r in queries.op3_quality_rules(spark, oracle.SMALL).collect():
        assert (*r[1:8], round(r["score"], 9)) == want[r["doc_id"]]
    none = labels.limit(0)
    rows = quality_rules.quality_rules(edge, none).collect()
    assert len(rows) == len(EDGE) and {r["score"] for r in rows} == {0.0}
    assert {r["base_failed"] for r in rows} == {True}
    assert quality_rules.quality_rules(empty, none).count() == 0
    kept = quality_rules.quality_rules(edge, none, keep=edge.columns)
    assert kept.columns == [*edge.columns, "kept"] and kept.where("kept").count() == 0


def test_language_id(spark, edge, empty):
    rows = queries.op4_language_id(spark, oracle.SMALL).collect()
    lang = {r["doc_id"]: r["lang"] for r in common.read(spark, oracle.SMALL, "documents").collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == language_id.is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95
    profiles = language_id.learn(common.read(spark, oracle.SMALL, "documents"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(edge, profiles).collect()}
    assert got[2] == got[3] == got[4] == "und" and got[1] == "en"
    assert language_id.language_id(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(edge, language_id.learn(empty)).collect()} == {"und"}
    assert language_id.identify(edge, profiles, keep=["text", "length"]).columns == ["text", "length", "lang_pred", "score"]


def brute_profile(text, size):
    """Ranks by Counter: n-grams of letter runs padded with one mark, most frequent first, then by packed code points."""
    counts = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = chr(language_id.PAD) + word + chr(language_id.PAD)
        counts.update(word)
        for n in range(2, language_id.LONGEST + 1):
            counts.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    number = lambda g: sum(ord(c) << 16 * (len(g) - 1 - i) for i, c in enumerate(g))
    return counts, [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))][:size]


def test_language_id_against_brute_force(spark):
    docs = common.read(spark, oracle.SMALL, "documents").collect()
    total = defaultdict(Counter)
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and not language_id.is_held_out(r["doc_id"]):
            total[r["lang"]].update(brute_profile(r["text"], 0)[0])
    number = lambda g: sum(ord(c) << 16 * (len(g) - 1 - i) for i, c in enumerate(g))
    size = language_id.PROFILE
    ranks = {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], number(x[0])))[:size])} for lang, c in total.items()}
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, oracle.SMALL).collect()}
    for r in docs:
        own = brute_profile(r["text"] or "", size)[1]
        away = {lang: sum(abs(at[g] - i) if g in at else size for i, g in enumerate(own)) for lang, at in ranks.items()}
        want = min(sorted(away), key=away.__getitem__) if own else "und"
        assert got[r["doc_id"]]["lang_pred"] == want
        assert abs(got[r["doc_id"]]["score"] - (1 - away[want] / (size * len(own)) if own else 0)) < 1e-12


def test_equally_near_languages_and_marks():
    """Of equally near languages the first by name wins; marks belong to their letters, and alone are no text."""
    same = language_id.profile("one and the same text").tolist()
    assert language_id.Profiles({"b": same, "a": same}).nearest("the same")[0] == "a"
    hindi = language_id.ngrams("\u0939\u093f\u0928\u094d\u0926\u0940")[0]
    assert len(language_id.ngrams("\u0939 \u0928 \u0926")[0]) != len(hindi) and not len(language_id.ngrams("\u093f \u094d")[0])


def test_html(spark):
    pages = [(1, "u", "<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>Some  text &amp; more.</p></article><footer>&copy; me</footer>"), (2, None, None), (2, None, None), (3, "v", "")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    rows = {r["page_id"]: r for r in html_extraction.extract(df).collect()}
    assert rows[1]["text"] == "Title\nSome text & more." and rows[1]["n_chars"] == 23
    assert rows[2]["text"] == rows[3]["text"] == "" and rows[2]["url"] is None
    assert html_extraction.extract(df.limit(0)).count() == 0
    assert html_extraction.extract(df).count() == 4


def test_warc(spark):
    body = "<p>same</p>"
    pages = [(1, "http://a.com/1", body), (2, "http://b.com/2", body), (3, "http://a.com/3", "other é"), (4, None, None), (5, "http://c.com", ""), (3, "http://a.com/3", "other é"), (9, "http://a.com/1", body)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = Counter()
    first = {}
    for k, _, x in pages:
        first[x or ""] = min(k, first.get(x or "", k))
    for k, _, x in pages:
        raw = (x or "").encode()
        again = first[x or ""] != k
        want[k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[x or ""] if again else None] += 1
    assert Counter(tuple(r) for r in warc.round_trip(df).collect()) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_capture_index(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/p{i // 2}", f"page {i}") for i in range(100)], "page_id long, url string, html string").repartition(4)
    scratch = common.Scratch(spark, "test")
    folder, at = scratch.path("archives"), scratch.path("index")
    captures = scratch.write(warc.write_archives(pages, folder), "captures")
    warc.build_index(captures, at, block_lines=4)
    index = warc.CaptureIndex(spark, at)
    assert sum(r["blocks"] for r in spark.read.parquet(f"{at}/root").collect()) >= 25 and len(index.root) <= common.shuffle_partitions(spark)
    wanted = spark.createDataFrame([(warc.url_key("http://h3.org/p5"),), (warc.url_key("http://none.org/"),)], "url_key string")
    assert 1 <= index.blocks_of(wanted).count() <= 3  # of 25 and more
    found = index.lookup(["http://www.h3.org/p5", "http://none.org/"])
    assert {r["id"] for r in found.collect()} == {i for i in range(100) if i % 7 == 3 and i // 2 == 5}
    read = warc.read_ranges(found, folder, with_payload=True).collect()
    assert {bytes(r["payload"]).decode() for r in read} == {f"page {r['id']}" for r in read}


def test_capture_index_opens_only_blocks_that_it_needs(spark, tmp_path):
    """With all other bytes of the block files spoilt, a look-up still gives its captures; a frequent key spans files."""
    urls = ["http://a.org/hot"] * 300 + [f"http://b{i:03}.org/" for i in range(100)]
    captures = spark.createDataFrame([(i, warc.url_key(u), "x", i, 1) for i, u in enumerate(urls)], "id long, url_key string, archive string, offset long, length long").repartition(3)
    at = str(tmp_path / "index")
    warc.build_index(captures, at, block_lines=8)
    index = warc.CaptureIndex(spark, at)
    keys = spark.createDataFrame([(warc.url_key(u),) for u in ("http://b007.org/", "http://b050.org", "http://a.org/zzz")], "url_key string")
    good = {(r["file"], r["offset"]): r["length"] for r in index.blocks_of(keys).collect()}
    for path in (tmp_path / "index").glob("*.blocks"):
        data = bytearray(path.read_bytes())
        keep = {j for (f, o), n in good.items() if f == path.stem for j in range(o, o + n)}
        path.write_bytes(bytes(x if j in keep else 0 for j, x in enumerate(data)))
    for crc in (tmp_path / "index").glob(".*.crc"):
        crc.unlink()
    assert {r["id"] for r in index.captures(keys).collect()} == {307, 350}
    warc.build_index(captures, str(tmp_path / "again"), block_lines=8)
    hot = warc.CaptureIndex(spark, str(tmp_path / "again")).lookup(["http://a.org/hot"])
    assert sorted(r["id"] for r in hot.collect()) == list(range(300))


def test_warc_with_long_payloads_and_clashing_names(spark):
    body = "é<p>" * 700_000
    pages = [(1, "u", body, "x"), (2, "u", body, "y"), (3, "v", body + ".", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest string").withColumn("_sha", F.lit(1)).withColumn("offset", F.lit("o"))
    rows = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert rows[1]["payload_bytes"] == len(body.encode()) and rows[2]["refers_to"] == 1 and rows[3]["record_type"] == "response"


def test_chats(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (4, 0, "user", "x"), (5, 0, None, None), (None, 0, "user", "lost"), (6, 0, "user", "a"), (6, 1, "assistant", "c")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, n_turns string").repartition(3)
    rows = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert set(rows) == {1, 4, 5, 6}  # 2 prefixes 1 and 6; 3 equals 1
    assert rows[1]["n_copies"] == 2 and rows[1]["n_turns"] == 2 and rows[1]["n_reply_chars"] == 1
    assert rows[1]["text"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_very_long_conversations(spark):
    """Thousands of turns and a very long one: the longer of two that begin alike stays."""
    turns = [(c, i, "user" if i % 2 == 0 else "assistant", LONG if i == 1 else f"t{i}") for c, n in ((1, 3000), (2, 2999), (3, 1)) for i in range(n)]
    rows = {r["conv_id"]: r for r in chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert set(rows) == {1} and rows[1]["n_turns"] == 3000 and rows[1]["text"].count("<|im_start|>") == 3000 and LONG in rows[1]["text"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, oracle.SMALL), oracle.database(), queries.ORACLE_SQL[name]) == ""
