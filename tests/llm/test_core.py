"""Pieces of the training-data operators that need no session, against brute force."""

from __future__ import annotations

import gzip
import html as entities
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import fingerprints, html_extraction, jaccard_join, language_id, packing, piece_encoding, queries, segments, shingles, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=" \n\taBbé日.,'s0<|  ́", max_size=60)


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}) if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_shingle_sets(texts):
    flat, at = shingles.shingles(*shingles.text_bytes(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        own = tuple(flat[at[i] : at[i + 1]].tolist())
        assert len(own) == len(shingle_set(t)) and list(own) == sorted(own)
        assert seen.setdefault(frozenset(shingle_set(t)), own) == own
    assert len(set(seen.values())) == len(seen)


def test_shingles_do_not_depend_on_blocks(monkeypatch):
    texts = ["alpha beta gamma delta epsilon zeta eta " * 20, "x" * 500, "", "a b c d e f"]
    whole = shingles.shingles(*shingles.text_bytes(pa.array(texts)))[0].tolist()
    monkeypatch.setattr(shingles, "BLOCK", 32)
    assert shingles.shingles(*shingles.text_bytes(pa.array(texts)))[0].tolist() == whole


def thue_morse(n):
    """The word of 2**n letters and its complement, which polynomial hashes modulo a power of two do not tell apart."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [3, 5, 6, 7, 10, 11, 12])
def test_words_built_alike_have_different_hashes(n):
    a, b = thue_morse(n)
    texts = [a, b, f"one two {a} three four five", f"one two {b} three four five", f"{a} {b}", f"{b} {a}"]
    flat, at = shingles.shingles(*shingles.text_bytes(pa.array(texts)))
    assert len({tuple(flat[lo:hi].tolist()) for lo, hi in zip(at, at[1:])}) == len(texts)
    assert not fingerprints.likeness(*fingerprints.sketches(pa.array([a, b])))
    words = segments.WordPieces(queries.tokenizer_path("word_bpe_49k.json"))
    for t, got in zip(texts, words.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(segments, "word_hashes", lambda data, begins, ends: (ends - begins).astype(np.uint64) % np.uint64(3))
    words = segments.WordPieces(queries.tokenizer_path("word_bpe_49k.json"))
    for t in ("one two six ten twelve nineteen", "six one " + "x" * 70 + " twelve", "eleven1 a-b 12"):
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def coders():
    return segments.WordPieces(queries.tokenizer_path("word_bpe_49k.json")), segments.LengthMemo(queries.tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_ids_and_lengths_are_the_librarys(coders, text):
    words, memo = coders
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert memo.lengths([text]) == [len(memo.tokenizer.encode(text, add_special_tokens=False))]


@pytest.mark.parametrize("text", ["a<|endoftext|> b", "<|startoftext|>x", "don't CAN'T 'RE", "İ ΣΑΣ ﬁ", "   lead and trail   ", "x" * 3000, "日本語", "a\x1cb"])
def test_special_texts(coders, text):
    words, memo = coders
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert memo.lengths([text]) == [len(memo.tokenizer.encode(text, add_special_tokens=False))]


def test_memos_may_overflow():
    words = segments.WordPieces(queries.tokenizer_path("word_bpe_49k.json"), most_bytes=100)
    memo = segments.LengthMemo(queries.tokenizer_path("byte_bpe_50k.json"), most_bytes=700)
    for t in ("one two three four", "five six seven, eight nine", "one six"):
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids
        assert memo.lengths([t]) == [len(memo.tokenizer.encode(t, add_special_tokens=False))]


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(1, 20))
def test_safe_splits(text, most):
    parts = token_counts.split_safely(text * 3, most)
    assert "".join(parts) == text * 3
    for a, b in zip(parts, parts[1:]):
        assert not a[-1].isspace() and b[0].isspace()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 10), st.integers(0, 6000), st.sampled_from([256, 512, 1024, 2048])), max_size=40))
def test_packing_holds_every_id_once_without_padding(lengths):
    at = {}
    for context, window in packing.pack(lengths):
        assert sum(w[2] for w in window) == context and context & (context - 1) == 0 and context <= 2048
        for doc, start, n in window:
            at.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        end = 0
        for start, size in sorted(at.get(doc, [])):
            assert start == end and size > 0
            end += size
        assert end == n


def test_packing_prefers_long_windows():
    rng = random.Random(1)
    out = packing.pack([rng.randint(1, 1500) for _ in range(4000)])
    assert sum(c < 256 for c, _ in out) <= 11  # the tail only


def test_step_groups_are_balanced():
    rng = random.Random(4)
    sequences = packing.pack([int(rng.paretovariate(0.8) * 60) for _ in range(6000)])
    groups = packing.step_groups(sequences)
    for context in packing.TIERS:
        cost, count = {}, {}
        for (c, window), g in zip(sequences, groups):
            if c == context:
                count[g] = count.get(g, 0) + 1
                cost[g] = cost.get(g, 0) + sum(n * n for _, _, n in window)
        assert max(count.values()) - min(count.values()) <= 1 and max(count.values()) * context <= packing.STEP_TOKENS
        least = -(-sum(count.values()) // (packing.STEP_TOKENS // context))
        assert len(count) == least
        assert max(cost.values()) <= 1.25 * min(cost.values()) or len(count) == 1
    assert packing.step_groups([]) == []


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_piece_spans_cover_the_text(text):
    m = piece_encoding.model(queries.tokenizer_path("piece_bpe_32k.model"))
    raw = text.encode()
    ids = np.array(m.processor.encode(text) + [m.end])
    spans = m.spans(raw, ids)
    assert spans[-1].tolist() == [len(raw), len(raw)]
    assert spans[:-1, 1].tolist()[-1:] in ([], [len(raw)]) and (spans[1:, 0] == spans[:-1, 1]).all() | (len(spans) < 2)


def build_map(rules: dict[bytes, bytes]) -> bytes:
    """A compiled map with one double-array unit block per node: enough for a few rules."""
    texts, offsets = b"", {}
    for k, v in rules.items():
        offsets[k] = len(texts)
        texts += v + b"\0"
    units, used, bases = [0] * 4096, {0}, set()
    nodes = [(0, b"")]
    while nodes:
        pos, prefix = nodes.pop()
        labels = sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in rules
        base = next(b for b in range(256, 4096) if b not in bases and all((b ^ x) not in used for x in [*labels, *([0] if leaf else [])]) and (b ^ pos) < (1 << 21))
        bases.add(base)
        units[pos] |= (base ^ pos) << 10 | (leaf << 8)
        if leaf:
            used.add(base)
            units[base] = offsets[prefix] | 1 << 31
        for x in labels:
            used.add(base ^ x)
            units[base ^ x] |= x
            nodes.append((base ^ x, prefix + bytes([x])))
    blob = b"".join(u.to_bytes(4, "little") for u in units)
    return len(blob).to_bytes(4, "little") + blob + texts


def test_longest_prefix_of_a_compiled_map():
    chars = piece_encoding.CharsMap(build_map({b"a": b"A", b"ab": b"X", "é".encode(): b"e"}))
    assert chars.longest(b"abc", 0) == (2, b"X") and chars.longest(b"ac", 0) == (1, b"A") and chars.longest(b"c", 0) is None
    m = object.__new__(piece_encoding.PieceModel)
    m.map, m.prefix, m.fold, m.escape, m.suffix, m.own, m.plain = chars, True, True, True, False, [], False
    normal, at = m.aligned("  ab  éa ".encode())
    assert normal.decode() == "▁X▁eA"
    assert at.tolist() == [2, 2, 2, 2, 4, 4, 4, 6, 8, 9]


def test_sketches_estimate_and_merge():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(6000)]
    rng.shuffle(words)
    long, part = " ".join(words), " ".join(words[:3000])
    a, b = fingerprints.sketches(pa.array([long, part]))
    x, y = shingle_set(long), shingle_set(part)
    assert abs(fingerprints.likeness(a, b) - len(x & y) / len(x | y)) < 0.06
    assert fingerprints.containment(b, a) == 1.0
    assert np.array_equal(fingerprints.merged(a, b).kept, a.kept)
    assert fingerprints.parsed(fingerprints.written(a)).kept.tolist() == a.kept.tolist()
    empty, short = fingerprints.sketches(pa.array(["", "two words"]))
    assert fingerprints.likeness(empty, empty) == 1.0 and fingerprints.likeness(short, short) == 1.0 and fingerprints.likeness(empty, short) == 0.0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=400), min_size=2, max_size=6))
def test_a_union_of_sketches_is_the_sketch_of_the_union(texts):
    sets = [shingles.shingles(*shingles.text_bytes(pa.array([t])))[0] for t in texts]
    union = np.unique(np.concatenate(sets))
    total = fingerprints.sketches(pa.array([texts[0]]))[0]
    for t in texts[1:]:
        total = fingerprints.merged(total, fingerprints.sketches(pa.array([t]))[0])
    assert total.kept.tolist() == np.unique(union[union < np.uint64(1 << 63)] >> np.uint64(32)).tolist()
    assert total.least == (int(union[0]) if len(union) else None)
    assert fingerprints.written(fingerprints.parsed(fingerprints.written(total))) == fingerprints.written(total)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_linked_nodes_share_the_prefixes(data):
    """Two sets over the threshold have l tokens in common in their prefixes for l, for every l that both have one for."""
    names = data.draw(st.lists(st.integers(1, 9), min_size=1, max_size=12))
    often = data.draw(st.lists(st.integers(2, 5), min_size=len(names), max_size=len(names)))
    nodes = []
    for _ in range(2):
        own = data.draw(st.sets(st.integers(0, len(names) - 1), min_size=1))
        lone = data.draw(st.integers(0, 6))
        rows = sorted((often[i], i) for i in own)
        nodes.append((sum(names[i] for i in own) + lone, np.array([(o, names[i], i) for o, i in rows], jaccard_join._TOKEN)))
    (na, x), (nb, y) = nodes
    both = sum(names[i] for i in set(x["name"].tolist()) & set(y["name"].tolist()))
    if 100 * both >= 75 * (na + nb - both):
        for m, (p, q) in enumerate(zip(jaccard_join.prefixes(na, x, 75), jaccard_join.prefixes(nb, y, 75)), 1):
            assert len(set(x["name"][:p].tolist()) & set(y["name"][:q].tolist())) >= m
        assert jaccard_join.prefixes(na, x, 75) and jaccard_join.prefixes(nb, y, 75)
    assert jaccard_join.overlaps([x, y])[0, 1] == both


def test_language_profiles():
    grams, counts = language_id.ngrams("ab, AB!")
    assert dict(zip(grams.tolist(), counts.tolist()))[ord("a")] == 2
    assert language_id.profile("12 34 .,").tolist() == []
    ranked = {k: language_id.profile(t).tolist() for k, t in {"x": "the then there this that", "y": "und der die das und"}.items()}
    p = language_id.Profiles(ranked)
    assert p.nearest("these them the")[0] == "x" and p.nearest("des und dem")[0] == "y" and p.nearest("…") == ("und", 0.0)
    own, score = p.nearest("the then there this that")
    assert own == "x" and score == 1.0


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a<p>b<div>c</div>d<br>e", ["a", "b", "c", "d e"]),
        ("<ul><li>x<li>y</ul>", ["x", "y"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("a &lt;b&gt; &#233;\n\n c<!-- no --><script>var x='</p>'</script><style>p{}</style>", ["a <b> é c"]),
        ("<div hidden>no</div><span>in</span>line", ["inline"]),
        ("", []), ("<", ["<"]), ("<p", []), ("<script>never closed", []),
        ("<head><title>t</title><meta x><p>a", ["a"]), ("<head>text", ["text"]), ("<body>a</body></html>b", ["ab"]),
        ("<select><option>a<p>after", ["after"]), ("<select><option>a<option>b</select>c", ["c"]), ("&am<b></b>p;", ["&am p;".replace(" ", "")]),
        ("<li><p>a<li>b", ["a", "b"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]), ("</p>a</x>b", ["ab"]),
        ("<a title='x>y'>z</a>", ["z"]), ("<a title='x>y", ["y"]), ("<!-->a<!--b-->c<!d>e<?f>g", ["aceg"]), ("<p style='display: none'>x</p>y", ["y"]),
    ],
)
def test_leaf_blocks(page, texts):
    assert [b.text for b in html_extraction.leaf_blocks(page)] == texts


def brute_decode(field, blocks):
    from itertools import product

    def score(ys):
        total = sum(sum(field.lean.get(f, 0.0) for f in [*context, *own]) for (context, own), y in zip(html_extraction.features(blocks), ys) if y)
        return total + field.start[ys[0]] + sum(field.moves[a][b] for a, b in zip(ys, ys[1:]))

    return max(product((0, 1), repeat=len(blocks)), key=score)


PROSE = "This is a fairly long paragraph of ordinary prose, with several words in it, and it ends as sentences do. It even has a second sentence."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>P</p></article>", "T\nP"),
        ('<body><div class="zzq"><div class="kk"><a href=/>Home</a> <a href=/b>News</a></div><div class="x1"><div class="qp"><h1>Title here</h1><p>P</p><p>P</p></div></div></div>', "Title here\nP\nP"),
        ("<body><section><h2>Heading</h2><p>P</p><p>P</p></section>", "Heading\nP\nP"),
        ("<body><header><a href=/>Site</a></header><article><header><h1>My title</h1></header><p>P</p></article>", "My title\nP"),
        ("<body><article><h1>T</h1><p>P</p><div id=comments><p>reader says things</p></div></article>", "T\nP"),
        ("<body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><h1>Old page</h1><p>P</p><p>P</p></td></tr></table>", "Old page\nP\nP"),
        ("<article><select><option>a<p>P</article>", "P"),
        ('<main><h1>T</h1><p>P</p><div class="newsletter"><p>Sign up now.</p></div><p>P</p></main><div class="cookie-consent"><p>We use cookies.</p></div>', "T\nP\nP"),
    ],
)
def test_layouts_the_field_was_not_fitted_on(page, text):
    assert html_extraction.main_text(page.replace("P</", f"{PROSE}</"), html_extraction.default_field())[0] == text.replace("P", PROSE)


@pytest.mark.parametrize(
    "page",
    ["<p>word word word. </p>" * 400_000, "<div class=a>" * 100_000 + "x", "".join(f"<div class=c{i}q>" for i in range(50_000)) + "x", "<a title=\"x>" * 100_000, "<b>" * 50_000 + "<p>a" * 50_000, "<div>" * 50_000 + "</x></p>" * 100_000, "<!--" * 200_000],
    ids=["long", "deep", "marks", "quotes", "inline", "ends", "comments"],
)
def test_time_is_linear_in_the_page(page):
    begin = time.process_time()
    html_extraction.main_text(page, html_extraction.default_field())
    assert time.process_time() - begin < 40


def test_pages_have_the_text_of_their_article_elements():
    """Every page of the driver's table against its article element, cut out by another way."""
    for (page,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert html_extraction.main_text(page, html_extraction.default_field())[0] == "\n".join(filter(None, parts))


def test_field_learns_and_decodes_the_best_sequence():
    field = html_extraction.default_field()
    right = every = 0
    for page, labels in html_extraction.labelled_pages(150, seed=321):
        blocks = html_extraction.leaf_blocks(page)
        got = field.decode(blocks)
        right, every = right + sum(a == b for a, b in zip(got, labels)), every + len(labels)
        if len(blocks) <= 9:
            assert tuple(map(int, got)) == brute_decode(field, blocks)
    assert right / every > 0.98


def test_warc_records_round_trip():
    digest = warc.base32_sha1(b"abc")
    one, two = warc.record("response", "http://a/\r\nx", b"abc", digest, "urn:page:1"), warc.record("revisit", "http://b/", b"abc", digest, "urn:page:2", "urn:page:1")
    data = gzip.compress(one, mtime=0) + gzip.compress(two, mtime=0)
    got = [(at, n, warc.parse(c)) for at, n, c in warc.members(data)]
    assert [g[2][1] for g in got] == [b"abc", b""] and got[1][2][0]["warc-refers-to"] == "<urn:page:1>"
    assert got[1][0] == got[0][1] and sum(g[1] for g in got) == len(data)


@pytest.mark.parametrize(
    ("url", "key"),
    [("http://www.Example.com/a?b=1#c", "com,example)/a?b=1"), ("https://m.x.org:8080", "org,x,m:8080)/"), ("http://u:p@h.de:80/p", "de,h)/p"), ("", ")/"), (None, ")/")],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key
