"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (runs of text without a block-level boundary), each with
features of its ancestors' tags, classes and ids, of its own text (length, links, sentence marks, short words,
digits), of its neighbours' and of its place. Two labels, article and rest; feature weights and label
transitions are fitted by gradient ascent of the likelihood on labelled pages, and a page is decoded by Viterbi.
Labelled pages come from labelled_pages(), generated layouts of many kinds with known parts (semantic elements,
telling class names, meaningless ones, tables, no container at all); callers may bring their own.
"""

from __future__ import annotations

import html as entities
import random
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .html_blocks import Block, leaf_blocks

BATCH_BYTES = 1 << 20
#: Labelled pages that the default model is fitted on, passes over them, step size, penalty, and the transitions' share of the step.
TRAINING_PAGES = 2000
PASSES = 150
STEP = 1.0
PENALTY = 5e-5
SLOW = 0.1
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


#: Marks of sentences in any script of the basic plane: punctuation that Unicode classes as other, but for signs that text uses as symbols.
_MARKS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Po" and c not in "#%&*@/\\\'\"§¶†‡•·")
_MARK = re.compile(f"[{re.escape(_MARKS)}]")
_ENDS = frozenset(_MARKS + "\"'”’»」』）)")
#: Scripts that write without spaces, or a syllable or word a character: a character says as much as two or three letters.
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u9fff\uac00-\ud7af\uf900-\ufaff]")
#: What notices, adverts and comments say of themselves, whatever their elements are called.
PHRASES = {
    "notice": ("cookies", "cookie policy", "privacy policy", "accept all", "gdpr", "subscribe", "newsletter", "your consent", "enable javascript", "sign up", "sign in", "register now", "join our", "datenschutz", "akzeptieren", "abonnieren", "confidentialité", "accepter", "aceptar", "privacidad", "suscríbete"),
    "ad": ("advertisement", "sponsored", "buy now", "free shipping", "% off", "anzeige", "gesponsert", "publicité", "publicidad", "promoted"),
    "comments": ("reply", "posted by", "log in to comment", "leave a comment", "says:", "antworten", "répondre", "responder"),
    "aside": ("read more", "related articles", "share this", "most popular", "weiterlesen", "lire la suite", "leer más"),
    "footer": ("all rights reserved", "terms of use", "impressum", "mentions légales", "aviso legal"),
}
_SAYS_ANY = re.compile("|".join(re.escape(p) for told in PHRASES.values() for p in told))
_SAYS = {kind: re.compile("|".join(map(re.escape, told))) for kind, told in PHRASES.items()}


def _step(x: float, *bounds: float) -> int:
    """How many bounds x reaches."""
    return sum(x >= b for b in bounds)


def _dense(block: Block) -> int:
    return _step(block.linked / len(block.text), 0.05, 0.5, 0.9)


def features(blocks: list[Block]) -> list[tuple[frozenset[str], list[str]]]:
    """For each block the names of its ancestors' features, shared among blocks, and of its own."""
    n, out = len(blocks), []
    widths = [len(b.text) if b.text.isascii() else len(b.text) + 1.5 * len(_WIDE.findall(b.text)) for b in blocks]
    sizes = [_step(w, 12, 25, 50, 100, 200, 400, 800) for w in widths]
    dense = [_dense(b) for b in blocks]
    for i, b in enumerate(blocks):
        text, words = b.text, b.text.split(" ")
        few = [w for w in words if len(w) < 4 and (w.isascii() or not _WIDE.search(w))]
        own = [
            "bias", f"tag={b.tag}", f"near={b.part}", f"length={sizes[i]}", f"linked={dense[i]}", f"length={sizes[i]} linked={dense[i]}",
            f"near={b.part} length={sizes[i]}", f"marks={_step(len(_MARK.findall(text)), 1, 2, 4, 8)}", f"short={_step(len(few) / len(words), 0.01, 0.2, 0.5)}",
            f"digits={_step(sum(map(str.isdigit, text)) / len(text), 0.01, 0.1, 0.4)}", f"depth={_step(b.depth, 1, 2, 3, 5, 8, 13)}",
            f"place={_step(i / n, 0.1, 0.25, 0.5, 0.75, 0.9) if n > 3 else 'any'}", f"before={(sizes[i - 1], dense[i - 1] > 1) if i else 'none'}", f"after={(sizes[i + 1], dense[i + 1] > 1) if i + 1 < n else 'none'}",
        ]
        if b.tag in HEADINGS:
            own.append(f"heads={(sizes[i + 1] > 2, dense[i + 1] > 1) if i + 1 < n else 'none'}")
        if text[-1] in _ENDS:
            own.append("ends")
        if n < 3:
            own += [f"alone={n} length={sizes[i]} linked={dense[i]}", f"alone ends={text[-1] in _ENDS} linked={dense[i]}"]
        low = text.lower()
        if _SAYS_ANY.search(low):
            own += [f"says={kind} length={_step(widths[i], 60, 200, 600)}" for kind, said in _SAYS.items() if said.search(low)]
        if text[:1].isupper():
            own.append("capital")
        if "©" in text or "(c)" in low:
            own.append("rights")
        out.append((b.context, own))
    return out


class Field:
    """Feature weights (n, 2), transitions (2, 2) and start scores (2,); label 1 is the article."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.lean = {k: float(weights[i, 1] - weights[i, 0]) for k, i in names.items()}
        self.known = frozenset(k for k in names if k.startswith(("mark=", "last=", "in=")))
        self.moves, self.start = moves.tolist(), start.tolist()

    def leanings(self, blocks: list[Block]) -> list[float]:
        """How far each block's features alone speak for the article."""
        lean, shared, out = self.lean, {}, []
        for context, own in features(blocks):
            if context not in shared:
                shared[context] = sum(lean.get(f, 0.0) for f in sorted(context))
            out.append(shared[context] + sum(lean.get(f, 0.0) for f in own))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels by Viterbi; of equally likely ones, rest before article."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.moves
        back: list[tuple[int, int]] = []
        zero, one = self.start
        for i, e in enumerate(self.leanings(blocks)):
            if i == 0:
                one += e
                continue
            to0 = (zero + m00, 0) if zero + m00 >= one + m10 else (one + m10, 1)
            to1 = (zero + m01, 0) if zero + m01 >= one + m11 else (one + m11, 1)
            back.append((to0[1], to1[1]))
            zero, one = to0[0], to1[0] + e
        label = int(one > zero)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]


def fit(pages: Iterable[tuple[str, list[bool]]], passes: int = PASSES, step: float = STEP, penalty: float = PENALTY) -> Field:
    """A field fitted to pages (html, a label for each leaf block) by gradient ascent of the mean log-likelihood."""
    sequences = [([[*sorted(context), *own] for context, own in features(leaf_blocks(h))], labels) for h, labels in pages]
    sequences = [(f, y) for f, y in sequences if f]
    names: dict[str, int] = {}
    for f, y in sequences:
        if len(f) != len(y):
            raise ValueError("a page needs one label for each leaf block")
        for own in f:
            for name in own:
                names.setdefault(name, len(names))
    n, longest = len(sequences), max(len(f) for f, _ in sequences)
    gold, there = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (f, y) in enumerate(sequences):
        there[i, : len(f)] = True
        gold[i, : len(f)] = y
    # The features of all blocks, page after page, and where each block's begin.
    ids = np.array([names[x] for f, _ in sequences for own in f for x in own])
    sizes = np.array([len(own) for f, _ in sequences for own in f])
    begins = np.cumsum(sizes) - sizes
    # The two labels' weights of a feature are each other's negatives: their gradients are, and both begin at 0.
    w, moves, start = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    speeds = [np.full_like(x, 1e-8) for x in (w, moves, start)]
    hot = np.eye(2)[gold] * there[:, :, None]
    pair_there = there[:, 1:] & there[:, :-1]
    gold_moves = np.einsum("nta,ntb,nt->ab", hot[:, :-1], hot[:, 1:], pair_there)
    for _ in range(passes):
        e = np.zeros((n, longest, 2))
        lean = np.add.reduceat(w[ids], begins)
        e[there] = np.stack([-lean, lean], axis=1)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = e[:, 0] + start
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves[None], axis=1) + e[:, t]
            forward[:, t] = np.where(there[:, t, None], nxt, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            prv = np.logaddexp.reduce(moves[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], prv, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        single = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
        double = np.exp(forward[:, :-1, :, None] + moves[None, None] + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pair_there[:, :, None, None]
        gap = hot - single
        gw = np.bincount(ids, np.repeat(gap[there][:, 1], sizes), len(names))
        grads = [gw / n - penalty * w, (gold_moves - double.sum(axis=(0, 1))) / n - penalty * moves, gap[:, 0].sum(axis=0) / n - penalty * start]
        # Transitions learn slowly, so that features explain what they can: a single foreign block inside an article must not be smoothed over.
        for x, g, s, rate in zip((w, moves, start), grads, speeds, (step, SLOW * step, SLOW * step), strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Field(names, np.stack([-w, w], axis=1), moves, start)


#: Stands before each stretch of article text while a page is generated: blocks that have it are labelled article.
_TRUE = "\ue000"


class _Layouts:
    """Generates pages with invented words."""

    PARTS = ("la", "re", "mi", "to", "ne", "sa", "ku", "vi", "do", "pe", "sch", "ion", "ent", "ing", "ó", "é", "ü", "th", "er", "an")
    MARKS = {
        "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination topnav main-menu toc links toolbar skip",
        "header": "header masthead site-header branding topbar logo site-title top tagline",
        "ad": "ad ads advert advertisement sponsored promo promotion sponsor adsbygoogle banner-ad banner adbox partner commercial",
        "aside": "sidebar side aside related recent popular tags share social trending more recommended author-bio widget rail teaser see-also",
        "notice": "notice cookie cookies consent gdpr alert newsletter subscribe popup modal warning disclaimer paywall announcement message overlay",
        "form": "search login contact signup form register poll survey",
        "comments": "comments comment-list discussion responses respond disqus replies feedback reader-comments thread user-posts user-comments",
        "footer": "footer site-footer copyright legal bottom colophon foot credits",
        "article": "content article post entry story main-content article-body post-content text body page-content main hentry prose",
    }

    #: Letters of a page's words, what stands between words, the marks within and at the end of a sentence, and words a Latin one makes.
    SCRIPTS = (
        (tuple(map(chr, range(0x4E00, 0x4E00 + 600))), "", "，、；", "。。。！？", 1), (tuple(map(chr, range(0x3042, 0x3094))), "", "、", "。。！？", 2), (tuple(map(chr, range(0xAC00, 0xAC00 + 400))), " ", ",", "..!?", 1),
        (tuple(map(chr, range(0x430, 0x450))), " ", ",;:", "...!?", 3), (tuple(map(chr, range(0x627, 0x64B))), " ", "،؛", "..!؟", 3), (tuple(map(chr, range(0x905, 0x93A))), " ", ",", "।।!?", 3), (tuple(map(chr, range(0xE01, 0xE2F))), "", " ", " ", 4),
    )
    LATIN = (PARTS, " ", ",,:", "....!?", 1)

    def __init__(self, rng: random.Random):
        self.rng, self.script = rng, self.LATIN

    def word(self) -> str:
        letters, _, _, _, more = self.script
        return "".join(self.rng.choices(letters, k=more * self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, lo: int, hi: int) -> str:
        return self.script[1].join(self.word() for _ in range(self.rng.randint(lo, hi))).capitalize()

    def phrase(self, kind: str) -> str:
        """What such a part says, or nothing."""
        return f" {self.rng.choice(PHRASES[kind])}{self.rng.choice(('', '.', '!'))} " if kind in PHRASES and self.rng.random() < (0.7 if kind == "notice" else 0.4) else ""

    def sentence(self, lo: int = 1, hi: int = 40) -> str:
        """A text of some sentences, once in a while with odd ends or characters."""
        rng, out = self.rng, []
        if rng.random() < 0.12:  # a word over and over, or words and signs without sentences
            return " ".join(rng.choice((self.word(), self.sign(), self.sign())) for _ in range(rng.randint(lo, hi))) if rng.random() < 0.5 else " ".join([self.words(1, 1)] * rng.randint(lo, 3 * hi))
        left = rng.randint(lo, hi)
        while left > 0:
            n = min(left, rng.randint(3, 18))
            out.append(self.words(n, n) + rng.choice((*self.script[3], rng.choice(self.script[2]), "")))
            left -= n
        said = f" {rng.choice(rng.choice(tuple(PHRASES.values())))} {self.words(1, 9)}." if rng.random() < 0.02 else ""
        return self.script[1].join(out) + said + rng.choice(("",) * 8 + (f" {self.sign()}", f" {self.sign()}", f" {rng.randint(1, 3000)}", f" &lt;{self.word()}&gt;"))

    def sign(self) -> str:
        """A sign or two that no sentence has, as page text writes it."""
        sign = self.rng.choice(string.punctuation + "→•§°€©")
        return entities.escape(sign * self.rng.choice((1, 1, 2, 3)))

    def mark(self, kind: str) -> str:
        """An attribute whose words tell the kind."""
        name = self.rng.choice(self.MARKS[kind].split())
        if self.rng.random() < 0.3:
            return f' id="{name}"'
        return f' class="{name}{self.rng.choice(("", "", "-box", "-wrapper", "_area", " widget", " block", " clearfix", "Container"))}"'

    def odd(self) -> str:
        """An attribute that tells nothing, or none."""
        return self.rng.choice(("", "", f' class="{self.word()}"', f' id="{self.word()}{self.rng.randint(1, 99)}"', f' class="{self.word()} {self.word()}"'))

    def links(self, n: int) -> str:
        rng = self.rng
        one = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        return rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>", rng.choice((" | ", " ", " &middot; ")).join(one), "".join(f"<div>{x}</div>" for x in one)))

    def around(self, kind: str, style: str) -> str:
        rng = self.rng
        if kind == "nav":
            body = self.links(rng.randint(2, 8))
        elif kind == "header":
            body = rng.choice((f"<h1>{self.words(1, 4)}</h1><p>{self.sentence(2, 9)}</p>", f"<div>{self.words(1, 4)}</div>", f'<a href="/">{self.words(1, 3)}</a>{self.links(3)}'))
        elif kind == "ad":
            body = f"{rng.choice(('', '<p>'))}{self.sentence(2, 40)}{self.phrase('ad')}"
        elif kind == "aside":
            body = rng.choice((f"<h3>{self.words(1, 4)}</h3>{self.links(rng.randint(2, 6))}", f"<h2>{self.words(1, 3)}</h2><p>{self.sentence(3, 50)}</p>", f"<p>{self.sentence(3, 30)}</p>"))
        elif kind == "notice":
            body = f"{rng.choice(('<p>', ''))}{self.phrase('notice')}{self.sentence(3, 40)}{self.phrase('notice')}{rng.choice(('', '<button>' + self.words(1, 2) + '</button>'))}"
        elif kind == "form":
            return f"<form{rng.choice(('', self.mark('form')))}><label>{self.words(1, 4)}</label><input name=q>{rng.choice(('', '<p>' + self.sentence(2, 20) + '</p>'))}<button>{self.words(1, 2)}</button></form>"
        elif kind == "comments":
            t = rng.choice(("div", "li", "div", "p", "article"))
            own = rng.choice((self.mark("comments"), " class=comment", " class=reply", *("",) * (3 if t != "article" else 0)))
            rows = "".join(f"<{t}{own}>{rng.choice(('', '<b>' + self.words(1, 2) + '</b>'))}{rng.choice(('<p>', ''))}{self.sentence(2, 60)}{self.phrase('comments')}</{t}>" for _ in range(rng.randint(1, 5)))
            body = f"{rng.choice(('', '<h3>' + self.words(1, 3) + '</h3>'))}{rows}"
        else:
            body = rng.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentence(2, 20)}", f"<p>&copy; {self.words(1, 4)}</p>{self.links(3)}", f"<p>{self.sentence(2, 25)}</p>"))
        told = any(p in body for p in PHRASES.get(kind, ()))
        if told and kind in ("notice", "ad") and rng.random() < 0.5:  # only its words tell
            return f"<{(t := rng.choice(('div', 'div', 'section', 'p')))}{self.odd()}>{body}</{t}>"
        tag = {"nav": "nav", "header": "header", "aside": "aside", "footer": "footer"}.get(kind)
        if style == "unnamed" and kind in ("nav", "footer", "header"):
            if kind == "footer" and "&copy;" not in body:
                body = f"&copy; {body}"
            return f"<div{self.odd()}>{body}</div>"
        if tag and rng.random() < (0.6 if style == "semantic" else 0.15):
            return f"<{tag}{rng.choice(('', self.odd(), self.mark(kind)))}>{body}</{tag}>"
        tag = rng.choice(("div", "div", "section", "ul" if body.startswith("<li") else "div"))
        return f"<{tag}{self.mark(kind)}>{body}</{tag}>"

    def paragraph(self) -> str:
        rng, t = self.rng, _TRUE
        r = rng.random()
        if r < 0.05:  # many short ones in a row
            again = f"<p>{t}{self.words(1, 4)}{rng.choice(('.', '.', ',', ''))}</p>"
            return "".join(again if rng.random() < 0.8 else f"<p>{t}{self.sentence(1, 12)}</p>" for _ in range(rng.randint(3, 12)))
        if r < 0.68:
            return f"<p{rng.choice(('', '', self.odd()))}>{t}{self.sentence(1, 110)}{rng.choice(('</p>', '</p>', ''))}"
        if r < 0.76:
            return f"<h{(h := rng.randint(2, 4))}>{t}{self.words(1, 9)}</h{h}>"
        if r < 0.82:
            return "<ul>" + "".join(f"<li>{t}{self.sentence(1, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.86:
            return f"<blockquote>{rng.choice(('', '<p>'))}{t}{self.sentence(4, 40)}</blockquote>"
        if r < 0.89:
            return f"<figure><img src=x><figcaption>{t}{self.sentence(2, 15)}</figcaption></figure>"
        if r < 0.92:
            return "<table>" + "".join(f"<tr><td>{t}{self.words(1, 4)}</td><td>{t}{self.words(1, 4)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        if r < 0.94:
            return f"<pre>{t}{self.words(2, 12)}</pre>"
        if r < 0.97:
            return f'<p><a href="/x">{t}{self.words(1, 6)}</a> {self.sentence(3, 30)}</p>'
        return f"<p>{t}{self.sentence(2, 20)}<br>{self.sentence(2, 20)}"

    def article(self, style: str) -> str:
        rng = self.rng
        body = [self.paragraph() for _ in range(rng.randint(2 if style in ("unnamed", "table", "bare") else 1, 14))]
        if style in ("unnamed", "table", "bare"):  # only the text can tell
            body.insert(0, f"<p>{_TRUE}{self.sentence(20, 110)}</p>")
        head = rng.choice((f"<h1>{_TRUE}{self.words(1, 12)}</h1>", f"<h1>{_TRUE}{self.words(1, 12)}</h1>", f"<h2>{_TRUE}{self.words(1, 12)}</h2>", f"<header><h1>{_TRUE}{self.words(1, 12)}</h1></header>", ""))
        for _ in range(rng.choice((0, 0, 0, 1, 2, 3))):  # something foreign inside the article's own element
            kind = rng.choice(("ad", "aside", "notice", "comments", "comments", "form"))
            at = len(body) if kind == "comments" else rng.randint(0, len(body))
            body.insert(at, "</p>" + self.around(kind, "classes"))
        if rng.random() < 0.3:  # a division inside
            body = [f"<{(d := rng.choice(('div', 'section')))}{self.odd()}>", *body, f"</{d}>"]
        text = head + "".join(body)
        if style == "bare":
            return text
        if style == "table":
            return f"<table><tr><td>{self.links(rng.randint(2, 6))}</td><td{self.odd()}>{text}</td></tr></table>"
        if style == "unnamed":
            tag = rng.choice(("div", "section", "div"))
            depth = rng.randint(1, 3)
            return "".join(f"<{tag}{self.odd()}>" for _ in range(depth)) + text + f"</{tag}>" * depth
        r = rng.random()
        if style == "semantic" and r < 0.7:
            return f"<article{rng.choice(('', self.odd(), self.mark('article')))}>{text}</article>"
        if style == "semantic":
            return f"<main>{rng.choice(('', '<div>'))}{text}</main>"
        return f"<div{self.mark('article')}>{text}</div>"

    def short_page(self) -> str:
        """A page of a block or two: text without tags or in the plainest ones, or only what stands around articles."""
        rng = self.rng
        if rng.random() < 0.25:
            kind = rng.choice(("nav", "notice", "footer", "form", "ad"))
            return f"<html><body>{self.around(kind, 'classes')}</body></html>"
        text = f"{_TRUE}{self.sentence(rng.choice((8, 25, 60)), 140)}"
        head = rng.choice(("", "", f"<h1>{_TRUE}{self.words(1, 9)}</h1>"))
        r = rng.random()
        if r < 0.2:
            return text
        if r < 0.45:
            return f"<html><body>{head}{text}{rng.choice(('', '</body></html>'))}"
        tag = rng.choice(("div", "p", "p", "section", "main", "article"))
        more = "".join(f"<{tag}>{_TRUE}{self.sentence(5, 60)}</{tag}>" for _ in range(rng.choice((0, 0, 1, 1, 2))))
        inner = f"{head}<{tag}{self.odd()}>{text}</{tag}>{more}"
        return rng.choice((inner, f"<html><head><title>{self.words(1, 4)}</title></head><body>{inner}</body></html>", f"<body><div>{inner}</div>"))

    def page(self) -> str:
        rng = self.rng
        self.script = rng.choice(self.SCRIPTS) if rng.random() < 0.2 else self.LATIN
        if rng.random() < 0.15:
            return self.short_page()
        style = rng.choice(("semantic", "semantic", "semantic", "classes", "classes", "unnamed", "table", "bare"))
        share = rng.choice((0.05, 0.4, 0.4, 0.6))
        before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if rng.random() < share]
        after = [k for k in ("ad", "aside", "comments", "notice", "form", "nav", "footer") if rng.random() < share]
        body = "".join([*(self.around(k, style) for k in before), self.article(style), *(self.around(k, style) for k in after)])
        if rng.random() < 0.3:
            body = f"<div{self.odd()}>{body}</div>"
        head = f"<title>{self.words(1, 6)}</title><style>p{{}}</style>"
        return f"<!DOCTYPE html><html><head>{head}{rng.choice(('</head>', '</head>', ''))}{rng.choice(('<body>', '<body>', ''))}{body}{rng.choice(('</body></html>', ''))}"


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 7) -> Iterator[tuple[str, list[bool]]]:
    """Pages of many layouts with invented words, and whether each leaf block belongs to the article."""
    layouts = _Layouts(random.Random(seed))
    for _ in range(count):
        page = layouts.page()
        yield page.replace(_TRUE, ""), [_TRUE in b.text for b in leaf_blocks(page)]


@cache
def default_field() -> Field:
    return fit(labelled_pages())


#: Changes with what the default model learns from.
MODEL = f"8-{TRAINING_PAGES}-{PASSES}"


def saved_field(spark: SparkSession) -> Field:
    """The default model, fitted once for a shared folder and read from there by later sessions."""
    path = f"{common.shared_dir(spark)}/models/html-{MODEL}"
    try:
        rows = spark.read.schema("kind string, name string, value double").parquet(path).collect()
    except AnalysisException:  # no such folder yet
        rows = []
    if not rows:
        field = default_field()
        made = [("lean", k, v) for k, v in field.lean.items()] + [("move", f"{a}{b}", field.moves[a][b]) for a in (0, 1) for b in (0, 1)] + [("start", str(a), field.start[a]) for a in (0, 1)]
        spark.createDataFrame(made, "kind string, name string, value double").coalesce(1).write.mode("overwrite").parquet(path)
        return field
    of = {(r["kind"], r["name"]): r["value"] for r in rows}
    names = {r["name"]: i for i, r in enumerate(rows) if r["kind"] == "lean"}
    lean = np.zeros((len(rows), 2))
    for k, i in names.items():
        lean[i, 1] = of["lean", k]
    return Field(names, lean, np.array([[of["move", f"{a}{b}"] for b in (0, 1)] for a in (0, 1)]), np.array([of["start", str(a)] for a in (0, 1)]))


def main_text(html: str | None, field: Field) -> tuple[str, int, int]:
    """(text, blocks kept, blocks of the page)."""
    blocks = leaf_blocks(html or "", field.known)
    kept = [b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y]
    return "\n".join(kept), len(kept), len(blocks)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", field: Field | None = None) -> DataFrame:
    """Rows (key, url, text, n_chars, n_blocks, n_kept), one for each row of pages; text is empty if nothing is article.

    Null html counts as empty, a null url stays null. Repeated rows are read each, alike. An empty table gives no rows.
    Other columns are not read. A page is read whole, however long and deep, in time linear in it. Of labels equally likely,
    rest comes before article.
    """
    field = field or saved_field(pages.sparkSession)
    schema = T.StructType(
        [T.StructField(key, pages.schema[key].dataType), T.StructField(url, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices_by_bytes(batches, "_html", BATCH_BYTES):
            got = [main_text(h, field) for h in common.strings(batch.column("_html"))]
            texts, kept, every = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(every, pa.int64()), pa.array(kept, pa.int64())], names=schema.names)

    return pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html")).mapInArrow(run, schema)
