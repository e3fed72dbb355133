"""Leaf blocks of an HTML page, with what is known of their ancestors, in time and memory linear in the page.

Ends that HTML lets authors omit are implied (paragraphs, list items, table cells, the head, an open select), ends
of nothing are ignored, and body and html stay open to the end. Ancestors are linked, not copied; open
elements are counted by name, so no step walks up a deep page more than once.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

#: Fixed values of HTML: elements that bound blocks, have no content, hold raw text, hold no text of the page, and may stand in a head.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe title textarea noembed noframes xmp".split())
SKIPPED = frozenset("head select datalist svg math object audio video canvas".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
#: What an open select goes on through.
IN_SELECT = frozenset("option optgroup hr".split())
#: Elements that end an open one of these names, elements that bound the search for it, and those that end a paragraph.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "optgroup": "option optgroup", "thead": "thead tbody tfoot", "tbody": "thead tbody tfoot", "tfoot": "thead tbody tfoot"}
FENCES = frozenset("ul ol dl table article section div main aside nav body html blockquote form select".split())
ENDS_P = BLOCKS - frozenset("button iframe option select optgroup caption body html noscript tbody td tfoot th thead tr textarea".split())
CLOSED = frozenset(" ".join(CLOSES.values()).split())
#: Elements whose name, when it is the nearest of them, says what part of a page one is in.
PARTS = frozenset("nav article main aside footer header form section table figure dialog".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute; the second pattern is for the rest of a page after which no closing quote comes.
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/\"']+|[=\"'])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_UNQUOTED = re.compile(r"[\s/]*([^\s=>/\"']+|[=\"'])(?:\s*=\s*([^\s>]*))?")
_END = re.compile(r"[\s/]*(>|\Z)")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """An open element: name, parent, words of its class, id and role, whether it is hidden, and its nearest block and part."""

    __slots__ = ("_context", "_full", "block", "depth", "hidden", "marked", "marks", "name", "parent", "part")

    def __init__(self, name: str, parent: Element | None, marks: tuple[str, ...], hidden: bool):
        self.name, self.parent, self.marks, self.hidden = name, parent, marks, hidden
        self.block = name if name in BLOCKS or parent is None else parent.block
        self.part = name if name in PARTS or parent is None else parent.part
        self.marked = self if marks or parent is None else parent.marked
        self.depth = 0 if parent is None else parent.depth + 1
        self._context: frozenset[str] | None = None
        self._full: frozenset[str] | None = None

    def context(self, known: frozenset[str] | None) -> frozenset[str]:
        """Names of the ancestors, itself included, of their marks, and of the nearest marks; of `known` marks only, if given."""
        if self._full is None:
            last = [m for m in map("last={}".format, self.marked.marks) if known is None or m in known]
            self._full = self._above(known).union(last) if last else self._above(known)
        return self._full

    def _above(self, known: frozenset[str] | None) -> frozenset[str]:
        todo, at = [], self
        while at is not None and at._context is None:
            todo.append(at)
            at = at.parent
        now = frozenset() if at is None else at._context
        for e in reversed(todo):
            new = [f"in={e.name}"] if e.name in BLOCKS or e.name in PARTS or known is None or f"in={e.name}" in known else []
            new += [m for m in map("mark={}".format, e.marks) if known is None or m in known]
            new += ["marked"] if e.marks else []
            if not now.issuperset(new):
                now = now.union(new)
            e._context = now
        return now


class Block:
    """A run of visible text without a block boundary."""

    __slots__ = ("context", "depth", "linked", "part", "tag", "text")

    def __init__(self, text: str, tag: str, part: str, context: frozenset[str], depth: int, linked: int):
        self.text, self.tag, self.part, self.context, self.depth, self.linked = text, tag, part, context, depth, linked


class _Attributes:
    """Reads start tags of one page; remembers that no closing quote is left, so that each is looked for once."""

    def __init__(self, html: str):
        self.html, self.last = html, {q: html.rfind(q) for q in "\"'"}

    def read(self, at: int) -> tuple[int, list[tuple[str, str]], bool]:
        """(place behind the tag, attributes, whether it closes itself)."""
        found: list[tuple[str, str]] = []
        while True:
            m = _END.match(self.html, at)
            if m:
                return m.end(), found, self.html[at : m.end()].rstrip(">").endswith("/")
            m = _UNQUOTED.match(self.html, at)
            value = m[2]
            if value and value[0] in self.last and self.last[value[0]] > m.start(2):
                m = _ATTRIBUTE.match(self.html, at)
                value = m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] and m[2][0] in self.last else m[2]
            found.append((m[1].lower(), value or ""))
            at = m.end()


def _marks(attributes: list[tuple[str, str]]) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words: list[str] = []
    hidden = False
    for name, value in attributes:
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            hidden = True
        elif name in ("class", "id", "role"):
            words += _WORD.findall(_HUMP.sub("-", value).lower())
    return tuple(dict.fromkeys(words)), hidden


class _Page:
    def __init__(self, known: frozenset[str] | None):
        self.known, self.out = known, []
        self.root = Element("body", None, (), False)
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()
        self.hidden = 0
        #: Places of the stack's closable elements by name, for each fence.
        self.scopes: list[dict[str, list[int]]] = [{}]
        self.parts: list[str] = []
        self.linked = 0

    def top(self) -> Element:
        return self.stack[-1] if self.stack else self.root

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = self.top()
                self.out.append(Block(text, at.block, at.part, at.context(self.known), at.depth, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def take(self, text: str) -> None:
        if self.open["head"] and text.strip():
            self.end("head")
        if text and not self.hidden:
            text = entities.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.open["a"]:
                self.linked += len(text)

    def push(self, name: str, marks: tuple[str, ...], hidden: bool) -> None:
        if name in CLOSED:
            self.scopes[-1].setdefault(name, []).append(len(self.stack))
        if name in FENCES:
            self.scopes.append({})
        self.stack.append(Element(name, self.top(), marks, hidden))
        self.open[name] += 1
        self.hidden += hidden

    def close(self, to: int) -> None:
        if any(e.name in BLOCKS for e in self.stack[to:]):
            self.flush()
        while len(self.stack) > to:
            e = self.stack.pop()
            self.open[e.name] -= 1
            self.hidden -= e.hidden
            if e.name in FENCES:
                self.scopes.pop()
            if e.name in CLOSED:
                self.scopes[-1][e.name].pop()

    def end(self, name: str) -> None:
        """The end of the innermost open element of the name; of none, it means nothing."""
        if self.open[name] and name not in ("body", "html"):
            i = len(self.stack) - 1
            while self.stack[i].name != name:
                i -= 1
            self.close(i)

    def imply(self, name: str) -> None:
        """Ends that the start of an element implies."""
        if self.open["head"] and name not in HEAD:
            self.end("head")
        if self.open["select"] and name not in IN_SELECT:
            self.end("select")
        closing = CLOSES.get(name, "").split()
        if name in ENDS_P and name != "p":
            closing = [*closing, "p"]
        places = [at[-1] for kind in closing if (at := self.scopes[-1].get(kind))]
        if places:
            self.close(min(places))


def leaf_blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """Blocks of visible text in page order: references decoded, white space single, ends trimmed, no empty ones."""
    page, attributes = _Page(known), _Attributes(html)
    at, n, text_from = 0, len(html), 0
    while True:
        lt = html.find("<", at)
        if lt < 0:
            break
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?") or after == "/" and not html[lt + 2 : lt + 3].isalpha() and html[lt + 2 : lt + 3]:
            page.take(html[text_from:lt])
            if html.startswith("<!--", lt):
                end = lt + 4 if html.startswith(("<!-->", "<!--->"), lt) else html.find("-->", lt + 4)
                at = n if end < 0 else html.index(">", end) + 1
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            text_from = at
            continue
        m = _NAME.match(html, lt + 1 + (after == "/"))
        if not m:
            at = lt + 1
            continue
        end, found, alone = attributes.read(m.end())
        page.take(html[text_from:lt])
        if html[end - 1 : end] != ">":  # a tag that the page's end cuts off is dropped
            text_from = n
            break
        at = text_from = end
        name = m[0].lower()
        if after == "/":
            if name == "br":
                page.take(" ")
            page.end(name)
            continue
        page.imply(name)
        if name in RAW:
            if name in BLOCKS:
                page.flush()
            close = _RAW_END[name].search(html, at)
            at = text_from = close.end() if close else n
        elif name in VOID:
            if name == "br":
                page.take(" ")
            elif name in BLOCKS:
                page.flush()
        elif name not in ("html", "body") or not page.open[name]:
            if name in BLOCKS:
                page.flush()
            if not alone:
                marks, hidden = _marks(found) if found else ((), False)
                page.push(name, marks, hidden or name in SKIPPED)
    page.take(html[text_from:])
    page.flush()
    return page.out
