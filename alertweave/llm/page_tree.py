"""Pages as trees of blocks, for wrapper induction: a tolerant reading of HTML, what the
names of elements tell about them, and the joining of trees by simple tree matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: The elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - frozenset("body caption head html legend option tbody td template tfoot th thead title tr".split())
#: An element that opens closes an open one of these, up to the nearest of the others.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
}
#: Elements that are never main text.
ASIDE = frozenset("head script style noscript template nav header footer aside form button select textarea iframe object svg canvas video audio dialog menu search fieldset noembed noframes xmp".split())
#: Words in class, id and role that mark what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promotion recommendations recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar widget".split()
)
#: A name that begins so tells what an element has, not what it is.
HAS = frozenset("has with no without is show hide".split())

#: Open elements beyond which no deeper node is made; runs of equal siblings in a page and
#: places in a wrapper, under one parent, beyond which those of one label are one.
DEPTH, RUNS, SLOTS = 200, 24, 64
VARIES = -1


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


class Node:
    """An element, or a run of text (label ``#text``)."""

    __slots__ = ("tag", "label", "aside", "kids", "text", "links", "hash")

    def __init__(self, tag: str, label: str, aside: bool):
        self.tag, self.label, self.aside = tag, label, aside
        self.kids: list[Node] = []
        self.text: list[str] = []
        self.links = 0
        self.hash = 0

    def words(self) -> str:
        return " ".join("".join(self.text).split())


@lru_cache(4096)
def described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's label, whether it is no main text, and whether it is the main part."""
    label, aside, main = tag, tag in ASIDE, tag == "main"
    if not TELLING.search(attributes):
        return label, aside, main
    seen: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        seen.setdefault(name.lower(), unescape(a or b or c))
    names = [n for k in ("class", "id", "role") for n in seen.get(k, "").split()]
    words = [[w.lower() for w in NAME_PARTS.findall(n)] for n in names]
    style = seen.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in seen or seen.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    marked = any(w and w[0] not in HAS and not MARKS.isdisjoint(w) for w in words)
    if tag in ("html", "body", "main"):
        hidden = marked = False
    if tag == "article":
        marked = any("comment" in w or "comments" in w for w in words)
    main = main or seen.get("role", "").lower() == "main" or "articlebody" in seen.get("itemprop", "").lower()
    label = re.sub("[0-9]+", "0", ".".join([tag, *sorted(names)]))
    return label, aside or hidden or marked, main


class Page:
    """The tree of a page. Inline elements are part of the text around them, unless their
    names mark them as no main text."""

    def __init__(self, html: str):
        self.root = Node("html", "html", False)
        self.main: list[Node] = []
        self.title = ""
        self.stack: list[tuple[str, Node]] = [("html", self.root)]
        self.open: dict[str, int] = {"html": 1}
        self.read(html)

    def say(self, text: str) -> None:
        node = self.stack[-1][1]
        if not node.kids or node.kids[-1].label != "#text":
            if not text.strip():
                return
            node.kids.append(Node("#text", "#text", False))
        node.kids[-1].text.append(text)
        if self.open.get("a"):
            node.kids[-1].links += len(text)

    def pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            tag, _ = self.stack.pop()
            self.open[tag] -= 1

    def close(self, tags: frozenset[str], within: frozenset[str] = frozenset(["table"])) -> None:
        """Closes the innermost open element of ``tags`` with all in it, if none of
        ``within`` is around it."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                return self.pop(i)
            if self.stack[i][0] in within:
                return

    def begin(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P and self.open.get("p"):
            self.close(frozenset(["p"]), frozenset(["table", "button"]))
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in ("html", "body") and self.open.get(tag):
            return
        label, aside, main = described(tag, attributes)
        if tag in BLOCK or aside:
            if tag != "html" and len(self.stack) < DEPTH:
                node = Node(tag, label, aside)
                self.stack[-1][1].kids.append(node)
                if main and not aside:
                    self.main.append(node)
            else:
                node = self.stack[-1][1]
        elif tag == "a":
            node = self.stack[-1][1]
        else:
            return
        self.stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            if not m:
                self.say(unescape(html[at:]))
                break
            if m.start() > at:
                part = html[at : m.start()]
                self.say(unescape(part) if "&" in part else part)
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self.say(m[0][9:].removesuffix("]]>"))
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    self.say(" ")
                elif tag == "p" and not self.open.get("p"):
                    self.begin("p", "")
                    self.close(frozenset(["p"]))
                else:
                    self.close(frozenset([tag]), frozenset() if tag in ("table", "html", "body", "article", "main") else frozenset(["table"]))
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                stop = end.start() if end else n
                if tag == "title" and not self.title:
                    self.title = " ".join(unescape(html[at:stop]).split())
                at = stop
                if end:
                    close = html.find(">", stop)
                    at = n if close < 0 else close + 1
            elif tag in ("br", "hr", "img", "wbr"):
                if tag == "hr":
                    self.close(frozenset(["p"]))
                    self.stack[-1][1].kids.append(Node("hr", "hr", False))
                elif tag == "br":
                    self.say(" ")
            elif tag not in VOID:
                self.begin(tag, m[3])


class Slot:
    """A place of a wrapper: nodes of one label that stand side by side in a page, and their
    like in the host's other pages. ``const`` is the hash of their text if all have the same,
    ``ids`` up to three of the pages' headings, ``chars`` and ``links`` sums of characters."""

    __slots__ = ("label", "const", "n", "ids", "chars", "links", "repeated", "aside", "kids", "nodes")

    def __init__(self, label: str, const: int, n: int, ids: list[int], chars: int, links: int, repeated: bool, aside: bool, kids: list[Slot], nodes: list[Node] | None = None):
        self.label, self.const, self.n, self.ids, self.chars, self.links = label, const, n, ids, chars, links
        self.repeated, self.aside, self.kids, self.nodes = repeated, aside, kids, nodes or []

    def plain(self) -> list:
        return [self.label, self.const, self.n, self.ids, self.chars, self.links, int(self.repeated), int(self.aside), [k.plain() for k in self.kids]]

    @staticmethod
    def of(x: list) -> Slot:
        return Slot(x[0], x[1], x[2], x[3], x[4], x[5], bool(x[6]), bool(x[7]), [Slot.of(k) for k in x[8]])


def matched(a: list[Slot], b: list[Slot], memo: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The pairs of equal labels, in order, that simple tree matching aligns: those with the
    most matching nodes below them."""
    labels = [s.label for s in a]
    if labels == [s.label for s in b] and len(set(labels)) == len(labels):
        return [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            most = max(best[i + 1][j], best[i][j + 1])
            best[i][j] = max(most, best[i + 1][j + 1] + size(a[i], b[j], memo)) if a[i].label == b[j].label else most
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i].label == b[j].label and best[i][j] == best[i + 1][j + 1] + size(a[i], b[j], memo):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def size(a: Slot, b: Slot, memo: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the nodes in the largest common top-down tree."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + sum(size(a.kids[i], b.kids[j], memo) for i, j in matched(a.kids, b.kids, memo))
    return memo[key]


def united(a: Slot, b: Slot, memo: dict[tuple[int, int], int] | None = None) -> Slot:
    """Both slots as one: aligned children are united, others stand between them."""
    memo = {} if memo is None else memo
    kids: list[Slot] = []
    i = j = 0
    for x, y in [*matched(a.kids, b.kids, memo), (len(a.kids), len(b.kids))]:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            kids.append(united(a.kids[x], b.kids[y], memo))
        i, j = x + 1, y + 1
    const = a.const if a.const == b.const else VARIES
    ids = sorted({*a.ids, *b.ids})[:3] if const != VARIES else []
    return Slot(a.label, const, a.n + b.n, ids, a.chars + b.chars, a.links + b.links, a.repeated or b.repeated, a.aside, slots(kids), a.nodes + b.nodes)


def slots(kids: list[Slot]) -> list[Slot]:
    """A parent keeps at most ``SLOTS`` places: of more, those of one label become one, and
    then the most frequent stay. What has no place is content."""
    if len(kids) <= SLOTS:
        return kids
    by: dict[str, Slot] = {}
    for k in kids:
        by[k.label] = united(by[k.label], k) if k.label in by else k
    if len(by) > SLOTS:
        keep = set(sorted(by, key=lambda x: (-by[x].n, x))[:SLOTS])
        by = {k: v for k, v in by.items() if k in keep}
    return list(by.values())


def folded(nodes: list[Node], identity: int) -> Slot:
    """The slot of nodes of one label that stand side by side, or, in a parent of very many
    children, anywhere in it."""
    out: list[Slot] = []
    for node in nodes:
        if node.label == "#text":
            text = node.words()
            node.hash = digest(text)
            out.append(Slot("#text", node.hash, 1, [identity], len(text), min(node.links, len(text)), False, False, [], [node]))
            continue
        runs: list[list[Node]] = []
        for k in node.kids:
            if runs and runs[-1][0].label == k.label:
                runs[-1].append(k)
            else:
                runs.append([k])
        if len(runs) > RUNS:
            by: dict[str, list[Node]] = {}
            for k in node.kids:
                by.setdefault(k.label, []).append(k)
            runs = list(by.values())
        kids = [folded(r, identity) for r in runs]
        node.hash = digest(f"{node.label} {[k.hash for k in node.kids]}")
        chars, links = sum(k.chars for k in kids), sum(k.links for k in kids)
        out.append(Slot(node.label, node.hash, 1, [identity], chars, links, False, node.aside, slots(kids), [node]))
    while len(out) > 1:  # pairwise, so that no run takes quadratic time
        out = [united(out[i], out[i + 1]) if i + 1 < len(out) else out[i] for i in range(0, len(out), 2)]
    if len(nodes) > 1:
        out[0].repeated, out[0].n = True, 1
        out[0].const, out[0].ids = digest(str([n.hash for n in nodes])), [identity]
    return out[0]


def walk(node: Node) -> Iterator[Node]:
    yield node
    for k in node.kids:
        yield from walk(k)


def identity(page: Page) -> int:
    """What tells a page's article from others: its first heading, else its title, else all
    its text."""
    for n in walk(page.root):
        if n.tag in HEADING and (said := " ".join(k.words() for k in walk(n) if k.label == "#text")):
            return digest(said)
    return digest(page.title or " ".join(k.words() for k in walk(page.root) if k.label == "#text"))


def wrapper(page: Page) -> Slot:
    return folded([page.root], identity(page))
