"""Main text of pages by wrapper induction.

The trees of a host's pages are aligned by simple tree matching into one wrapper: equal
siblings side by side are one repeated slot, aligned slots are united, others are added. A
slot whose text is the same wherever it occurs, in pages of ``SUPPORT`` different headings,
is template; one that varies is content, unless its element says that it is none (nav,
header, footer, aside, form, and names such as ``sidebar``, ``cookie-notice``, ``comments``).
If a page has articles, or else a main part, its content is taken from there; if it has
neither, from the slot of the wrapper that holds most of the varying text.

Wrappers are made where the pages lie, one for each host and task, and merged twice: by host
and task group, then by host, so a host of a third of all pages sends one wrapper a task and
no task gets its pages. A parent has at most 64 slots, so wrappers stay small. They are
broadcast to the pages if all of them together have at most ``BROADCAST_BYTES``, else joined
by host (a skewed join, which AQE splits).

Blocks are what block elements hold; a line break is a space. Defined results: null and empty
pages give an empty text; a null url, or one without a host, has no wrapper but the page's
own; repeated pages are extracted each, and being of one heading, make no template; copies of
an article in one host don't either; an unclosed script, style or comment goes to the end;
elements nested over 200 deep are read as part of the 200th; headings inside an article's own
header stay; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .page_tree import BLOCK, HEADING, VARIES, Node, Page, Slot, matched, united, walk, wrapper

SUPPORT = 3
#: Slots that a task holds before it lets its wrappers go.
HELD = 100_000
BROADCAST_BYTES = 16_000_000
#: Of the varying text that a part must hold to stand for its parent.
MOST = 0.8
CONTAINERS = frozenset("html body div section main center table tbody tr td".split())


def host(url: str) -> F.Column:
    """The host of a URL, lower case, or null."""
    found = F.regexp_extract(F.col(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def weight(s: Slot) -> int:
    return s.chars if s.const == VARIES or len(s.ids) < SUPPORT else 0


def plainly(s: Slot) -> int:
    """Characters that vary and are no links, in what may be main text."""
    if s.aside or not weight(s):
        return 0
    return sum(map(plainly, s.kids)) if s.kids else max(0, s.chars - s.links)


def has_title(s: Slot) -> bool:
    return not s.aside and (s.label.split(".")[0] == "h1" or any(map(has_title, s.kids)))


def region(s: Slot) -> Slot:
    """The innermost slot that holds most of what varies, and the page's h1."""
    while True:
        own = {id(k): plainly(k) for k in s.kids}
        best = max(s.kids, key=lambda k: own[id(k)], default=None)
        if best is None or best.repeated or best.label.split(".")[0] not in CONTAINERS or own[id(best)] < MOST * max(1, sum(own.values())):
            return s
        if any(has_title(k) for k in s.kids if k is not best):
            return s
        s = best


def settled(s: Slot) -> str:
    """A wrapper as it is applied: label, hash of a template's text or 0, whether it is the
    region, and the slots below."""
    main = region(s)

    def plain(x: Slot) -> list:
        fixed = x.const if x.const != VARIES and len(x.ids) >= SUPPORT and x.chars else 0
        return [x.label, fixed, int(x is main), [] if fixed else [plain(k) for k in x.kids]]

    return json.dumps(plain(s), separators=(",", ":"))


class Applied:
    """Slots of a settled wrapper, in the form that matching takes."""

    __slots__ = ("label", "fixed", "main", "kids")

    def __init__(self, x: list):
        self.label, self.fixed, self.main = x[0], x[1], bool(x[2])
        self.kids = [Applied(k) for k in x[3]]


def applied(own: Slot, to: Applied, template: set[int], main: list[Node]) -> None:
    """Marks the page's nodes that are template, and finds those of the region."""
    if to.fixed and to.fixed == own.const:
        template.update(map(id, own.nodes))
        return
    if to.main:
        main += own.nodes
    for i, j in matched(own.kids, to.kids, {}):
        applied(own.kids[i], to.kids[j], template, main)


def links_only(node: Node) -> bool:
    """Whether a list is a menu: nearly all its text is in links."""
    texts = [k for k in walk(node) if k.label == "#text"]
    total = sum(len(k.words()) for k in texts)
    return total > 0 and sum(min(k.links, len(k.words())) for k in texts) >= MOST * total


def blocks(roots: list[Node], template: set[int], menus: bool, kept: set[int]) -> list[str]:
    """The texts of the blocks under ``roots``, without template and what is no main text.
    ``menus``: lists of links go. ``kept``: elements that hold main parts."""
    out: list[str] = []
    said: list[str] = []

    def flush() -> None:
        if said:
            if line := " ".join("".join(said).split()):
                out.append(line)
            said.clear()

    def add(node: Node, only_headings: bool) -> None:
        if id(node) in template:
            return flush() if node.tag in BLOCK else None
        if node.label == "#text":
            if not only_headings:
                said.extend(node.text)
            return
        if node.aside and id(node) not in kept:
            if node.tag == "header" or node.tag == "div" and "header" in node.label:
                only_headings = True
            else:
                return flush() if node.tag in BLOCK else None
        if menus and node.tag in ("ul", "ol", "menu", "dir") and links_only(node):
            return flush()
        if node.tag in BLOCK or node.tag == "hr":
            flush()
        for k in node.kids:
            add(k, only_headings and node.tag not in HEADING)
        if node.tag in BLOCK:
            flush()

    for r in roots:
        add(r, False)
    flush()
    return out


def articles(node: Node) -> Iterator[Node]:
    """The outermost articles that aren't inside what is no main text."""
    if node.tag == "article" and not node.aside:
        yield node
    elif not node.aside:
        for k in node.kids:
            yield from articles(k)


def main_text(html: str | None, shared: Applied | None) -> str:
    """A page's main text, by its host's wrapper or by its own."""
    page = Page(html or "")
    own = wrapper(page)
    template: set[int] = set()
    found: list[Node] = []
    applied(own, shared if shared is not None else Applied(json.loads(settled(own))), template, found)
    roots = list(articles(page.root)) or page.main[:1]
    if roots:
        return "\n".join(blocks(roots, template, False, set()))
    return "\n".join(blocks(found or [page.root], template, True, {id(page.root)}))


def slots_in(s: Slot) -> int:
    return 1 + sum(map(slots_in, s.kids))


def induced(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of each host, from pages of host and html."""

    def made(parts: Iterator[dict]) -> Iterator[dict]:
        held: dict[str, Slot] = {}
        size = 0

        def gone() -> dict:
            hosts = sorted(held)
            return {"host": hosts, "wrapper": [json.dumps(held[h].plain(), separators=(",", ":")) for h in hosts]}

        for p in parts:
            for h, html in zip(p["host"], p["html"]):
                own = wrapper(Page(html))
                for x in walk_slots(own):
                    x.nodes = []
                before = slots_in(held[h]) if h in held else 0
                held[h] = united(held[h], own) if h in held else own
                size += slots_in(held[h]) - before
            if size > HELD:
                yield gone()
                held, size = {}, 0
        yield gone()

    def merged(last: bool):
        def rows(parts: Iterator[dict]) -> Iterator[dict]:
            name, whole = None, None
            for p in parts:
                out: dict[str, list] = {"host": [], "wrapper": []}
                for h, text in zip(p["host"], p["wrapper"]):
                    one = Slot.of(json.loads(text))
                    if h == name:
                        whole = united(whole, one)
                        continue
                    if whole is not None:
                        out["host"].append(name)
                        out["wrapper"].append(settled(whole) if last else json.dumps(whole.plain(), separators=(",", ":")))
                    name, whole = h, one
                yield out
            if whole is not None:
                yield {"host": [name], "wrapper": [settled(whole) if last else json.dumps(whole.plain(), separators=(",", ":"))]}

        return rows

    schema = "host string, wrapper string"
    own = common.map_rows(pages.filter("host is not null"), made, schema, batch=500)
    own = common.written(own.withColumn("part", F.spark_partition_id()), "wrappers")
    groups = max(1, round(own.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] ** 0.5))
    first = own.withColumn("salt", F.col("part") % groups).repartition("host", "salt").sortWithinPartitions("host", "salt", "part", "wrapper")
    some = common.map_rows(first.select("host", "wrapper"), merged(False), schema, batch=500)
    return common.map_rows(some.repartition("host").sortWithinPartitions("host", "wrapper"), merged(True), schema, batch=500)


def walk_slots(s: Slot) -> Iterator[Slot]:
    yield s
    for k in s.kids:
        yield from walk_slots(k)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The identifier, URL and main text of each page, and its length in code points."""
    rows = pages.select(common.column(id_col).alias("page_id"), common.column(url_col).alias("url"), common.column(html_col).alias("html")).withColumn("host", host("url"))
    wrappers = common.written(induced(rows.select("host", F.coalesce("html", F.lit("")).alias("html"))), "templates")
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    whole = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")

    def texts(parts: Iterator[dict]) -> Iterator[dict]:
        known: dict[str, Applied] = {}
        for p in parts:
            out = []
            for html, w in zip(p["html"], p["wrapper"]):
                if w is not None and w not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[w] = Applied(json.loads(w))
                out.append(main_text(html, known[w] if w is not None else None))
            yield {"text": out, "n_chars": [len(t) for t in out]}

    found = common.map_rows(whole.select("page_id", "url", "html", "wrapper"), texts, "text string, n_chars bigint", batch=500, keep=("page_id", "url"))
    return found.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
