"""HTML extraction by wrappers: union-free regular expressions inferred by aligning the token streams of a host's pages."""

from __future__ import annotations

import html as entities
import json
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, broadcast_below, cut, read
from .url_filter import host

# Names of HTML. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object select".split())
#: What a start tag closes, up to the first element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Elements, roles and words of classes and ids that mark what isn't the article; FRAMING words beside them say no more.
DROP_TAGS = frozenset("head nav aside footer form button fieldset input dialog menu".split())
DROP_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert advertisement advertising adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup social share sharing related recommended comment comments disqus respond replies search login toolbar pagination pager".split()
)
FRAMING = frozenset(
    "article articles area bar block body bottom box buttons button col column container content count desktop div field fixed form global group holder icons inner item items left link links list "
    "main meta mobile module outer page panel post posts primary reply right row secondary section site slot small space sticky story text thread title top unit widget widgets wrap wrapper zone".split()
)
PAGE_ONLY = frozenset({"header"})
#: Words of classes and ids that mark the article where no element does: one of the first, or one of each of the others.
ARTICLE_WORDS, PART_WORDS, BODY_WORDS = frozenset({"article", "articlebody", "content", "maincontent"}), frozenset("post entry main story page blog news".split()), frozenset("body text content article".split())
#: Pages of a host that must hold a place before it counts as the host's template, the share of them that repeat its text or
#: have it, and the share of the words of the article (twice that of a page without one) that the template has at most: beyond,
#: the pages are copies of each other.
LEAST_PAGES, REPEATED, TEMPLATE = 5, 0.8, 0.25
#: Places compared one by one when two sequences are aligned; larger ones are aligned by what recurs in order.
CELLS = 1 << 18
#: Hosts whose wrappers a task holds before it sends them on.
HELD = 4000
SALTS = 64
BROADCAST_HOSTS = 20_000
#: Python frames that the deepest page may need.
FRAMES = 1 << 22

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


class Element:
    __slots__ = ("tag", "sig", "marks", "items")

    def __init__(self, tag: str, sig: str):
        self.tag, self.sig, self.items = tag, sig, []


def signature(tag: str, attributes: str) -> str:
    """Tag, role, and the names of class and id without digits, words joined by hyphens; hidden elements are marked."""
    words, extra = [], ""
    if "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes.rstrip(">").rstrip("/")):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower().split():
                    if w := "-".join(x for x in re.split(r"[^a-z]+", name) if x):
                        words.append(w)
            elif name == "role":
                extra += f"@{value.strip()}"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                extra += "@hidden"
    return f"{tag}{extra}" + (f".{'.'.join(dict.fromkeys(words))}" if words else "")


def parse(page: str) -> Element:
    """The page's block elements; their items are elements and texts (text, words, words in links), white space as one space."""
    root = Element("", "")
    stack, text, linked, in_link, at = [root], [], 0, 0, 0
    held: Counter = Counter()  # tags of the stack
    last = page.rfind(">")

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = "".join(text).split()
            if words:
                stack[-1].items.append((" ".join(words), len(words), min(linked, len(words))))
        text, linked = [], 0

    def put(s: str) -> None:
        nonlocal linked
        if s:
            s = entities.unescape(s) if "&" in s else s
            text.append(s)
            if in_link:
                linked += len(s.split())

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at) if at <= last or page.find("<!", at) >= 0 else None
        put(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in INLINE or tag in VOID:
                continue
            if held[tag]:
                flush()
                while True:
                    held[shut := stack.pop().tag] -= 1
                    if shut == tag:
                        break
            elif tag == "p":
                flush()
            in_link = 0
            continue
        if tag in RAW:
            if not m[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>|\Z", re.I).search(page, at)
                at = end.end()
            if tag in ("title", "textarea", "select", "object", "iframe"):
                flush()
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            if tag == "a":
                in_link = 1
            continue
        flush()
        if tag in CLOSES:
            shuts, within = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(held[x] for x in shuts) else ():
                if stack[i].tag in shuts:
                    held.subtract(e.tag for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in within:
                    break
        if stack[-1].tag == "p":
            held[stack.pop().tag] -= 1
        if tag in VOID:
            continue
        e = Element(tag, signature(tag, m[3]))
        stack[-1].items.append(e)
        if not m[3].endswith("/>"):
            stack.append(e)
            held[tag] += 1
    flush()
    return root


# A wrapper is a tree of nodes: [signature, pages, repeated, loop, items] of elements, ["#", pages, repeated, words, words in
# links, texts] of text slots. `pages` counts the pages that have the node: one that has fewer than its parent is optional.
# `texts` holds (pages, words) by the hash of each text that stands here on half of the pages at least: the template's words.
# `loop` says that the items, all optional, stand in a repeated group: (a? b? c?)+. Without unions, that is all that the
# expressions are made of.


def shape(x: list) -> set:
    return {y[0] for y in x[4]}


def common(x: set, y: set) -> float:
    """1 to 2, by what two nodes' items have in common."""
    return 1 + len(x & y) / len(x | y) if x and y else 2


def likeness(a: list, b: list) -> float:
    """0 of nodes that cannot be one; else 1 to 2."""
    if a[0] != b[0]:
        return 0
    return 2 if a[0] == "#" else common(shape(a), shape(b))


#: Likeness from which nodes are taken for one.
ALIKE = 1.5


def as_one(nodes: list, pages: int) -> list:
    """Nodes of one signature merged two by two, so that each is copied a few times only."""
    while len(nodes) > 1:
        nodes = [merge(x, y, pages) for x, y in zip(nodes[::2], nodes[1::2], strict=False)] + ([nodes[-1]] if len(nodes) % 2 else [])
    return nodes[0]


def fold(nodes: list, pages: int, loop: bool = False) -> tuple[list, bool]:
    """Neighbours that are alike as one repeated node; sequences with squares like a b a b as a loop."""
    runs: list[tuple[list, set]] = []
    for x in nodes:
        own = set() if x[0] == "#" else shape(x)
        if runs and runs[-1][0][0][0] == x[0] and common(runs[-1][1], own) >= ALIKE:
            runs[-1][0].append(x)
            runs[-1][1].update(own)
        else:
            runs.append(([x], set(own)))
    out = []
    for run, _ in runs:
        out.append(as_one(run, pages))
        if len(run) > 1:
            out[-1] = [*out[-1][:2], True, *out[-1][3:]]
    kinds: dict[str, list[set]] = {}
    names = []
    for x, (_, own) in zip(out, runs, strict=True):
        firsts = kinds.setdefault(x[0], [])
        k = next((i for i, y in enumerate(firsts) if common(y, own) >= ALIKE), len(firsts))
        if k == len(firsts):
            firsts.append(own)
        names.append((x[0], k))
    squares = {*zip(names, names[1:], strict=False)}
    if loop or len(squares) < len(names) - 1:
        one: dict = {}
        for name, x in zip(names, out, strict=True):
            one.setdefault(name, []).append(x)
        merged = [as_one(x, pages) for x in one.values()]
        return sorted(merged, key=lambda x: (x[0], x[0] != "#" and sorted(shape(x)))), True
    return out, False


def wrapper_of(page: Element) -> list:
    """The expression of one page."""
    order, at = [page], 0
    while at < len(order):
        order += [x for x in order[at].items if isinstance(x, Element)]
        at += 1
    built: dict[int, list] = {}
    for e in reversed(order):
        nodes = []
        for x in e.items:
            if isinstance(x, Element):
                nodes.append(built.pop(id(x)))
            else:
                nodes.append(["#", 1, False, x[1], x[2], {digest(x[0]): (1, x[1])}])
        items, loop = fold(nodes, 1)
        built[id(e)] = [e.sig, 1, False, loop, items]
    return built[id(page)]


def digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def merge(a: list, b: list, pages: int) -> list:
    """One node for two of a signature, of so many pages at most: what mismatches becomes optional, a repeated group or a slot."""
    n = min(pages, a[1] + b[1])
    if a[0] == "#":
        texts = dict(a[5])
        for h, (k, w) in b[5].items():
            texts[h] = (min(n, texts[h][0] + k) if h in texts else k, w)
        return ["#", n, a[2] or b[2], a[3] + b[3], a[4] + b[4], {h: x for h, x in texts.items() if 2 * x[0] >= n}]
    items, loop = align(a[4], a[3], b[4], b[3], n)
    return [a[0], n, a[2] or b[2], loop, items]


def align(a: list, a_loop: bool, b: list, b_loop: bool, pages: int) -> tuple[list, bool]:
    """The expression that covers both sequences: what matched() pairs is merged, the rest stands between."""
    if a_loop or b_loop:
        return fold([*a, *b], pages, True)
    out, i, j = [], 0, 0
    for x, y in [*matched(a, b), (len(a), len(b))]:
        out += [*a[i:x], *b[j:y]]
        if x < len(a):
            out.append(merge(a[x], b[y], pages))
        i, j = x + 1, y + 1
    return fold(out, pages)


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a and b that are aligned, in order: those of most likeness in all. Sequences of equal signatures are aligned
    place by place, those of more than CELLS pairs by a longest sequence of the k-th nodes of a signature."""
    n, m = len(a), len(b)
    if [x[0] for x in a] == [x[0] for x in b]:
        return [*zip(range(n), range(m), strict=True)]
    if n * m > CELLS:
        seen, place = Counter(), {}
        for j, y in enumerate(b):
            place[y[0], seen[y[0]]] = j
            seen[y[0]] += 1
        seen, ends, tops, before = Counter(), [], [], {}
        for i, x in enumerate(a):
            j = place.get((x[0], seen[x[0]]))
            seen[x[0]] += 1
            if j is not None:
                k = bisect_left(tops, j)
                before[i, j] = ends[k - 1] if k else None
                tops[k:k + 1], ends[k:k + 1] = [j], [(i, j)]
        out, at = [], ends[-1] if ends else None
        while at:
            out.append(at)
            at = before[at]
        return out[::-1]
    like = [[likeness(x, y) for y in b] for x in a]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            skip = max(best[i + 1][j], best[i][j + 1])
            best[i][j] = max(skip, like[i][j] + best[i + 1][j + 1]) if like[i][j] else skip
    out, i, j = [], 0, 0
    while i < n and j < m:
        if like[i][j] and best[i][j] == like[i][j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def both(a: list | None, b: list) -> list:
    """Two wrappers as one."""
    return b if a is None else merge(a, b, a[1] + b[1])


def dumped(w: list) -> str:
    """A wrapper as JSON without nesting: nodes in the order of their start, elements with the number of their items."""
    flat, left = [], [w]
    while left:
        x = left.pop()
        if x[0] == "#":
            flat.append([*x[:5], [[h, *v] for h, v in sorted(x[5].items())]])
        else:
            flat.append([*x[:4], len(x[4])])
            left += reversed(x[4])
    return json.dumps(flat, separators=(",", ":"))


def loaded(dump: str) -> list:
    top: list = ["", 0, False, False, []]
    left = [(top, 1)]
    for x in json.loads(dump):
        node, n = left.pop()
        if n > 1:
            left.append((node, n - 1))
        if x[0] == "#":
            new = [*x[:5], {h: (k, w) for h, k, w in x[5]}]
        else:
            new = [*x[:4], []]
            if x[4]:
                left.append((new, x[4]))
        node[4].append(new)
    return top[4][0]


# --- what is kept ---------------------------------------------------------------------------------------------------


def named(words: str, drop: frozenset) -> bool:
    """Whether one of the names says what is dropped: all its words do or are FRAMING. So `comment-list`, but neither
    `comments-open` nor `related-work`."""
    for name in words.split("."):
        w = name.split("-")
        if any(x in drop for x in w) and all(x in drop or x in DROP_WORDS or x in FRAMING for x in w):
            return True
    return False


def dropped(sig: str, in_article: bool) -> int:
    """Whether an element isn't part of an article: 2 by its tag or role, 1 by its class and id or as a form, 0 if it may be."""
    head, _, words = sig.partition(".")
    tag, *marks = head.split("@")
    if tag in ("html", "body", ""):
        return 0
    if "hidden" in marks or DROP_ROLES.intersection(marks) or (tag in DROP_TAGS and tag != "form"):
        return 2
    if tag == "form" or named(words, DROP_WORDS):
        return 1
    return int(not in_article and (tag in PAGE_ONLY or named(words, PAGE_ONLY)))


def is_article(sig: str) -> bool:
    tag, *marks = sig.partition(".")[0].split("@")
    return tag in ("article", "main") or "main" in marks


def named_article(sig: str) -> bool:
    w = {x for name in sig.partition(".")[2].split(".") for x in name.split("-")}
    return sig[:4] not in ("html", "body") and bool(w & ARTICLE_WORDS or (w & PART_WORDS and w & BODY_WORDS))


class Node:
    """A node of a wrapper as used to extract: by position among its parent's items."""

    __slots__ = ("sig", "pages", "repeated", "loop", "items", "by", "up", "all", "linked", "texts", "gone", "inside", "words", "region", "fixed")

    def __init__(self, raw: list, up: Node | None):
        self.sig, self.pages, self.repeated, self.up = raw[0], raw[1], raw[2], up
        self.items, self.by, self.region, self.gone, self.fixed, self.texts = [], {}, False, False, frozenset(), {}
        self.loop = self.sig != "#" and raw[3]
        self.all = self.linked = self.words = 0  # words of the subtree, those in links, those not gone
        if self.sig == "#":
            self.all, self.linked, self.texts = raw[3], raw[4], raw[5]
        self.inside = False  # whether within an article


def compiled(wrapper: list) -> Node:
    """The wrapper with its article marked: the smallest article or main element with most of the words of all of them; without
    such elements, the one with most words whose class or id says so. Then the host's template is taken out of it."""
    top = Node(wrapper, None)
    order, left = [], [(top, wrapper)]
    while left:
        node, raw = left.pop()
        order.append(node)
        if raw[0] != "#":
            new = [(Node(x, node), x) for x in raw[4]]
            node.items = [x for x, _ in new]
            for i, x in enumerate(node.items):
                node.by.setdefault(x.sig, []).append(i)
            left += reversed(new)
    for x in reversed(order):
        if x.up:
            x.up.all, x.up.linked = x.up.all + x.all, x.up.linked + x.linked
    for strict in (1, 2):  # names count only if they leave something
        mark(order, strict)
        if top.words:
            break
    for test in (is_article, named_article):
        found = [x for x in order if x.sig != "#" and not x.gone and x.words and test(x.sig)]
        if found:
            most = max(x.words for x in found)
            region = min((x for x in found if x.words >= 0.6 * most), key=lambda x: x.words) if test is is_article else max(found, key=lambda x: x.words)
            region.region = True
            break
    else:
        region = top
    template(region)
    return top


def mark(order: list[Node], strict: int) -> None:
    """Sets which nodes are gone, by dropped() at least `strict`, and counts the words of the others. A name or a form doesn't
    drop an element that holds half of the words of all articles."""
    inner = [0] * len(order)  # words in articles
    at = {id(x): i for i, x in enumerate(order)}
    for x in reversed(order):
        x.words = 0
        if x.sig != "#" and is_article(x.sig) and not dropped(x.sig, True):
            inner[at[id(x)]] = x.all
        if x.up:
            inner[at[id(x.up)]] += inner[at[id(x)]]
    total = inner[0]
    for i, x in enumerate(order):
        up = x.up
        x.gone, x.inside = bool(up and up.gone), bool(up and up.inside)
        if x.sig != "#":
            why = dropped(x.sig, x.inside)
            x.gone = x.gone or (why >= strict and not (why == 1 and total and inner[i] * 2 >= total))
            x.inside = x.inside or is_article(x.sig)
    for x in reversed(order):
        if x.sig == "#" and not x.gone:
            x.words = x.all
        if x.up:
            x.up.words += x.words


def template(region: Node) -> None:
    """Takes the host's template out of the article: texts that most of its pages repeat in one place, and groups of links that
    most of them have there. If that is much of the article, the pages are copies of each other, and it stays."""
    if region.pages < LEAST_PAGES:
        return
    below, at = [region], 0
    while at < len(below):
        below += [x for x in below[at].items if not x.gone]
        at += 1
    menus = []
    for x in below[1:]:
        # a group of links in a place that most pages have
        if x.sig != "#" and x.pages >= REPEATED * region.pages and x.linked >= REPEATED * x.all > 0 and (x.loop or any(y.repeated for y in x.items)):
            menus.append(x)
    linked = sum(x.all for x in menus if not any(y is x.up for y in menus))
    if linked <= 0.5 * region.words:
        for x in menus:
            hidden = [x]
            while hidden:
                y = hidden.pop()
                y.gone = True
                hidden += y.items
    same = []
    for x in below:
        if x.sig == "#" and not x.gone:
            same.append((x, {h: w * k for h, (k, w) in x.texts.items() if k >= REPEATED * region.pages}))
    if sum(sum(f.values()) for _, f in same) <= (TEMPLATE if region.up else 2 * TEMPLATE) * region.words:
        for x, fixed in same:
            x.fixed = frozenset(fixed)


def extract(page: Element, wrapper: Node) -> str:
    """The texts of the page that stand in slots of the article, joined by line ends; without an article, of all slots but
    those of links. Neither holds what is gone or the host's template. A page that the wrapper doesn't cover is read by its own."""
    main: list[str] = []
    other: list[str] = []
    plans: dict[tuple[int, int], list[Node] | None] = {}

    def plan(e: Element, node: Node) -> list[Node] | None:
        """The nodes of e's items, in order, each the first that covers the item with all that it holds; None if there are none."""
        key = id(e), id(node)
        if key not in plans:
            out, at = [], 0
            for x in e.items:
                inner, k = isinstance(x, Element), -1
                for i in node.by.get(x.sig if inner else "#", ()):
                    if (node.loop or i >= at) and (not inner or plan(x, node.items[i]) is not None):
                        k = i
                        break
                if k < 0:
                    out = None
                    break
                at = k if node.items[k].repeated else k + 1
                out.append(node.items[k])
            plans[key] = out
        return plans[key]

    if plan(page, wrapper) is None:
        wrapper = compiled(wrapper_of(page))
        plan(page, wrapper)
    left = [(page, wrapper, wrapper.region)]
    order: list[tuple[str, Node, bool]] = []
    while left:
        x, node, within = left.pop()
        if isinstance(x, Element):
            within = within or node.region
            left += [(y, slot, within) for y, slot in zip(reversed(x.items), reversed(plan(x, node)), strict=True)]
        else:
            order.append((x[0], node, within))
    for text, slot, within in order:
        if slot.gone or (slot.fixed and digest(text) in slot.fixed):
            continue
        if within:
            main.append(text)
        if slot.linked <= 0.5 * slot.all:
            other.append(text)
    return "\n".join(main or other)


@contextmanager
def deep() -> Iterator[None]:
    """Lets functions call themselves as deep as pages nest."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(FRAMES)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


# --- tables ---------------------------------------------------------------------------------------------------------


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of pages(host, html). Tasks align their own pages of each host; their wrappers are aligned by host
    in two steps, the first salted, so a host with most pages sends a few small wrappers of each task to one place."""

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def out() -> pa.RecordBatch:
            values = [dumped(w) for w in held.values()]
            return pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array(values, pa.string())], names=["host", "salt", "wrapper"])

        with deep():
            for b in it:
                for h, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    held[h] = both(held.get(h), wrapper_of(parse(page.as_py())))
                if len(held) >= HELD:
                    yield out()
                    held = {}
            if held:
                yield out()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w = None
        with deep():
            for x in sorted(pdf["wrapper"]):
                w = both(w, loaded(x))
        return pdf.iloc[:1].assign(wrapper=dumped(w))

    parts = pages.select("host", "html").mapInArrow(own, "host string, salt int, wrapper string")
    salted = parts.groupBy("host", "salt").applyInPandas(one, "host string, salt int, wrapper string")
    return salted.select("host", "wrapper").groupBy("host").applyInPandas(one, "host string, wrapper string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html): the main text of every page by its host's wrapper.

    Null html counts as empty and gives an empty text; null and odd urls share the empty host; a page alone on its host
    is its own wrapper; repeated rows and null ids are kept; an empty table gives an empty one; other columns are ignored.
    """
    batches(pages.sparkSession, 200)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    wrappers = cut(infer(p)).select(F.col("host").alias("w_host"), "wrapper")
    joined = p.join(broadcast_below(wrappers, BROADCAST_HOSTS), F.col("host") == F.col("w_host"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for b in it:
            texts = []
            with deep():
                for page, w in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                    if w not in known:
                        if len(known) > 200:
                            known.clear()
                        known[w] = compiled(loaded(w))
                    texts.append(extract(parse(page.as_py()), known[w]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark, sf_dir) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
