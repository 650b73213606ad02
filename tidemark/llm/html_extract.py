"""Main-text extraction by wrappers: union-free regular expressions inferred from the pages of one host.

A page's token stream is read as elements (block tags; inline tags melt into text). The wrapper of a host is a
sequence of groups of places at each level, every kind of element once. Pages are aligned one after another: what a
page lacks becomes optional, what recurs becomes repeated, kinds that come before and after each other become one
repeated group, and a text that differs becomes a slot, so the wrapper stays free of unions. The wrapper keeps which
kind directly follows which; its groups in order are the strong components of that relation, so the merge depends
on no order of the pages, and every page shapes the wrapper: each task merges its own pages, hosts then merge what
tasks found, in two steps. Pages with an article element, with a main element and with neither are templates of
their own.

Slots decide what the article is. A slot weighs as many words as its texts do not share. From the root on, the
division that holds more than two thirds of the words of its level is followed, as long as it is no repeated place;
headings before it and other places of paragraphs with an eighth of its words come along. Where no division
below the body leads, text that SUPPORT different pages repeat alike is template. Article and main elements are the author's own word: they bound the
article, unless their slots hold less than a tenth of all. A group under a menu, footer, advert or the like never
belongs to it. Hosts with fewer than SUPPORT different pages prove no slot: all that is not outside counts there.

Each page is then matched against its host's wrapper, group by group in order. A page that has places in another
order, lacks a required one or repeats one that is not repeated does not match and is read by a wrapper of its own;
elements the wrapper does not know are as their parent.

Wrappers are one row a host. They are broadcast only if their measured size is small; else pages and wrappers
meet in a join whose key is salted, so that a host with a third of the pages spreads over many tasks.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh
from .url_filter import host_of

#: Wrappers of more bytes in all are not broadcast.
BROADCAST_BYTES, SALTS = 16 << 20, 64
#: Different pages that must repeat a text before it counts as template.
SUPPORT = 4
#: Elements nested deeper are read as blocks of the element at this depth; kinds of one tag beyond this number in one
#: place are one place, so that names of their own for every page do not swell a wrapper.
MAX_DEPTH, MAX_KINDS = 128, 200
#: A division is followed if it holds more than this share of its level's slot words, others come along from this share
#: of its words on, and article elements below this share of all slot words do not bound the article.
DOMINANT, COMPANION, EXPLICIT = (2, 3), (1, 8), (1, 10)
#: Places that a task holds before it passes its wrappers on.
HELD_PLACES = 200_000

#: HTML's block elements, those whose content is raw, those left out with their content, those that close an open one of their kind,
#: the divisions of a page, headings, and the elements, roles and class words that mark what is not the article.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = "script|style|textarea|title"
DROPPED = set("noscript template iframe svg select button object canvas".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
VOID = {"hr"}
DIVISIONS = {"html", "body", "main", "article", "section", "div", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
OUTSIDE = {"aside", "dialog", "footer", "form", "head", "header", "menu", "nav"}
OUTSIDE_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
OUTSIDE_WORDS = set("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())

#: A tag ends at its first > outside quotes; one that another < interrupts is text, which keeps the scan linear.
_REST = r"(?:\"[^\"]*\"|'[^']*'|[^\"'<>])*+>"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<({RAW})\b{_REST}.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)({_REST[:-1]})>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


class Element:
    """A block element or the root; children are Elements and texts (str, as written)."""

    __slots__ = ("tag", "names", "children")

    def __init__(self, tag: str, names: str):
        self.tag, self.names, self.children = tag, names, []

    @property
    def kind(self) -> str:
        return f"{self.tag} {self.names}" if self.names else self.tag


def _names(attributes: str) -> str:
    """Class, id and role words without digits, in a fixed form."""
    words = []
    for key, *values in _ATTRIBUTE.findall(attributes):
        mark = "@" if key.lower() == "role" else ""
        words += [mark + re.sub(r"\d+", "", w) for w in next((v for v in values if v), "").lower().split()]
    return " ".join(sorted({w for w in words if w}))


def read(page: str) -> Element:
    """The element tree of a page; unclosed, misnested and cut-off markup is repaired as browsers do."""
    root = Element("", "")
    stack, at, text = [root], 0, []
    dropped: list[tuple[int, list[str]]] = []  # depth of an open element that is left out, and the text before it
    deep: dict[str, int] = {}  # open elements below MAX_DEPTH

    def flush() -> None:
        joined = "".join(text)
        text.clear()
        if joined and not joined.isspace():
            stack[-1].children.append(joined)

    def close(tags: set[str], scope: set[str]) -> None:
        nonlocal text
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while dropped and dropped[-1][0] >= i:
                    depth, text = dropped.pop()
                    del stack[depth:]
                    if depth > i:
                        flush()
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    for m in _TOKEN.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if tag == "br":
            text.append("\n")
        if tag not in BLOCKS and tag not in DROPPED:
            continue
        if m[2] and deep.get(tag):
            deep[tag] -= 1
            flush()
            continue
        if tag in DROPPED:
            if m[2]:
                if any(stack[depth].tag == tag for depth, _ in dropped):
                    flush()
                    close({tag}, set())
            elif not (tag == "svg" and m[4].endswith("/")):
                if len(stack) > 2 * MAX_DEPTH:  # inside another one that is left out
                    deep[tag] = deep.get(tag, 0) + 1
                    continue
                dropped.append((len(stack), text))
                text = []
                stack.append(Element(tag, ""))
            continue
        flush()
        if m[2]:
            close({tag}, {"td", "th", "table"} - {tag} if tag not in {"table", "body", "html", "article", "main", "section", "div"} else set())
            continue
        close({"p"}, set() if tag == "p" else {"td", "th", "li", "div", "section", "article"})
        if tag in CLOSES and tag != "p":
            close(CLOSES[tag], SCOPES.get(tag, set()))
            if tag == "tr":
                close({"tr"}, {"table"})
        if len(stack) > MAX_DEPTH and tag not in VOID:
            deep[tag] = deep.get(tag, 0) + 1
            continue
        element = Element(tag, _names(m[4]) if m[4] else "")
        stack[-1].children.append(element)
        if tag not in VOID:
            stack.append(element)
    text.append(page[at:])
    flush()
    while dropped:
        depth, text = dropped.pop()
        del stack[depth:]
        flush()
    return root


@lru_cache(100_000)
def outside(kind: str) -> bool:
    tag, _, names = kind.partition(" ")
    if tag in OUTSIDE:
        return True
    if tag in {"", "html", "body", "article", "main"}:
        return False
    words = names.split()
    return any(w[1:] in OUTSIDE_ROLES for w in words if w[0] == "@") or any(p in OUTSIDE_WORDS for w in words if w[0] != "@" for p in re.split(r"[-_:]+", w))


def _is(kind: str, template: str) -> bool:
    return kind.split(" ")[0] == template or (template == "main" and "@main" in kind.split(" "))


def template_of(root: Element) -> str:
    """article or main if the page has such an element outside menus and the like, else the empty name."""
    found, todo = "", [root]
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, str) and not outside(c.kind):
                if _is(c.kind, "article"):
                    return "article"
                if _is(c.kind, "main"):
                    found = "main"
                todo.append(c)
    return found


# An element's place is a list [optional, repeated, places by kind, hashes of SUPPORT pages (root only), kinds that
# directly follow each kind]; a text's place (kind "#") is [optional, repeated, the text that all pages repeat or None
# for a slot, hashes of SUPPORT pages with it, words, texts, words that all texts share (None: those of the text)].
def fold(element: Element, page_hash: int) -> list:
    """The wrapper of one page: siblings of one kind are one repeated place."""
    node: list = [0, 0, {}, [], {}]
    places, last = node[2], None
    for c in element.children:
        if isinstance(c, str):
            text = _SPACE.sub(" ", c).strip()
            kind, one = "#", [0, 0, text, [page_hash], text.count(" ") + 1, 1, None]
        else:
            kind, one = c.kind, fold(c, page_hash)
        if kind in places:
            merge(places[kind], one)
            places[kind][1] = 1
        else:
            places[kind] = one
        if last is not None:
            node[4].setdefault(last, set()).add(kind)
        last = kind
    return _collapsed(node)


def merge(a: list, b: list) -> list:
    """Align b with a, in place."""
    a[0], a[1] = a[0] | b[0], a[1] | b[1]
    if isinstance(a[2], dict):
        if b[3]:
            a[3] = sorted({*a[3], *b[3]})[:SUPPORT]
        return align(a, b)
    a[4], a[5] = a[4] + b[4], a[5] + b[5]
    if a[2] is not None and a[2] == b[2]:
        a[3] = sorted({*a[3], *b[3]})[:SUPPORT]
    else:
        mine, other = (x[2].split(" ") if x[6] is None else x[6] for x in (a, b))
        a[2], a[3], a[6] = None, [], sorted({*mine}.intersection(other)) if mine and other else []
    return a


def align(a: list, b: list) -> list:
    """Align the places of element b with those of a, in place: what one of them lacks is optional, what both hold is
    merged, and what follows what is what either says."""
    wide = {kind[1:] for x in (a, b) for kind in x[2] if kind[0] == "*"}
    if wide:
        _gather(a, wide)
        _gather(b, wide)
    for kind, x in a[2].items():
        if kind in b[2]:
            merge(x, b[2][kind])
        else:
            x[0] = 1
    for kind, x in b[2].items():
        if kind not in a[2]:
            x[0] = 1
            a[2][kind] = x
    for kind, after in b[4].items():
        a[4][kind] = {*a[4].get(kind, ()), *after}
    return _collapsed(a)


def _collapsed(node: list) -> list:
    """More than MAX_KINDS kinds of one tag, none of them known as outside, become one repeated place."""
    if len(node[2]) > MAX_KINDS:
        tags = [kind.split(" ")[0] for kind in node[2] if kind != "#" and not outside(kind)]
        _gather(node, {tag for tag in set(tags) if tag[0] != "*" and tags.count(tag) > MAX_KINDS})
    return node


def _gather(node: list, tags: set[str]) -> None:
    """All kinds of these tags that are not outside become the place * and the tag."""
    if not tags:
        return
    name = lambda kind: f"*{tag}" if (tag := kind.split(" ")[0]) in tags and not outside(kind) else kind
    for kind in [k for k in node[2] if name(k) != k]:
        whole = node[2].setdefault(name(kind), [1, 1, {}, [], {}])
        merge(whole, node[2].pop(kind))
        whole[:2] = [1, 1]
    order, node[4] = node[4], {}
    for kind, after in order.items():
        node[4].setdefault(name(kind), set()).update(map(name, after))


def groups_of(node: list) -> list[list[str]]:
    """The kinds of an element by groups in page order: kinds that lead to each other are one group (the strong
    components of "directly follows")."""
    after = {kind: sorted(node[4].get(kind, ())) for kind in node[2]}
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held: dict[str, None] = {}
    found: list[list[str]] = []
    for start in sorted(after):
        todo = [] if start in index else [(start, iter(after[start]))]
        while todo:
            kind, rest = todo[-1]
            if kind not in index:
                index[kind] = low[kind] = len(index)
                held[kind] = None
            for x in rest:
                if x not in index:
                    todo.append((x, iter(after[x])))
                    break
                if x in held:
                    low[kind] = min(low[kind], index[x])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[kind])
                if low[kind] == index[kind]:
                    group = []
                    while not group or group[-1] != kind:
                        group.append(held.popitem()[0])
                    found.append(sorted(group))
    return found[::-1]


def places_of(node: list) -> int:
    return 1 + sum(map(places_of, node[2].values())) if isinstance(node[2], dict) else 1


def _constant(text: list) -> bool:
    return text[2] is not None and len(text[3]) >= SUPPORT


def slot_words(kind: str, node: list) -> int:
    """Words of the slots at and below a place that is not outside, less those that all texts of a slot share."""
    if isinstance(node[2], dict):
        return 0 if outside(kind) else sum(slot_words(k, x) for k, x in node[2].items())
    return 0 if _constant(node) else node[4] - node[5] * len(node[6] or ())


def _paragraphs(kind: str, node: list) -> bool:
    return kind.split(" ")[0] == "p" or (isinstance(node[2], dict) and any(_paragraphs(k, x) for k, x in node[2].items()))


def article_places(wrapper: list) -> tuple[list[list], bool]:
    """The places that slots choose: the division they lead to, headings before it and companions of paragraphs; and
    whether that division lies below the body."""
    kept, node, kind = [], wrapper, ""
    while len(wrapper[3]) >= SUPPORT:
        words = {k: slot_words(k, x) for k, x in node[2].items()}
        best = max(words, key=lambda k: (words[k], k), default="#")
        x = node[2].get(best)
        if best.split(" ")[0] not in DIVISIONS or outside(best) or x[1] or words[best] * DOMINANT[1] <= sum(words.values()) * DOMINANT[0] or set(x[2]) <= {"#"}:
            break
        before = set()
        for group in groups_of(node):
            if best in group:
                break
            before.update(group)
        kept += [y for k, y in node[2].items() if k != best and k != "#" and ((k in before and k.split(" ")[0] in HEADINGS) or (words[k] * COMPANION[1] >= words[best] * COMPANION[0] and _paragraphs(k, y)))]
        node, kind = x, best
    return [*kept, node], kind.split(" ")[0] not in {"", "html", "body"}


def mark(wrapper: list, template: str) -> list:
    """[inside, its text counts, {kind: [group, place]}, [required, repeated] of each group]: the wrapper as pages are
    matched with it, and which of its places belong to the article."""

    def explicit(kind: str, node: list) -> int:
        if _is(kind.lstrip("*"), template):
            return slot_words(kind, node)
        return 0 if outside(kind) or not isinstance(node[2], dict) else sum(explicit(k, x) for k, x in node[2].items())

    if template and len(wrapper[3]) >= SUPPORT and explicit("", wrapper) * EXPLICIT[1] < slot_words("", wrapper) * EXPLICIT[0]:
        template = ""
    places, bounded = ([], True) if template else article_places(wrapper)
    chosen = {id(x) for x in places}

    def walk(kind: str, node: list, inside: bool) -> list:
        inside = (inside or id(node) in chosen or bool(template and _is(kind.lstrip("*"), template))) and not outside(kind)
        if outside(kind):
            return [0, 0, {}, []]
        text = node[2].get("#")
        groups = groups_of(node)
        flags = [[int(any(not node[2][k][0] for k in group)), int(len(group) > 1 or node[2][group[0]][1])] for group in groups]
        at = {k: i for i, group in enumerate(groups) for k in group}
        below = {k: [at[k], walk(k, x, inside) if k != "#" else None] for k, x in node[2].items()}
        return [int(inside), int(inside and (bounded or text is None or not _constant(text))), below, flags]

    return walk("", wrapper, False)


def infer(pages: list[str]) -> dict[str, list]:
    """The marked wrappers of some pages of one host, by template."""
    return {t: mark(w, t) for t, w in unmarked(pages).items()}


def unmarked(pages: list[str], known: dict[str, list] | None = None) -> dict[str, list]:
    found = {} if known is None else known
    for page in pages:
        root = read(page)
        page_hash = zlib.crc32(page.encode("utf-8", "replace"))
        template, one = template_of(root), fold(root, page_hash)
        one[3] = [page_hash]
        found[template] = merge(found[template], one) if template in found else one
    return found


def matched(wrapper: list, root: Element) -> list[str] | None:
    """The article's blocks of a page that matches the wrapper, group by group in order; None if it does not."""
    blocks: list[str] = []

    def walk(element: Element, node: list) -> bool:
        inside, text, places, groups = node
        at = -1
        for c in element.children:
            whole = isinstance(c, str)
            place = places.get("#" if whole else c.kind)
            if place is None and not whole and not outside(c.kind):
                place = places.get(f"*{c.tag}")
            if place is not None:
                if place[0] < at or (place[0] == at and not groups[at][1]) or any(required for required, _ in groups[at + 1 : place[0]]):
                    return False
                at = place[0]
            if whole:
                if (text if place else inside) and (t := _SPACE.sub(" ", entities.unescape(c)).strip()):
                    blocks.append(t)
            elif not outside(c.kind) and not walk(c, place[1] if place else [inside, inside, {}, []]):
                return False
        return not any(required for required, _ in groups[at + 1 :])

    return blocks if walk(root, wrapper) else None


def apply(wrappers: dict[str, list], page: str) -> str:
    """Match a page with its template's wrapper: the text at the places that belong to the article. A page that does
    not match is read by a wrapper of its own."""
    root = read(page)
    template = template_of(root)
    if template not in wrappers:
        return ""
    blocks = matched(wrappers[template], root)
    return "\n".join(matched(infer([page])[template], root) if blocks is None else blocks)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): JSON of the marked wrappers of each host. Every page shapes them."""
    rows = pages.select(F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("page"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, list]] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def passed() -> pa.RecordBatch:
            out = [(h, json.dumps(w, separators=(",", ":"), default=sorted)) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([salt] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.string())], names=["host", "salt", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                unmarked([page.as_py()], held.setdefault(host, {}))
            if sum(places_of(w) for x in held.values() for w in x.values()) > HELD_PLACES:
                yield passed()
        if held:
            yield passed()

    def meet(group: pd.DataFrame, last: bool) -> pd.DataFrame:
        whole: dict[str, list] = {}
        for text in group["wrapper"]:
            for template, w in json.loads(text).items():
                whole[template] = merge(whole[template], w) if template in whole else w
        if last:
            whole = {t: mark(w, t) for t, w in whole.items()}
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps(whole, separators=(",", ":"), default=sorted)]})

    found = rows.mapInArrow(own, "host string, salt int, wrapper string")
    found = found.groupBy("host", "salt").applyInPandas(lambda g: meet(g, False), "host string, wrapper string")
    return found.groupBy("host").applyInPandas(lambda g: meet(g, True), "host string, wrapper string")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`pages` with main_text at the end: the article's blocks in page order, joined by a line feed.

    Character references are decoded, white space inside a block is one space, blocks are trimmed. Null and
    empty pages, and those without an article, give the empty text. Pages without a host share the wrapper of
    the empty host. Repeated rows give repeated rows, very long and very deep pages are read whole, an empty table
    gives no rows. A column that bears the new name is replaced."""
    pages = pages.drop(*(c for c in pages.columns if c.lower() == "main_text" and c not in (url_col, html_col)))
    found = cut(wrappers(pages, url_col, html_col))
    host, salt, wrapper, text = (fresh([*pages.columns, "main_text"], f"_{x}") for x in ("host", "salt", "wrapper", "html"))
    rows = pages.withColumn(host, F.coalesce(host_of(F.col(url_col)), F.lit("")))
    found = found.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))
    size = found.agg(F.sum(F.length(wrapper) + F.length(host) + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        rows = rows.join(F.broadcast(found), host, "left")
    else:
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(html_col), F.lit(SALTS)))
        found = found.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.join(found, [host, salt], "left")
    rows = rows.select(*pages.columns, F.col(wrapper), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias(text))
    width = len(pages.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, list]] = {}
        for batch in batches:
            out = []
            for w, page in zip(batch.column(width), batch.column(width + 1), strict=True):
                w = w.as_py() or "{}"
                if w not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[w] = json.loads(w)
                out.append(apply(known[w], page.as_py()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(out, pa.string())], names=[*batch.schema.names[:width], "main_text"])

    return rows.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())]))
