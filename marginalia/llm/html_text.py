"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks at block-level tags, each at the end of a root-to-leaf tag path.

1. Per path, the length of its text outside links and its punctuation are summed over its blocks. Both ratios (per block of
   the path) are smoothed over neighbouring paths in page order and fused: length times (1 + punctuation). Paths whose fused
   ratio reaches the standard deviation of all are content paths; their text is the page's content weight.
2. This is done twice. Elements that name themselves as something else than the article (by tag, role, class or id: menus,
   sidebars, adverts, comments and so on) and yet hold SHARE of the first content weight, or half of that with a main
   heading, have misleading names, which are ignored (but for navigation, footer, aside and dialog elements). The second time, paths under the other names count a tenth and paths
   in article or main elements twice.
3. The content node is the deepest element that holds SHARE of the weight, or the article or main element around it, or
   where there is none an outer element that adds a heading and little else.
4. Every block under the content node is main text, but for inner elements with such names, for what page headers have
   beside headings, and, unless the node is an article or main element, for blocks off the content paths that are mostly
   links. Where only the whole page holds the content, blocks off the content paths are main text only as headings.

Scripts, styles, form controls and hidden elements are never text. All steps are linear in the page.

Defined cases: null or empty html gives an empty text; html without tags is one block; broken or unclosed tags are closed
as browsers do for paragraphs, list items and table cells, and a tag that the end of the page cuts off is markup; very long
and very deep pages are handled whole; of elements that hold the same weight the deepest is taken; repeated rows are
extracted each; an empty table gives an empty result; further columns are passed through.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import plain

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Share of the content weight that the content node holds, and what a name takes from a path and an article element gives it.
SHARE, NAME_FACTOR, ARTICLE_FACTOR = 0.8, 0.1, 2.0
#: Elements whose content is not text of the page; the first ones end only at their own end tag.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math".split())
CONTROLS = frozenset("button select object canvas audio video datalist map label input".split())
#: Elements that are named by their tag; the first ones are never the article.
SURE = frozenset("nav footer aside dialog menu".split())
NAMED = SURE | {"form", "search", "fieldset"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner footer sidebar aside widget widgets ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion notice notices cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies "
    "respond discussion search pagination pager toolbar skip copyright legal disclaimer form".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What an opening tag closes, up to one of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
PUNCTUATION = re.compile(r"[^\w\s]")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Node:
    __slots__ = ("tag", "parent", "path", "gone", "named", "header", "article")

    def __init__(self, tag: str, parent: int, path: int, gone: bool, named: bool, header: bool, article: int) -> None:
        self.tag, self.parent, self.path, self.gone, self.named, self.header, self.article = tag, parent, path, gone, named, header, article


class _Block:
    __slots__ = ("node", "text", "links")

    def __init__(self, node: int, text: str, links: int) -> None:
        self.node, self.text, self.links = node, text, links


def _traits(tag: str, raw: str) -> tuple[str, bool, bool, bool]:
    """Of an opening tag: its label in paths; whether it is never text, names itself as something else, is a header."""
    if not raw.strip(" \t\r\n/"):
        return tag, tag in CONTROLS, tag in NAMED, tag == "header"
    attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
    names = [w.lower() for k in ("class", "id") for w in _WORDS.findall(attributes.get(k, ""))]
    label = tag + "." + attributes["class"].split()[0] if attributes.get("class", "").split() else tag
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I)
    if tag in ("html", "body"):
        return label, False, False, False
    own = not {"with", "has", "no"} & set(names)
    named = tag in NAMED or attributes.get("role", "").lower() in ROLES or own and not NAMES.isdisjoint(names)
    return label, tag in CONTROLS or bool(hidden), named, tag == "header" or own and "header" in names


class Page:
    """A page's elements (the first stands for the whole page) and text blocks, in page order."""

    def __init__(self, page: str) -> None:
        self.nodes = [_Node("", 0, 0, False, False, False, 0)]
        self.blocks: list[_Block] = []
        self._parse(page)

    def _parse(self, page: str) -> None:
        nodes, stack = self.nodes, [0]
        paths: dict[tuple[int, str], int] = {}
        parts: list[str] = []
        in_link, links = False, 0
        opened: Counter[str] = Counter()

        def leave(i: int) -> None:
            opened.subtract(nodes[x].tag for x in stack[i:])
            del stack[i:]

        def end_block() -> None:
            nonlocal links
            if parts:
                text = " ".join(_html.unescape("".join(parts)).split())
                parts.clear()
                if text and not nodes[stack[-1]].gone:
                    self.blocks.append(_Block(stack[-1], text, min(links, len(text))))
            links = 0

        def close(tags: set[str], stops: set[str]) -> None:
            if not any(opened[t] for t in tags):
                return
            for i in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[i]].tag
                if tag in tags:
                    last = i
                    while last > 1 and nodes[stack[last - 1]].tag in tags:
                        last -= 1
                    leave(last)
                    return
                if tag in stops:
                    return

        def enter(tag: str, raw: str) -> None:
            label, gone, named, header = _traits(tag, raw)
            up = nodes[stack[-1]]
            path = paths.setdefault((up.path, label), len(paths) + 1)
            article = len(nodes) if tag in ("article", "main") and not (tag == "main" and up.article) else up.article
            nodes.append(_Node(tag, stack[-1], path, up.gone or gone, named, header, article))
            stack.append(len(nodes) - 1)
            opened[tag] += 1

        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            text = page[at : m.start() if m else n]
            if text:
                parts.append(text)
                if in_link:
                    links += len(text)
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    in_link = False
                elif tag in BLOCK or tag in CONTROLS:
                    end_block()
                    if opened[tag]:
                        leave(next(i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag))
                continue
            if tag in RAW:
                if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                    end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                    gone = page.find(">", end.end() - 1) if end else -1
                    at = gone + 1 if gone >= 0 else n
                continue
            if tag == "br":
                parts.append("\n")
            elif tag in BLOCK:
                end_block()
                if tag not in ("html", "body", "head", "option"):
                    close({"p"}, {"button", "td", "th", "table", "caption", "object"})
                if tag in CLOSES:
                    close(*CLOSES[tag])
                if tag not in VOID and not (tag in ("html", "body") and opened[tag]):
                    if tag == "body" and opened["head"]:
                        leave(next(i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == "head"))
                    enter(tag, m[3])
            elif tag in CONTROLS and tag not in VOID:
                enter(tag, m[3])
            elif m[3] and tag in ("span", "a", "ins") and (traits := _traits(tag, m[3])) and (traits[1] or traits[2]):
                # an inline element that names itself as an advert or the like, or is hidden: skip to its end
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
            if tag == "a":
                in_link = True
        end_block()


def _smoothed(values: list[float]) -> list[float]:
    """Each value and its neighbours at weights 1, 2, 1."""
    n = len(values)
    return [(values[max(i - 1, 0)] + 2 * values[i] + values[min(i + 1, n - 1)]) / 4 for i in range(n)]


def content_paths(page: Page, named: list[bool]) -> dict[int, float]:
    """The tag paths whose fused, smoothed ratios reach the standard deviation of all, with their factors."""
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    factor: dict[int, float] = {}
    for b in page.blocks:
        node = page.nodes[b.node]
        path = node.path
        length[path] = length.get(path, 0) + len(b.text) - b.links
        marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(b.text))
        count[path] = count.get(path, 0) + 1
        factor[path] = (NAME_FACTOR if named[b.node] else 1.0) * (ARTICLE_FACTOR if node.article else 1.0)
    paths = list(length)
    text_ratio = _smoothed([length[p] / count[p] for p in paths])
    mark_ratio = _smoothed([marks[p] / count[p] for p in paths])
    fused = [t * (1 + m) * factor[p] for p, t, m in zip(paths, text_ratio, mark_ratio)]
    mean = sum(fused) / len(fused)
    threshold = min(math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)), max(fused))
    return {p: factor[p] for p, x in zip(paths, fused) if x >= threshold}


def _weights(page: Page, good: dict[int, float]) -> list[float]:
    """The content weight that each element holds."""
    weight = [0.0] * len(page.nodes)
    for b in page.blocks:
        weight[b.node] += len(b.text) * good.get(page.nodes[b.node].path, 0.0)
    for i in range(len(page.nodes) - 1, 0, -1):
        weight[page.nodes[i].parent] += weight[i]
    return weight


def _named(page: Page) -> list[bool]:
    """Whether an element or one around it names itself as something else, and its name isn't misleading."""
    nodes = page.nodes
    weight = _weights(page, content_paths(page, [False] * len(nodes)))
    titled = [n.tag in ("h1", "h2") for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        titled[nodes[i].parent] |= titled[i]
    out = [False] * len(nodes)
    for i, n in enumerate(nodes):
        n.named = n.named and (n.tag in SURE or weight[i] < (SHARE / 2 if titled[i] else SHARE) * weight[0])
        out[i] = n.named or bool(i and out[n.parent])
    return out


def _content_node(page: Page, weight: list[float], named: list[bool]) -> int:
    nodes, root = page.nodes, 0
    for i, n in enumerate(nodes):  # elements come after those around them, so the last such one in a branch is the deepest
        if n.parent == root and i and weight[i] >= SHARE * weight[0]:
            root = i
    if nodes[root].article:
        return nodes[root].article
    size, heads = [0] * len(nodes), [0] * len(nodes)
    for b in page.blocks:
        if not named[b.node]:
            size[b.node] += len(b.text)
            heads[b.node] += nodes[b.node].tag in HEADINGS
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        heads[nodes[i].parent] += heads[i]
    while root and nodes[root].tag in ("p", "li", "td", "pre", "blockquote", *HEADINGS):
        root = nodes[root].parent
    up = nodes[root].parent
    while root and nodes[up].tag not in ("", "html", "body"):
        if heads[up] > heads[root] and 4 * (size[up] - size[root]) <= size[root]:
            root = up
        up = nodes[up].parent
    return root


def main_text(html: str | None) -> str:
    page = Page(html or "")
    if not page.blocks:
        return ""
    nodes, named = page.nodes, _named(page)
    good = content_paths(page, named)
    weight = _weights(page, good)
    root = _content_node(page, weight, named)
    inside, gone, header, heading = ([False] * len(nodes) for _ in range(4))
    inside[root] = True
    for i, n in enumerate(nodes):
        if i:
            inside[i] = inside[i] or inside[n.parent]
            if inside[i] and i != root:
                gone[i] = gone[n.parent] or n.named
                header[i] = header[n.parent] or n.header and 2 * weight[i] < weight[root]
            heading[i] = heading[n.parent] or n.tag in HEADINGS
    whole, article = nodes[root].tag in ("", "html", "body"), nodes[root].tag in ("article", "main")
    kept: list[str] = []
    after = False  # whether the block after this one is kept
    for b in reversed(page.blocks):
        n = b.node
        keep = inside[n] and not gone[n] and (heading[n] or not header[n])
        if keep and nodes[n].path not in good and not article:
            keep = 2 * b.links <= len(b.text) and (not whole or heading[n] and after)
        if keep:
            kept.append(b.text)
        after = keep
    return "\n\n".join(reversed(kept))


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """pages without html_col, with the main text and its length in code points."""
    at = pages.columns.index(html_col)
    names = [c for c in pages.columns if c not in (html_col, text_col, length_col)]
    schema = pages.select(*[plain(c) for c in names]).schema.add(text_col, "string").add(length_col, "long")
    kept = [pages.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 200):
                batch = whole.slice(s, 200)
                texts = [main_text(x) for x in batch.column(at).to_pylist()]
                columns = [batch.column(i) for i in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, text_col, length_col])

    return pages.mapInArrow(run, schema)
