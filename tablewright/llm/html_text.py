"""Main-text extraction by composite text density.

The page becomes a tree of nodes (a tolerant reader closes what authors leave
open). Each node has its characters, tags, link characters and link tags; its
density is characters per tag, adjusted by how much of it stands in links
against the body's mean. A node's sum is that of its children's densities. From
the node of the largest sum, the smallest density on the path up to the body is
the threshold: nodes below it are left out, and from each kept branch the
subtree of the largest sum is taken. Where that lies in an article or main, the
page itself names the border, and the whole of it is taken. Elements that never hold main text (scripts,
controls, what is hidden) are cut before the densities are computed. So is what
its tag, role or name marks as standing beside an article (navigation, forms,
notices, adverts, comments), unless it holds the page's article: the mark alone
is no more than evidence. If nothing is left, the marks are disregarded.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import load

#: Elements whose content is never text of the page.
SKIP = {"script", "style", "noscript", "template", "head", "title", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "audio", "video", "select", "option", "button", "input", "textarea"}
#: Elements that stand beside an article as a rule.
ASIDE = {"form", "nav", "footer", "aside", "dialog", "menu"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text runs on with the text around them.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mstyle", "mpadded", "mphantom", "mfenced", "menclose", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mtable", "mtr", "mtd"}
#: Opening one of these closes an open one of those before it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
#: Elements inside which the rules of CLOSES look no further up.
BARRIER = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "body", "select", "td", "th"}
#: Block elements: their start ends an open paragraph.
BLOCKS_END_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Words in class, id or role that mark what stands beside an article.
BESIDE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|comment-list|replies|respond|disqus|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|footer|header|masthead|share|sharing|social|related|recommend(?:ed|ations)?|pagination|pager|skip|toolbar|search|copyright)(?:$|[\s_-])", re.I)
#: Names of a part of an article itself, inside one.
HEADING = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
#: Words that may name a section of an article, too: as a part of a name inside one they tell nothing without many links.
SECTION = re.compile(r"(?:^|[\s_-])(?:related|recommend(?:ed|ations)?|notice|side|search|banner|overlay|skip|copyright|footer|menu|promo(?:tion)?s?|widget)(?=$|[\s_-])", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "mark", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", mark: str = ""):
        self.tag, self.parent, self.mark, self.cut = tag, parent, mark, bool(mark)
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _beside(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> str:
    """Why an element is cut: "never" text of the page, marked by "tag" or role, "name" or "part" of a name, or a part that may name a "section"; else empty."""
    if tag in SKIP:
        return "never"
    mark = "part" if tag == "form" else "tag" if tag in ASIDE or tag == "header" and not inside_article else ""
    if not mark and tag in ("html", "body", "article", "main"):
        return ""
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "never"
        if key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"):
            mark = mark or "tag"
        if key in ("class", "id") and value:
            tokens = [HEADING.sub(" ", t) if inside_article else t for t in value.split()]
            if any(BESIDE.fullmatch(t) for t in tokens):
                mark = mark or "name"
            elif any(BESIDE.search(t) for t in tokens):
                plain = inside_article and not any(BESIDE.search(SECTION.sub(" ", t)) for t in tokens)
                mark = mark or ("section" if plain else "part")
    return mark


class TreeReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("#root", None)
        self.depth_article = 0

    def parse_marked_section(self, i, report=1):
        # Not markup of HTML: read as a comment, up to the next ">".
        return self.parse_bogus_comment(i)

    def _open_up_to(self, tags: set[str], stop: set[str]) -> Node | None:
        node = self.top
        while node is not None and node.tag not in stop:
            if node.tag in tags:
                return node
            node = node.parent
        return node if node is not None and node.tag in tags else None

    def _close(self, node: Node) -> None:
        at = self.top
        while at is not node:
            self.depth_article -= at.tag in ("article", "main")
            at = at.parent
        self.depth_article -= node.tag in ("article", "main")
        self.top = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS_END_P and (p := self._open_up_to({"p"}, BARRIER - {"p"})):
            self._close(p)
        if tag in CLOSES and (old := self._open_up_to(CLOSES[tag], BARRIER - CLOSES[tag])):
            self._close(old)
        if tag == "body" and (head := self._open_up_to({"head"}, {"body"})):
            self._close(head)
        node = Node(tag, self.top, _beside(tag, attrs, self.depth_article > 0))
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node
            self.depth_article += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.top.tag == tag:
            self._close(self.top)

    def handle_endtag(self, tag):
        # An end tag closes the nearest such element; a stray one changes nothing.
        node = self.top
        while node is not None and node.tag != tag:
            if node.tag in ("table", "td", "th", "article", "body") and tag in INLINE | {"p", "li"}:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self._close(node)

    def handle_data(self, data):
        self.top.children.append(data)


def _plain(root: Node) -> tuple[dict[int, int], dict[int, int], dict[int, set[str]]]:
    """By node: characters outside links, all characters and, of these tags, whether an article or main is it or in it; what is never text is left out."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        stack.extend((c, linked) for c in node.children if isinstance(c, Node) and c.mark != "never")
    plain: dict[int, int] = {}
    chars: dict[int, int] = {}
    holds: dict[int, set[str]] = {}
    for node, linked in reversed(order):
        below = [c for c in node.children if isinstance(c, Node) and c.mark != "never"]
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        chars[id(node)] = own + sum(chars[id(c)] for c in below)
        plain[id(node)] = (0 if linked else own) + sum(plain[id(c)] for c in below)
        holds[id(node)] = ({node.tag} & {"article", "main"}).union(*[holds[id(c)] for c in below])
    return plain, chars, holds


def _spare(body: Node) -> None:
    """Keep marked elements that hold the page's article.

    That is those which hold its main; and, where no article or main stands
    outside marked elements, those which hold an article of more text than stands
    outside, and those marked by a part of a name only (or forms) that hold
    most of the page's text. Links count as no text. What may be a section of an
    article is kept unless most of it is links.
    """
    plain, chars, holds = _plain(body)
    free, named, stack = 0, False, [body]
    while stack:
        node = stack.pop()
        if node.mark == "section":
            node.cut = 2 * plain[id(node)] < chars[id(node)]
        below = [c for c in node.children if isinstance(c, Node) and c.mark != "never"]
        free += plain[id(node)] - sum(plain[id(c)] for c in below)
        named = named or node.tag in ("article", "main")
        stack.extend(c for c in below if not c.cut or c.mark == "section")
    stack = [body]
    while stack:
        node = stack.pop()
        if node.cut and node.mark != "section":
            text, inside = plain[id(node)], holds[id(node)]
            node.cut = not ("main" in inside or not named and ("article" in inside and text > free or node.mark == "part" and 2 * text > plain[id(body)]))
        if not node.cut:
            stack.extend(c for c in node.children if isinstance(c, Node) and c.mark != "never")


def _post_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.cut)
    return out[::-1]


def _measure(root: Node) -> None:
    order = _post_order(root)
    for node in order:
        in_link = node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(_SPACE.sub(" ", child).strip())
            elif not child.cut:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if in_link:
            node.link_chars = node.chars
    body_chars, body_links = max(1, root.chars), root.link_chars
    for node in order:
        c, t = node.chars, max(1, node.tags)
        lc, lt = node.link_chars, max(1, node.link_tags)
        plain = max(1, c - lc)
        # Characters per tag, weighed by a logarithm whose base grows with the share of links.
        base = max(math.log(c / plain * lc + body_links / body_chars * c + math.e), 1.0 + 1e-9)
        weight = math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)
        node.density = c / t * weight if c else 0.0
        node.total = sum(child.density for child in node.children if isinstance(child, Node) and not child.cut)


def _best(root: Node) -> Node:
    """The node of the largest sum under root (the first of equals in page order)."""
    best, stack = root, [root]
    while stack:
        node = stack.pop()
        if node.total > best.total:
            best = node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.cut)
    return best


def _selected(body: Node) -> list[Node]:
    """The subtrees to keep, in page order."""
    best = _best(body)
    threshold, node = best.density, best
    while node is not body.parent and node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    kept, stack = [best], [body]
    while stack:
        node = stack.pop()
        if node is best or node.density < threshold:
            continue
        if not _holds(node, best):
            kept.append(_best(node))
            continue
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.cut)
    order = {id(n): k for k, n in enumerate(_page_order(body))}
    return sorted(kept, key=lambda n: order[id(n)])


def _page_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.cut)
    return out


def _holds(node: Node, other: Node) -> bool:
    while other is not None:
        if other is node:
            return True
        other = other.parent
    return False


def _widen(node: Node) -> Node:
    """From a part of an article to the article itself, where the page names one."""
    at, found = node, node
    while at is not None:
        if at.tag in ("article", "main"):
            found = at
            break
        at = at.parent
    return found


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks under a node, in page order; cut elements are left out."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        item, leaving = stack.pop()
        if isinstance(item, str):
            buffer.append(item)
            continue
        block = item.tag not in INLINE
        if leaving or item.cut:
            if block:
                flush()
            continue
        if block:
            flush()
        stack.append((item, True))
        stack.extend((c, False) for c in reversed(item.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by one space; empty if the page has no text."""
    if not html:
        return ""
    reader = TreeReader()
    reader.feed(html)
    reader.close()
    root = reader.root
    body, stack = root, [root]
    while stack:
        node = stack.pop()
        if node.tag == "body":
            body = node
            break
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    if body is not root:
        body.cut = False
    _spare(body)
    text = _extract(body)
    if not text:
        _unmark(body)
        text = _extract(body)
    return text


def _unmark(body: Node) -> None:
    """Keep all named blocks and forms; what its tag or role marks stays cut."""
    stack = [body]
    while stack:
        node = stack.pop()
        node.cut = node.cut and node.mark in ("never", "tag")
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        stack.extend(c for c in node.children if isinstance(c, Node))


def _extract(body: Node) -> str:
    _measure(body)
    chosen: list[Node] = []
    for node in _selected(body):
        node = _widen(node)
        if not any(_holds(c, node) for c in chosen):
            chosen.append(node)
    return " ".join(block for node in chosen for block in _blocks(node))


def extract_main_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), out_col: str = "text") -> DataFrame:
    """Each page's ``keep`` columns and its main text.

    Null and empty pages, and pages without text outside menus, footers and the
    like, have the empty text. Broken markup is read as browsers do, as far as
    it goes: no page stops the run. Pages of any length are read whole;
    repeated rows are repeated; other columns are not read.
    """
    source = pages.select(*[F.col(c) for c in keep], F.col(html_col).cast("string").alias("__html"))

    def extract(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, out_col])

    return source.mapInArrow(extract, source.select(*keep).schema.add(out_col, "string"))


def op9_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
