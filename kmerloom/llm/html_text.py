"""Main text of web pages by composite text density.

The page is parsed into a tree of its elements. Every node has its characters,
tags, link characters and link tags, and a composite density that sets
characters per tag against the links among them. The block whose children have
the largest sum of densities is the article, taken up to an enclosing article
element, or else main element. The least density on its path to the body is
the threshold: below it lists of links inside the block are left out, from it
on blocks of the same kind beside it are parts of the article too.

Names of elements and classes only take away what they name as a whole, and
never a block that holds most of the page's text or its heading.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.tokens import drop_heavy

# Element names of HTML, and words by which pages name what is no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
MATHML = set("mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle semantics annotation mfenced menclose mpadded mphantom".split())
NEVER_TEXT = set("head nav footer button select template noscript svg canvas object audio video datalist progress meter".split())
USUALLY_NO_TEXT = set("aside form menu dialog".split())
IN_HEAD = set("base link meta title script style noscript template".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
SAME_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"},
}
LIST_SCOPE = set("ul ol dl menu dir table td th body html".split())
TABLE_SCOPE = set("table body html".split())
CELL_SCOPE = set("table td th caption body html".split())
TABLE_PARTS = set("table caption colgroup tbody thead tfoot tr td th".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
COMMENT_WORDS = set("comment comments commentlist commentform commentary disqus reply replies respond".split())
BOILERPLATE_WORDS = COMMENT_WORDS | set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsors sponsored promo promos sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer footers cookie cookies consent gdpr notice notices popup popups modal overlay newsletter newsletters subscribe share sharing sharebar social related login "
    "signup masthead topbar skip pagination pager toolbar paywall alert alerts hidden".split()
)
NEUTRAL_WORDS = set(
    "main left right top bottom box block blocks area wrap wrapper container containers section sections list lists item items widget widgets site page global primary secondary inner outer "
    "col column bar link links button buttons icon icons text content group row panel module component post posts entry article articles story stories thread form body head title side footer "
    "header the and to up of for us follow media policy message slot unit".split()
)

#: Elements nested deeper are taken as part of the one they are in, as browsers do.
DEPTH = 512
#: A block with so many links at least, and such a share of link characters, is a list of links.
LINKS, LINK_SHARE = 3, 0.9

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_SKIP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(\s*+=\s*+)?+")
_UNQUOTED = re.compile(r"[^\s>]*+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "parent", "parts", "depth", "block", "in_link", "hard", "soft", "header", "kind", "out", "holds", "every", "chars", "tags", "link_chars", "link_tags", "own", "density")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.kind = tag, parent, attributes.get("class", "")
        self.parts: list[str | Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.block = tag not in INLINE and tag not in MATHML
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.hard = tag in NEVER_TEXT or "hidden" in attributes and tag not in ("html", "body")
        self.soft, self.header = _named(tag, attributes) if self.block else (0, False)
        self.out = self.holds = False
        self.every = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.own = [0, 1, 0, 0]  # characters, tags, link characters and link tags outside of blocks within
        self.density = 0.0


def _named(tag: str, attributes: dict[str, str]) -> tuple[int, bool]:
    """(2 for reader comments, 1 for other things beside the article, 0 for none; whether it is a header) by its names.

    A class names a thing if all its words belong to the thing's name, so
    ``share-buttons`` does and ``share-enabled`` or ``no-sidebar`` do not.
    """
    if tag in ("html", "body", "main"):
        return 0, False
    soft, header = int(tag in USUALLY_NO_TEXT or attributes.get("role", "").lower() in ROLES or attributes.get("aria-hidden", "").lower() == "true"), tag == "header"
    for name in (*attributes.get("class", "").split(), *attributes.get("id", "").split()):
        words = {w.lower() for w in _WORDS.findall(name)}
        words = {w for w in words if not w.isdigit()}
        if words & COMMENT_WORDS and words <= BOILERPLATE_WORDS | NEUTRAL_WORDS:
            soft = 2
        elif words & BOILERPLATE_WORDS and words <= BOILERPLATE_WORDS | NEUTRAL_WORDS and tag != "article":
            soft = max(soft, 1)
        elif "header" in words and words <= NEUTRAL_WORDS and tag != "article":
            header = True
    return soft, header


class _Page:
    """A reader of tags that never looks at a character more than a few times."""

    def __init__(self, page: str):
        self.page, self.last = page, {'"': page.rfind('"'), "'": page.rfind("'")}

    def tag(self, at: int) -> tuple[int, str, dict[str, str]] | None:
        """(end, name, attributes) of the tag whose name begins at ``at``; none if the page ends before the tag does."""
        page, attributes = self.page, {}
        m = _NAME.match(page, at)
        name, at = m[0].lower(), m.end()
        while True:
            at = _SKIP.match(page, at).end()
            if at >= len(page):
                return None
            if page[at] == ">":
                return at + 1, name, attributes
            m = _ATTRIBUTE.match(page, at)
            key, at, value = m[1].lower(), m.end(), ""
            if m[2] and at < len(page):
                quote = page[at]
                if quote in "\"'" and self.last[quote] > at:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                elif quote in "\"'":  # never closed: the tag ends where the next > is
                    end = page.find(">", at)
                    if end < 0:
                        return None
                    value, at = page[at + 1 : end], end
                else:
                    m = _UNQUOTED.match(page, at)
                    value, at = m[0], m.end()
            attributes.setdefault(key, html.unescape(value) if "&" in value else value)


def parse(page: str) -> list[Node]:
    """The page's elements, each before its children; the first is the root."""
    reader, n, at = _Page(page), len(page), 0
    root = node = Node("html", None, {})
    nodes, body, open_tags = [root], None, Counter()

    def add(raw: str) -> None:
        nonlocal node
        if raw:
            if node.tag == "head" and raw.strip():
                leave(node)
            text = html.unescape(raw) if "&" in raw else raw
            size = len("".join(text.split()))
            node.parts.append(text)
            block = node
            while not block.block:
                block = block.parent
            block.own[0] += size
            node.chars += size
            if node.in_link:
                block.own[2] += size
                node.link_chars += size

    def enter(tag: str, attributes: dict[str, str]) -> None:
        nonlocal node
        new = Node(tag, node, attributes)
        node.parts.append(new)
        nodes.append(new)
        open_tags[tag] += 1
        node = new

    def leave(upto: Node) -> None:
        nonlocal node
        while node is not upto.parent:
            open_tags[node.tag] -= 1
            node = node.parent

    def within(tags: set[str], scope: set[str]) -> Node | None:
        """The innermost open element of ``tags``, as far as ``scope`` lets one see; the outermost of a row of them."""
        if not any(open_tags[t] for t in tags):
            return None
        up, found = node, None
        while up is not None and up.tag not in scope | tags:
            up = up.parent
        while up is not None and up.tag in tags:
            found, up = up, up.parent
        return found

    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            add(page[at:])
            break
        follows = page[cut + 1 : cut + 3]
        closing = follows[:1] == "/"
        first = follows[1:2] if closing else follows[:1]
        if page.startswith("<!--", cut):
            add(page[at:cut])
            end = page.find("-->", cut + 2 if page.startswith(("<!-->", "<!--->"), cut) else cut + 4)
            at = n if end < 0 else end + 3
        elif first.isascii() and first.isalpha():
            add(page[at:cut])
            found = reader.tag(cut + 1 + closing)
            if found is None:
                break
            at, tag, attributes = found
            if closing:
                if tag == "head" or tag not in ("html", "body") and open_tags[tag]:
                    scope = set() if tag in TABLE_PARTS else CELL_SCOPE
                    up = node
                    while up is not None and up.tag != tag and up.tag not in scope and not (tag in INLINE and up.block):
                        up = up.parent
                    if up is not None and up.tag == tag and up.parent is not None:
                        leave(up)
                continue
            if node.tag == "head" and tag not in IN_HEAD:
                leave(node)
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                if end is None:
                    break
                found = reader.tag(end.start() + 2)
                at = found[0] if found else n
            elif tag in VOID:
                if tag in ("br", "hr"):
                    node.parts.append("\n")
                node.tags += 1
                block = node
                while not block.block:
                    block = block.parent
                block.own[1] += 1
            elif tag == "html":
                pass
            elif tag == "body":
                if body is None:
                    leave_to_root = node
                    while leave_to_root is not root:
                        open_tags[leave_to_root.tag] -= 1
                        leave_to_root = leave_to_root.parent
                    node = root
                    enter(tag, attributes)
                    body = node
            else:
                shut = SAME_CLOSES.get(tag)
                if shut and (up := within(shut, TABLE_SCOPE if tag in TABLE_PARTS else LIST_SCOPE)):
                    leave(up)
                elif tag in CLOSES_P and (up := within({"p"}, CELL_SCOPE | {"button", "object"})):
                    leave(up)
                elif tag == "a" and (up := within({"a"}, CELL_SCOPE)):
                    leave(up)
                if node.depth < DEPTH:
                    enter(tag, attributes)
                    if tag in INLINE or tag in MATHML:
                        block = node
                        while not block.block:
                            block = block.parent
                        block.own[1] += 1
                        block.own[3] += tag == "a"
                elif tag not in INLINE and tag not in MATHML:
                    node.parts.append("\n")
        elif closing and first or follows[:1] in ("!", "?"):
            add(page[at:cut])
            end = page.find(">", cut)
            at = n if end < 0 else end + 1
        else:
            add(page[at : cut + 1])
            at = cut + 1
    return nodes


def leave_out(nodes: list[Node]) -> None:
    """Sets ``out``: what holds no text of an article by its element or name; ``holds``: an article, main or h1 element is within.

    What a name takes away stays if such an element is within it, or if it is
    most of the page's text, no reader comments, and such an element is nowhere.
    """
    for x in reversed(nodes):
        x.every += x.chars
        if x.parent and not x.hard:
            x.parent.every += x.every
    total = nodes[0].every
    for x in reversed(nodes):
        x.out = x.hard or bool(x.soft) and not x.holds
        x.header = x.header and 2 * x.every <= total
        if x.parent and not x.out:
            x.parent.holds |= x.holds or x.tag in ("article", "main", "h1")
    for x in nodes:
        if x.soft == 1 and not x.hard and not nodes[0].holds and 2 * x.every > total:
            x.out = False
        x.out |= x.parent is not None and x.parent.out


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    """Characters per tag, with the base of the logarithm growing with the share of link characters."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    plain = max(chars - link_chars, 1)
    base = math.log(chars * link_chars / plain + body_links * chars + math.e)
    ratio = (chars / links) * (tags / link_tags)
    return chars / tags * math.log(ratio) / math.log(base + 1.0) if ratio > 1 else 0.0


def select(nodes: list[Node]) -> tuple[Node, float]:
    """The block with the largest sum of its children's densities, and the least density on its path to the body."""
    root, inside = nodes[0], [x for x in nodes if not x.out]
    for x in reversed(inside):
        if x.parent:
            up = x.parent
            up.chars, up.tags, up.link_chars, up.link_tags = up.chars + x.chars, up.tags + x.tags + 1, up.link_chars + x.link_chars, up.link_tags + x.link_tags + (x.tag == "a")
    share = root.link_chars / max(root.chars, 1)
    sums = {}
    for x in inside:
        x.density = composite_density(x.chars, x.tags, x.link_chars, x.link_tags, share)
        if x.block:
            sums[x] = composite_density(*x.own, share)
    for x in inside:
        if x.block and x.parent:
            up = x.parent
            while not up.block:
                up = up.parent
            sums[up] += x.density
    best = root
    for x in sums:
        if sums[x] > sums[best] * (1 + 1e-9) or (best is root and x.tag == "body"):
            best = x
    enclosing = {}
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            enclosing.setdefault(up.tag, up)
        up = up.parent
    article = enclosing.get("article") or enclosing.get("main")
    if article is None and not best.holds:
        for tag in ("article", "main"):
            one = [x for x in inside if x.tag == tag]
            if len(one) == 1 and any(p.tag == "h1" for p in inside if _is_in(p, one[0])):
                article = one[0]
                break
    best = article or best
    threshold, up = best.density, best
    while up is not None and up.tag != "html":
        threshold, up = min(threshold, up.density), up.parent
    return best, threshold


def _is_in(x: Node | None, y: Node) -> bool:
    while x is not None and x is not y:
        x = x.parent
    return x is y


def _is_link_list(x: Node, threshold: float) -> bool:
    return x.density < threshold and x.link_tags >= LINKS and x.link_chars >= LINK_SHARE * x.chars and x.tag in ("ul", "ol", "div", "section", "dl")


def _titles(best: Node) -> list[Node]:
    """The h1 elements that come before ``best`` beside it or beside a block around it, if it has none itself."""
    found, x = [], best
    stack = [best]
    while stack:
        y = stack.pop()
        if y.tag == "h1" and not y.out:
            return []
        stack += [p for p in y.parts if isinstance(p, Node)]
    while x.parent is not None:
        before = x.parent.parts[: x.parent.parts.index(x)]
        near = [y for y in before if isinstance(y, Node) and not y.out]
        if x.parent.tag not in ("html", "body"):
            near = [z for y in near for z in ([p for p in y.parts if isinstance(p, Node) and not p.out] if y.header else [y])]
        found = [y for y in near if y.tag == "h1"] + found
        x = x.parent
    return found


def main_text(page: str) -> str:
    """The article's blocks in page order, white space as one space; empty if there is none."""
    nodes = parse(page)
    leave_out(nodes)
    best, threshold = select(nodes)
    taken: list[str | Node] = [best]
    if best.parent and best.kind and best.tag not in ("article", "main", "body"):
        taken = [x for x in best.parent.parts if isinstance(x, Node) and (x is best or (not x.out and (x.tag, x.kind) == (best.tag, best.kind) and x.density >= threshold))]
    taken = _titles(best) + taken
    out: list[str] = []
    in_article = best.tag == "article"
    stack: list[tuple[str | Node, bool]] = [(x, False) for x in reversed(taken)]
    while stack:
        x, only_headings = stack.pop()
        if isinstance(x, str):
            if not only_headings or x == "\n":
                out.append(x)
            continue
        if x.out or (not in_article and x is not best and _is_link_list(x, threshold)):
            continue
        only_headings = (only_headings or (x.header and x is not best)) and x.tag not in HEADINGS
        if x.block:
            out.append("\n")
            stack.append(("\n", False))
        stack += [(p, only_headings) for p in reversed(x.parts)]
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null html counts as empty and gives empty text; null ids and urls are kept;
    repeated rows are each done for itself; of blocks with equal sums the first
    is taken. Pages of any length are parsed whole, in time that grows with
    their length. Other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
