"""Main text of web pages by composite text density.

A page is read into a DOM (scripts, styles, forms and other parts that are never prose are left out while
reading; open paragraphs and inline markup close as browsers close them, and nesting may go as deep as it likes).
For every node the composite text density is its characters for each tag, times the logarithm of characters and tags
over those of links, to a base that grows with the links of the node and of the whole page (e at least, or a few
characters on a page of few links would count for most):

    density(n) = chars / tags * log[ln(chars / unlinked * links + page_links / page_chars * chars + e)](chars / links * tags / link_tags)

The density sum of a node is the sum of its children's densities. The threshold is the smallest density on the path
from the body to the node of the largest density sum. From the body down, as far as nodes reach that threshold, each keeps
the subtree of the largest sum below it, and the text is what is kept, in page order. A block beside the article that nothing
speaks against need only reach the smallest density that the path has with its menus and the like counted in (``low``), or a lead
of one paragraph would go. Inside what is kept, lists of links below ``low`` are left out. What an article is called decides nothing here: pages
with and without ``article`` go the same way.

Elements that are never the article (``nav``, ``footer``, what is hidden, the roles that stand for such elements) take no part.
A class or id is a weight and no more: where a whole token is made of words in MARKS (``ad-banner``, but not ``has-sidebar`` or
``related-work``), the densities of the element and of all below it are multiplied by ``WEIGHT`` (``P_WEIGHT`` for a paragraph; headings are not
marked), and it stays if that still reaches the threshold itself. No mark holds for an element around the article or main with the most prose, nor, if it is the
element's name (or there is no article or main), for one that holds most of the page's prose, but what is hidden or only leads elsewhere (NEVER).
The header of an article that holds a heading stays. Where no text is left at all, such marks are dropped.

Defined results: a null or empty page gives an empty text, as does a page without prose; nothing is cut.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns

# Element names: fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title noscript iframe svg math object xmp noembed noframes".split())
BOILER = frozenset("nav header footer aside form menu dialog button select fieldset".split())
#: Those that are not kept for the prose they hold.
NEVER = frozenset("nav menu button select footer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body"}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_AT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Roles that stand for elements of BOILER: fixed values of ARIA.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar".split())
#: Words of class and id that weigh against an element.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead cookie cookies consent notice notices newsletter subscribe share sharing social related recommended comment comments disqus reply replies respond popup modal login signup search copyright contentinfo complementary alert".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(?:>|$)""", re.DOTALL)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
#: What densities are multiplied by where a class or id speaks against an element; a paragraph is prose by its name, so there it says less.
WEIGHT, P_WEIGHT = 0.2, 0.5
#: Blocks that can be lists of links.
LISTS = frozenset("ul ol dl div section table tbody center".split())


class Node:
    __slots__ = ("name", "boiler", "children", "counts", "whole", "weight", "density", "full_density", "sum", "top")

    def __init__(self, name: str, boiler: str = ""):
        self.name, self.boiler, self.children = name, boiler, []

    @property
    def out(self) -> bool:
        """Takes no part; a mark by class or id only weighs."""
        return self.boiler in ("name", "hidden")


def marked(name: str, attrs: str) -> str:
    """By what an element is boilerplate: hidden, name or mark; empty if it is none."""
    found = "name" if name in BOILER else ""
    for key, *values in _ATTR.findall(attrs) if attrs else ():
        value = next((v for v in values if v), "").lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden"
        if not found and key == "role" and value.strip() in ROLES:
            found = "name"
        if not found and key in ("class", "id") and name not in ("body", "html", "article", "main") and name not in HEADINGS:
            words = (re.findall(r"[^\W\d_]+", token) for token in value.split())
            if any(w and MARKS.issuperset(w) for w in words):
                found = "mark"
    return found


def parse(page: str) -> Node:
    """A DOM of elements (Node) and decoded texts (str)."""
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each name is open, so that no search walks it
    at, size = 0, len(page)
    endless: set[str] = set()  # raw elements that do not end from here on

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    def push(node: Node) -> None:
        places[node.name].append(len(stack))
        if node.name in BLOCK:
            places["#block"].append(len(stack))
        stack.append(node)

    def pop() -> None:
        node = stack.pop()
        places[node.name].pop()
        if node.name in BLOCK:
            places["#block"].pop()

    def close(names: Iterable[str], stop: Iterable[str]) -> None:
        """Close the innermost open element of these names, unless one of ``stop`` is open inside it."""
        found = max((places[n][-1] for n in names if places[n]), default=0)
        if found and found >= max((places[n][-1] for n in stop if places[n]), default=0):
            while len(stack) > found:
                pop()

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m["end"]:
            # an end tag of a block closes what is open inside it; one of anything else does not leave its block
            close((name,), () if name in BLOCK and name != "p" else ("#block",))
            if name == "br":
                stack[-1].children.append(Node("br"))
            continue
        if name in RAW:
            if not m["attrs"].endswith("/") or name not in ("svg", "math"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                if end is None:
                    endless.add(name)
                if name == "iframe" or end or name in ("script", "style", "textarea", "title", "xmp"):
                    at = end.end() if end else size
            continue
        if name in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "body"})
            while stack[-1].name in INLINE and stack[-1].name != "a":  # unclosed inline markup ends with its block; links may hold blocks
                pop()
        if name == "body":
            close(("head",), ())
        if name == "a":
            close(("a",), ("#block",))
        if name in LIKE:
            close(LIKE[name], ENDS_AT[name])
        node = Node(name, marked(name, m["attrs"]))
        stack[-1].children.append(node)
        if name not in VOID and not m["attrs"].endswith("/"):
            push(node)
    return root


def spare(root: Node) -> None:
    """Unmark what holds the article or most of the prose, and headers of articles that hold a heading."""
    order, todo = [], [(root, None, False)]
    parent, inside, holder = {}, {}, {}
    while todo:
        node, above, linked = todo.pop()
        order.append((node, linked))
        parent[node] = above
        holder[node] = None if above is None else above if above.name in ("header", "article", "main") else holder[above]
        inside[node] = above is not None and (above.name in ("article", "main") or inside[above])
        todo += [(c, node, linked or node.name == "a") for c in node.children if isinstance(c, Node)]
    if not any(node.boiler for node, _ in order):
        return
    prose = dict.fromkeys(parent, 0)
    for node, linked in reversed(order):
        if not linked and node.name != "a":
            prose[node] += sum(len(_SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        if parent[node] is not None and node.boiler != "hidden":
            prose[parent[node]] += prose[node]
    articles = [node for node, _ in order if node.name in ("article", "main") and prose[node]]
    article = max(articles, key=prose.get) if articles else None
    for node, _ in order:
        if node.boiler in ("name", "mark") and node.name not in NEVER and 2 * prose[node] > prose[root] and (article is None or node.boiler == "name"):
            node.boiler = ""
        if node.name in HEADINGS and inside[node]:
            above = holder[node]
            if above is not None and above.name == "header" and above.boiler == "name":
                above.boiler = ""
    while article is not None:
        article.boiler = ""
        article = parent[article]


def density(chars: int, links: int, tags: int, link_tags: int, page_share: float) -> float:
    """Composite text density; page_share: linked characters of the page over all."""
    if not chars:
        return 0.0
    base = max(math.log(chars / max(chars - links, 1) * links + page_share * chars + math.e), math.e)
    return chars / max(tags, 1) * math.log(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)) / math.log(base)


def measure(root: Node) -> None:
    """Characters, linked characters, tags and link tags below each node without what takes no part (``whole``: with it), densities and their sums."""
    order, todo = [], [root]
    root.weight = 1.0
    while todo:
        node = todo.pop()
        order.append(node)
        for c in node.children:
            if isinstance(c, Node):
                c.weight = min(node.weight, 1.0 if c.boiler != "mark" else P_WEIGHT if c.name == "p" else WEIGHT)
                todo.append(c)
    for node in reversed(order):
        own, whole = [0, 0, 0, 0], [0, 0, 0, 0]
        for c in node.children:
            if isinstance(c, str):
                n = len(_SPACE.sub("", c))
                own[0] += n
                whole[0] += n
                continue
            for i, (a, b) in enumerate(zip(c.counts, c.whole)):
                own[i] += 0 if c.out else a
                whole[i] += b
            for x in (whole,) if c.out else (own, whole):
                x[2] += 1
                x[3] += c.name == "a"
        if node.name == "a":
            own[1], whole[1] = own[0], whole[0]
        node.counts, node.whole = own, whole
    share = root.counts[1] / max(root.counts[0], 1)
    for node in reversed(order):
        node.density, node.full_density = (node.weight * density(*x, share) for x in (node.counts, node.whole))
        kept = [c for c in node.children if isinstance(c, Node) and not c.out]
        node.sum = sum(c.density for c in kept)
        node.top = node if node.counts[0] and node.name not in INLINE else None
        for c in kept:
            if c.top is not None and (node.top is None or c.top.sum > node.top.sum):
                node.top = c.top


def main_subtrees(root: Node) -> tuple[list[Node], float, float]:
    """What is kept, in page order and apart from each other, and the thresholds: of all, and of what nothing speaks against."""
    best = root.top
    if best is None:
        return [], 0.0, 0.0
    parent, order, todo = {root: None}, [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        below = [c for c in node.children if isinstance(c, Node) and not c.out]
        parent.update((c, node) for c in below)
        todo += reversed(below)

    def around(node: Node, names: tuple, last: Node | None = None) -> Node | None:
        while node is not None and node.name not in names and node is not last:
            node = parent[node]
        return node

    threshold, low, node = best.density, best.density, best
    while node is not None and node.name not in ("#root", "html"):
        threshold = min(threshold, node.density)
        low = min(low, node.density, node.full_density)
        node = parent[node]
    kept, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node.name not in ("#root", "html"):
            if node.top is None or node.density < (low if node.weight == 1 else threshold):
                continue
            # a paragraph with inline markup has a sum of its own: the text is what its section holds
            own = around(node.top, ("article", "main", "section", "div", "body", "td"), None if node.top is best else node)
            kept.add(root if own is None else own)
        todo += [c for c in node.children if isinstance(c, Node) and not c.out and c.name not in INLINE]
    if not kept:
        kept.add(root)
    out, covered = [], set()
    for node in order:
        if parent[node] in covered:
            covered.add(node)
        elif node in kept:
            covered.add(node)
            out.append(node)
    return out, threshold, low


def blocks(node: Node, threshold: float = 0.0, low: float = 0.0) -> list[str]:
    """Texts of the blocks in page order, white space made single, without marked blocks and lists of links below their threshold."""
    out, line = [], []

    def flush() -> None:
        t = _SPACE.sub(" ", "".join(line)).strip()
        if t:
            out.append(t)
        line.clear()

    def sparse(x: Node) -> bool:
        if x.boiler == "mark" and x.density < threshold:
            return True
        chars, links, _, link_tags = x.counts
        return x.name in LISTS and link_tags > 1 and 2 * links > chars and x.density < low

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        elif x is not node and (x.out or sparse(x)):
            flush()
        elif x.name == "br":
            line.append(" ")
        elif x.name in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    spare(root)
    text = text_of(root)
    if not text and unmark(root):
        text = text_of(root)
    return text


def unmark(root: Node) -> bool:
    """Where nothing else is left: marks are dropped but for what is hidden or in NEVER. Whether there were any."""
    todo, any_ = [root], False
    while todo:
        node = todo.pop()
        if node.boiler in ("name", "mark") and node.name not in NEVER:
            node.boiler, any_ = "", True
        todo += [c for c in node.children if isinstance(c, Node) and (not c.boiler or c.boiler != "hidden" and c.name not in NEVER)]
    return any_


def text_of(root: Node) -> str:
    measure(root)
    kept, threshold, low = main_subtrees(root)
    return "\n".join(line for node in kept for line in blocks(node, threshold, low))


def extract(df: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the main text of each page. A column named like ``out`` is replaced."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([main_text(p) for p in batch.column(batch.schema.get_field_index(html)).to_pylist()], pa.string())]

        return work

    return append_columns(df, [T.StructField(out, T.StringType())], make, keep)


def with_length(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("n_chars", F.char_length(text).cast("long"))
