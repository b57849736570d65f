"""HTML extraction by tree scoring.

A page becomes a tree of blocks. Each paragraph gives points for its length and commas to
its parent and, halved, to its grandparent; a container's points are discounted by the
share of its text that stands in links. From the best container the text grows upwards to
its article element, or to the page where there is none, by what stands beside it and is
prose, at every level. What never belongs to an article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) is left out by element, role
or class before scoring.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.llm.words import arrow_map

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"))
SKIP = frozenset(
    "script style noscript template iframe nav header footer aside form button select textarea title head menu dialog "
    "svg canvas object embed audio video map label input xmp".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
PARAGRAPH = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
CONTAINER = frozenset("article main section div body td blockquote ul ol table tbody tr dl html figure".split())
# A start tag of the left ends an open element of the right, unless a border stands between.
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)
P_BORDERS = ("article", "div", "section", "td", "li", "blockquote")
ALIKE = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
ENDED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "option": ("option",)}
BORDERS = {"p": P_BORDERS, "li": ("ul", "ol", "menu"), "dt": ("dl",), "tr": ("table", "tbody"), "td": ("tr", "table"),
           "option": ()}
# Element name -> the kinds above for which it is ended or a border, with which of both.
MARKS: dict[str, list[tuple[str, bool]]] = {}
for _kind in ENDED:
    for _names, _ended in ((ENDED[_kind], True), (BORDERS[_kind], False)):
        for _name in _names:
            MARKS.setdefault(_name, []).append((_kind, _ended))
BOILERPLATE = re.compile(
    r"(?:(?<=[\s_-])|^)(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|"
    r"nav|navbar|navigation|newsletter|notices?|popup|promo|related|replies|respond|share|sharing|sidebar|social|"
    r"sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])",
    re.I,
)
# Of these, words that stand on whole articles now and then ("related-work", "post-share").
MILD = re.compile(r"header|notices?|promo|related|share|sharing|social|widget", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# As in HTML, "<" begins a tag only before a letter or "/", and quotes hold only attribute values.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|</?[A-Za-z](?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
NAME = re.compile(r"</?\s*([A-Za-z][\w:-]*)")
ATTRIBUTE = re.compile(r"(?<=[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
WHITE = re.compile(r"\s+")
NEAR = 0.2  # share of the best score from which a sibling is kept
LINKED = 0.5  # a sibling with more of its text in links is not
PROSE = 80  # characters of paragraphs outside of links that make any sibling prose
ARTICLE = 400  # characters from which the text of a form or of a mild class is an article
FLOW = frozenset("blockquote ul ol table dl figure".split())  # stand between paragraphs of one text


@dataclass
class Node:
    name: str
    parent: Node | None
    skip: bool = False
    children: list = field(default_factory=list)  # nodes and pieces of text, in order
    points: float = 0.0
    chars: int = 0  # of text, also below
    linked: int = 0  # of these, in links
    commas: int = 0  # here and in inline children
    prose: int = 0  # characters outside of links in paragraphs, also below


def _skipped(name: str, tag: str, lenient: bool = False) -> bool:
    """Whether an element never belongs to an article. ``lenient`` takes forms, and classes
    that articles are found to bear, for what they hold."""
    if name in SKIP:
        return not (lenient and name == "form")
    if " " not in tag and "\n" not in tag and "\t" not in tag:
        return False
    for key, value in ATTRIBUTE.findall(tag):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            if any(not (lenient and MILD.fullmatch(x[0])) for x in BOILERPLATE.finditer(value)):
                return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def parse(page: str, lenient: bool = False) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers would, roughly.

    Every tag costs a constant time on average: open elements are counted by name, and of
    those that one tag may end, and their borders, the innermost is kept on a stack by kind.
    ``lenient`` is as for ``_skipped``.
    """
    root = Node("html", None)
    now, at = root, 0
    opened: dict[str, int] = {}
    marks: dict[str, list[tuple[Node, bool]]] = {kind: [] for kind in ENDED}

    def leave(inner: Node, outer: Node) -> Node:
        """Closes the elements from ``inner`` up to ``outer``; the one now open."""
        while True:
            opened[inner.name] -= 1
            for kind, _ in MARKS.get(inner.name, ()):
                marks[kind].pop()
            if inner is outer:
                return inner.parent
            inner = inner.parent

    while found := TOKEN.search(page, at):
        tag = found.group()
        if found.start() > at:
            now.children.append(page[at : found.start()])
        at = found.end()
        match = NAME.match(tag)
        if tag.startswith(("<!", "<?")) or not match:
            continue
        name = match.group(1).lower()
        if tag.startswith("</"):
            if opened.get(name):
                node = now
                while node.name != name:
                    node = node.parent
                now = leave(now, node)
            continue
        if name in ("html", "body"):
            continue
        for kind in (["p"] if name in CLOSES_P else []) + ([ALIKE[name]] if name in ALIKE else []):
            while marks[kind] and marks[kind][-1][1]:
                now = leave(now, marks[kind][-1][0])
        node = Node(name, now, _skipped(name, tag, lenient))
        now.children.append(node)
        if name in RAW:  # only its own end tag counts
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif name not in VOID and not tag.endswith("/>"):
            now = node
            opened[name] = opened.get(name, 0) + 1
            for kind, ended in MARKS.get(name, ()):
                marks[kind].append((node, ended))
    if at < len(page):
        now.children.append(page[at:])
    return root


def _score(root: Node) -> list[Node]:
    """Points, lengths and link lengths of all nodes; the containers with points."""
    order, stack = [], [(root, False)]
    while stack:  # no recursion: pages may be nested deeply
        node, in_link = stack.pop()
        order.append((node, in_link or node.name == "a"))
        stack += [(c, in_link or node.name == "a") for c in node.children if isinstance(c, Node) and not c.skip]
    scored = []
    for node, in_link in reversed(order):
        text = [c for c in node.children if isinstance(c, str)]
        own = sum(len(t.strip()) for t in text)
        node.chars += own
        node.linked += own if in_link else 0
        commas = sum(t.count(",") for t in text)
        node.commas = commas + sum(c.commas for c in node.children if isinstance(c, Node) and c.name in INLINE)
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
        plain = node.chars - node.linked
        if (node.name in PARAGRAPH or node.name not in INLINE and own >= 25) and node.linked < 0.25 * node.chars:
            node.prose = max(node.prose, plain)
        if node.parent is not None:
            node.parent.prose += node.prose
        if node.name in PARAGRAPH and plain >= 10 or node.name not in INLINE and own >= 25:
            points = 1 + node.commas + min(node.chars / 100, 3) + node.chars / 1000
            points *= 1 - node.linked / max(node.chars, 1)
            holder = node if node.name not in PARAGRAPH else node.parent
            for share in (1, 0.5):
                if holder is None:
                    break
                holder.points += points * share
                holder = holder.parent
    for node, _ in order:
        if node.points and (node.name in CONTAINER or node.parent is None):
            node.points *= 1 - node.linked / max(node.chars, 1)
            scored.append(node)
    return scored


def _blocks(nodes: list) -> list[str]:
    """Texts of the blocks below some nodes, pieces of text and lists of both, in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def end():
        text = WHITE.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    stack: list = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif isinstance(item, list):
            stack += reversed(item)
        elif item.name == "br":
            line.append(" ")
        elif not item.skip:
            block = item.name not in INLINE
            if block:
                end()
                stack.append(None)
            stack += reversed(item.children)
    end()
    return blocks


def main_text(page: str | None) -> str:
    """The article's blocks, one line each; empty where a page has none.

    Prose goes before class: where all else is empty, a text of ARTICLE characters or more
    inside a form, or below a class that only mostly names what is left out, is the article.
    """
    if not page:
        return ""
    text = _text_of(parse(page))
    if text:
        return text
    text = _text_of(parse(page, lenient=True))
    return text if len(text) >= ARTICLE else ""


def _text_of(root: Node) -> str:
    scored = _score(root)
    if not scored:
        return "\n".join(_blocks([root])) if root.chars > root.linked else ""
    best = max(scored, key=lambda n: (n.points, n.name in ("article", "main")))
    if best.parent is None:
        return "\n".join(_blocks([best]))
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    tops = [n for n in above if n.name == "article"] or [n for n in above if n.name == "main"] or above
    top, kept = tops[-1], [best]
    for node in above[:-1]:
        kept = _beside(node, kept, NEAR * best.points, top)
        if node is top:
            break
    return "\n".join(_blocks(kept))


def _beside(node: Node, kept: list, limit: float, top: Node) -> list:
    """``kept``, which stands for ``node``, between the siblings of the node that belong to it:
    all inside an article but links; elsewhere titles, prose, and what lies between prose."""
    siblings = node.parent.children
    inside = node is not top and top.parent is not None

    def sure(x):
        if x is node:
            return True
        if isinstance(x, str) or x.skip or not x.chars:
            return False
        links = x.linked / x.chars
        near = x.points >= limit and links < LINKED
        paragraph = x.name in PARAGRAPH and x.chars >= PROSE and links < 0.25
        return near or paragraph or node is not top and x.prose >= PROSE and links < LINKED

    def may(x):
        if isinstance(x, str):
            return bool(x.strip())
        return not x.skip and x.linked < LINKED * x.chars

    order = [k for k, x in enumerate(siblings) if sure(x)]
    first, last, known = order[0], order[-1], set(order)
    out = []
    for k, x in enumerate(siblings):
        if x is node:
            out += [None, kept, None]
        elif k in known:
            out.append(x)
        elif may(x):
            text = isinstance(x, str) or x.name in INLINE
            title = not text and x.name in ("h1", "h2", "h3")
            short = not text and (x.prose > 0 or x.name in PARAGRAPH)
            flow = node.name in FLOW and short and x.name in PARAGRAPH
            if inside or title or flow or first < k < last and (text or short):
                out.append(x)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html).

    A null or empty page, and one without text outside of links and left-out elements, has
    an empty text. Character references are decoded once, white space inside a block
    becomes one space, blocks are joined by a line break; nothing is cut. Repeated rows are
    extracted each; other columns are ignored.
    """
    rows = pages.select("page_id", "url", "html")

    def make(batch):
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = [main_text(p) for p in part.column(2).to_pylist()]
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return arrow_map(rows, f"page_id {kind}, url string, text string, n_chars long", make)
