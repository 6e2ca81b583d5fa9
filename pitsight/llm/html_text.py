"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose content is text only, and block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag of the key ends, up to the elements of the second part.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Elements whose content is never text of the page, whatever it holds.
NEVER = RAW | frozenset("button select svg canvas object audio video map".split())
#: Elements, and class, id or role words, that mark what stands around a main text. Marked text counts as linked: it adds
#: nothing to densities, and where it makes up most of an element, densities leave that out.
MARKED = frozenset("nav header footer aside form menu dialog search".split())
MARKED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "subscription share sharing social related recommended comment comments commentlist disqus respond reply replies widget pagination "
    "pager toolbar login signup search skip contentinfo complementary dialog alert".split()
)
#: Words that mark only where they are the whole class, id or role.
MARKED_WHOLE = frozenset("header top-bar topbar bottom form aside".split())
#: Words beside a marking one that leave its sense as it is.
NEUTRAL = frozenset(
    "box list item bar area block section container wrapper wrap inner outer left right top bottom main site page link links button buttons "
    "icon icons unit slot module panel col column row thread title text sticky group zone global primary secondary".split()
)
#: Marking words that wrappers of the whole layout bear too.
LAYOUT_WORDS = frozenset("ad ads banner nav navbar navigation menu sidebar footer masthead header cookie cookies share sharing social login search toolbar form widget".split())
#: Beginnings of class names that say what a wrapper has or lacks.
ABOUT = ("has-", "with-", "no-", "without-", "tag-", "category-")
#: What an article or main element is called when it is no article.
NOT_ARTICLE = frozenset("comment comments reply replies respond related recommended promo sponsored advert advertisement ad".split())
#: Elements whose text counts as paragraphs where a wrapper is told from what stands around.
PARAGRAPHS = frozenset("p blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a running text consists of. In the containers that the densest part lies in, they, and loose text,
#: need SIBLING of the threshold.
PROSE = HEADINGS | PARAGRAPHS | frozenset("ul ol dl figure table".split())
SIBLING = 1 / 32
#: Unlinked letters of a paragraph of which three make an article where marks would leave nothing.
ARTICLE_LETTERS = 40
#: Elements within each other that the tree holds; what lies deeper belongs to the innermost one.
DEPTH = 512

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[a-z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACES = re.compile(r"\s+")
#: What is said of an element: nothing, that its name may be a wrapper's, that it stands around, that it is no text.
PLAIN, WEAK, STRONG, NO_TEXT = range(4)


class Node:
    __slots__ = ("tag", "parent", "parts", "mark", "chars", "tags", "link_chars", "link_tags", "density", "total", "place")

    def __init__(self, tag: str, parent: Node | None, mark: int = PLAIN) -> None:
        self.tag, self.parent, self.mark, self.parts = tag, parent, mark, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.place = 0
        self.density = self.total = 0.0

    def nodes(self) -> list[Node]:
        return [part for part in self.parts if isinstance(part, Node) and part.mark != NO_TEXT]


def mark_of(tag: str, attributes: str) -> int:
    """What an element's name, class, id and role say of it. A name with other words beside the marking one, or one that
    layouts use, is WEAK."""
    if tag in NEVER:
        return NO_TEXT
    mark = (WEAK if tag == "form" else STRONG) if tag in MARKED else PLAIN
    if not attributes.strip():
        return mark
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return NO_TEXT
        if name in ("class", "id", "role") and tag not in ("html", "body"):
            for whole in value.split():
                parts = set(PARTS.findall(whole))
                marking = parts & MARKED_WORDS
                if tag in ("article", "main"):
                    mark = STRONG if parts & NOT_ARTICLE else mark
                elif whole.startswith(ABOUT):
                    continue
                elif whole in MARKED_WHOLE:
                    mark = max(mark, WEAK)
                elif marking:
                    known = all(part in MARKED_WORDS or part in NEUTRAL or part.isdigit() for part in parts)
                    mark = max(mark, STRONG if known and not marking <= LAYOUT_WORDS else WEAK)
    return mark


class Builder:
    """The tree of a page, built tag by tag."""

    def __init__(self) -> None:
        self.root = self.here = Node("#root", None)
        self.depth, self.open, self.deeper = 0, Counter(), Counter()

    def text(self, raw: str) -> None:
        self.here.parts.append(html.unescape(raw))

    def climb(self, to: Node) -> None:
        while self.here is not to:
            self.open[self.here.tag] -= 1
            self.here, self.depth = self.here.parent, self.depth - 1

    def start(self, tag: str, attributes: str, closed: bool) -> Node:
        self.climb(self._close_before(tag))
        node = Node(tag, self.here, mark_of(tag, attributes))
        self.here.parts.append(node)
        if tag in ("article", "main") and node.mark == PLAIN:
            up = self.here
            while up is not None:
                # What holds an article is a wrapper.
                up.mark = PLAIN if up.mark == WEAK else up.mark
                up = up.parent
        if not closed:
            if self.depth < DEPTH:
                self.here, self.depth = node, self.depth + 1
                self.open[tag] += 1
            else:
                self.deeper[tag] += 1
        return node

    def end(self, tag: str) -> None:
        if self.deeper[tag]:
            self.deeper[tag] -= 1
            self.here.parts.append(Node(tag, self.here))
        elif self.open[tag]:
            up = self.here
            while up.tag != tag:
                if tag not in BLOCKS and up.tag in BLOCKS:
                    return
                up = up.parent
            self.climb(up.parent)
        elif tag == "p":
            self.here.parts.append(Node("p", self.here))

    def _close_before(self, tag: str) -> Node:
        """The node that a start tag goes into, after the elements that it ends."""
        here = self.here
        if tag in BLOCKS and self.open["p"]:
            up = here
            while up.parent is not None and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in ENDS:
            ended, stop = ENDS[tag]
            up, last = here, None
            while up.parent is not None and up.tag not in stop:
                if up.tag in ended:
                    last = up
                up = up.parent
            if last is not None:
                here = last.parent
        return here


def parse(page: str) -> Node:
    """The page's tree, in one pass. End tags without a start are passed over, unclosed elements end with their parents,
    raw text elements end at their own end tag, a tag without an end is the end of the page."""
    made, at, end, closings = Builder(), 0, len(page), {}
    while at < end:
        opening = page.find("<", at)
        if opening < 0:
            made.text(page[at:])
            break
        name = NAME.match(page, opening + 1)
        if name is None and page[opening + 1 : opening + 2] not in ("!", "?"):
            made.text(page[at : opening + 1])
            at = opening + 1
            continue
        if opening > at:
            made.text(page[at:opening])
        if name is None:
            cdata = page.startswith("<![CDATA[", opening)
            mark = "-->" if page.startswith("<!--", opening) else "]]>" if cdata else ">"
            closing = page.find(mark, opening + 4 if mark == "-->" else opening)
            if cdata:
                made.here.parts.append(page[opening + 9 : closing if closing >= 0 else end])
            at = closing + len(mark) if closing >= 0 else end
            continue
        # A quoted value may hold the sign that ends the tag; where quotes don't close, the next such sign ends it.
        rest = REST.match(page, name.end(), min(end, name.end() + (1 << 16)))
        closing = rest.end() - 1 if rest else page.find(">", name.end())
        if closing < 0:
            break
        attributes, at, tag = page[name.end() : closing], closing + 1, name[0].lower()
        if tag[0] == "/":
            made.end(tag[1:])
            continue
        node = made.start(tag, attributes, tag in VOID or tag in RAW)
        if tag in RAW:
            if tag not in closings or closings[tag] is not None:
                closings[tag] = re.compile(f"</{re.escape(tag)}(?![a-zA-Z0-9])[^>]*>", re.I).search(page, at)
            node.mark, at = NO_TEXT, closings[tag].end() if closings[tag] else end
    _unmark_wrappers(made.root)
    return made.root


def _letters(text: str) -> int:
    return len("".join(text.split()))


def _unmark_wrappers(root: Node) -> None:
    """Elements whose name is only a weak mark are wrappers of the page all the same if their own paragraphs hold over
    half of its unlinked text that isn't marked for certain."""
    order, stack = [], [(root, False, False)]
    while stack:
        node, linked, prose = stack.pop()
        order.append((node, linked, prose))
        stack.extend((n, linked or n.tag == "a", n.tag in PARAGRAPHS or prose and n.tag not in BLOCKS) for n in node.nodes() if n.mark != STRONG)
    if not any(node.mark == WEAK for node, *_ in order):
        return
    text, prose_text = {}, {}
    for node, linked, prose in reversed(order):
        own = 0 if linked else sum(_letters(p) for p in node.parts if isinstance(p, str))
        below = [id(n) for n in node.nodes() if id(n) in text]
        text[id(node)] = own + sum(text[n] for n in below)
        prose_text[id(node)] = (own if prose else 0) + sum(prose_text[n] for n in below)
    for node, *_ in order:
        if node.mark == WEAK and 2 * prose_text[id(node)] > text[id(root)]:
            node.mark = PLAIN


def in_order(root: Node) -> list[Node]:
    """The nodes of a tree that can have text, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.place = len(out)
        out.append(node)
        stack.extend(reversed(node.nodes()))
    return out


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters for each tag, times a logarithm of how few of both are links, to a base that grows with the links."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(chars * link_chars / max(chars - link_chars, 1) + body_ratio * chars + math.e)
    return chars / tags * math.log(max(chars / max(link_chars, 1) * tags / max(link_tags, 1), 1.0)) / max(math.log(max(base, math.e)), 1.0)


def measure(nodes: list[Node]) -> None:
    """Characters, tags, link characters and link tags of every subtree, its composite text density, and for every node
    with blocks in it the sum of its children's densities; loose text between them counts as a child."""
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += _letters(part)
            elif part.mark != NO_TEXT:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a" or node.mark:
            node.link_chars = node.chars
        if node.mark:
            node.link_tags = max(node.tags, 1)
    body = _body(nodes)
    ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
    for node in nodes:
        if any(part.tag in BLOCKS for part in node.nodes()) and not node.mark:
            node.total = sum(part.density for part in node.nodes() if part.tag in BLOCKS)
            node.total += sum(composite_density(run.chars, run.tags, run.link_chars, run.link_tags, ratio) for run in loose_runs(node))


def _unmark_article(root: Node) -> bool:
    """For pages where marks leave nothing: the marks of elements around an article are dropped. An article or main
    element with paragraphs, a first-level heading with one, or three paragraphs of ARTICLE_LETTERS unlinked letters make
    one; a lone notice or menu doesn't. Of several candidates those with the most paragraph text are meant."""
    held: dict[int, tuple[int, int, bool, bool]] = {}
    nodes = in_order(root)
    for node in reversed(nodes):
        letters, long, named, title = 0, 0, node.tag in ("article", "main"), node.tag == "h1"
        if node.tag in PARAGRAPHS:
            letters = _unlinked(node)
            long = int(letters >= ARTICLE_LETTERS)
        else:
            for part in node.nodes():
                a, b, c, d = held[id(part)]
                letters, long, named, title = letters + a, long + b, named or c and part.mark == PLAIN, title or d
        held[id(node)] = letters, long, named, title
    marked = [n for n in nodes if n.mark in (WEAK, STRONG) and held[id(n)][0] and (held[id(n)][2] or held[id(n)][3] or held[id(n)][1] >= 3)]
    if not marked:
        return False
    most = max(held[id(n)][0] for n in marked)
    for node in marked:
        if 2 * held[id(node)][0] > most:
            node.mark = PLAIN
    return True


def _unlinked(node: Node) -> int:
    return 0 if node.tag == "a" else sum(_letters(p) if isinstance(p, str) else _unlinked(p) if p.mark != NO_TEXT else 0 for p in node.parts)


def _body(nodes: list[Node]) -> Node:
    return next((n for n in nodes if n.tag == "body"), nodes[0])


def loose_runs(node: Node) -> list[Node]:
    """The runs of text and inline elements directly in a node that holds blocks, each as a node of its own, whose place
    is behind what stands before it."""
    runs, run, last = [], None, node.place
    for part in node.parts:
        if isinstance(part, Node) and part.mark != NO_TEXT and part.tag in BLOCKS:
            run, last = None, part.place + part.tags
        elif isinstance(part, str) and not part.strip():
            if run is not None:
                run.parts.append(part)
        elif isinstance(part, str) or part.mark != NO_TEXT:
            if run is None:
                run = Node("#loose", node)
                run.place = last + 0.5
                runs.append(run)
            run.parts.append(part)
            if isinstance(part, str):
                run.chars += _letters(part)
            else:
                run.chars, run.tags, last = run.chars + part.chars, run.tags + part.tags + 1, part.place + part.tags
                run.link_chars, run.link_tags = run.link_chars + part.link_chars, run.link_tags + part.link_tags + (part.tag == "a")
    return [r for r in runs if r.chars]


def running(node: Node) -> bool:
    """Whether words stand between or behind the links of a paragraph: then it is a sentence that links are part of."""
    linked, stack = False, list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            if linked and any(c.isalnum() for c in part):
                return True
        elif part.tag == "a":
            linked = True
        elif part.mark == PLAIN:
            stack.extend(reversed(part.parts))
    return False


def around(node: Node) -> bool:
    """Whether a block in the main text is none of it: its characters are mostly links or marked. Headings, blocks with
    one link only, and paragraphs whose sentences the links are part of, stay."""
    if node.mark == PLAIN and (node.tag in HEADINGS or node.link_tags < 2 and node.tag != "#loose" or node.tag == "p" and running(node)):
        return False
    return node.tag in BLOCKS | {"#loose"} and 2 * node.link_chars > node.chars or node.mark != PLAIN


def mostly_prose(node: Node) -> bool:
    """Whether a container consists of running text: over half of its characters are unlinked ones in headings,
    paragraphs, lists and tables."""
    prose, stack = 0, [node]
    while stack:
        here = stack.pop()
        for part in here.nodes():
            if part.mark != PLAIN:
                continue
            if part.tag in PROSE:
                prose += part.chars - part.link_chars
            else:
                stack.append(part)
    return 2 * prose > node.chars


def main_nodes(nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the main text, in page order.

    Of the nodes within no marked one, that with the largest sum of child densities is taken (of equal ones the outermost). The smallest density on the
    path from the body to it is the threshold: a block beside that path which reaches it is main text too. In the
    containers on the path below the body, headings, paragraphs, lists, loose text and containers that consist of these
    (the other sections of an article) need SIBLING of it. Pages without any block that sums up are taken whole.
    """
    body = _body(nodes)
    ratio = body.link_chars / max(body.chars, 1)
    marked: set[int] = set()
    for node in nodes:
        if node.mark != PLAIN or id(node.parent) in marked:
            marked.add(id(node))
    best = max(nodes, key=lambda n: 0.0 if id(n) in marked else n.total)
    if id(best) in marked:
        return []
    if best.total <= 0:
        return [nodes[0]] if nodes[0].chars > nodes[0].link_chars else []
    path, up = [best], best.parent
    while best is not body and up is not None and up is not body and up.tag not in ("html", "#root"):
        path.append(up)
        up = up.parent
    threshold, on_path, taken = min(n.density for n in path), {id(n) for n in path}, [best]
    for node in path:
        above = node.parent
        if above is None or node is body:
            continue
        inner = above is not body and above.tag not in ("html", "#root")
        for part in above.nodes():
            if part.tag in BLOCKS and id(part) not in on_path:
                lenient = inner and not around(part) and (part.tag in PROSE or mostly_prose(part))
                if part.density >= threshold * (SIBLING if lenient else 1):
                    taken.append(part)
        for run in loose_runs(above) if inner else []:
            if not around(run) and composite_density(run.chars, run.tags, run.link_chars, run.link_tags, ratio) >= threshold * SIBLING:
                taken.append(run)
    return sorted(taken, key=lambda n: n.place)


def blocks(node: Node) -> list[str]:
    """The text blocks of a subtree in page order: character references decoded, white space runs one space, trimmed."""
    out, run = [], []

    def close() -> None:
        text = SPACES.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        part = stack.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        elif part is node or part.mark != NO_TEXT and not around(part):
            if part.tag in BLOCKS:
                close()
                stack.append(None)
            stack.extend(reversed(part.parts))
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by two line ends; empty if there is none."""
    if not page:
        return ""
    text = _text_of(parse(page))
    if not text:
        root = parse(page)
        text = _text_of(root) if _unmark_article(root) else ""
    return text


def _text_of(root: Node) -> str:
    nodes = in_order(root)
    measure(nodes)
    return "\n\n".join(text for node in main_nodes(nodes) for text in blocks(node))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with a column text_col for html_col's main text, the other columns untouched (a column named text_col is
    replaced). Null or empty pages, and pages without text, give an empty text. Rows are independent: one narrow pass,
    no shuffle; equal rows give equal texts."""
    fields = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]
    source = pages.select(*(F.col(f"`{f.name}`") for f in fields), F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch.column(len(fields))], pa.string())
            columns = [batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*columns, texts], [*(f.name for f in fields), text_col])

    return source.mapInArrow(run, type(pages.schema)([*fields]).add(text_col, "string"))
