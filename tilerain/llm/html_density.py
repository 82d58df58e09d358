"""Main text of web pages by composite text density."""

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilerain.llm.common import mapped, text_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
MARK = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements by their role in the HTML standard (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
             "h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: What each start tag ends, up to the element that bounds the search.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
#: Elements that never hold main text.
SKIPPED = set("head script style noscript template nav header footer aside form button select input textarea iframe object embed svg canvas "
              "audio video map dialog menu xmp noembed noframes title".split())
#: Words that, as a whole name in class, id or role, mark menus, notices, adverts, side columns, comments and the like.
SIDE = re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|"
                  r"signup|login|nav\w*|menus?|breadcrumbs?|pagination|pager|header|masthead|footer|foot|sidebar|side|aside|rail|widgets?|"
                  r"related|recommend\w*|share|sharing|social|comments?|replies|respond|disqus|discussion|toolbar|tags?|search|complementary|contentinfo|navigation|alert|alertdialog|hidden", re.I)
#: Parts of a name that say nothing of what an element holds.
NEUTRAL = re.compile(r"\d*|site|page|main|top|bottom|left|right|primary|secondary|global|wrap|wrapper|container|inner|outer|box|block|area|section|"
                     r"list|item|items|links?|buttons?|bar|slot|unit|posts?|form", re.I)
#: What the density of text below an element so marked counts beside that of other text.
DISCOUNT = 0.1
OPEN_LINK, CLOSED_LINK, TAGS_AND_SPACES = re.compile(r"<a\b", re.I), re.compile(r"</a\s*>", re.I), re.compile(r"<[^>]*(?:>|\Z)|\s")
SPACES = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "parts", "parent", "side", "marked", "chars", "tags", "links", "link_tags", "density", "total")

    def __init__(self, tag, parent, side, marked=False):
        self.tag, self.parent, self.side, self.marked, self.parts = tag, parent, side, marked, []


def _names_side(names: str) -> bool:
    """Whether one of the names, taken whole, is that of a side part: all its words are side words or neutral ones, and not
    all are neutral. has-sidebar, no-sidebar and search-results are none."""
    for name in names.split():
        words = re.split("[_-]", name)
        side = [w for w in words if SIDE.fullmatch(w)]
        if side and all(SIDE.fullmatch(w) or NEUTRAL.fullmatch(w) for w in words):
            return True
    return False


def _tree(page: str) -> _Node:
    """A forgiving element tree; text stands in `parts` between child nodes."""
    root = _Node("#root", None, False)
    node, at = root, 0
    raw_end = None
    opened: Counter = Counter()  # open elements by name, so that no tag looks for one that is not open

    def text(piece: str) -> None:
        if piece:
            node.parts.append(html.unescape(piece) if "&" in piece else piece)

    def close(last: _Node) -> None:
        nonlocal node
        while node is not last.parent:
            opened[node.tag] -= 1
            node = node.parent

    def up_to(names: set, stop: set) -> None:
        if not any(opened[x] for x in names):
            return
        n = node
        while n.parent is not None and n.tag not in stop:
            if n.tag in names:
                close(n)
                return
            n = n.parent

    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if found.group(1):
            if name in ("body", "html") or not opened[name]:
                continue
            n = node
            while n.parent is not None and n.tag != name:
                if n.tag in ("td", "th") and name not in ("tr", "table", "tbody", "thead", "tfoot") and name in BLOCKS:
                    break
                n = n.parent
            if n.tag == name and n.parent is not None:
                close(n)
            continue
        if name in CLOSES_P:
            up_to({"p"}, {"table", "td", "th", "body", "article", "section", "div", "li", "blockquote", "main", "aside", "header", "footer", "nav", "form"})
        if name in ENDS:
            up_to(*ENDS[name])
        if name == "body":
            up_to({"head"}, set())
        attrs = found.group(3) or ""
        side, marked = name in SKIPPED, False
        if not side and attrs and name not in ("body", "html", "article", "main"):
            for key, value in MARK.findall(attrs):
                key = key.lower()
                value = value.strip("\"'")
                if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                    side = True
                    break
                marked = marked or key in ("class", "id", "role") and _names_side(value)
        if name in VOID or attrs.rstrip().endswith("/") and name in ("svg", "path"):
            if name in ("br", "hr"):
                node.parts.append("\n" if name == "br" else _Node("hr", node, False))
            continue
        child = _Node(name, node, side, marked)
        node.parts.append(child)
        if name in RAW:
            raw_end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = raw_end.end() if raw_end else len(page)
            continue
        node = child
        opened[name] += 1
    return root


def _measure(root: _Node) -> list[_Node]:
    """Characters, tags, link characters and link tags below each node, children first. Side nodes count nothing."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(p for p in n.parts if isinstance(p, _Node) and not p.side)
    order.reverse()
    for n in order:
        n.chars = n.tags = n.links = n.link_tags = 0
        for p in n.parts:
            if isinstance(p, str):
                n.chars += len(p) - sum(map(p.count, " \n\t\r"))
            elif not p.side:
                n.chars += p.chars
                n.tags += p.tags + 1
                n.links += p.links
                n.link_tags += p.link_tags + (p.tag == "a")
        if n.tag == "a":
            n.links = n.chars
    return order


def _densities(order: list[_Node], link_chars: int, all_chars: int) -> None:
    """Composite text density of each node, and the sum of its children's."""
    share = link_chars / max(1, all_chars)
    for n in order:
        chars, tags = n.chars, max(1, n.tags)
        if not chars:
            n.density = 0.0
        else:
            plain = max(1, chars - n.links)
            base = math.log(chars / plain * n.links + share * chars + math.e)
            value = chars / max(1, n.links) * tags / max(1, n.link_tags)
            n.density = chars / tags * max(0.0, math.log(max(value, 1e-9)) / max(base, 1.0))
        n.total = sum(p.density for p in n.parts if isinstance(p, _Node) and not p.side)


def _densest(order: list[_Node]) -> _Node:
    """The node with the largest density sum, the outermost of equal ones."""
    best = order[0]
    for n in order:
        if n.total >= best.total:
            best = n
    return best


def _text_density(node: _Node) -> float:
    """Mean density of the nodes below that hold text themselves, weighted by their characters; 0 without text."""
    weighted, chars, stack = 0.0, 0, [node]
    while stack:
        n = stack.pop()
        if any(isinstance(p, str) and not p.isspace() for p in n.parts):
            weighted += n.density * n.chars
            chars += n.chars
        stack.extend(p for p in n.parts if isinstance(p, _Node) and not p.side)
    return weighted / chars if chars else 0.0


def _hide(body: _Node, links: int) -> None:
    """Makes side nodes of the marked nodes, but for those around the densest marked text if it stands out by DISCOUNT.

    Mean densities are compared, so it does not matter how much text either part holds.
    """
    order = _measure(body)
    marked = [n for n in order if n.marked]
    if not marked:
        return
    _densities(order, links, max(body.chars + links, 1))
    below, stack = [], [n for n in marked]
    seen = set()
    while stack:
        n = stack.pop()
        if id(n) not in seen:
            seen.add(id(n))
            below.append(n)
            stack.extend(p for p in n.parts if isinstance(p, _Node) and not p.side)
    places = {id(n): i for i, n in enumerate(order)}
    hidden = _densest(sorted(below, key=lambda n: places[id(n)]))
    named = _text_density(hidden)
    for n in marked:
        n.side = True
    order = _measure(body)
    _densities(order, links, max(body.chars + links, 1))
    if _text_density(_densest(order)) < DISCOUNT * named:
        n = hidden
        while n is not body:
            n.side = n.side and not n.marked
            n = n.parent


def _blocks(node: _Node, out: list[str]) -> None:
    """Adds the text of each block below a node, in page order."""
    line: list[str] = []

    def end() -> None:
        text = SPACES.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list = [(node, 0)]
    while stack:
        n, i = stack.pop()
        if i == 0 and n.tag in BLOCKS:
            end()
        while i < len(n.parts):
            p = n.parts[i]
            i += 1
            if isinstance(p, str):
                line.append(p)
            elif not p.side:
                stack.append((n, i))
                stack.append((p, 0))
                break
        else:
            if n.tag in BLOCKS:
                end()
    end()


def _link_chars(page: str) -> int:
    """Characters in links, without tags and white space: each from an opening tag to the next closing one."""
    total = 0
    for piece in CLOSED_LINK.split(page)[:-1]:
        link = OPEN_LINK.search(piece)
        end = piece.find(">", link.end()) if link else -1
        if end >= 0:
            total += len(TAGS_AND_SPACES.sub("", piece[end + 1:]))
    return total


def main_text(page: str) -> str:
    """The text of the subtree with the largest density sum, and of what is as dense as its thinnest ancestor.

    Every node gets its characters per tag, adjusted by the characters and tags of links below it and by the link share
    of the whole body. The node whose children have the largest sum of densities holds the article; the smallest density
    on its path up to the body is the threshold for further parts outside of it. Scripts, forms, menus, notices, adverts
    and comments, known by element, take no part. Text below an element that a name in class, id or role marks as one of them
    counts a tenth of its density: it takes part only if the other text is thinner even so, as a menu or a teaser beside an
    article that stands in a part of such a name.
    """
    if not page:
        return ""
    root = _tree(page)
    body, stack = root, [root]
    while stack:
        n = stack.pop()
        if n.tag == "body":
            body = n
            break
        stack.extend(p for p in reversed(n.parts) if isinstance(p, _Node) and not p.side)
    links = _link_chars(page)
    _hide(body, links)
    order = _measure(body)
    _densities(order, links, max(body.chars + links, 1))
    chosen = _densest(order)
    if chosen.total == 0:
        chosen = body
    path, n = [chosen.density], chosen
    while n is not body:
        n = n.parent
        path.append(n.density)
    threshold = min(path)
    within, n = {id(chosen)}, chosen
    while n is not body:
        n = n.parent
        within.add(id(n))
    out: list[str] = []
    stack = [body]
    while stack:
        n = stack.pop()
        if n is chosen or id(n) not in within and n.density >= threshold and n.chars > n.links:
            _blocks(n, out)
        elif id(n) in within:
            stack.extend(p for p in reversed(n.parts) if isinstance(p, _Node) and not p.side)
    return "\n".join(out)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per row of `pages`.

    Null or empty pages, and pages without text, give an empty text. Unclosed and stray tags are mended as browsers do in
    the common cases. Nothing is cut off; rows are neither merged nor dropped; further columns play no part.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        text_of(page).alias("html"))
    return mapped(rows, run, "page_id long, url string, text string, n_chars long")
