"""Main text of HTML pages by scoring a tree of block elements.

Elements that are never main text (by tag, or by class or id) are left out with
all they hold. Each block of text that remains gives points for its length and
its commas to the elements around it, fewer the further out, and an element's
points are discounted by the share of its text inside links. An article or main
element counts twice. The element with the most points is kept, or the article or
main element around it if that scores well, and with it those of its siblings
that score well and hold few links, and the headings, paragraphs, lists, quotes,
tables and articles beside it that hold few links.

A class or id only makes an element suspect. It stays if it holds most of the
page's text outside links, with headings or paragraphs, and its name is not
wholly one of comments or advertisements. A name is read as English compounds
are: its last word says what the thing is, once words for parts and for content
are taken off its end. So reader-comments, comment-thread and sponsored-content
are suspect, ad-hoc, share-price and comment-on-policy are not. Some words
name nothing else and make a name suspect wherever they stand in it.

Other articles that score well and hold few links are kept wherever they stand.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by their use, and words in class and id values
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
NEVER = frozenset("head nav footer aside form button select option dialog menu object applet audio video canvas map".split()) | RAW
OUTSIDE_ARTICLE = frozenset(["header"])
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset(["article", "main"])
#: Words of class and id values. A value is of the layout if all parts of it are such words and one is no filler
FOREIGN = frozenset("ad ads advert adverts advertisement advertising comment comments commentlist respond replies disqus consent cookie cookies gdpr newsletter".split())
LAYOUT = FOREIGN | frozenset("banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation notice notices pager pagination popup modal promo related recommended share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split())
#: Make a name suspect wherever they stand, and as the last word of it
ANYWHERE = frozenset("adsense advertisement advertising advertorial commentlist comments consent cookie cookies disqus gdpr newsletter newsletters replies".split())
AT_THE_END = FOREIGN | ANYWHERE | frozenset("discussion discussions reply signup sponsor sponsored sponsors promo promos promotion related recommended recommendations subscribe subscription paywall footer masthead siteinfo".split())
#: Taken off the end of a name before its last word is read, and beginnings that turn a name around
PART = frozenset("banner card cards embed feed form frame holder info links module notice overlay panel placement posts articles slot slots stories stream text thread threads unit units zone".split())
TURNED = frozenset("no not has with without hide".split())
FILLER = frozenset("area bar block bottom box buttons col column container global inner item items left links list outer primary right row secondary section side site top wrap wrapper".split())
CONTENT = frozenset("article body content entry main post".split())
#: Kept beside the best element, if few of their characters are in links
BESIDE = frozenset("article blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOLDS_TEXT = _HEADINGS | {"p", "li", "pre"}
_COMMAS = ",\u060c\u3001\uff0c"
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Quotes count only after ``=``
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: A sibling is kept with this share of the best score
SIBLING_SHARE = 0.2


class _Node:
    __slots__ = ("tag", "parent", "dead", "suspect", "in_main", "score", "chars", "linked", "prose")

    def __init__(self, tag: str, parent: _Node | None, dead: bool, suspect: int = 0):
        self.tag, self.parent, self.dead, self.suspect = tag, parent, dead, suspect
        self.in_main = tag in MAIN or (parent is not None and parent.in_main)
        self.score, self.chars, self.linked, self.prose = 0.0, 0, 0, False


def _names_foreign(value: str) -> bool:
    """Whether a class or id names comments, advertisements, sign-ups or the like, whatever it says besides."""
    for pattern in (r"[a-z]+", r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"):  # as it is written, and by its capitals
        parts = [x.lower() for x in re.findall(pattern, value if "A-Z" in pattern else value.lower())]
        if not parts or parts[0] in TURNED:
            continue
        if ANYWHERE.intersection(parts) or parts == ["site", "info"]:
            return True
        while len(parts) > 1 and (parts[-1] in PART or parts[-1] in FILLER or parts[-1] in CONTENT):
            parts.pop()
        if parts[-1] in AT_THE_END:
            return True
    return False


def _suspect(attrs: str) -> int:
    """2 if a class or id names what is never an article, 1 if it names a part of the layout or has a word for what is none, else 0."""
    found = 0
    for name, *values in _ATTR.findall(attrs):
        if name.lower() not in ("class", "id"):
            continue
        for value in "".join(values).split():
            parts = [x for x in re.split(r"[^a-z]+", value.lower()) if x]
            if not parts:
                continue
            if parts[0] in FOREIGN and all(x in LAYOUT or x in FILLER or x in CONTENT for x in parts):
                return 2
            if _names_foreign(value):
                found = max(found, 1)
            elif any(x in CONTENT for x in parts):
                return 0
            if any(x in LAYOUT for x in parts) and all(x in LAYOUT or x in FILLER for x in parts):
                found = max(found, 2 if any(x in FOREIGN for x in parts) else 1)
    return found


def _skipped(tag: str, attrs: str, parent: _Node) -> bool:
    if tag in NEVER:
        return True
    if tag in OUTSIDE_ARTICLE:
        return not parent.in_main
    if tag in ("body", "html", "article", "main") or not attrs.strip():
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "role" and value in _ROLES) or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def _gather(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Characters, linked characters and prose of each element with all that it holds; inner elements come after outer ones."""
    for x in nodes:
        x.chars, x.linked, x.prose = 0, 0, False
    for node, block, links in blocks:
        node.chars, node.linked, node.prose = node.chars + len(block), node.linked + links, node.prose or node.tag in _HEADINGS or node.tag == "p"
    for x in reversed(nodes[1:]):
        up = x.parent
        up.chars, up.linked, up.prose = up.chars + x.chars, up.linked + x.linked, up.prose or x.prose


def _blocks(source: str) -> tuple[list[_Node], list[tuple[_Node, str]]]:
    """The elements of a page, outer ones first, and its text blocks in order, each with the element it stands in; scores the elements."""
    nodes, found = _all_blocks(source)
    _gather(nodes, found)
    most = (nodes[0].chars - nodes[0].linked) / 2
    for x in nodes[1:]:
        x.dead = x.dead or x.parent.dead or (x.suspect > 0 and (x.suspect == 2 or not x.prose or x.chars - x.linked <= most))
    left = [b for b in found if not b[0].dead]
    _gather(nodes, left)
    for node, block, _ in left:
        _pass_points(node, len(block), sum(map(block.count, _COMMAS)))
    return nodes, [(node, block) for node, block, _ in left]


def _all_blocks(source: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """The elements, and all text blocks outside dropped tags, each with its element and the number of its characters in links."""
    root = _Node("", None, False)
    nodes, open_tags = [root], Counter()
    node, found, text, link, links = root, [], [], 0, 0
    at = 0

    def flush():
        nonlocal text, links
        if text and not node.dead:
            block = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if block:
                found.append((node, block, min(links, len(block))))
        text, links = [], 0

    while (m := _TAG.search(source, at)) is not None:  # goes on behind the end of a raw element
        if m.start() > at and not node.dead:
            text.append(source[at : m.start()])
            links += (m.start() - at) * (link > 0)
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW and not closing:
            flush()
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                link = 0 if closing else 1
        elif closing:
            flush()
            if open_tags[tag]:  # else nothing to close
                link, last = 0, ""
                while last != tag:
                    last, node = node.tag, node.parent
                    open_tags[last] -= 1
        else:
            flush()
            if (tag in CLOSES_P and node.tag == "p") or (tag in SAME and node.tag in SAME[tag]):
                open_tags[node.tag] -= 1
                node = node.parent
            if tag not in VOID:
                open_tags[tag] += 1
                node = _Node(tag, node, node.dead or _skipped(tag, m[3] or "", node), 0 if tag in ("body", "html", *MAIN) or not m[3].strip() else _suspect(m[3]))
                nodes.append(node)
    if at < len(source) and not node.dead:
        text.append(source[at:])
    flush()
    return nodes, found


def _pass_points(node: _Node, chars: int, commas: int) -> None:
    """A block's points for the elements around it, fewer the further out."""
    points, up, share = 1 + commas + min(chars / 100, 3.0), node if node.tag not in _HOLDS_TEXT else node.parent, 1.0
    while up is not None and share > 0.1:
        up.score += points * share
        up, share = up.parent, share / 2


def value(node: _Node) -> float:
    """An element's points, less the share of its text in links; an article or main element counts twice."""
    return node.score * (1 - node.linked / max(node.chars, 1)) * (2 if node.tag in MAIN else 1)


def main_text(source: str | None) -> str:
    """Main text of a page: its blocks joined by newlines, white space in a block as one space."""
    nodes, found = _blocks(source or "")
    if not found:
        return ""
    # of equal elements the inner one that comes first
    best = max(reversed(nodes), key=lambda n: (value(n) if n.chars else -1.0))
    top, up, least = best, best.parent, max(1.0, value(best) * SIBLING_SHARE)
    while up is not None:  # the article around the best part of it, if it holds up against it
        if up.tag in MAIN and value(up) >= least:
            top = up
        up = up.parent
    few_links = lambda n: n.linked * 4 < n.chars
    # what each element is to the top: in it, the sibling it stands in, the outermost element of BESIDE around it
    inside, below, beside = {}, {None: None}, {None: None}
    around_top, up = set(), top
    while up is not None:
        around_top.add(up)
        up = up.parent
    for x in nodes:
        article = x.tag == "article" and x not in around_top and not x.dead and value(x) >= least and few_links(x)
        inside[x] = x is top or article or inside.get(x.parent, False)
        is_sibling = x.parent is top.parent and x is not top and x.parent is not None
        below[x] = x if is_sibling else below[x.parent]
        around = None if is_sibling else beside[x.parent]
        beside[x] = around or (x if x.tag in BESIDE else None)
    kept = {}
    for x in nodes:
        if inside[x]:
            kept[x] = True
        elif below[x] is not None:
            kept[x] = few_links(below[x]) and ((beside[x] is not None and few_links(beside[x])) or value(below[x]) >= least)
        else:  # the title may stand further out
            kept[x] = beside[x] is not None and beside[x].tag == "h1" and few_links(beside[x])
    return "\n".join(block for node, block in found if kept[node])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, the columns ``keep``, text, n_chars): one row for each row of ``pages``.

    A null or empty page, or one without main text, gives an empty text.
    Repeated rows each return; an empty table gives no rows; other columns are
    ignored. Whole pages are read, cut off or not; time and memory grow with a
    page's length, however deep its elements are nested.
    """
    names = [id_col, *keep]
    types = [pages.schema[c].dataType.simpleString() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f"k{i}") for i in range(len(names))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f"k{i}" for i in range(len(names))), "text", "n_chars"])

    base = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(names)), F.col(html_col).alias("html"))
    found = base.mapInArrow(run, ", ".join(f"k{i} {t}" for i, t in enumerate(types)) + ", text string, n_chars bigint")
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), "text", "n_chars")
