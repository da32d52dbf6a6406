"""Operator 6, main text of web pages by inferred wrappers.

A wrapper is a union-free regular expression over a host's token streams: a sequence of elements
that occur once, may be missing (optional) or recur (repeated group), with text slots. It starts as
one page; every further page is aligned with it, and mismatches become optional elements, repeated
groups or slots. Wrappers of parts of a host's pages are aligned with each other in the same way, so
that tasks fold their pages first and only wrappers are shuffled.

The wrapper names the region of the host's pages that holds the article; a page's main text is the
text of that region without the furniture in it. Article and main elements weigh in the choice of the
region; alone they decide only on hosts whose wrapper has no slots (one page, or copies of one, on which no element recurs).

Furniture by tag or role never counts. Furniture by name goes where the wrapper confirms it, which it
does in two ways: the text is a constant of the host; or, for names that say nothing but furniture
(``ad-banner``, ``comments-area``) and for articles that recur inside the article, what is left of the
region still has text slots beside its headings.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Wrappers of up to so many bytes are broadcast; beyond that they are joined by host.
BROADCAST_BYTES = 32 << 20
#: So many partial wrappers of a host meet in one group, level by level.
GROUPS = 32
#: A wrapper describes the outermost levels of a page; what is deeper belongs to the level above.
DEPTH = 48
#: Longest repeated group, in elements, that a page is searched for.
PERIOD = 4
#: Share of a level's weight that the region's next element holds at least; with an article or main
#: element that pages have once, the smaller one is enough.
SHARE, HINTED_SHARE = 0.75, 0.5
#: Weights of slot text: in furniture by name and by sure name, by the mark for main (0 to 3); and of constant text.
BY_NAME, BY_SURE_NAME, BY_MARK, CONSTANT = 0.1, 0.01, (1.0, 1.5, 3.0, 4.0), 0.05

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A new one of these ends an open paragraph.
ENDS_P = BLOCK - {"br", "body", "html"}
#: An open one of the same set ends where the next begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = frozenset("nav aside footer form script style noscript template iframe svg canvas button select textarea input object embed dialog menu head title noembed noframes audio video map".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names that furniture often has; they count only where the wrapper confirms them, never on headings.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing social sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer footers toolbar widget widgets related recommended recommendations trending comment comments reply replies respond disqus discussion pagination pager skip".split()
) | frozenset("commentlist commentform commentbox dfp gpt taboola outbrain kommentar kommentare werbung anzeige anzeigen commentaire commentaires comentario comentarios publicite publicidad".split())
#: Of these, what names of articles' own parts have too; and what ids may say beside advert and comment names.
UNSURE_WORDS = frozenset("discussion register login signup share sharing social reply respond widget skip promotion notice notices alert alerts".split())
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement adsense sponsored dfp gpt taboola outbrain werbung anzeige anzeigen publicite publicidad".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentform commentbox disqus replies kommentar kommentare commentaire commentaires comentario comentarios".split())
#: Words that a name of furniture may have beside it; and those of a place, for adverts and comments only.
NEUTRAL_WORDS = frozenset("area author block body box button buttons card container content count div entry fixed form google group holder icon inline inner item items link links list meta native outer panel post reader readers row section slot sticky story text thread title unit user users wrap wrapper".split())
PLACE_WORDS = frozenset("above after before below bottom end in left mid middle right side start top".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Furniture outside the article only: inside, a header holds the article's title.
HEADERS = frozenset("header headers masthead topbar".split())
MAIN_WORDS = frozenset("article post entry story content main body text".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)/?>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@lru_cache(65536)
def _sure(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id says nothing but furniture: one of the words, and beside it none but neutral ones."""
    parts = {w.lower() for w in NAME_WORD.findall(name)}
    found = parts & words
    rest = {w for w in parts - found - NEUTRAL_WORDS if not w.isdigit()}
    return bool(found) and (not rest or bool(found & (ADVERT_WORDS | COMMENT_WORDS)) and rest <= PLACE_WORDS)


class Node:
    """An element: tag, signature (tag, classes without numbers and, after ``#``, the marks), children
    (nodes and strings) and what its attributes say about it; ``sure``: its name is furniture's alone."""

    __slots__ = ("children", "furniture", "header", "main", "named", "sig", "sure", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.sig, self.children = tag, tag, []
        self.furniture, self.header, self.named, self.sure = tag in FURNITURE, tag == "header", False, False
        self.main = 3 if tag == "article" else 2 if tag == "main" else 0
        if attributes and not attributes.isspace():
            given = {k.lower(): (v[1:-1] if v[:1] in ("'", '"') else v) for k, v in ATTRIBUTE.findall(attributes)}
            names = given.get("class", "") + " " + given.get("id", "")
            if given.get("class"):
                classes = sorted(c for c in given["class"].split() if not any(map(str.isdigit, c)))
                if classes and tag not in ("html", "body"):
                    self.sig = f"{tag}.{'.'.join(classes)}".replace("#", "")
            words = {w.lower() for w in NAME_WORD.findall(names)} if not names.isspace() else set()
            role = given.get("role", "").lower()
            style = given.get("style", "").replace(" ", "").lower()
            if tag not in ("html", "body"):
                self.furniture |= role in FURNITURE_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style
                self.named = bool(words & FURNITURE_WORDS) and tag not in HEADINGS
                if self.named:
                    self.sure = any(_sure(c, FURNITURE_WORDS - UNSURE_WORDS) for c in given.get("class", "").split()) or _sure(given.get("id", ""), ADVERT_WORDS | COMMENT_WORDS)
                if given.get("itemprop", "").lower() == "comment" or given.get("itemtype", "").lower().endswith("schema.org/comment"):
                    self.named = self.sure = True
            self.header |= bool(words & HEADERS)
            if role == "main" or given.get("itemprop") == "articleBody":
                self.main = max(self.main, 2)
            elif words & MAIN_WORDS and tag in ("div", "section", "td"):
                self.main = max(self.main, 1)
        marks = "f" * (self.furniture and tag not in FURNITURE) + "n" * self.named + "s" * self.sure + "h" * self.header + f"{self.main or ''}"
        if marks:
            self.sig += f"#{marks}"


def parse(page: str) -> Node:
    """The element tree of a page. Unclosed and stray tags are taken as browsers mostly do."""
    root = Node("#page")
    stack = [root]
    i, n = 0, len(page)
    while i < n:
        m = TOKEN.match(page, i)
        i = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if not (piece.startswith("<") and len(piece) > 1):
                stack[-1].children.append(piece)
            elif piece.startswith("<![CDATA["):
                stack[-1].children.append(html.escape(piece[9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            else:
                if tag in BLOCK:  # a stray end still parts blocks
                    stack[-1].children.append(Node("br"))
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "tr", "select") and stack[k].tag not in SIBLINGS[tag]:
                    break
        node = Node(tag, m.group(3))
        stack[-1].children.append(node)
        if tag in VOID or page[m.end() - 2] == "/" and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, i)
            stop = end.start() if end else n
            node.children.append(page[i:stop])
            close = page.find(">", stop)
            i = n if not end or close < 0 else close + 1
            continue
        stack.append(node)
    return root


# An element of a wrapper is a list: signature, least and most occurrences (0 or 1; 1 or 2 for "more"),
# children, for text the checksum of a constant or None for a slot, characters of text on all pages,
# and the number of pages it is on. "()" is a repeated group.


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != "()" or [x[0] for x in a[3]] == [x[0] for x in b[3]])


def _merge(a: list, b: list, pages: bool = True) -> list:
    """The element that matches what either matches; ``pages``: they are from different pages."""
    return [a[0], min(a[1], b[1]), max(a[2], b[2]), align(a[3], b[3], pages), a[4] if a[4] == b[4] else None, a[5] + b[5], a[6] + b[6] if pages else max(a[6], b[6])]


def align(a: list[list], b: list[list], pages: bool = True) -> list[list]:
    """The sequence that matches what either sequence matches: equal elements meet along a longest
    common subsequence, others become optional."""
    if not a and not b:
        return []
    if len(a) == len(b) and all(map(_same, a, b)):
        return [_merge(x, y, pages) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and _same(a[i], b[j]):
            out.append(_merge(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 0, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], 0, *b[j][2:]])
            j += 1
    return fold(out)


def fold(items: list[list]) -> list[list]:
    """Neighbouring equal elements, or equal runs of up to PERIOD elements, become a repeated group."""
    for period in range(1, PERIOD + 1):
        out: list[list] = []
        i = 0
        while i < len(items):
            j, group = i + period, None
            while j + period <= len(items) and all(_same(items[i + k], items[j + k]) for k in range(period)):
                group = [_merge(x, y, False) for x, y in zip(group or items[i : i + period], items[j : j + period], strict=True)]
                j += period
            if group is None:
                out.append(items[i])
                i += 1
            elif period == 1:
                group[0][1], group[0][2] = max(x[1] for x in items[i:j]), 2
                out.append(group[0])
                i = j
            else:
                out.append(["()", 1, 2, group, 0, 0, max(x[6] for x in group)])
                i = j
        items = out
    return items


def elements(node: Node, depth: int = DEPTH) -> list[list]:
    """A node's children as wrapper elements; text parts that inline tags cut count as one text."""
    out: list[list] = []
    if not depth:  # what is not looked at is no constant
        return [["#text", 1, 1, [], None, 0, 1]] if node.children else out
    for c in node.children:
        if isinstance(c, str):
            if c.isspace():
                continue
            text = c.strip()
            item = ["#text", 1, 1, [], zlib.crc32(text.encode("utf-8", "replace")), len(text), 1]
        elif c.tag in BLOCK or c.tag in FURNITURE or c.named:
            item = [c.sig, 1, 1, [] if c.tag in RAW else elements(c, depth - 1), 0, 0, 1]
        else:
            inner = elements(c, depth - 1)
            for x in inner:
                if x[0] != "#text":
                    out.append(x)
            if not any(x[0] == "#text" for x in inner):
                continue
            item = next(x for x in inner if x[0] == "#text")
        if item[0] == "#text" and out and out[-1][0] == "#text":
            out[-1][5] += item[5]
            out[-1][4] = None if item[4] is None or out[-1][4] is None else zlib.crc32(str(item[4]).encode(), out[-1][4])
            continue
        out.append(item)
    return fold(out)


def _marks(sig: str) -> tuple[str, str, int]:
    """Tag, marks and mark for main of a signature."""
    name, _, marks = sig.partition("#")
    return name.split(".")[0], marks, int(marks[-1]) if marks[-1:].isdigit() else 0


def _weight(items: list[list], constant: float = CONSTANT) -> float:
    """Characters of the text slots, more in paragraphs that recur and in what is marked as main,
    fewer in lists, headers and what is furniture by its name; constant text counts little, but in
    full in an element that is marked as the article and that pages have once."""
    total = 0.0
    for sig, _, most, children, text, chars, _ in items:
        if sig == "#text":
            total += chars * (1.0 if text is None else constant)
            continue
        tag, marks, main = _marks(sig)
        if "f" in marks or tag in FURNITURE and tag != "form":
            continue
        once = main >= 2 and most == 1
        inside = _weight(children, 1.0 if once else constant)
        name = BY_SURE_NAME if "s" in marks and not _holds_main(children) else BY_NAME if tag == "form" or "n" in marks or "h" in marks else 1.0
        total += inside * (2.0 if most > 1 and tag == "p" else 0.5 if tag in ("li", "td") else 1.0) * name * (BY_MARK[main] if once or main < 2 else 1.0)
    return total


def _holds_main(items: list[list]) -> bool:
    """Whether there is an article or main element that pages have once, and that is no furniture by name."""
    return any((_marks(x[0])[2] >= 2 and x[2] == 1 and "s" not in _marks(x[0])[1]) or _holds_main(x[3]) for x in items)


def _slots(items: list[list], skip: frozenset[str] | set[str] = frozenset()) -> bool:
    """Whether there is text that differs from page to page, furniture by tag or role left out, and
    what has a tag or signature in ``skip``."""
    for sig, _, _, children, text, _, _ in items:
        tag, marks, _ = _marks(sig)
        if "f" in marks or tag in FURNITURE and tag != "form" or sig in skip or tag in skip:
            continue
        if sig == "#text" and text is None or _slots(children, skip):
            return True
    return False


def _sure_furniture(items: list[list], article: bool, recurs: bool = False) -> set[str]:
    """Signatures below whose names are furniture's alone, unless they hold the page's article; in an
    article also the articles that recur."""
    out = set()
    for x in items:
        _, marks, main = _marks(x[0])
        again = recurs or x[2] > 1
        if "s" in marks and (article or not _holds_main(x[3])) or article and main == 3 and again:
            out.add(x[0])
        else:
            out |= _sure_furniture(x[3], article, again)
    return out


def _titled(x: list) -> bool:
    """Whether an element is or holds a heading of the first level that is no constant of the host."""
    tag, marks, _ = _marks(x[0])
    if tag in FURNITURE or "f" in marks or "n" in marks:
        return False
    return tag == "h1" and (_slots(x[3]) or x[6] < 2) or any(map(_titled, x[3]))


def _constant(items: list[list], pages: int) -> tuple[bool, bool]:
    """Whether all text below is the same on all of at least two and half the pages; whether there is any."""
    same, some = True, False
    for sig, _, _, children, text, _, on in items:
        if sig == "#text":
            same, some = same and text is not None and on >= max(2, pages / 2), True
        else:
            below = _constant(children, pages)
            same, some = same and below[0], some or below[1]
    return same, some


def _furniture(items: list[list], pages: int, headers: bool) -> tuple[set[str], set[str]]:
    """Signatures below that are furniture by name: those that the wrapper confirms (constant text on
    the host's pages), and those that it does not."""
    good, bad = set(), set()
    for x in items:
        marks = _marks(x[0])[1]
        if "n" in marks or headers and "h" in marks:
            same, some = _constant(x[3], pages)
            (good if same and some else bad).add(x[0])
        more = _furniture(x[3], pages, headers)
        good |= more[0]
        bad |= more[1]
    return good, bad


def region(wrapper: list[list]) -> tuple[list[list[str]], list[list[str]], list[str]] | None:
    """The wrapper's main region, or None if it has no slots: signatures of each step on the way to it
    (one of them is taken), those of the headings beside each step that belong to it, and signatures
    in it that are confirmed as furniture.

    A step leads to the element with most of the weight. The way ends where the weight parts, at the
    outermost article on it, or else at the innermost main element."""
    if not _slots(wrapper):
        return None
    path: list[tuple[list[str], list[str], int, list[list]]] = []
    items = wrapper
    while True:
        options = [[x] for x in items if x[0] != "#text" and not (_marks(x[0])[2] == 3 and x[2] == 1)]
        articles = [x for x in items if _marks(x[0])[2] == 3 and x[2] == 1]
        options += [articles] if articles else []
        whole = _weight(items)
        if not options or whole <= 0:
            break
        score, best = max(((_weight(o), o) for o in options), key=lambda s: s[0])
        tag, _, main = _marks(best[0][0])
        hinted = main >= 2 and best[0][2] == 1
        if score < (HINTED_SHARE if hinted else SHARE) * whole or tag in ("p", "h1", "h2", "h3", "li", "blockquote", "pre"):
            break
        below = [y for x in best for y in x[3]]
        if tag != "()":
            path.append(([x[0] for x in best], [x[0] for x in items if x not in best and x[0] != "()" and _titled(x)], main if hinted else 0, below))
        if hinted and main == 3:
            break
        items = below
    marked = [i for i, step in enumerate(path) if step[2] >= 2]
    if marked:
        path = path[: marked[-1] + 1]
    inside = path[-1][3] if path else wrapper
    pages = max(x[6] for x in wrapper)
    good, bad = _furniture(inside, pages, not marked)
    sure = _sure_furniture(inside, bool(path) and path[-1][2] == 3)
    if not _slots(inside, sure | HEADINGS | {"header"}):
        sure = set()  # it is the article that has such a name
    titled = any(map(_titled, inside))
    return [p[0] for p in path], [[] if titled else p[1] for p in path], sorted((good - bad) | sure)


def _mains(node: Node, least: int) -> list[Node]:
    """The outermost elements below that are marked as main at least so much, in page order."""
    out, open_nodes = [], [node]
    while open_nodes:
        x = open_nodes.pop()
        if x is not node and x.main >= least:
            out.append(x)
            continue
        open_nodes += [c for c in reversed(x.children) if isinstance(c, Node) and not c.furniture]
    return out


def _children(node: Node) -> Iterator[Node]:
    """The elements below as a wrapper sees them: through inline elements."""
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            continue
        if c.tag in BLOCK or c.tag in FURNITURE or c.named:
            yield c
        else:
            todo += reversed(c.children)


def _at(node: Node, steps: list[list[str]], beside: list[list[str]]) -> list[Node]:
    """The nodes that the steps lead to, with the headings beside them, in page order. A page that
    lacks a step is taken from the last one that it has."""
    if not steps:
        return [node]
    below = list(_children(node))
    if not any(c.sig in steps[0] for c in below):
        return [node]
    out: list[Node] = []
    for c in below:
        if c.sig in steps[0]:
            out += _at(c, steps[1:], beside[1:])
        elif c.sig in beside[0]:
            out.append(c)
    return out


def _text(node: Node, drop: frozenset[str] | list[str], headers: bool = True, sure: bool = False) -> str:
    """The text below without furniture and without ``drop``, with line feeds where blocks begin and
    end; ``sure``: without what its name alone says to be furniture."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x is not node and (x.furniture or x.sig in drop or sure and x.sure or x.tag == "header" and not headers):
            continue
        if x.tag in BLOCK:
            out.append("\n")
            todo.append("\n")
        todo += reversed(x.children)
    return "".join(out)


def _marked(root: Node) -> list[Node]:
    """The page's article, or else its main element, or else its articles if they hold most of its
    text; the page if none does."""
    for least in (3, 2):
        found = [x for x in _mains(root, least) if x.main == least]
        if len(found) == 1:
            return found
    found = _mains(root, 3)
    return found if found and 2 * sum(len(_text(x, [])) for x in found) >= len(_text(root, [])) else [root]


def main_text(page: str, where: tuple | None) -> str:
    """The article's text, without furniture: of the region that the host's wrapper names, or else
    (the wrapper has no slots) of the page's article or main elements."""
    root = parse(page)
    if where:
        texts = [_text(node, where[2]) for node in _at(root, where[0], where[1])]
    else:
        nodes = _marked(root)
        texts = [_text(node, [], node is not root, True) for node in nodes]
        if not "".join(texts).strip():
            texts = [_text(node, [], node is not root) for node in nodes]
    return " ".join(html.unescape("\n".join(texts)).split())


def host_of(url: F.Column) -> F.Column:
    """Lower-cased host of a URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _dump(wrapper: list[list]) -> bytes:
    return zlib.compress(json.dumps(wrapper).encode())


def _load(blob: bytes) -> list[list]:
    return json.loads(zlib.decompress(blob))


def _shape(items: list[list]) -> tuple:
    return tuple((x[0], x[2], _shape(x[3])) for x in items)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of every host, from all its pages."""
    source = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, dict[tuple, list[list]]] = {}
            for part in common.slices(batch, "html"):
                for host, raw in zip(part.column(0).to_pylist(), common.byte_column(part, "html"), strict=True):
                    page = elements(parse(raw.decode("utf-8", "replace")))
                    shapes = found.setdefault(host, {})
                    shape = _shape(page)
                    shapes[shape] = align(shapes[shape], page) if shape in shapes else page
            rows = [(host, _dump(_all(shapes.values()))) for host, shapes in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["host", "wrapper"])

    def merge(rows: pa.Table) -> pa.Table:
        whole = _all(_load(x.as_py()) for x in rows.column("wrapper"))
        return rows.slice(0, 1).drop_columns("wrapper").append_column("wrapper", pa.array([_dump(whole)], pa.binary()))

    part = source.mapInArrow(learn, "host string, wrapper binary")
    width = part.rdd.getNumPartitions()
    part = part.withColumn("g", F.spark_partition_id())
    while width > GROUPS:  # a tree over the tasks that read the pages, as high as they are many
        width = -(-width // GROUPS)
        part = part.withColumn("g", F.floor(F.col("g") / GROUPS).cast("int")).select("host", "g", "wrapper")
        part = part.groupBy("host", "g").applyInArrow(merge, "host string, g int, wrapper binary")
    return part.drop("g").groupBy("host").applyInArrow(merge, "host string, wrapper binary")


def _all(wrappers) -> list[list]:
    out = None
    for w in sorted(wrappers, key=lambda w: json.dumps(w)):  # alignment in one order, whatever arrives first
        out = w if out is None else align(out, w)
    return out or []


PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``id_col``, ``url_col``, text (the main text, white space as one
    space), n_chars (its code points).

    A null or empty page has the empty text; pages without a URL share one host; repeated rows stay;
    other columns are ignored.
    """
    from ..session import checkpoint_root

    spark = pages.sparkSession
    checkpoint_root(spark)
    known = infer(pages, url_col, html_col).checkpoint()
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    size = known.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        paths = spark.sparkContext.broadcast({r["host"]: region(_load(r["wrapper"])) for r in known.collect()})
        source = source.withColumn("wrapper", F.lit(None).cast("binary"))
    else:
        paths = None
        source = source.join(known, "host").select("page_id", "url", "html", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "html"):
                rows = []
                for page, url, raw, host, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.byte_column(part, "html"), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    where = paths.value.get(host) if paths else region(_load(blob))
                    text = main_text(raw.decode("utf-8", "replace"), where) if raw else ""
                    rows.append((page, url, text, len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PAGES, strict=True)], schema=PAGES)

    out = source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
