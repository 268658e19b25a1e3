"""Main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_batches

#: Fixed values of the HTML standard and of common page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of these names, unless a boundary stands between them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDARY = frozenset("html body table ul ol dl article section aside main nav td th select".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
#: Elements that never hold the article.
FURNITURE = frozenset("nav footer aside form button select dialog menu head search object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names in class and id that mark page furniture, adverts and reader comments outside of the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|nav|navs|navbar|navigation|menu|menus|menubar|breadcrumbs?|sidebar|side-?bar|"
    r"comments?|comment-?list|respond|disqus\w*|reply|replies|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|pagination|pager|"
    r"footer|masthead|topbar|site-?header|page-?header)(?:$|[\s_-])",
    re.I,
)
#: Within an article or main a name counts only as a whole: all its parts are of these words or say what kind of box it is (BOX).
#: What SURE names is cut there; what else NAMES finds is cut where its density is below the article's threshold.
SURE = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|cookies?|cookie\w*|consent|gdpr|navs?|navbar|navigation|menus?|menubar|breadcrumbs?|sidebar|comments?|commentlist|respond|disqus\w*|newsletter|subscri\w*|pagination|pager|footer|topbar|"
    r"social|share|sharing|related|recommended|recommendations?|promos?", re.I
)
BOX = re.compile(
    r"\d+|list|lists|box|boxes|item|items|section|area|wrapper|wrap|container|content|block|widget|bar|inner|outer|slot|unit|banner|form|thread|main|top|bottom|left|right|inline|links?|buttons?|posts?|site|page|side|reader|user|the|signup|label|title|header|body|text|author|meta|date", re.I
)
#: Names that mark furniture only outside of the article: within it they may name a part of the text.
LOOSE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:notice|banner|side|rail|widgets?|signup|login|popup|modal|overlay|toolbar|skip|tags?|toc|hidden|disclaimer|teasers?|copyright)(?:$|[\s_-])", re.I
)
#: Parts of names that say what is not there, or how a page is laid out.
STYLING = re.compile(
    r"(?<![^\s_-])(?:(?:no|non|not|has|have|with|without|hide|show)[_-]\S*|(?:overflow|backface|scroll)(?:[_-][xy])?[_-]hidden(?![^\s])|hidden[_-](?:xs|sm|md|lg|xl|xxl|print|mobile|desktop|phone|tablet)\S*)",
    re.I,
)
#: Elements that can hold a whole article.
CONTAINERS = frozenset("#page html body main article section div td center table tbody".split())
#: A subtree whose characters stand in links by more than this share may fall below the threshold.
LINKED = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S
)
#: One attribute after the other, so that nothing within a value or a longer name is taken for one.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _sure(name: str) -> bool:
    """Whether a class or id names furniture as a whole."""
    parts = [x for x in re.split(r"[_-]", name) if x]
    return any(map(SURE.fullmatch, parts)) and all(SURE.fullmatch(x) or BOX.fullmatch(x) for x in parts)


class Page:
    """The elements of a page in document order, with what is needed for densities.

    ``parts`` holds (element, text) in page order; a text of None is the edge of a block.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["#page"], [-1], [False]
        self.named: set[int] = set()  # elements whose class or id names furniture
        self.soft: set[int] = set()  # elements within an article with such a name, or a part of one
        self.loose: set[int] = set()  # elements whose names mean furniture only outside of the article
        self.beside: set[int] = set()  # of these and what they hold, the elements that stand outside
        self.parts: list[tuple[int, str | None]] = []
        self._parse(source)
        if self.named or self.loose:
            self._cut_named()

    def _in_article(self, node: int) -> bool:
        while node > 0:
            if self.tag[node] in ("article", "main"):
                return True
            node = self.parent[node]
        return False

    def _cut_named(self) -> None:
        """Cut the elements of ``named``, but for those that hold an article, a main or most of the body's unlinked text.

        The last does not count on a page with an article or main elsewhere: a notice may be longer than a short article.
        Those of ``loose`` that stand in no article or main are noted, by the same rule, in ``beside``.
        """
        n = len(self.tag)
        text, holds, above, inside_a = [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            inside_a[i] = inside_a[self.parent[i]] or self.tag[i] == "a"
            above[i] = above[self.parent[i]] + (self.tag[i] in ("article", "main"))
        for node, part in self.parts:
            if part and not self.cut[node] and not inside_a[node]:
                text[node] += len("".join(part.split()))
        for i in range(n - 1, 0, -1):
            if not self.cut[i]:
                p = self.parent[i]
                text[p] += text[i]
                holds[p] += holds[i] + (text[i] > 0 and self.tag[i] in ("article", "main"))
        for i in range(1, n):
            outside = not holds[i] and (2 * text[i] <= text[0] or holds[0] > above[i])
            self.cut[i] = self.cut[i] or self.cut[self.parent[i]] or i in self.named and outside
            if self.parent[i] in self.beside or i in self.loose and outside and not above[i]:
                self.beside.add(i)

    def _furniture(self, tag: str, attrs: str, inside: int) -> bool | None:
        """Whether an element is cut; None if only its names say so."""
        if tag in FURNITURE or tag in RAW:
            return True
        if tag == "header":  # an article's own header holds its title
            return not self._in_article(inside)
        if not attrs or tag in ("html", "body", "main", "article"):
            return False
        named = False
        in_article = None
        for m in _ATTRIBUTE.finditer(attrs):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
                return True
            if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True
            if name in ("class", "id"):
                plain = STYLING.sub("", value)
                if NAMES.search(plain):
                    in_article = self._in_article(inside) if in_article is None else in_article
                    named = named or not in_article or any(_sure(x) for x in plain.split())
                    if in_article:
                        self.soft.add(len(self.tag) - 1)
                elif value.strip().lower() == "header":
                    named = named or not self._in_article(inside)
                if LOOSE_NAMES.search(plain):
                    self.loose.add(len(self.tag) - 1)
        return None if named else False

    def _close(self, stack: list[int], names: tuple[str, ...], boundary: frozenset[str] = frozenset()) -> None:
        if not any(self.open[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in names:
                if any(self.tag[i] in BLOCK for i in stack[k:]):
                    self.parts.append((stack[k], None))
                self.open.subtract(self.tag[i] for i in stack[k:])
                del stack[k:]
                return
            if t in boundary:
                return

    def _parse(self, source: str) -> None:
        stack, at, open_p = [0], 0, 0
        self.open: Counter = Counter()  # open elements by name
        end = source.rfind(">") + 1  # nothing behind it is a tag
        while True:
            m = _TOKEN.search(source, at, end) if at < end else None
            text = source[at : m.start() if m else len(source)]
            if text:
                self.parts.append((stack[-1], text))
            if m is None:
                return
            at = m.end()
            if m.group().startswith("<!--") and not m.group().endswith("-->"):
                return  # a comment that never ends
            name = (m.group(2) or m.group(5) or "").lower()
            if not name:
                continue
            if m.group(1) or m.group(4):
                if name == "p" and not open_p:
                    self.parts.append((stack[-1], None))
                self._close(stack, (name,), frozenset(("article", "main", "body", "html")) - {name} if name in ("p", "b", "i", "a", "span", "em", "strong", "li") else frozenset())
                open_p = sum(self.tag[i] == "p" for i in stack[-4:]) if name in BLOCK else open_p
                continue
            attrs = m.group(3) or m.group(6) or ""
            if name in BLOCK:
                if open_p or any(self.tag[i] == "p" for i in stack[-6:]):
                    self._close(stack, ("p",), BOUNDARY)
                open_p = 0
                if name in ENDS:
                    self._close(stack, ENDS[name], BOUNDARY)
                self.parts.append((stack[-1], None))
            elif name == "br":
                self.parts.append((stack[-1], " "))
            node = len(self.tag)
            above = stack[-1]
            self.tag.append(name), self.parent.append(above)
            furniture = self.cut[above] or self._furniture(name, attrs, above)
            if furniture is None:
                self.named.add(node)
            self.cut.append(bool(furniture))
            if name in ("svg", "math") and attrs.rstrip().endswith("/"):
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            elif name not in VOID and not attrs.rstrip().endswith("/"):
                stack.append(node)
                self.open[name] += 1
                if name == "p":
                    open_p = 1


def _densities(page: Page) -> tuple[list[float], list[float], list[int], list[int]]:
    """(composite density, sum of the children's densities, characters, characters in links) of every element."""
    n = len(page.tag)
    chars, linked, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    inside_a = [False] * n
    for i in range(1, n):
        inside_a[i] = inside_a[page.parent[i]] or page.tag[i] == "a"
    for node, text in page.parts:
        if text and not page.cut[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if inside_a[node]:
                linked[node] += size
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        if not page.cut[i]:
            chars[p] += chars[i]
            linked[p] += linked[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    body_chars, body_linked = max(1, chars[0]), linked[0]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, lc, t, lt = chars[i], linked[i], max(1, tags[i]), max(1, link_tags[i])
        if c and not page.cut[i]:
            base = math.log(c / max(1, c - lc) * lc + body_linked / body_chars * c + math.e)
            inner = c / max(1, lc) * t / lt
            density[i] = c / t * max(0.0, math.log(max(inner, 1.0)) / base)
        if i:
            total[page.parent[i]] += density[i]
    return density, total, chars, linked


def main_text(source: str | None) -> str:
    """The article of a page as blocks joined by line ends; empty for null or text-free pages.

    Page furniture (see FURNITURE, ROLES, NAMES) is cut, though by its names alone nothing that holds an article, a main
    or, on a page without these elsewhere, most of the body's unlinked text. Of the rest, the element with the largest sum of its
    children's composite densities stands in the article; the least density on its path up to the page is the
    threshold. The article grows from that element to the container around it, and on as long as neighbours
    reach the threshold with prose; of those that stand beside it under the body each is kept for itself. Where it has grown, and
    on pages without a container, subtrees that are mostly links and below the threshold and those of LOOSE_NAMES fall out;
    within the densest element, and within an article, lists of links and named blocks are text, but for what is named as furniture as a whole (SURE) and
    what a part of its name (NAMES) and a density below the threshold tell to be furniture. Headings that stand in
    the article's ancestors before its last part belong to it. Ties go to the first element of the page. Time and memory
    are linear in the page, however long or deep it is.
    """
    if not source:
        return ""
    page = Page(source)
    density, total, chars, linked = _densities(page)
    n = len(page.tag)
    best = max(range(n), key=lambda i: (total[i] if not page.cut[i] and i not in page.beside else -1.0, -i))
    if not total[best]:
        best = 0
    densest = best
    path, node = [], best
    while node >= 0:
        path.append(node)
        node = page.parent[node]
    threshold = min((density[i] for i in path if density[i] > 0), default=0.0)
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        children.setdefault(page.parent[i], []).append(i)

    def dense(i: int) -> bool:
        return density[i] >= threshold and linked[i] <= LINKED * chars[i] and chars[i] > 0

    def prose(i: int) -> bool:
        return not page.cut[i] and i not in page.beside and dense(i)

    while (up := page.parent[best]) > 0 and page.tag[up] not in ("html", "#page"):
        if page.tag[best] in CONTAINERS and (page.tag[up] == "body" or not any(prose(i) for i in children[up] if i != best)):
            break
        best = up
    up = page.parent[best]
    ends = up >= 0 and page.tag[best] not in ("html", "body") and page.tag[up] in ("body", "html", "#page")
    beside = {i for i in children[up] if i != best and prose(i)} if ends else set()  # where growth ends, prose stands beside
    last = max(beside | {best})
    on_path = set(path[path.index(best) :])
    loose_at = {i for i in path[: path.index(best) + 1] if page.tag[i] in ("html", "body", "#page") or i != densest and page.tag[i] != "article"}
    kept = [False] * n
    for i in range(n):
        if page.cut[i]:
            continue
        p = page.parent[i]
        if i == best or i in beside:
            kept[i] = True
        elif p >= 0 and kept[p]:
            kept[i] = (i not in page.soft or dense(i)) and (p not in loose_at or i not in page.beside and not (density[i] < threshold and chars[i] and linked[i] > LINKED * chars[i] and page.tag[i] in BLOCK))
        elif i < last and p in on_path and page.tag[i] in HEADINGS and i not in on_path:
            kept[i] = True
    blocks, now = [], []
    for node, text in page.parts:
        if text is None:
            blocks.append(now)
            now = []
        elif kept[node]:
            now.append(text)
    blocks.append(now)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of ``pages``. Null and empty pages have empty text; repeated rows are extracted each; other columns are ignored; an empty table gives no rows."""
    arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def digest(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("n_chars", F.char_length("text").cast("long"))
