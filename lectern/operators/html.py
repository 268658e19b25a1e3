"""Web pages in a table: sections, links, tables, titles, languages, bounded traversal."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import forget, persist_shared, small_batches

SECTION = "page_id long, section_no int, heading string, heading_level int, text string"
LINK = "page_id long, position int, text string, url string"


class _Sections(HTMLParser):
    """Text below each heading, outside page furniture; and links with their labels."""

    SKIP = frozenset(("nav", "footer", "header", "script", "style", "head"))
    TEXT = frozenset(("p", "li", "td", "th", "ul", "ol", "table", "br", "div", "tr"))

    def __init__(self, base: str = ""):
        super().__init__(convert_charrefs=True)
        self.base, self.skip, self.level = base, 0, 0
        self.sections: list[tuple[str | None, int | None, list[str]]] = []
        self.heading: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.link: tuple[str, list[str]] | None = None
        self.tables: list[tuple[str, str]] = []
        self.row: list[str] | None = None

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag in self.SKIP:
            self.skip += 1
        if tag in ("h1", "h2", "h3", "h4", "h5"):
            self.level, self.heading = int(tag[1]), []
        if tag == "a" and dict(attrs).get("href"):
            self.link = (urljoin(self.base, dict(attrs)["href"]), [])
        if tag == "tr":
            self.row = []
        if tag in ("td", "th") and self.row is not None:
            self.row.append("")
        if tag in self.TEXT and self.sections:
            self.sections[-1][2].append("\n")

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag in ("h1", "h2", "h3", "h4", "h5") and self.level:
            title = " ".join("".join(self.heading).split())
            if title and not self.skip:
                self.sections.append((title, self.level, []))
            self.level = 0
        if tag == "a" and self.link:
            label = " ".join("".join(self.link[1]).split())
            if label:
                self.links.append((label, self.link[0]))
            self.link = None
        if tag == "tr" and self.row is not None:
            cells = [" ".join(c.split()) for c in self.row]
            if len(cells) == 2 and cells[0]:
                self.tables.append((cells[0].rstrip(":"), cells[1]))
            self.row = None

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if self.link:
            self.link[1].append(data)
        if self.row:
            self.row[-1] += data
        if self.skip:
            return
        if self.level:
            self.heading.append(data)
        elif data.strip():
            if not self.sections:
                self.sections.append((None, None, []))
            self.sections[-1][2].append(data)


def _parsed(source: str | None, base: str | None) -> _Sections:
    p = _Sections(base or "")
    p.feed(source or "")
    p.close()
    return p


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, section_no, heading, heading_level, text) below every heading h1 to h5; text before the first has none."""
    small_batches(pages.sparkSession)

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            rows = []
            for i, url, source in zip(f.page_id, f.url, f.html):
                kept = [(h, lv, "\n".join(x for x in (" ".join(line.split()) for line in "".join(t).split("\n")) if x)) for h, lv, t in _parsed(source, url).sections]
                rows += [(i, n, h, lv, t) for n, (h, lv, t) in enumerate(((h, lv, t) for h, lv, t in kept if h or t), 1)]
            out = pd.DataFrame(rows, columns=["page_id", "section_no", "heading", "heading_level", "text"])
            out["heading_level"] = out["heading_level"].astype("Int32")
            yield out

    return pages.select("page_id", "url", "html").mapInPandas(run, SECTION)


def table_map(pages: DataFrame) -> DataFrame:
    """(page_id, fields): the two-column rows of a page's tables as a map; the last of equal names stays."""
    small_batches(pages.sparkSession)

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            yield pd.DataFrame({"page_id": f.page_id, "fields": [dict(_parsed(s, u).tables) for u, s in zip(f.url, f.html)]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, fields map<string,string>")


_LINK = r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'


def links(pages: DataFrame) -> DataFrame:
    """(page_id, position, url, text): links in page order, made absolute, each address and text once."""
    href = F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))
    label = F.regexp_extract_all("html", F.lit(_LINK), F.lit(2))
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.arrays_zip(href.alias("href"), label.alias("label"))).alias("position", "l"))
    text = F.trim(F.regexp_replace(F.regexp_replace("l.label", "<[^>]*>", " "), r"\s+", " "))
    out = rows.select("page_id", "position", absolute_url(F.col("base"), F.col("l.href")).alias("url"), text.alias("text"))
    return out.groupBy("page_id", "url", "text").agg(F.min("position").alias("position")).select("page_id", "position", "url", "text")


def absolute_url(base: Column, href: Column) -> Column:
    """An address as seen from a page: absolute, of the same scheme, of the same host, or beside the page."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/|[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), href))
    )


#: Words that tell what a link is for, in the order of precedence.
LINK_KINDS = (
    (r"\.pdf", "pdf"), ("contact|office|service|support|help|beratung", "support_or_contact"), ("sport|culture|association|student|activity|event", "social_or_activity"),
    ("housing|accommodation|living|restaurant|library|infrastructure", "campus_life_resource"),
)


def link_kind(label: Column, url: Column) -> Column:
    s = F.lower(F.concat_ws(" ", label, url))
    out = F.lit("reference")
    for words, kind in reversed(LINK_KINDS):
        out = F.when(s.rlike(words), kind).otherwise(out)
    return out


def is_content_link(label: Column, url: Column) -> Column:
    """No mail, phone or script address, no map, calendar or place within a page, no label of the page frame."""
    u, t = F.lower(F.trim(url)), F.lower(F.trim(label))
    return ~((u == "") | u.rlike("^(?:mailto:|tel:|javascript:)") | u.rlike("/map|agenda|calendar|#") | t.isin("back", "quick links", "schnellzugriff", "fr", "de", "en", "map & orientation", "maps/orientation", "agenda"))


def is_page_address(url: Column, host_suffix: str) -> Column:
    """An address of the host (or below) that is no file to download."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return F.endswith(host, F.lit(host_suffix)) & ~F.lower(url).rlike(r"\.(?:pdf|docx?|xlsx?|zip|jpe?g|png)(?:\?|$)")


def is_relevant(label: Column, url: Column, wanted: list[str], unwanted: list[str], prefixes: list[str] = ()) -> Column:
    s = F.lower(F.concat_ws(" ", label, url))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(s, w))
    allowed = F.lit(True) if not prefixes else F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(path, p))
    return allowed & has(wanted) & ~has(unwanted)


def reachable(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(url, depth) of pages within ``depth`` links of the seeds; ``edges``: source, target. Each page at its least depth.

    Every level is written to the shared folder, so that a level costs two joins, however deep it lies; pages seen before are pruned by an
    anti join, and the walk ends with the first level that is empty. Null addresses are no pages.
    """
    seen = frontier = persist_shared(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)), "level-0")
    for d in range(1, depth + 1):
        step = frontier.join(edges, F.col("url") == F.col("source")).select(F.col("target").alias("url")).where("url is not null").distinct()
        frontier = persist_shared(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)), f"level-{d}")
        if frontier.isEmpty():
            forget(frontier)
            break
        seen = seen.unionByName(frontier)
    return seen


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, path): names from the root joined by " > "; ``nodes``: id, parent (null at roots), name.

    Levels are followed until one is empty, however deep the tree; every level is written to the shared folder. Nodes that
    no root leads to have no path. An id that is met again, which no tree has, is an error.
    """
    level = persist_shared(nodes.where("parent is null").select("id", F.col("name").alias("path")), "tree-level")
    out, met, total = level, level.count(), nodes.count()
    while True:
        below = nodes.alias("n").join(level.alias("p"), F.col("n.parent") == F.col("p.id")).select("n.id", F.concat("p.path", F.lit(" > "), "n.name").alias("path"))
        level = persist_shared(below, "tree-level")
        more = level.count()
        if not more:
            return out
        met += more
        if met > total:
            raise ValueError("not a tree")
        out = out.unionByName(level)


def best_title(candidates: Column, unwanted: list[str]) -> Column:
    """The shortest candidate that isn't blank or unwanted; the first of equally short ones."""
    ok = F.filter(candidates, lambda c: (F.trim(c) != "") & ~F.lower(F.trim(c)).isin(*unwanted) if unwanted else (F.trim(c) != ""))
    return F.array_min(F.transform(ok, lambda c, i: F.struct(F.char_length(c).alias("n"), i.alias("i"), c.alias("c"))))["c"]


def url_language(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"/(en|fr|de|it)(?:/|$)", 1), F.lit(""))


def with_language(url: Column, code: str) -> Column:
    """The address with its language part replaced."""
    return F.regexp_replace(url, r"/(?:en|fr|de|it)(?=/|$)", f"/{code}")


def page_key(prefix: str, url: Column) -> Column:
    """A key of host and path: small letters, digits and underscores, 180 at most."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(F.concat(F.lit(prefix + " "), rest)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(180))
