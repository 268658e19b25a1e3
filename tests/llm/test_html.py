import html
import math
import random
import re
from html.parser import HTMLParser

import pytest

from lectern.llm import html_extraction as H


def test_pages_of_the_table(spark, sf_dir):
    got = {r.page_id: r for r in H.digest(H.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1).replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_furniture():
    page = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><nav><a href=a>Menu</a></nav>
    <main><h1>Title &amp; more</h1><div class=content><p>First paragraph of the text, long enough.<p>Second   <a href=y>link</a> and text.
    <ul><li>one<li>two</ul></div><section id="comments"><p>Great post, thanks so much, I enjoyed it a lot.</p></section></main>
    <aside>side</aside><form>f<input></form><script>if (a<b) {}</script><footer>foot</footer></body></html>"""
    assert H.main_text(page) == "Title & more\nFirst paragraph of the text, long enough.\nSecond link and text.\none\ntwo"


def test_headers_of_articles_stay():
    page = '<body><div id="header">Site name</div><article><header class="entry-header"><h1>Title</h1></header><div class="commentary"><p>Body of the text, as it stands.</p></div><div class="post-comments"><p>Nice!</p></div></article></body>'
    assert H.main_text(page) == "Title\nBody of the text, as it stands."


def test_links_fall_out():
    page = "<body><div>" + "<p>Prose of a paragraph that goes on for a while and then some more.</p>" * 4 + "</div><div><ul>" + "<li><a href=x>go</a>" * 30 + "</ul></div></body>"
    assert "go" not in H.main_text(page).split("\n")


def test_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain &lt; text"), (4, "u", "<p>a<p>b"), (4, "u", "<p>a<p>b"), (None, None, "<" * 50), (6, "u", "<b>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' text", "1 n_chars", "2 page_no")
    got = [(r.page_id, r.text) for r in H.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (3, "plain < text"), (4, "a\nb"), (4, "a\nb"), (None, "<" * 50), (6, "deep")], key=str)
    assert H.extract(df.limit(0)).count() == 0


def test_sections_under_body():
    p = "<p>Prose of section {} that goes on for a while, and then for some more, until it ends.</p>"
    section = lambda k, n: f"<section>{p.format(k) * n}</section>"
    page = "<h1>Title</h1>" + section(1, 5) + "<h2>Middle</h2>" + section(2, 7) + "<h2>More</h2>" + section(3, 5) + "<div>" + "<a href=x>go on</a> " * 40 + "</div><h2>After</h2>"
    want = ["Title", *["section 1"] * 5, "Middle", *["section 2"] * 7, "More", *["section 3"] * 5]
    for whole in (f"<html><body>{page}</body></html>", page):
        got = H.main_text(whole).split("\n")
        assert len(got) == len(want) and all(w in g for w, g in zip(want, got))


def test_names_do_not_cut_the_article():
    p = "<p>Prose of the article that goes on for a while, and then for some more.</p>"
    text = "\n".join([p[3:-4]] * 4)
    for name in ("overflow-hidden", "layout no-sidebar", "content has-sidebar", "row social"):
        for body in (f"<article>{p * 4}</article>", f"<main>{p * 4}</main>", p * 4):
            assert H.main_text(f'<body><div class="{name}">{body}</div><div class="sidebar"><p>Aside, of some words.</p></div></body>') == text
            assert H.main_text(f'<body><main><div>{p * 5}</div><div class="{name}">{p * 4}</div></main></body>').count("Prose") == (5 if "social" in name else 9)
    for empty in ('<svg class="i" />', "<math/>"):
        assert H.main_text(f"<body><article>{p * 2}{empty}{p * 2}<svg><text>x</text></svg></article></body>") == text


class Tree(HTMLParser):
    """A plain tree of a well-formed page: [tag, children], texts as strings."""

    def __init__(self, page):
        super().__init__()
        self.root = ["#page", []]
        self.stack = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def brute_density(page):
    """Composite density of every element in document order, each counted anew from its whole subtree."""

    def inside(node, linked=False):
        for c in node[1]:
            if isinstance(c, str):
                yield c, linked or node[0] == "a", None
            else:
                yield None, None, c[0]
                yield from inside(c, linked or node[0] == "a")

    def numbers(node, linked):
        found = list(inside(node, linked))
        size = lambda t: len("".join(t.split()))
        c, lc = sum(size(t) for t, _, _ in found if t), sum(size(t) for t, k, _ in found if t and k)
        return c, lc, max(1, sum(t is not None for _, _, t in found)), max(1, sum(t == "a" for _, _, t in found))

    root = Tree(page).root
    body_c, body_lc, _, _ = numbers(root, False)
    out = []

    def walk(node, linked):
        c, lc, t, lt = numbers(node, linked)
        base = math.log(c / max(1, c - lc) * lc + body_lc / max(1, body_c) * c + math.e)
        out.append(c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / base if c else 0.0)
        for k in node[1]:
            if not isinstance(k, str):
                walk(k, linked or k[0] == "a")

    walk(root, False)
    return out


def nameless_page(r):
    """A page without article, main, nav or telling names: (page, text of its article)."""
    sentence = lambda n: " ".join("".join(r.choices("abcdefghijkl", k=r.randint(3, 8))) for _ in range(n)).capitalize() + "."
    links = lambda n: "".join(f"<div><a>{sentence(2)[:-1]}</a></div>" for _ in range(n))
    blocks = [sentence(r.randint(12, 40)) for _ in range(r.randint(3, 7))]
    inner = "".join(f"<p>{b[: len(b) // 2]}<b>{b[len(b) // 2 :]}</b></p>" if r.random() < 0.3 else f"<p>{b}</p>" for b in blocks)
    side = f"<div>{links(r.randint(6, 15))}</div>"
    small = f"<div><div>{sentence(3)}</div><div><a>{sentence(2)}</a><a>{sentence(2)}</a></div></div>"
    page = f"<html><body><div><div>{links(8)}</div></div><div><div>{side if r.random() < 0.5 else small}</div><div class='x1'>{inner}</div></div><div><div><a>{sentence(2)}</a></div><div><a>{sentence(3)}</a></div></div></body></html>"
    return page, "\n".join(blocks)


def test_densities_are_brute_force():
    r = random.Random(6)
    for _ in range(30):
        page, _ = nameless_page(r)
        got, want = H._densities(H.Page(page))[0], brute_density(page)
        assert len(got) == len(want) and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, want))


def test_density_decides(monkeypatch):
    """Without telling names the article comes from the densities: with all of them zero it is no longer found."""
    r = random.Random(8)
    pages = [nameless_page(r) for _ in range(60)]
    assert all(H.main_text(page) == text for page, text in pages)
    real = H._densities

    def nothing(page):
        density, total, chars, linked = real(page)
        return [0.0] * len(density), [0.0] * len(total), chars, linked

    monkeypatch.setattr(H, "_densities", nothing)
    assert sum(H.main_text(page) == text for page, text in pages) == 0


def test_named_blocks_of_the_article_stay():
    p = "Prose of the article that goes on for a while, and then for some more."
    for tag in ("article", "main"):
        for block in ('<div class="price-tags">Price: 5 and more</div>', '<div class="widget">Part of the text</div>', '<p id="disclaimer">No claims are made</p>', '<p class="notice">Take care here</p>', "<math><mi>x</mi>+1</math>"):
            want = " ".join(re.sub("<[^>]*>", "", block).split())
            assert want in H.main_text(f"<body><{tag}><h1>Title</h1><p>{p}</p>{block}<p>{p}</p></{tag}></body>").split("\n"), block
    listed = f"<article><p>{p}</p><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul><p>{p}</p></article>"
    assert H.main_text(f"<body>{listed}</body>") == f"{p}\nFirst source\nSecond source\n{p}"
    assert H.main_text(f'<body><div class="notice"><p>{p * 3}</p></div><article><p>Short one.</p></article></body>') == "Short one."
    assert H.main_text(f'<body><div class="widget">Join us today, all of you.</div><div>{f"<p>{p}</p>" * 4}</div></body>') == "\n".join([p] * 4)


def test_very_long_page():
    p = "<p>Words of a paragraph in a page that is very long.</p>"
    text = H.main_text(f"<body><article>{p * 40_000}</article>" + "<div>" * 30_000)
    assert len(text) == 40_000 * (len(p) - 6) - 1


PROSE = "This is a long enough paragraph of article prose, with words and more words to read. " * 3


def in_article(x):
    return f"<html><body><nav><a href=a>Home</a> <a href=b>News</a></nav><article><h1>Title</h1><p>{PROSE}</p>{x}<p>{PROSE}</p></article><footer>Imprint</footer></body></html>"


@pytest.mark.parametrize(
    "attrs",
    ['title="a hidden gem"', 'data-hidden="false"', 'data-id="comments"', "data-role='navigation'", 'title="class=ads id=comments"', 'class="related-work"', 'id="social-history"', 'class="reply"', 'id="comments-on-method"', 'class="promotion"', 'class="share-price"'],
)
@pytest.mark.parametrize("tag", ["p", "div", "section"])
def test_words_within_attributes_lose_nothing(tag, attrs):
    assert f"KEPT {PROSE}".strip() in H.main_text(in_article(f"<{tag} {attrs}>KEPT {PROSE}</{tag}>"))


@pytest.mark.parametrize(
    "attrs", ["hidden", 'aria-hidden="true"', "style='display: none'", "ROLE=navigation", 'class="comments"', 'id="comment-list"', 'class="ad-slot"', "class='x  newsletter-signup'", 'class="cookie_banner"']
)
def test_whole_names_cut_within_the_article(attrs):
    assert "GONE" not in H.main_text(in_article(f"<div {attrs}><p>GONE {PROSE}</p></div>"))


def test_density_decides_on_parts_of_names():
    links = '<a href="x">GONE one</a> <a href="y">GONE two</a>'
    assert "GONE" not in H.main_text(in_article(f'<div class="related">{links}</div><div class="share-price">{links}</div>'))
