import re
import time
from html import unescape

import pyarrow.parquet as pq
import pytest

from plumbob.llm import html_text as h
from plumbob.llm import queries

SCHEMA = "page_id bigint, url string, html string, text string, n_chars string"
LONG = "Some words that make a sentence of the article, and then some more of them. " * 3


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""), (" \n", ""), ("plain & simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<", "<"), ("a < b <c", "a < b <c"),
        ("<!-- x", ""), ("<script>var a = '<p>x</p>'", ""), ("<p>&lt;b&gt;&nbsp;&eacute;&#x4e2d;&amp;amp;</p>", "<b> é中&amp;"),
        ("<div title='a > b'>x</div>", "x"), ("<div title='a>x</div><p>y", "x\n\ny"), ("<p>one<br>two <b>th</b>ree\n four</p>", "one two three four"),
        ("<title>t</title><body></body>", ""), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\n\nb\n\nc"),
    ],
)
def test_small(html, want):
    assert h.main_text(html) == want


def page(article):
    return (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-ads">'
        '<header><a href="/">Home</a> The site</header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>'
        '<div class="cookie-notice">We use cookies, please accept all of them now or go away.</div><div id="adBox" class="ad">Buy this now</div>'
        f'{article}<aside>Related things</aside><form>Name <input> <button>Send</button></form>'
        '<section class="reader-comments"><h2>Comments</h2><p>' + LONG + "</p></section><footer>&copy; site</footer></body></html>"
    )


@pytest.mark.parametrize(
    "article",
    [
        f"<article><h1>Title</h1><p><b>{LONG}<br><p>{LONG}</p><p>x</p></article>",
        f'<div class="page"><h1>Title</h1><div class="content"><p>{LONG}</p><p>{LONG}</p><p>x</p></div></div>',
        f'<main><header><h1>Title</h1></header><section><p>{LONG}</p></section><section><p>{LONG}</p><div>x</div></section></main>',
        f"<article><h1>Title</h1><div class=ad>Buy</div><p>{LONG}</p><nav><a href=x>next</a></nav><p>{LONG}<p>x<footer>by me</footer></article>",
    ],
)
def test_article_alone(article):
    line = " ".join(LONG.split())
    assert h.main_text(page(article)) == f"Title\n\n{line}\n\n{line}\n\nx"


def test_short_article():
    assert h.main_text(page("<article><h1>T</h1><p>x y</p></article>")) == "T\n\nx y"


def test_density():
    assert h.density(0, 5, 0, 0, 0, 0) == 0
    assert h.density(1000, 5, 0, 0, 0, 1000) > h.density(1000, 50, 0, 0, 0, 1000) > 0
    assert h.density(1000, 5, 0, 0, 100, 1000) > h.density(1000, 5, 900, 4, 900, 1000)


def test_odd_pages_end():
    begin = time.time()
    for odd in ("<" * 50_000, "<a href='" * 20_000, "<div>" * 50_000 + "x", "<p>" * 50_000, "<li>" * 30_000 + "</ul>", "<!--" * 50_000, "</p>" * 50_000, "&" * 99_999, "<b>" * 20_000 + "<p>" * 100 + "x"):
        h.main_text(odd)
    assert time.time() - begin < 30


def article(html):
    """What the test pages' own markup holds: the heading and the paragraphs of the article."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br>" in p else "", p)).split()) for p in parts)
    return "\n\n".join(b for b in blocks if b)


def test_query_over_the_table(spark, data):
    t = {r["page_id"]: r for r in pq.read_table(f"{data}/pages.parquet").to_pylist()}
    got = queries.op8_article_text(spark, data).collect()
    assert len(got) == len(t)
    for r in got:
        assert (r.url, r.n_chars) == (t[r.page_id]["url"], len(r.text))
        assert r.text == article(t[r.page_id]["html"])


def test_tables(frame):
    rows = [(1, None, None), (None, "u", "<p>a"), (2, "v", "<p>b"), (2, "v", "<p>b")]
    got = sorted(map(tuple, h.extract_text(frame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "a", 1), (2, "v", "b", 1), (2, "v", "b", 1)], key=str)
    assert h.extract_text(frame([], SCHEMA)).count() == 0


def test_article_over_sibling_divs():
    line = " ".join((LONG * 2).split())
    half = lambda k: f"<h2>Part {k}</h2>" + f"<p>{LONG * 2}</p>" * 3
    want = "\n\n".join(f"Part {k}\n\n{line}\n\n{line}\n\n{line}" for k in (1, 2, 3))
    menu = '<div><a href="/a">One of the links</a> <a href="/b">Another of the links</a></div>'
    assert h.main_text(page("".join(f"<div>{half(k)}</div>" for k in (1, 2, 3)))) == want
    # A part in a wrapper that links thin out, and one whose kind is main.
    split = f"<div>{half(1)}</div><div>{menu * 20}<div>{half(2)}</div></div><div><main>{half(3)}</main></div>"
    assert h.main_text(page(split.replace("main>", "center>"))) == want


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="content no-sidebar">{}</div>', '<div id="page-with-sidebar">{}</div>', '<div class="layout header-fixed">{}</div>',
        '<div class="search-results-page"><div class="hasComments">{}</div></div>', '<section class="main menu-open" role="main search">{}</section>',
    ],
)
@pytest.mark.parametrize("kind", ["article", "main", "div"])
def test_named_wrappers(wrapper, kind):
    line = " ".join(LONG.split())
    inner = f"<{kind}><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></{kind}>"
    assert h.main_text(page(wrapper.format(inner))) == f"Title\n\n{line}\n\n{line}"


def test_long_layout_beside_a_short_article():
    line = " ".join(LONG.split())
    text = f'<div class="page-sidebar-left"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>'
    assert h.main_text(f"<body>{text}<article>A teaser</article></body>").startswith(f"T\n\n{line}\n\n{line}")


def test_long_comments_are_left_out():
    thread = '<div class="comments">' + f"<p>{LONG}</p>" * 20 + "</div>"
    related = f'<div class="related"><article><p>{LONG}</p></article></div>'
    line = " ".join(LONG.split())
    assert h.main_text(page(f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article>{related}{thread}")) == f"T\n\n{line}\n\n{line}"


def plain(html):
    """The page with every element that names a part of a page as a div, without classes, ids and roles."""
    html = re.sub(r"<(/?)(?:article|nav|footer|header|main|aside|section|h1)\b[^>]*>", r"<\1div>", html)
    return re.sub(r' (?:class|id|role)="[^"]*"', "", html)


def pages(folder):
    return [html for html in pq.read_table(f"{folder}/pages.parquet").column("html").to_pylist() if html]


def test_pages_whose_markup_names_nothing(data, monkeypatch):
    table = pages(data.replace("sf0.001", "sf0.01"))
    right = sum(h.main_text(plain(html)) == article(html) for html in table)
    assert right >= 0.95 * len(table)
    for other in (lambda *a: 0.0, lambda *a: 1.0, lambda chars, *a: float(chars)):
        monkeypatch.setattr(h, "density", other)
        assert sum(h.main_text(plain(html)) == article(html) for html in table) < right


def chosen_plainly(html):
    """The chosen blocks' text, from the definitions alone, each node by itself; for pages without names."""
    tree = h.Tree(html)
    children = lambda i: [c for c in tree.content[i] if not isinstance(c, str)]
    dropped = lambda i: tree.kind[i] in ("head", "script", "style", "title")

    def under(i):
        return [i] + [d for c in children(i) if not dropped(c) for d in under(c)]

    def size(i):
        return sum(len("".join(t.split())) for d in under(i) for t in tree.content[d] if isinstance(t, str))

    def mark(i):
        return all(tree.kind[d] in h.INLINE or tree.kind[d] == "a" for d in under(i)) and tree.kind[i] != "a"

    body = tree.kind.index("body")

    def links(i):
        return [d for d in under(i) if tree.kind[d] == "a"]

    def dense(i):
        tags = sum(not mark(d) for d in under(i)) - (not mark(i))
        return h.density(size(i), tags, sum(map(size, links(i))), len(links(i)), sum(map(size, links(body))), size(body))

    of = {i: dense(i) for i in under(body)}
    kids = {i: [c for c in children(i) if c in of] for i in of}
    total = {i: sum(of[c] for c in kids[i] if not mark(c)) for i in of}
    best = max((i for i in of if not mark(i) and size(i)), key=lambda i: (total[i], of[i], -i))
    way = [best]
    while way[-1] != body:
        way.append(tree.parent[way[-1]])
    least = min(of[i] for i in way)
    usual = sum(of[c] * size(c) for c in kids[best]) / max(1, sum(map(size, kids[best])))
    kept = set(under(best))
    for i in of:
        if i not in way and of[i] >= least and max(max(of[d], total[d]) for d in under(i)) >= usual:
            kept |= set(under(i))
    return "".join("".join(t.split()) for i in sorted(kept) for t in tree.content[i] if isinstance(t, str))


def test_choice_against_plain_code(data):
    some = [plain(html) for html in pages(data) if len(html) < 4000]
    some.append(f"<body><div><p>{LONG}<p>{LONG}</div><div><a href=x>{LONG}</a><p>a b</div><div><i>{LONG}</i><p>c</div></body>")
    assert len(some) > 5
    for html in some:
        assert sorted("".join(h.main_text(html).split())) == sorted(chosen_plainly(html))
