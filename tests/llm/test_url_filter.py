import random

import pytest

from plumbob.llm import graph, url_filter as uf
from plumbob.llm.queries import URL_RULES

SCHEMA = "page_id bigint, url string, html string, host string, path string, node string"


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_own_rules(frame):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "https://example.org/en/12", "http://example.org/en/2",
        "http://notexample.org/es/", "http://a.com/fr/x", "http://a.com/de", "http://a.com/de/x://y", "http://net.com?x=/fr/", "ÄB://ÄB.org#/",
        "x\ny://org", "mailto:a://b.com/de/",
    ]
    got = verdicts(uf.judge_pages(frame(list(enumerate(urls)), SCHEMA), URL_RULES))
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("www.example.org", "/es/1", "example.org/es/", "block"),
        5: ("example.org", "/en/12", "example.org/en/1", "block"),
        6: ("example.org", "/en/2", "org/", "allow"),
        7: ("notexample.org", "/es/", "org/", "allow"),
        8: ("a.com", "/fr/x", "com/fr/", "allow"),
        9: ("a.com", "/de", None, "allow"),
        10: ("a.com", "/de/x://y", "com/de/", "block"),
        11: ("net.com", "", None, "allow"),
        12: ("Äb.org", "", None, "allow"),
        13: ("org", "", None, "allow"),
        14: ("b.com", "/de/", "com/de/", "block"),
    }


def test_aliases(spark, frame):
    link = '<html><LINK href="{}" rel="canonical">'.format
    rows = [
        (1, "http://a.net/x", link("http://b.net/y")),
        (2, "https://B.net/y#z", "<meta http-equiv='refresh' content='0; URL=http://c.com/de/1'>"),
        (3, "http://c.com/de/1", ""),
        (4, "http://d.net/", link("/e")),
        (5, "http://d.net/e", link("//c.com/fr/2")),
        (6, "http://d.net/f/g", link("../f/h")),
        (7, "http://e.net/", link("http://c.com/de/9")),
        (8, "http://e.net", None),
        (9, "http://c.com/fr/3", link("http://c.com/de/9")),
        (10, "http://f.net/", link("javascript:x()")),
        (11, "http://g.net/a", ""),
        (11, "http://g.net/a", ""),
        (12, None, link("http://c.com/de/9")),
    ]
    redirects = spark.createDataFrame([("http://g.net/a", "http://h.net/"), ("http://h.net/", "http://x.com/de/"), (None, "http://a.net/")], "from_url string, to_url string")
    got = {k: v[3] for k, v in verdicts(uf.judge_pages(frame(rows, SCHEMA), URL_RULES, redirects)).items()}
    # 1-2-3 end at a blocked page; 4-5 and 9-7-8 hold an allowed one; 11 redirects to a blocked one.
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block", 12: "allow"}
    assert uf.judge_pages(frame(rows, SCHEMA), URL_RULES, redirects).count() == len(rows)


def test_empty_and_native(frame):
    df = uf.judge_pages(frame([], SCHEMA), URL_RULES)
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().toString()


def brute(edges):
    up = {}
    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(7, 7), (200, 200)],
        "path": [(i, i + 1) for i in range(40)][::-1],
        "star": [(500, i) for i in range(100, 300)] + [(500, 1)],
        "empty": [],
    }[kind]
    df = spark.createDataFrame([*edges, (None, 1)], "a bigint, b bigint")
    assert {r.node: r.component for r in graph.connected_components(df).collect()} == brute(edges)


def test_decoded(spark):
    from html import unescape

    whole = ["a", "x&amp;y", "&amp;amp;", "&#38;&#x26;&#X26;", "&#128;&#129;", "&#x1F600;", "&eacute;x", "&#0;&#xD800;&#99999999999999999999;", "&nope;", "a&", "&&lt;", "&#00000000000038;", "&quot;&apos;&#233"]
    attribute = {"?a=1&copy=2": "?a=1&copy=2", "?a=1&copyx=2": "?a=1&copyx=2", "?a&amp": "?a&", "?a&copy/": "?a©/"}
    df = spark.createDataFrame([(t,) for t in [*whole, *attribute]], "t string")
    got = {r.t: r.d for r in df.select("t", uf.decoded(df.t).alias("d")).collect()}
    assert {t: got[t] for t in attribute} == attribute
    for t in whole:
        assert got[t].replace("\x81", "") == unescape(t).replace("\x81", ""), t


def test_targets_as_written_in_pages(frame):
    link = '<html><link rel="canonical" href="{}">'.format
    cases = [
        ("http://a.net/1", "http://c.com/de/p?x=1&amp;y=2", "http://c.com/de/p?x=1&y=2"),
        ("http://b.net/f/g", "../de/h", "http://b.net/de/h"),
        ("http://b.net/f/g/", "./../i/../j/.", "http://b.net/f/j/"),
        ("http://d.net/k/l", "?p=2", "http://d.net/k/l?p=2"),
        ("http://e.net", "?p=2", "http://e.net/?p=2"),
        ("http://f.net/a/", "http://c.com/x/../../../de/q", "http://c.com/de/q"),
        ("http://g.net/m", "/n&#47;o&#x2F;p", "http://g.net/n/o/p"),
        ("http://h.net/q", "/r/../s", "http://h.net/t/../s"),
    ]
    rows = [(10 * i, a, link(t)) for i, (a, t, _) in enumerate(cases)] + [(10 * i + 1, b, "") for i, (*_, b) in enumerate(cases)]
    # Each target is blocked by a rule of its own or by its alias.
    rows += [(10 * i + 2, f"http://c.com/de/{i}", link(b.replace("&", "&amp;"))) for i, (*_, b) in enumerate(cases)]
    got = {k: v[3] for k, v in verdicts(uf.judge_pages(frame(rows, SCHEMA), URL_RULES)).items()}
    assert got == dict.fromkeys(got, "block") and len(got) == len(rows)
    refresh = [(1, "http://a.net/x/y", "<meta http-equiv=refresh content='0; url=../z?a=1&amp;b=2'>"), (2, "http://a.net/z?a=1&b=2", link("http://c.com/de/1"))]
    assert {v[3] for v in verdicts(uf.judge_pages(frame(refresh, SCHEMA), URL_RULES)).values()} == {"block"}
