import pytest
from pyspark.sql import functions as F

from cairn.llm import urls

CASES = [
    ("https://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("https://m.example.org/en/12?x", "m.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://a.com/de/x#y", "a.com", "/de/x", "com/de/", "block"),
    ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
    ("http://a.com/en/", "a.com", "/en/", None, "allow"),
    ("http://acom/de/", "acom", "/de/", None, "allow"),
    ("http://org", "org", "", None, "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("x://h?q://z/", "h", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://a.com\n/de/", "a.com\n", "/de/", None, "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, c[0], None, "x") for i, c in enumerate(CASES)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (url, host, path, rule, verdict) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), url
    assert urls.judge(df.where("false")).count() == 0


def link(href):
    return f'<html><head><LINK href="{href}" rel="canonical"></head>'


PAGES = [
    (1, "http://x.net/1", link("http://a.com/de/1")),  # alias of a blocked address that is no page
    (2, "https://x.net/1#top", None),  # the same node as 1
    (3, "http://x.net/3", '<meta content="0; url=/4" http-equiv=refresh>'),
    (4, "http://x.net/4", link("http://x.net/1")),  # 3 -> 4 -> 1
    (5, "http://y.net/5", link("http://b.com/de/5")),
    (6, "http://y.net/6", link("http://y.net/5") + '<meta http-equiv="refresh" content="3;URL=http://z.org/ok">'),  # block and allow: allow
    (7, "http://q.net/7", link("http://q.net/7")),
    (8, "http://a.com/fr/8", link("http://a.com/de/9")),  # its own rule holds
    (9, "http://r.net/9", None),
    (10, None, link("http://a.com/de/1")),
]


def test_aliases(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://r.net/9", "http://a.com/de/77"), (None, "x"), ("http://r.net/0", "http://r.net/9")], "from_url string, to_url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, redirects=redirects).collect()}
    assert [got[i][1] for i in range(1, 11)] == ["block", "block", "block", "block", "allow", "allow", "allow", "allow", "block", "allow"]
    assert got[1][0] is None and got[8][0] == "com/fr/"
    plain = {r.page_id: r.verdict for r in urls.judge(df, html_col=None).collect()}
    assert plain[1] == "allow" and plain[9] == "allow"


def test_no_python_on_the_executors(spark):
    plan = urls.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("html, target", [("<link rel=canonical href=http://h/p>", "http://h/p"), ("<link href='http://h/' rel='canonical' />", "http://h/"), ("<link rel=stylesheet href=/x><link rel=next>", "")])
def test_canonical_links(spark, html, target):
    assert spark.createDataFrame([(html,)], "h string").select(urls.value_of(F.regexp_extract("h", urls.CANONICAL, 0), urls.HREF)).first()[0] == target


def test_targets(spark):
    page = "HTTP://Site.example/a/b/page.html?x=1#f"
    cases = [
        ("page2.html", "HTTP://Site.example/a/b/page2.html"), ("../x", "HTTP://Site.example/a/x"), ("../../../x/./y/..", "HTTP://Site.example/x/"),
        ("?id=1", "HTTP://Site.example/a/b/page.html?id=1"), ("/r/../s?q#z", "HTTP://Site.example/s?q"), ("//o.example/p", "HTTP://o.example/p"),
        ("https://o.example/?a=1&amp;b=2", "https://o.example/?a=1&b=2"), ("x&#38;y&#x3d;z", "HTTP://Site.example/a/b/x&y=z"), ("mailto:a@b", None), ("#top", None), ("", None), (".", "HTTP://Site.example/a/b/"),
    ]
    df = spark.createDataFrame([(page, t) for t, _ in cases], "p string, t string")
    got = [r[0] for r in df.select(urls.resolved(urls.unescaped(df.t), df.p)).collect()]
    assert got == [w for _, w in cases]


def test_all_links_of_a_page(spark):
    html = """<html><head><BASE href='/sub/'><link rel="alternate canonical" href="one?a&amp;b"><LINK href=two rel=canonical>
      <link rel=stylesheet href=no><meta http-equiv="refresh" content="5; url='http://far.example/x y'"><meta content='0;URL=three' http-equiv=Refresh></head>"""
    df = spark.createDataFrame([(1, "http://h.example/p/q", html, 1), (2, None, html, 1), (3, "http://h.example/z", None, 1), (4, "http://h.example/z", "", 1)], "page_id long, url string, html string, f int")
    got = sorted(r.t for r in urls.links_of(df, "url", "html").collect())
    assert got == ["http://far.example/x", "http://h.example/sub/one?a&b", "http://h.example/sub/three", "http://h.example/sub/two"]


def test_equal_urls_with_conflicting_edges(spark):
    link = "<link rel=canonical href='http://{}/'>".format
    rules = (("block", "bad.example", "/"), ("block", "worse.example", "/"), ("allow", "good.example", "/"))
    rows = [(1, "http://x.example/", link("bad.example")), (2, "http://x.example/", link("good.example")), (3, "http://y.example/", link("worse.example")), (4, "http://y.example/", None), (None, "http://y.example/", "z" * 500_000)]
    df = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r.verdict for r in urls.judge(df, rules).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", None: "block"}
    assert urls.judge(df.where("false"), rules).count() == 0
