from pyspark.sql import functions as F

from webmill.functions.html import Options
from webmill.operators import links as L

PAGE = """<html class=x lang="en"><head><base href="/base/"><title> T &amp; t </title>
<meta name="description" content=" D "><meta name='keywords' content='a, b ,c'><meta name="robots" content="noindex">
<link rel="canonical" href="https://c.org/x"><style>@import "i.css"; .a{background:url('bg.png')}</style>
<script src="s.js"></script><meta http-equiv=refresh content="5; url=next.html"></head><body>
<a class=k href="one.html"> <b>One</b> </a><a href='two.html'>Two</a><a href=three.html>Three</a><a href="one.html">again</a><a href="open.html">
<a data-href="x.html" href="#top">n</a></a><a href="mailto:x@y.zz">m</a>
<img src="i.png" srcset="i1.png 1x, i2.png 2x"><iframe src="f.html"></iframe><area href="ar.html"><video src="v.mp4"><object data="o.swf"></object>
<div data-url="du.html"></div> Mail: Foo.Bar@Example.COM, foo.bar@example.com éx@y.org
<form action="/go" METHOD="post" id="f1"><input name="q" aria-required=1><input type=hidden name='h' value=""><input type="text"><select name="s" required><option value="1">x<option value="2"></select><textarea name=t></textarea></form>
<form><input name=lost></form><form action="javascript:x"></form>
"api/v1/users" 'https://js.org/a'
</body></html>"""


def pages(spark, *html):
    return spark.createDataFrame([(i, f"https://h.org/d{i}/p.html", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_links_of_every_kind(spark):
    got = {r.url.removeprefix("https://h.org"): (r.source, r.text) for r in L.extract_links(pages(spark, PAGE)).collect()}
    assert got["/base/one.html"] == ("anchor", "<b>One</b>")
    for path, source in {"/base/two.html": "anchor", "/base/three.html": "anchor", "/go": "form", "/base/f.html": "iframe", "/base/next.html": "meta", "/base/ar.html": "anchor", "/base/s.js": "script", "https://c.org/x": "link", "/base/i.png": "image", "/base/i1.png": "image", "/base/i2.png": "image", "/base/v.mp4": "link", "/base/o.swf": "link", "/base/bg.png": "css", "/base/i.css": "css", "/base/du.html": "link"}.items():
        assert got[path][0] == source, path
    assert not any("mailto" in u or "js.org" in u for u in got)
    js = L.extract_links(pages(spark, PAGE), Options(js_strings=True, scripts=False))
    kinds = {r.url.removeprefix("https://h.org"): r.source for r in js.collect()}
    assert kinds["https://js.org/a"] == "javascript" and kinds["/base/api/v1/users"] == "javascript" and "/base/s.js" not in kinds


def test_single_quotes_count_for_anchors_only(spark):
    got = {r.url for r in L.extract_links(pages(spark, "<img src='a.png'><a href='b'>x</a><script src=c.js></script>")).collect()}
    assert got == {"https://h.org/d0/b"}


def test_first_link_to_a_url_stays(spark):
    got = L.extract_links(pages(spark, '<img src="x"><a href="x">text</a>')).collect()
    assert [(r.source, r.text) for r in got] == [("anchor", "text")]
    assert L.navigable(L.extract_links(pages(spark, '<img src="x">'))).count() == 0
    assert L.resources(L.extract_links(pages(spark, '<img src="x">'))).count() == 1


def test_forms(spark):
    forms = L.extract_forms(pages(spark, PAGE)).collect()
    assert [(f.action, f.method, f.id, f.name) for f in forms] == [("https://h.org/go", "POST", "f1", None)]
    got = [(i.name, i.type, i.value, i.required, i.options) for i in L.form_inputs(L.extract_forms(pages(spark, PAGE))).orderBy("input_no").collect()]
    assert [g[:4] for g in got] == [("q", "text", None, True), ("h", "hidden", "", False), ("s", "select", "1", True), ("t", "textarea", None, False)]
    assert got[2][4] == ["1", "2"]


def test_emails_and_metadata(spark):
    assert [r.email for r in L.extract_emails(pages(spark, PAGE)).orderBy("n").collect()] == ["x@y.zz", "foo.bar@example.com", "x@y.org"]
    m = L.extract_metadata(pages(spark, PAGE, "")).orderBy("page_id").collect()
    assert m[0][1:] == ("T &amp; t", "D", ["a", "b", "c"], "https://c.org/x", "en", "noindex") and m[1][1:] == (None,) * 6
    og = '<meta property="og:url" content="https://og.org/">'
    assert L.extract_metadata(pages(spark, og)).first().canonical == "https://og.org/"


def test_empty_null_and_combined(spark):
    assert L.extract_links(pages(spark, "", None)).count() == 0
    p = pages(spark, PAGE)
    both = L.combine([L.all_links(p), L.all_links(p)])
    assert both.count() == L.extract_links(p).count()
    m = L.extract_metadata(p)
    assert L.combine_metadata([m, m.withColumn("title", F.lit(None).cast("string")).withColumn("language", F.lit("de"))]).select("title", "language").first() == ("T &amp; t", "de")


def test_enqueue_links_filters_scopes_and_deepens(spark):
    p = pages(spark, '<a href="a">1</a><a href="https://sub.h.org/b">2</a><a href="https://z.com/">3</a>').withColumns({"depth": F.lit(1), "status": F.lit(200)})
    urls = lambda **k: {(r.url, r.depth) for r in L.enqueue_links(p, **k).collect()}
    assert urls() == {("https://h.org/d0/a", 2), ("https://sub.h.org/b", 2)}
    assert urls(strategy="same-hostname") == {("https://h.org/d0/a", 2)}
    assert len(urls(strategy="all", same_domain_only=False)) == 3
    assert urls(max_depth=1) == set()
    assert urls(query="req.host.ne:h.org") == {("https://sub.h.org/b", 2)}
    assert L.enqueue_links(p.withColumn("status", F.lit(404))).count() == 0
    assert L.enqueue_links(p, transform=lambda d: d.limit(1)).count() == 1


def test_all_that_a_page_holds_at_once(spark):
    p = pages(spark, PAGE, '<a href="x">t</a> a@b.org')
    got = L.extract(p)
    same = lambda one, two: sorted(map(repr, one.select(*sorted(one.columns)).collect())) == sorted(map(repr, two.select(*sorted(two.columns)).collect()))
    assert same(got.links, L.extract_links(p)) and same(got.forms, L.extract_forms(p)) and same(got.emails, L.extract_emails(p)) and same(got.metadata, L.extract_metadata(p))
    assert L.extract(p, Options(forms=False, emails=False, metadata=False)).forms is None


def test_results_of_extractors_are_combined(spark):
    one, two = pages(spark, PAGE), pages(spark, '<form action="/second"></form> x@y.zz late@z.org').withColumn("page_id", F.lit(0))
    forms = L.combine_forms([L.extract_forms(one), L.extract_forms(two)]).orderBy("form_no").collect()
    assert [(f.form_no, f.action) for f in forms] == [(0, "https://h.org/go"), (1, "https://h.org/second")]
    emails = L.combine_emails([L.extract_emails(one), L.extract_emails(two)]).orderBy("n").collect()
    assert [(e.n, e.email) for e in emails] == [(0, "x@y.zz"), (1, "foo.bar@example.com"), (2, "x@y.org"), (3, "late@z.org")]
