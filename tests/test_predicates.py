import pytest
from pyspark.sql import functions as F

from webmill.functions import predicates as P


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "query", "want"),
    [
        ("https://a.com/x?y=1", "", True), ("nope", " ", True), ("nope", "req.host.eq:a", False), ("https://A.com/", "req.host.eq:a.com", True),
        ("https://a.com/x", 'req.path.cont:"/x" AND req.method.eq:GET', True), ("https://a.com/x", "req.path.eq:/x and req.host.ne:a.com", False),
        ("https://a.com/x", "garbage", True), ("https://a.com/x", "req.path.eq:/x OR req.host.eq:b", True), ("https://a.com/x", "resp.host.eq:zzz", True),
        ("https://a.com/x", "REQ.host.eq:a.com", False), ("https://a.com/x", 'req.path.regex:"^/x$"', True), ("https://a.com/x", 'req.path.regex:"("', False), ("https://a.com/x", 'req.path.nregex:"("', True),
        ("https://a.com/x", "req.path.like:%x", True), ("https://a.com/x", "req.path.like:_x", True), ("https://a.com/x", "req.host.like:a_com", True), ("https://a.com/x", "req.host.nlike:a.co", True), ("https://a.com/x", "req.url.ncont:a.com", False),
    ],
)
def test_filter(spark, url, query, want):
    assert one(spark, P.matches_filter(F.lit(url), query)) is want


def test_filter_is_pushed_into_one_condition(spark):
    assert P.parse_clause('req.path.eq : "a\\"b" rest').value == 'a"b'
    assert len(P.parse_filter("req.host.eq:a AND x AND resp.path.cont:b")) == 2


@pytest.mark.parametrize(
    ("link", "base", "domain", "host", "origin"),
    [
        ("https://a.x.com/", "https://b.x.com/", True, False, False), ("https://x.com:8080/", "https://x.com/", True, True, False), ("http://x.com/", "https://x.com/", True, True, False),
        ("https://x.com/a", "https://x.com/b", True, True, True), ("https://y.com/", "https://x.com/", False, False, False), ("bad", "https://x.com/", False, False, False), ("https://y.com/", "bad", True, True, True),
    ],
)
def test_scopes(spark, link, base, domain, host, origin):
    a, b = F.lit(link), F.lit(base)
    assert [one(spark, f(a, b)) for f in (P.same_domain, P.same_hostname, P.same_origin)] == [domain, host, origin]
    assert one(spark, P.in_strategy(a, b, "all", False)) and one(spark, P.in_strategy(a, b)) is domain


def test_router(spark):
    r = P.Router().label("L", "by label").glob("https://x.com/*", "shallow").glob("https://x.com/**", "deep").glob("https://y.com/?", "one").regex("(?i)z", "z").otherwise("rest")
    at = lambda u, label=None: one(spark, r.route(F.lit(u), F.lit(label).cast("string")))
    assert [at("https://x.com/a"), at("HTTPS://x.com/a/b"), at("https://y.com/q"), at("https://y.com/qq"), at("Z"), at("https://x.com/a", "L"), at("https://x.com/a", "none")] == ["shallow", "deep", "one", "rest", "z", "by label", "shallow"]
    assert len(r) == 5 and len(r.remove("z")) == 4 and len(r.clear()) == 0


def test_kinds(spark):
    assert [one(spark, P.is_resource_url(F.lit(u))) for u in ("http://a/x.CSS", "http://a/x.css?v=1", "http://a/x.html")] == [True, False, False]
    assert [one(spark, P.is_page_url(F.lit(u))) for u in ("http://a/x", "http://a.b/x.y/", "http://a/x.php", "http://a/x.zip", "bad")] == [True, True, True, False, None]
    assert [one(spark, P.is_static_resource(F.lit(p))) for p in ("/a.JS", "/a.js?x", "/a")] == [True, False, False]
    assert [one(spark, P.is_success(F.lit(s))) for s in (199, 200, 299, 300)] == [False, True, True, False]
    assert [one(spark, P.should_retry(F.lit(s))) for s in (408, 429, 499, 500)] == [True, True, False, True]
    assert [one(spark, f(F.lit(t))) for f, t in ((P.is_html, "Text/HTML; x"), (P.is_json, "application/ld+json"), (P.is_xml, "image/svg+xml"))] == [True] * 3
    assert one(spark, P.url_class(F.lit("https://a/sitemap-1.xml"), "SITEMAP")) and one(spark, P.in_scope(F.lit("a.x"), ["*.x"], ["b.*"]))
    assert one(spark, P.retry_delay(F.lit(2))) == 4000 and one(spark, P.retry_delay(F.lit(9))) == 30_000 and one(spark, P.remaining_retries(F.lit(4), F.lit(3))) == 0
    assert one(spark, P.can_retry(F.lit(1), F.lit(3), F.lit(False))) and not one(spark, P.can_retry(F.lit(1), F.lit(3), F.lit(True)))


def test_a_table_of_routes_is_the_router(spark):
    import random

    from webmill.operators import routes

    rnd = random.Random(12)
    bit = lambda: rnd.choice(["a", "B", "/", "*", "**", "?", ".", "$", "é", "(", "+", "x=1", "[", "\\"])
    globs = [rnd.choice(["http://h/", "http://H/a", ""]) + "".join(bit() for _ in range(rnd.randint(0, 4))) for _ in range(300)]
    urls = ["http://h/" + "".join(rnd.choice(["a", "b", "/", ".", "é", "x=1", "(", "$", "[", "+"]) for _ in range(rnd.randint(0, 5))) for _ in range(200)] + [None]
    router = P.Router().label("L", "by label").otherwise("rest")
    for i, g in enumerate(globs):
        router.glob(g, f"r{i}")
    table = spark.createDataFrame([(i, None, g, f"r{i}") for i, g in enumerate(globs)] + [(900, "L", None, "by label")], "ord long, label string, glob string, handler string")
    df = spark.createDataFrame([(u, "L" if i % 9 == 0 else None) for i, u in enumerate(urls)], "url string, label string")
    want = sorted(map(repr, df.filter("url IS NOT NULL").select("url", "label", router.route("url", "label").alias("handler")).collect()))
    got = routes.route(df, table, label_col="label", default="rest")
    assert sorted(map(repr, got.filter("url IS NOT NULL").collect())) == want and got.count() == len(urls)
    none = routes.route(df, table.limit(0), label_col="label", default="rest")
    assert {r.handler for r in none.collect()} == {"rest"}


def test_patterns_of_callers_are_checked(spark):
    one = lambda *p: spark.range(1).select(P.matches_any(F.lit("https://a.org/X"), p)).first()[0]
    assert one("(?i)/x$") and one("[", "/X") and not one("[") and not one("/x$") and not one()
