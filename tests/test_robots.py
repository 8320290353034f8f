import pytest

from webmill.operators import robots as R

BODY = """# c
Disallow: /before
User-agent: a
User-agent: B # two
Disallow: /x
Allow: /x/ok
Crawl-delay: 2.5s
User-agent: *
Disallow: private
Disallow: /*.pdf$
Disallow:
Sitemap: https://h/s1.xml
User-agent: leak
Disallow:
User-agent: zz
Disallow: /tmp*x
sitemap: https://h/s2.xml"""


def verdicts(spark, body, agent, *urls):
    files = spark.createDataFrame([("h.org", body)], "host string, body string")
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    return [r.allowed for r in R.is_allowed(df, files, agent).orderBy("i").collect()]


def test_rules_groups_and_lists(spark):
    files = spark.createDataFrame([("h.org", BODY)], "host string, body string")
    got = {(r.user_agent, r.allow, r.pattern) for r in R.rules(files).collect()}
    assert got == {(a, al, p) for a in "ab" for al, p in ((False, "/x"), (True, "/x/ok"))} | {("*", False, "/private"), ("*", False, "/*.pdf$"), ("leak", False, "/tmp*x"), ("zz", False, "/tmp*x")}
    assert [r.url for r in R.sitemaps(files).orderBy("n").collect()] == ["https://h/s1.xml", "https://h/s2.xml"]
    assert R.crawl_delays(files, "B").first().delay_ms == 2500 and R.crawl_delays(files, "q").count() == 0


@pytest.mark.parametrize(
    ("agent", "path", "want"),
    [("a", "/x", False), ("a", "/x/ok/1", True), ("xBx", "/X/y", False), ("a", "/private", True), ("q", "/private/1", False), ("q", "/a/b.pdf", False), ("q", "/a/b.pdf?x", True), ("q", "/x", True), ("zz", "/tmp1x", False), ("leak", "/tmp1x", False), ("leak", "/private", True)],
)
def test_verdicts(spark, agent, path, want):
    assert verdicts(spark, BODY, agent, "https://h.org" + path) == [want]


def test_ties_and_missing_files(spark):
    tie = "User-agent: *\nAllow: /a\nDisallow: /a\n"
    assert verdicts(spark, tie, "q", "https://h.org/a", "https://other.org/a", "https://h.org/b", None) == [False, True, True, True]
    assert verdicts(spark, "User-agent: *\nDisallow: /", "q", "https://h.org/") == [False]
    assert verdicts(spark, None, "q", "https://h.org/") == verdicts(spark, "", "q", "https://h.org/") == [True]
    files = spark.createDataFrame([("h.org", "User-agent: *\nDisallow: /", False)], "host string, body string, fetch_ok boolean")
    assert R.is_allowed(spark.createDataFrame([("https://h.org/",)], "url string"), files, "q").first().allowed
