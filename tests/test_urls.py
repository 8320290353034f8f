import random

import pytest
from pyspark.sql import functions as F

from webmill.functions import urls as U

BASE = "https://base.org:8443/dir/page.html?x#y"


def run(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r.o for r in df.select("i", expr(F.col("u")).alias("o")).orderBy("i").collect()]


def test_normalize(spark):
    cases = {
        "https://a.com:443/x/../y?b=2#f": "https://a.com/y?b=2",
        "http://A.com": "http://a.com/",
        "//b.c/d": "https://b.c/d",
        "/p?q": "https://base.org:8443/p?q",
        "?z=1": "https://base.org:8443/dir/page.html?z=1",
        "rel/./x/..": "https://base.org:8443/dir/rel/",
        "../up": "https://base.org:8443/up",
        "HTTP://x.y/": "https://base.org:8443/dir/HTTP://x.y/",
        "JavaScript:x": "https://base.org:8443/dir/JavaScript:x",
        "javascript:x": None, "mailto:a@b": None, "tel:1": None, "data:,": None, "blob:x": None, "#top": None, "": None, "   ": None, None: None,
        "http://": None, "http://a b/": None, "http://a.com:99999/": None,
        "  /trim﻿ ": "https://base.org:8443/trim",
        "/é ü": "https://base.org:8443/%C3%A9%20%C3%BC",
        "/a\tb\n": "https://base.org:8443/ab",
        "/%2e%2E/a%zz": "https://base.org:8443/a%zz",
    }
    assert dict(zip(cases, run(spark, lambda u: U.normalize(u, F.lit(BASE)), list(cases)), strict=True)) == cases


def test_unique_key(spark):
    cases = {
        "https://a.com/?b=2&a=1&a=0&x#f": "GET:https://a.com/?a=0&a=1&b=2&x=",
        "http://a.com/?": "GET:http://a.com/",
        "http://a.com/?x=%zz&y=a+b&&=v": "GET:http://a.com/?=v&x=%25zz&y=a+b",
        "not a url": "GET:not a url",
    }
    assert dict(zip(cases, run(spark, U.unique_key, list(cases)), strict=True)) == cases


def test_key_ignores_the_order_of_parameters(spark):
    rnd, urls = random.Random(1), []
    for _ in range(30):
        pairs = [f"{rnd.choice('abc')}={rnd.randint(0, 3)}" for _ in range(5)]
        urls += ["http://h.com/p?" + "&".join(pairs), "http://h.com/p?" + "&".join(rnd.sample(pairs, 5))]
    keys = run(spark, U.unique_key, urls)
    assert keys[::2] == keys[1::2]


def test_hosts_origins_and_domains(spark):
    values = ["http://A.b.co.uk:80/x", "https://1.2.3.4:8080", "nope", "http://[::1]/", "http:\\\\c.d\\e"]
    assert run(spark, U.url_host, values) == ["a.b.co.uk", "1.2.3.4", None, "[::1]", "c.d"]
    assert run(spark, U.url_origin, values) == ["http://a.b.co.uk", "https://1.2.3.4:8080", None, "http://[::1]", "http://c.d"]
    assert run(spark, U.url_domain, values)[2] == "nope"
    assert run(spark, lambda u: U.root_domain(U.url_host(u)), values)[:2] == ["co.uk", "3.4"]
    assert run(spark, U.robots_url, values)[1] == "https://1.2.3.4:8080/robots.txt"
    assert run(spark, U.is_valid, values) == [True, True, False, True, True]
    assert run(spark, U.serialize, ["HTTP://X.com/a#F"]) == ["http://x.com/a#F"]


@pytest.mark.parametrize(("port", "tls", "want"), [(443, True, "https://h"), (80, False, "http://h"), (8080, False, "http://h:8080"), (80, True, "https://h:80")])
def test_build_url(spark, port, tls, want):
    assert spark.range(1).select(U.build_url(F.lit("h"), F.lit(port), F.lit(tls))).first()[0] == want
