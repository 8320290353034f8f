"""Links by one search for all tags are those of a search for each tag."""

import random

import pytest
from pyspark.sql import functions as F

from webmill.functions import html as H
from webmill.functions.urls import let
from webmill.operators import links as L

TAGS = tuple(H._TAGS)


def soup(rnd):
    """Tags, some broken: quotes that don't pair up, angle brackets within tags, attributes within values."""
    names = [*TAGS, "a", "p", "linkx", "IMG", "Form"]
    value = lambda: rnd.choice(['"{}"', "'{}'", "{}", '"{}', "{}'"]).format(rnd.choice(["u1", "/a/b?x=1", "", " ", "x>y", "it's", "src=", 'say "src=', "5; url=n.html", "i1.png 1x, i2.png 2x", "q=", "<b", "url=", "a/"]))
    attr = lambda: rnd.choice(["src", "href", "action", "data", "srcset", "content", "alt", "title", "SRC", "data-src", "rel"]) + rnd.choice(["=", " = ", "", "= "]) + value()
    tag = lambda: rnd.choice(["<", "<", "<", "< ", "</"]) + rnd.choice(names) + rnd.choice([" ", "\n", "", "　"]) + " ".join(attr() for _ in range(rnd.randint(0, 3))) + rnd.choice([">", ">", ">", "/>", " />", "", " <"])
    return "".join(rnd.choice([tag(), tag(), " text ", '"', "'", ">", "url(x.png)"]) for _ in range(rnd.randint(1, 12)))


def clean(rnd):
    tag = lambda: f'<{rnd.choice(TAGS)} {rnd.choice(["src", "href", "action", "data", "srcset", "content"])}="{rnd.choice(["u1", "u2 2x,u3", "/p/q", "5; url=n.html", ""])}" alt=\'{rnd.choice(["x", ""])}\'>'
    return "".join(tag() for _ in range(rnd.randint(1, 9)))


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(8)
    made = [soup(rnd) for _ in range(3000)] + [clean(rnd) for _ in range(500)] + ["", "<img", "<img src=\"a\"", '<img alt="x src=" y> "', "<img title='src=\"' x> later \"foo>"]
    return spark.createDataFrame(list(enumerate(made)), "page_id long, html string")


def test_one_search_finds_what_one_for_each_tag_does(spark, pages):
    h = F.col("html")
    full = lambda a: F.transform(F.filter(a, lambda x: x.raw != ""), lambda x: F.struct(x.getField("rank").alias("rank"), x.raw.alias("raw"), x.source.alias("source")))
    both = pages.select("html", full(H._tag_links(h, F.lower(h), TAGS)).alias("once"), full(H._by_pattern(h, TAGS)).alias("each"))
    wrong = both.filter(~F.col("once").eqNullSafe(F.col("each"))).limit(3).collect()
    assert not wrong, wrong
    found = let(H.every(h, H.P.any_tag(TAGS), 0), lambda t: F.when(F.size(t) > 0, ~F.exists(t, lambda x: x.rlike(H.P.UNCLEAR))))
    counts = pages.groupBy(found.alias("plain")).count().collect()
    assert {r.plain: r["count"] for r in counts}[True] > 300  # both ways were taken
    assert both.filter("size(each) > 0").count() > 200


def test_nothing_is_shuffled(spark, pages):
    p = pages.withColumn("url", F.lit("https://h.org/"))
    plan = L.extract_links(p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = L.extract_links(p)
    assert got.groupBy("page_id", "url").count().filter("count > 1").isEmpty()
    first = L.first_links(L.all_links(p)).select(*got.columns)
    assert got.exceptAll(first).isEmpty() and first.exceptAll(got).isEmpty()
