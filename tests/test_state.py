from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webmill.functions import cookies as C
from webmill.operators import queue, sessions, stats
from webmill.schemas import COOKIE

NOW = datetime(2024, 1, 1, 12)


def cookie(spark, header, domain=None):
    d = F.lit(domain).cast("string")
    return spark.range(1).select(C.parse_set_cookie(F.lit(header), F.lit(NOW), d).alias("c")).first().c


def test_set_cookie(spark):
    c = cookie(spark, "a=b=c; Domain=.x.org; Path=/p; HttpOnly; Secure; SameSite=LAX; Max-Age=60; Expires=Wed, 21 Oct 2015 07:28:00 GMT")
    assert (c.name, c.value, c.domain, c.path, c.http_only, c.secure, c.same_site) == ("a", "b=c", "x.org", "/p", True, True, "Lax")
    assert c.expires == datetime(2015, 10, 21, 7, 28)
    assert cookie(spark, "a=1; Expires=Wed, 21 Oct 2015 07:28:00 GMT; max-age=60").expires == NOW + timedelta(minutes=1)
    assert cookie(spark, "a=1", "d.org").domain == "d.org" and cookie(spark, "a=1; samesite=odd").same_site is None
    assert cookie(spark, "=x") is None and cookie(spark, "nothing") is None and cookie(spark, "a=1; max-age=x").expires is None


def test_jar_and_headers(spark):
    df = spark.range(1).select(F.array(C.parse_set_cookie(F.lit("a=1"), F.lit(NOW)), C.parse_set_cookie(F.lit("b=2; domain=x.org"), F.lit(NOW)), C.parse_set_cookie(F.lit("c=3; max-age=-1"), F.lit(NOW))).alias("jar"), F.create_map(F.lit("H"), F.lit("v")).alias("h"))
    now = F.lit(NOW)
    got = df.select(C.cookie_header("jar", F.lit("www.x.org"), now).alias("x"), C.cookie_header("jar", F.lit("y.org"), now).alias("y"), C.all_headers("h", "jar", F.lit("y.org"), now).alias("all"), F.size(C.set_cookie("jar", C.parse_set_cookie(F.lit("a=9"), now))).alias("n"), C.get_cookie("jar", "b").alias("b"), C.remove_header("h", "H").alias("none"), C.set_header("h", "H", "w").alias("set")).first()
    assert (got.x, got.y, got["all"], got.n, got.b.value, got.none, got["set"]) == ("a=1; b=2", "a=1", {"H": "v", "Cookie": "a=1"}, 3, "2", {}, {"H": "w"})


def test_session_health_is_the_fold(spark):
    import random

    rnd, rows = random.Random(2), []
    for s in range(6):
        rows += [(f"s{s}", i, rnd.random() < [0.1, 0.5, 0.7, 0.9, 1, 0][s]) for i in range(60)]
    got = {r.session_id: tuple(r)[1:] for r in sessions.health(spark.createDataFrame(rows, "session_id string, seq int, ok boolean")).collect()}
    for s in {r[0] for r in rows}:
        score, blocked = 0.0, False
        for _, _, ok in (r for r in rows if r[0] == s):
            score = max(0.0, score - 0.5) if ok else score + 1
            blocked |= not ok and score >= 8
        assert got[s] == (60, score, blocked)


def test_session_pool(spark):
    schema = "id string, created_at timestamp, usage_count int, max_usage_count int, is_blocked boolean, error_score double, cookies array<struct<name:string,expires:timestamp>>"
    rows = [("old", NOW - timedelta(hours=2), 0, 5, False, 0.0, []), ("used", NOW - timedelta(minutes=3), 5, 5, False, 0.0, []), ("blocked", NOW - timedelta(minutes=2), 0, 5, True, 9.0, []), ("expired", NOW - timedelta(minutes=2), 0, 5, False, 0.0, [("c", NOW - timedelta(1))]), ("good", NOW - timedelta(minutes=1), 1, 5, False, 0.5, [("c", None)])]
    df, now = spark.createDataFrame(rows, schema), F.lit(NOW)
    assert [r.id for r in sessions.clean_up(df, now).collect()] == ["good"]
    assert {r.id for r in sessions.restore(df, now).collect()} == {"old", "good"}
    assert sessions.pick(df, now).first().id == "old" and sessions.oldest(df, now).first().id == "old"
    new = spark.createDataFrame([("new", NOW, 0, 5, False, 0.0, [])], schema)
    assert {r.id for r in sessions.add(df, new, now, most=5).collect()} == {"used", "blocked", "expired", "good", "new"}
    s = stats.session_pool_stats(df, sessions.usable(now)).first()
    assert (s.total, s.usable, s.blocked, s.avg_usage) == (5, 2, 1, 1.2)


def test_rate_check(spark):
    rows = [("a", i, i * 1000) for i in range(8)] + [("b", i, 0) for i in range(3)] + [("c", 0, 5)]
    limits = spark.createDataFrame([("a", 5), ("b", 2)], "domain string, per_window int")
    got = {(r.domain, r.seq): (r.in_window, r.over, r.wait_ms) for r in stats.rate_check(spark.createDataFrame(rows, "domain string, seq long, ts_ms long"), limits).collect()}
    assert got["a", 4] == (5, False, 0) and got["a", 5] == (6, True, 55_001) and got["a", 7] == (8, True, 55_001)
    assert got["b", 2] == (3, True, 60_001) and got["c", 0] == (1, False, 0)


def test_headers_of_requests(spark):
    schema = "id string, created_at timestamp, usage_count int, max_usage_count int, is_blocked boolean, error_score double, headers map<string,string>, " + f"cookies array<{COOKIE}>"
    one = ("s", NOW, 0, 5, False, 0.0, {"A": "own"}, [("k", "v", "b", None, None, None, None, None)])
    r = requests(spark)
    got = {x.url: x.headers for x in queue.with_headers(r, {"A": "all", "B": "all"}, spark.createDataFrame([one], schema)).collect()}
    assert got["http://b/"] == {"A": "own", "B": "all", "Cookie": "k=v"} and got["http://c/"] == {"A": "own", "B": "all"}
    assert queue.with_headers(r, {"A": "x"}).first().headers == {"A": "x"}


def requests(spark):
    items = spark.createDataFrame([("http://a/?x=1&y=2", 0, 0.0), ("http://a/?y=2&x=1", 1, 5.0), ("http://b/", 2, 5.0), ("http://c/", 3, 9.0)], "url string, seq long, priority double")
    return queue.make_requests(items)


def test_queue_takes_each_key_once_in_order(spark):
    r = requests(spark)
    new = queue.new_requests(r, r.limit(0))
    assert [x.url for x in queue.next_requests(new, 9).collect()] == ["http://c/", "http://b/", "http://a/?x=1&y=2"]
    assert queue.accepted(r, new) == 0 and queue.accepted(r, r.limit(0), max_size=2) == 2
    again = new.withColumn("state", F.when(F.col("url") == "http://b/", "retrying").otherwise(F.col("state")))
    assert queue.next_requests(again, 1).first().url == "http://b/"


def test_queue_states(spark):
    r = queue.new_requests(requests(spark), requests(spark).limit(0))
    failed = queue.after_failure(r, F.col("url") == "http://c/", 2)
    assert {x.url: (x.state, x.retry_count) for x in failed.collect()}["http://c/"] == ("retrying", 2)
    assert {x.state for x in queue.after_failure(failed, F.col("retry_count") > 0).collect()} == {"pending", "failed"}
    busy = queue.mark(r, r.filter("url = 'http://b/'"), "processing")
    back = queue.reclaim(busy)
    assert back.filter("state = 'processing'").count() == 0 and back.filter("url = 'http://b/'").first().seq > 3
    assert queue.drop(r, r.filter("url = 'http://b/'")).count() == 2 and queue.snapshot(busy).count() == 2
    s = stats.queue_stats(busy).first()
    assert (s.pending, s.in_progress, s.total) == (2, 1, 3)
    assert queue.clone(r).join(r, "id").count() == 0
    kids = queue.children(r.filter("url = 'http://b/'"), r.filter("url = 'http://b/'").select(F.col("id").alias("parent_id"), F.lit("http://b/k").alias("url")))
    assert kids.first().depth == 1 and queue.lineage(r.unionByName(kids)).filter("url = 'http://b/k'").first().parent_url == "http://b/"


def test_small_formulas(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(stats.throughput(F.lit(120), F.lit(60_000))) == (120.0, 2.0) and one(stats.throughput(F.lit(1), F.lit(0))) == (0.0, 0.0)
    assert one(stats.progress_percent(F.lit(1), F.lit(3))) == 33 and one(stats.progress_percent(F.lit(1), F.lit(0))) == 0
    assert one(stats.success_rate(F.lit(0), F.lit(0))) == 1.0 and one(stats.running_average(F.lit(10.0), F.lit(1))) == 5.0
    assert one(stats.autoscaled(F.lit(5), F.lit(3.0), F.lit(0.95), F.lit(100))) == 6 and one(stats.autoscaled(F.lit(5), F.lit(0.0), F.lit(0.4), F.lit(100))) == 4
    empty = spark.createDataFrame([], "duration_ms long")
    assert tuple(stats.response_stats(empty).first()) == (0, None, None, None, None)


def test_log_lines_are_capped_before_agents_are_chosen(spark):
    logs = spark.createDataFrame([("j", i, i, i % 2) for i in range(600)], "job_id string, ts int, seq int, agent_id int")
    assert stats.last_lines(logs).count() == 500 and stats.last_lines(logs, agent_id=1).count() == 250


@pytest.mark.parametrize("windows", [(1000, 60_000)])
def test_windows_include_both_ends(spark, windows):
    got = stats.trailing_counts(spark.createDataFrame([("a", 0), ("a", 1000), ("a", 60_000), ("a", 60_001)], "d string, t long"), "d", "t", windows).orderBy("t").collect()
    assert [(r.in_1000, r.in_60000) for r in got] == [(1, 1), (2, 2), (1, 3), (2, 3)]
