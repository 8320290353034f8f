import pytest
from pyspark.sql import functions as F

from webmill.plans import jobs, queries
from webmill.plans.crawl import Config, crawl
from webmill.sources import tables
from webmill import schemas
from webmill.streaming import live


def site(spark):
    page = lambda *links: "".join(f'<a href="{x}">t</a>' for x in links)
    rows = [
        (1, "https://a.org/", page("/b", "/c", "/q?y=2&x=1", "https://z.com/", "/secret"), 200),
        (2, "https://a.org/b", page("/d", "/"), 200),
        (3, "https://a.org/c", page("/d", "/q?x=1&y=2", "/b#frag", "/missing"), 200),
        (4, "https://a.org/d", page("/e", "/flaky"), 200),
        (5, "https://a.org/q?x=1&y=2", page("/"), 200),
        (6, "https://a.org/e", page("/f"), 200),
        (7, "https://a.org/f", page(), 200),
        (8, "https://a.org/flaky", page("/never"), 503),
        (9, "https://z.com/", page("/z"), 200),
        (10, "https://a.org/secret", page("/x"), 200),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, status int")


ROBOTS = "User-agent: *\nDisallow: /secret"


def test_crawl_of_a_small_site(spark):
    corpus = tables.corpus(site(spark))
    robots = spark.createDataFrame([("a.org", ROBOTS)], "host string, body string")
    seeds = spark.createDataFrame([("https://a.org/",)], "url string")
    r = crawl(seeds, corpus, Config(max_pages=None, max_depth=3), robots)
    state = {x.url: (x.state, x.depth) for x in r.requests.collect()}
    assert state == {
        "https://a.org/": ("completed", 0), "https://a.org/b": ("completed", 1), "https://a.org/c": ("completed", 1), "https://a.org/q?y=2&x=1": ("completed", 1), "https://a.org/secret": ("blocked", 1),
        "https://a.org/d": ("completed", 2), "https://a.org/missing": ("completed", 2), "https://a.org/e": ("completed", 3), "https://a.org/flaky": ("failed", 3),
    }
    tries = {x.url: x.n for x in r.responses.groupBy("url").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert tries["https://a.org/flaky"] == 3 and tries["https://a.org/"] == 1
    r = crawl(seeds, corpus, Config(max_pages=None, max_depth=3, double_retry=True), robots)
    assert r.responses.filter("url = 'https://a.org/flaky'").count() == 2


def test_budget_depth_and_hooks(spark):
    corpus, seeds = tables.corpus(site(spark)), spark.createDataFrame([("https://a.org/",)], "url string")
    assert crawl(seeds, corpus, Config(max_pages=3)).responses.count() == 3
    assert crawl(seeds, corpus, Config(max_depth=0)).responses.count() == 1
    r = crawl(seeds, corpus, Config(same_domain_only=False, strategy="all", max_depth=1))
    assert "https://z.com/" in {x.url for x in r.requests.collect()}
    r = crawl(seeds, corpus, Config(max_depth=1), transform=lambda d: d.filter("url LIKE '%/b'"))
    assert {x.url for x in r.requests.collect()} == {"https://a.org/", "https://a.org/b"}
    nothing = crawl(seeds.limit(0), corpus, Config())
    assert nothing.requests.count() == nothing.responses.count() == nothing.links.count() == 0


def test_config_bounds():
    assert Config().update(page_delay_ms=100).per_minute == 600 and Config().per_second == 10
    for bad in ({"agents": 0}, {"agents": 21}, {"page_delay_ms": -1}, {"max_pages": 0}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_jobs_are_tables(spark, tmp_path):
    history = spark.createDataFrame([("a.org", "GET", "https://a.org/f", None), ("a.org", "POST", "https://a.org/x", None)], schemas.HISTORY)
    corpus = tables.corpus(site(spark))
    here = jobs.Jobs(spark, str(tmp_path / "jobs"))
    here.run("j", "https://a.org/", corpus, Config(max_depth=1, agents=2), history=history)
    row = jobs.Jobs(spark, str(tmp_path / "jobs")).now().first()
    assert (row.id, row.status, row.crawled, row.host) == ("j", "completed", 6, "a.org")
    assert {a.status for a in jobs.agents(here.now()).collect()} == {"completed"}
    assert here.lines("j").count() >= 3 and {e.type for e in here.events.load().collect()} == {"crawl:started", "crawl:completed"}
    here.set_status("j", "cancelled")
    assert {a.status for a in jobs.agents(here.now()).collect()} == {"stopped"}
    here.clear_completed()
    assert here.now().count() == 0
    with pytest.raises(ValueError):
        here.run("k", "nonsense", corpus)
    with pytest.raises(ValueError):
        here.set_status("j", "paused")
    here.set_config(agents=3, max_depth=2, respect_robots=False)
    assert (here.config().agents, here.config().max_depth, here.config().respect_robots) == (3, 2, False)


def test_a_job_is_paused_and_goes_on(spark, tmp_path):
    corpus, here = tables.corpus(site(spark)), jobs.Jobs(spark, str(tmp_path / "jobs"))
    log = here.log

    def pause_at_two(job, line, *rest):
        log(job, line, *rest)
        if line.startswith("round 2"):
            here.put(job, status="paused")

    here.log = pause_at_two
    half = here.run("j", "https://a.org/", corpus, Config(max_pages=None, max_depth=3))
    assert half.rounds == 1 and here.status("j") == "paused"
    here.log = log
    rest = here.run("j", "https://a.org/", corpus, Config(max_pages=None, max_depth=3), previous=half)
    whole = crawl(spark.createDataFrame([("https://a.org/",)], "url string"), corpus, Config(max_pages=None, max_depth=3))
    state = lambda r: sorted((x.url, x.state, x.depth) for x in r.requests.collect())
    assert state(rest) == state(whole) and here.status("j") == "completed"


def test_scope_handlers_extractors_and_content_types(spark):
    from webmill.functions.predicates import Router

    pages = site(spark).withColumn("content_type", F.when(F.col("url") == "https://a.org/c", "text/plain").otherwise("text/html; charset=utf-8"))
    corpus, seeds = tables.corpus(pages), spark.createDataFrame([("https://a.org/",)], "url string")
    r = crawl(seeds, corpus, Config(max_depth=2))
    assert "https://a.org/missing" not in {x.url for x in r.requests.collect()}  # only /c, which is no HTML, leads there
    r = crawl(seeds, corpus, Config(max_depth=1, same_domain_only=False, strategy="all", in_scope_only=True, deny=("z.*",)))
    assert "https://z.com/" not in {x.url for x in r.requests.collect()}
    router = Router().glob("https://a.org/?", "letter").otherwise("rest")
    extra = lambda html, url: F.array(F.struct(F.lit(12).alias("rank"), F.lit("/extra").alias("raw"), F.lit("link").alias("source"), F.lit(None).cast("string").alias("text")))
    r = crawl(seeds, corpus, Config(max_depth=1), router=router, handlers={"letter": lambda d: d.select("url", F.length("html").alias("n"))}, extractors=(extra,))
    assert {x.url for x in r.records["letter"].collect()} == {"https://a.org/b", "https://a.org/c"}
    assert "https://a.org/extra" in {x.url for x in r.requests.collect()}


def test_job_views(spark):
    rows = spark.createDataFrame([("1", "u", "h", "running", 1, 10, 0, None, None, 2, None), ("2", "u", "h2", "cancelled", 1, 0, 0, None, None, None, "t")], schemas.JOBS)
    live_rows = spark.createDataFrame([("1", 20, 5)], "id string, discovered long, crawled long")
    assert [(r.id, r.discovered, r.progress) for r in jobs.with_live(rows, live_rows).orderBy("id").collect()] == [("1", 20, 25), ("2", 0, 0)]
    assert jobs.active(rows).count() == 1 and jobs.by_host(rows, "h").count() == 1 and jobs.agents(rows).count() == 7
    slots = spark.createDataFrame([("1", 2, "running")], "job_id string, agent_id int, status string")
    assert {(a.agent_id, a.status) for a in jobs.agents(rows.filter("id = '1'"), slots).collect()} == {(1, "idle"), (2, "running")}
    assert jobs.page(rows, 2, 1, "id").first().id == "2"
    with pytest.raises(ValueError):
        jobs.page(rows, 0)
    logs = spark.createDataFrame([("WARN",), ("odd",), (None,)], "level string")
    assert jobs.at_least(logs, "warn").count() == 1


def test_store_by_project(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "jobs"), "id string, n int", {"n": 7})
    assert store.load().count() == 0
    store.switch_project("p1").save(spark.createDataFrame([("a", None)], "id string, n int"))
    store.append(spark.createDataFrame([("b", 1)], "id string, n int"))
    assert {tuple(r) for r in store.load().collect()} == {("a", 7), ("b", 1)}
    assert store.switch_project("p2").load().count() == 0
    (tmp_path / "x.json").write_text('[{"id": "q",\n"n": 2}]')
    assert tables.load_json(spark, str(tmp_path / "x.json"), "id string, n int").first() == ("q", 2)


def test_history_seeds(spark):
    from datetime import datetime

    at = lambda n: datetime(2024, 1, n)
    h = spark.createDataFrame([("h", "GET", "u2", at(2)), ("h", "GET", "u1", at(1)), ("h", "GET", "u2", at(3)), ("h", "POST", "u3", at(1)), ("g", "GET", "u4", at(1)), ("h", "GET", " ", at(1)), ("h", "GET", None, at(1))], schemas.HISTORY)
    assert [r.url for r in tables.history_seeds(h, "h").collect()] == ["u1", "u2"] and tables.history_seeds(h, " ").count() == 0


def test_history_seeds_query_has_a_url_as_often_as_pages_do(spark, tmp_path):
    rows = [(1, "http://a.org/x", "p"), (2, "http://b.org/x", "p"), (3, "http://a.org/x", "q"), (4, "http://a.org/y", "p")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.url for r in queries.s3_history_seeds(spark, str(tmp_path)).collect()) == ["http://a.org/x", "http://a.org/x", "http://a.org/y"]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.s3_history_seeds(spark, f"{tmp_path}/none").count() == 0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("n.org", 443, True, "/a.js", True), ("n.org", 443, True, "/", True), ("n.org", 443, True, "/b", True), ("out.org", 80, False, "/", False), ("busy.org", 80, False, "/", True), ("p.org", 8080, False, "/", True)]
    spark.createDataFrame(rows, "host string, port int, tls boolean, path string, in_scope boolean").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("host string, port int, tls boolean, path string, in_scope boolean").parquet(str(src))
    busy = spark.createDataFrame([("busy.org",)], "host string")
    started = []
    q = live.start_crawls(live.triggers(stream, busy, "req.url.ncont:zzz"), started.append, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(started) == ["http://p.org:8080", "https://n.org"]


def test_stateful_streams_agree_with_batches(spark, tmp_path):
    from webmill.operators import sessions

    outcomes = spark.createDataFrame([("s", i, i % 3 == 0) for i in range(20)], "session_id string, seq long, ok boolean")
    outcomes.coalesce(1).write.parquet(str(tmp_path / "o"))
    stream = spark.readStream.schema(outcomes.schema).parquet(str(tmp_path / "o"))
    q = live.session_health(stream).writeStream.format("memory").queryName("health").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert tuple(spark.table("health").first()) == tuple(sessions.health(outcomes).first())


def test_a_crawl_works_out_the_keys_of_its_corpus_once(spark, monkeypatch):
    from webmill.plans import crawl as module

    plans, fetch = [], tables.fetch
    monkeypatch.setattr(module, "fetch", lambda r, c: plans.append(c._jdf.queryExecution().optimizedPlan().toString()) or fetch(r, c))
    pages = spark.createDataFrame([(1, "https://a.org/", '<a href="/b">t</a>', 200), (2, "https://a.org/b", "", 200)], "page_id long, url string, html string, status int")
    got = crawl(spark.createDataFrame([("https://a.org/",)], "url string"), tables.corpus(pages), Config(respect_robots=False))
    assert sorted(r.url for r in got.requests.collect()) == ["https://a.org/", "https://a.org/b"]
    assert len(plans) == 2 and not any("Aggregate" in p for p in plans)
