"""Crawls and jobs that outlive a program: committed rounds, versions that hold, settings, files that stay few."""

import pytest
from pyspark.sql import functions as F

from webmill.functions.html import Options
from webmill.operators import robots as R
from webmill.plans import jobs
from webmill.plans.crawl import Config, crawl
from webmill.sources import tables


def a(*urls):
    return "".join(f'<a href="{u}">t</a>' for u in urls)


@pytest.fixture(scope="module")
def site(spark):
    rows = [("https://a.org/", a("/b", "/private/x", "https://other.org/p")), ("https://a.org/b", a("/c")), ("https://a.org/c", a("/d")), ("https://a.org/d", a("/b")), ("https://a.org/private/x", a("/e")),
            ("https://a.org/robots.txt", "User-agent: *\nDisallow: /private\n"), ("https://other.org/p", a("/q")), ("https://other.org/q", "")]
    return tables.corpus(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string"))


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([("https://a.org/",)], "url string")


def told(r):
    of = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    return of(r.requests, "url", "state", "depth", "retry_count"), of(r.responses, "url", "status", "round"), of(r.links, "url", "page_url", "pos")


CONFIG = Config(max_depth=4, strategy="all", same_domain_only=False)


@pytest.fixture(scope="module")
def whole(site, seeds):
    return crawl(seeds, site, CONFIG)


def test_robots_files_are_looked_up_once_for_each_host(spark, whole):
    state = {r.url: r.state for r in whole.requests.collect()}
    assert state["https://a.org/private/x"] == "blocked" and state["https://a.org/d"] == "completed" and "https://a.org/e" not in state
    assert sorted((r.host, r.fetch_ok) for r in whole.robots.collect()) == [("a.org", True), ("other.org", False)]
    assert whole.rounds == 4


def test_a_crawl_goes_on_in_another_session(spark, site, seeds, whole, tmp_path):
    at = str(tmp_path / "crawl")
    half = crawl(seeds, site, CONFIG, at=at, go_on=lambda n, waiting: n < 3)
    assert half.rounds == 2

    def dies(pages):
        raise RuntimeError("the program ends here")

    with pytest.raises(RuntimeError):
        crawl(seeds, site, CONFIG, at=at, after=dies)  # in round 3, which is not committed
    other = spark.newSession()
    again = tables.corpus(other.createDataFrame(site.select("page_id", F.col("page_url").alias("url"), "html").toPandas()))
    rest = crawl(other.createDataFrame([("https://unused.org/",)], "url string"), again, CONFIG, at=at)
    assert told(rest) == told(whole) and rest.rounds == whole.rounds


def test_a_page_budget_is_kept_across_sessions(spark, site, seeds, tmp_path):
    config = Config(max_depth=4, max_pages=3, respect_robots=False)
    crawl(seeds, site, config, at=str(tmp_path / "c"), go_on=lambda n, waiting: n < 2)
    rest = crawl(seeds, site, config, at=str(tmp_path / "c"))
    assert rest.responses.count() == 3 and rest.requests.filter("state = 'pending'").count() == crawl(seeds, site, config).requests.filter("state = 'pending'").count()


def test_settings_come_back_as_they_were(spark, tmp_path):
    here = jobs.Jobs(spark, str(tmp_path / "j"))
    given = {"max_pages": None, "max_depth": None, "query": "req.url.cont:x", "strategy": "same-host", "allow": ("a.org", "*.b"), "deny": (), "headers": {"A": "b"}, "options": Options(forms=False, js_strings=True), "agents": 7, "user_agent": "u", "page_delay_ms": 0, "respect_robots": False, "double_retry": True, "same_domain_only": False, "max_retries": 0, "in_scope_only": True}
    here.set_config(**given)
    assert jobs.Jobs(spark, str(tmp_path / "j")).config() == Config(**given)
    here.set_config(query=None, max_pages=5)
    assert here.config() == Config(**given | {"query": None, "max_pages": 5})
    for wrong in ({"agents": 0}, {"no_such": 1}):
        with pytest.raises(ValueError):
            here.set_config(**wrong)
    assert Config(max_pages=9).update(max_pages=None, agents=None).max_pages is None


def test_of_two_writers_neither_is_lost(spark, tmp_path):
    one, two = jobs.Jobs(spark, str(tmp_path / "j")), jobs.Jobs(spark, str(tmp_path / "j"))
    one.put("x", status="running", discovered=0)
    read = one._last
    stopped = []

    def late(job):
        """What `one` reads is old by the time that it writes."""
        row = read(job)
        if not stopped:
            stopped.append(two.put("x", status="cancelled"))
        return row

    one._last = late
    assert one.put("x", discovered=9)
    row = two.now().first()
    assert (row.status, row.discovered) == ("cancelled", 9)
    assert not one.put("x", when={"status": "running"}, status="completed") and two.status("x") == "cancelled"
    assert jobs.valid_versions(one.versions.load()).count() == one.versions.load().count() - 1


def test_files_stay_few_and_lines_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 4)
    here = jobs.Jobs(spark, str(tmp_path / "j"))
    for i in range(9):
        here.put("x", status="running", discovered=i)
        here.log("x" if i % 2 else "y", f"line {i}")
    assert here.now().first().discovered == 8 and len(here.versions.files()) <= 4
    assert here.lines("x").count() == 4 and len(here.logs.files()) == 1
    here.clear_lines("x")
    assert here.lines("x").count() == 0 and here.lines("y").count() == 5
    here.clear_lines()
    assert here.lines("y").count() == 0


def test_agents_and_all_jobs(spark, tmp_path):
    here = jobs.Jobs(spark, str(tmp_path / "j"))
    here.put("x", status="running", agent_count=3)
    here.set_agent("x", 2, "paused")
    here.set_agent("x", 2, "stopped")
    assert {(r.agent_id, r.status) for r in jobs.agents(here.now(), here.agent_slots()).collect()} == {(1, "idle"), (2, "stopped"), (3, "idle")}
    with pytest.raises(ValueError):
        here.set_agent("x", 1, "asleep")
    here.put("y", status="completed")
    here.clear_all()
    assert here.now().isEmpty()


def test_prefix_index_agrees_with_every_rule(spark):
    import itertools
    import random
    import re

    rnd = random.Random(4)
    part = lambda: rnd.choice(["/a", "/B", "/a/b", "/c.html", "/x?q=1", "*", "$", "/é", "(", "b"])
    files, urls = [], []
    for h in range(12):
        groups = [(agents, [(rnd.choice(["Allow", "Disallow"]), rnd.choice(["", "/"]) + "".join(part() for _ in range(rnd.randint(1, 3)))) for _ in range(rnd.randint(1, 4))]) for agents in rnd.sample([["*"], ["bot"], ["other"], ["*", "bot"]], 2)]
        files.append((f"h{h}.org", "\n".join("\n".join([*(f"User-agent: {x}" for x in agents), *(f"{k}: {v}" for k, v in rs)]) for agents, rs in groups), groups))
        urls += [f"https://h{h}.org" + "".join(rnd.choice(["/a", "/b", "/A/B", "/c.html", "/x", "/"]) for _ in range(rnd.randint(1, 3))) + rnd.choice(["", "?q=1", ".html"]) for _ in range(25)]

    def verdict(url, groups):
        path = re.sub("^https://[^/]*", "", url)
        flat = [(x, rs) for agents, rs in groups for x in agents]
        mine = [rs for x, rs in flat if x != "*" and x in "mybot"] or [rs for x, rs in flat if x == "*"]
        best, out = -1, True
        for rs in mine:
            for kind, value in itertools.chain(((k, v) for k, v in rs if k == "Disallow"), ((k, v) for k, v in rs if k == "Allow")):
                value = value if value[0] in "/*" else "/" + value
                regex = re.sub(r"[.+?^{}()|\[\]\\]", r"\\\g<0>", value).replace("*", ".*")
                regex = regex[:-1].replace("$", r"\Z") + r"\Z" if regex.endswith("$") else "^" + regex.replace("$", r"\Z")
                if (value == "/" or re.search("(?is)" + regex, path)) and len(value.replace("*", "")) > best:
                    best, out = len(value.replace("*", "")), kind == "Allow"
        return out

    df = spark.createDataFrame([(u,) for u in set(urls)], "url string")
    got = {r.url: r.allowed for r in R.is_allowed(df, spark.createDataFrame([f[:2] for f in files], "host string, body string"), "mybot").collect()}
    by_host = {f[0]: f[2] for f in files}
    assert got == {u: verdict(u, by_host[u.split("/")[2]]) for u in set(urls)}
    assert len(set(got.values())) == 2


def test_errors_of_a_fetch_are_tried_again(spark):
    from webmill.plans.crawl import events

    rows = [(1, "https://a.org/", a("/x", "/ok"), None), (2, "https://a.org/x", a("/never"), "timed out"), (3, "https://a.org/ok", "", None)]
    corpus = tables.corpus(spark.createDataFrame(rows, "page_id long, url string, html string, error string"))
    sent = []

    def look(batch):
        sent.extend(r.headers for r in batch.select("headers").collect())
        return batch

    r = crawl(spark.createDataFrame([("https://a.org/",)], "url string"), corpus, Config(max_retries=2, respect_robots=False, user_agent="me"), before=look)
    assert {x.url[14:]: (x.state, x.retry_count) for x in r.requests.collect()} == {"": ("completed", 0), "x": ("failed", 2), "ok": ("completed", 0)}
    assert sent[0] == {"User-Agent": "me"}
    seen = sorted((e.type, e.url[14:], e.detail) for e in events(r).filter("type in ('request:error', 'request:retried', 'request:failed', 'links:found')").collect() if e.url)
    assert seen == [("links:found", "", "2"), ("request:error", "x", "timed out"), ("request:error", "x", "timed out"), ("request:failed", "x", None), ("request:retried", "x", "1")]


def test_seen_hosts_are_listed_and_forgotten(spark, tmp_path):
    from webmill.streaming import live

    schema = "host string, port int, tls boolean, path string, in_scope boolean"
    src, seen, started = str(tmp_path / "in"), live.SeenHosts(spark, str(tmp_path / "seen")), []
    none = spark.createDataFrame([], "host string")

    def batch(*rows, **more):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        live.watch(stream, more.get("active", lambda: none), more.get("start", started.append), more.get("at", str(tmp_path / "ck")), seen, query="req.url.ncont:zzz", enabled=lambda: more.get("enabled", True)).awaitTermination(120)

    batch(("a.org", 443, True, "/", True), ("a.org", 443, True, "/x", True), ("js.org", 443, True, "/x.js", True), ("out.org", 443, True, "/", False), ("zzz.org", 443, True, "/", True), ("busy.org", 443, True, "/", True), active=lambda: spark.createDataFrame([("busy.org",)], "host string"))
    assert started == ["https://a.org"] and sorted(r.host for r in seen.list().collect()) == ["a.org", "busy.org", "zzz.org"]
    batch(("a.org", 443, True, "/", True), ("busy.org", 443, True, "/", True), ("off.org", 443, True, "/", True), enabled=False)
    assert started == ["https://a.org"] and not seen.has("off.org")
    seen.clear("a.org")
    seen.add("new.org")
    batch(("a.org", 443, True, "/", True), ("busy.org", 443, True, "/", True), ("new.org", 443, True, "/", True))
    assert started == ["https://a.org"] * 2
    seen.clear()
    assert seen.list().isEmpty()

    def dies(url):
        started.append(url)
        if url.endswith("q.org"):
            raise RuntimeError("lost")

    try:
        batch(("p.org", 443, True, "/", True), ("q.org", 443, True, "/", True), start=dies)
    except Exception:  # noqa: BLE001
        pass
    batch(("p.org", 443, True, "/y", True))  # the batch is given again: p.org was started, q.org was not
    assert started[2:] == ["https://p.org", "https://q.org", "https://q.org"]
