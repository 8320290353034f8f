"""A crawl as a fixpoint: rounds of fetch, extract, filter and anti-join until no request is left or the budget is spent.

Fetching is a join with a corpus of pages. Each round reads only what is new; all that was seen is kept as keys. The
rounds' results are written to the shared folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webmill.functions import html as H
from webmill.functions.predicates import Router, in_scope, is_success, should_retry
from webmill.functions.urls import url_host
from webmill.operators import robots as R
from webmill.operators.links import Extractor, enqueue_links
from webmill.operators.queue import after_failure, make_requests, new_requests, next_requests, with_headers
from webmill.sources.shared import Rounds, keep, let_go
from webmill.sources.tables import fetch

Hook = Callable[[DataFrame], DataFrame]


#: Settings that may be None.
UNLIMITED = ("max_pages", "max_depth", "strategy", "query")


@dataclass(frozen=True)
class Config:
    """What a crawl may do. None: no limit."""

    max_pages: int | None = 100
    max_depth: int | None = 5
    max_retries: int = 3
    strategy: str | None = None
    same_domain_only: bool = True
    query: str | None = None
    respect_robots: bool = True
    user_agent: str = "webmill"
    options: H.Options = H.Options()
    #: A response that asks for a retry counts two tries, as some crawlers have it.
    double_retry: bool = False
    page_delay_ms: int = 100
    agents: int = 5
    #: Whether only hosts of the scope are asked for: those that a glob of allow takes (all, if there is none) and none of deny.
    in_scope_only: bool = False
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    #: Headers of every request; a session's own count before them.
    headers: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= self.agents <= 20 or self.page_delay_ms < 0 or any(x is not None and x < low for x, low in ((self.max_pages, 1), (self.max_depth, 0))):
            raise ValueError("out of bounds: agents 1 to 20, delay and depth 0 or more, pages 1 or more")

    def update(self, **changes) -> Config:
        """With these changes. None lifts a limit; where a setting cannot be None it leaves it as it is."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None or k in UNLIMITED})

    @property
    def per_minute(self) -> int:
        return 60_000 // max(self.page_delay_ms, 1)

    @property
    def per_second(self) -> int:
        return -(-self.per_minute // 60)


@dataclass(frozen=True)
class Result:
    """requests: all, with their last state; responses: one row an attempt; links: of successful pages."""

    requests: DataFrame
    responses: DataFrame
    links: DataFrame
    rounds: int
    #: What handlers made of responses, by label.
    records: dict[str, DataFrame] = field(default_factory=dict)
    #: The robots files that were looked up: host, body, fetch_ok.
    robots: DataFrame | None = None


def crawl(
    seeds: DataFrame,
    corpus: DataFrame,
    config: Config = Config(),
    robots: DataFrame | None = None,
    router: Router | None = None,
    before: Hook | None = None,
    after: Hook | None = None,
    transform: Hook | None = None,
    failed: Callable[[DataFrame], None] | None = None,
    handlers: dict[str, Hook] | None = None,
    extractors: tuple[Extractor, ...] = (),
    session: DataFrame | None = None,
    go_on: Callable[[int, int], bool] | None = None,
    previous: Result | None = None,
    at: str | None = None,
) -> Result:
    """Crawls from seeds (url) over a corpus (sources.tables.corpus).

    Requests are taken in the queue's order, no more in all than max_pages; robots-disallowed ones are `blocked` and
    count for nothing. A status that asks for a retry sends the request back; out of retries it counts as completed
    if it was so from the start, else as failed. A fetch with an error (corpus column `error`) sends the request back
    too, and fails it when it is out of retries. Links of successful HTML pages, and what extractors find in them,
    become requests one level deeper. before and after change requests before, and responses after the fetch;
    transform changes or drops new requests; failed gets the requests that failed for good. handlers take the
    responses of the requests that the router gives their label, and make records of them. session: the sessions that
    requests may go with (the first usable one). go_on is asked before each round, with its number and the requests
    that wait: where it says no the crawl ends, and a later one may go on from its result as `previous`.

    robots: robots files (host, body); without, each host's file is looked up in the corpus once, when its first
    request comes. at: a folder for the crawl's tables. Each round is committed there, and a crawl of a folder that
    has rounds goes on after the last of them, in whatever program or session; seeds and previous are then not read.
    """
    scoped = lambda d: d.filter(in_scope(url_host("url"), config.allow, config.deny)) if config.in_scope_only else d
    labelled = lambda d: d.withColumn("label", router.route("url", "label")) if router else d
    rounds = Rounds(corpus.sparkSession, at)
    begun = rounds.last()
    if begun is None:
        _begin(rounds, labelled(scoped(make_requests(seeds, max_retries=config.max_retries))), previous, config.max_pages)
        begun = rounds.last()
    n, left = begun[0], begun[1]["left"]
    waiting = rounds.one("waiting", n)
    judged = config.respect_robots and robots is None
    corpus = keep(corpus, "corpus")  # its keys are worked out once, not twice a round
    while left is None or left > 0:
        batch = waiting if left is None else next_requests(waiting, left)
        batch = with_headers(batch, {"User-Agent": config.user_agent} | config.headers, session)
        batch = keep(before(batch) if before else batch, "batch")
        size = batch.count()
        if not size or (go_on and not go_on(n + 1, size)):
            let_go(batch)
            break
        n += 1
        rest = waiting.join(batch.select("id"), "id", "left_anti").select(*waiting.columns)
        files = robots
        if judged:
            rounds.put("robots", R.look_up(R.new_hosts(batch, rounds.all("robots", n - 1)), corpus), n)
            files = rounds.all("robots", n)
        allowed = keep(R.is_allowed(batch, files, config.user_agent) if config.respect_robots else batch.withColumn("allowed", F.lit(True)), "allowed")
        got = fetch(allowed.filter("allowed"), corpus)
        got = keep((after(got) if after else got).withColumn("round", F.lit(n)), "responses")
        broken = F.col("error").isNotNull()
        retry = ~broken & should_retry("status") & F.col("no_retry").eqNullSafe(False) & (F.col("retry_count") < F.col("max_retries"))
        moved = after_failure(got.withColumn("state", F.lit("completed")), retry, 2 if config.double_retry else 1)
        moved = after_failure(moved, broken).select(*waiting.columns)
        moved = keep(moved, "moved")
        blocked = allowed.filter("NOT allowed").withColumn("state", F.lit("blocked")).select(*waiting.columns)
        rounds.put("done", moved.filter("state <> 'retrying'").unionByName(blocked), n)
        rounds.put("responses", got.select(*_columns(RESPONSES)), n)
        if failed:
            failed(moved.filter("state = 'failed'"))
        for label, handle in (handlers or {}).items():
            rounds.put(f"records-{label}", handle(got.filter(F.col("label") == label)), n)
        pages = got.filter(~broken & is_success("status") & F.col("html").isNotNull()).select(F.col("id").alias("page_id"), "url", "html", "depth", "status", "content_type")
        found = enqueue_links(pages, config.strategy, config.same_domain_only, config.query, config.max_depth, None, config.options, extractors)
        found = rounds.put("links", found.select(*_columns(LINKS)), n)
        children = found.select("url", "depth", F.col("page_id").alias("parent_id"), (F.lit(n) * F.lit(1 << 40) + F.col("rank") * F.lit(1 << 20) + F.col("pos")).cast("long").alias("seq"))
        children = labelled(scoped(make_requests(children, max_retries=config.max_retries)))
        if transform:
            children = transform(children)
        fresh = keep(new_requests(children, rounds.all("seen", n - 1)), "fresh")
        rounds.put("seen", fresh.select("unique_key"), n)
        waiting = rounds.put("waiting", rest.unionByName(moved.filter("state = 'retrying'")).unionByName(fresh), n)
        left = None if left is None else left - (size - allowed.filter("NOT allowed").count())
        rounds.commit(n, left=left)
        let_go(batch, allowed, got, moved, fresh)
    let_go(corpus)
    records = {label: rounds.all(f"records-{label}", n) for label in handlers or {} if rounds.has(f"records-{label}")}
    return Result(rounds.all("done", n).unionByName(waiting), rounds.all("responses", n), rounds.all("links", n), n, records, rounds.all("robots", n))


RESPONSES = "id long, url string, unique_key string, status int, content_type string, duration_ms long, depth int, round int, error string"
LINKS = "page_id long, url string, pos int, page_url string, depth int, source string, text string, rank int"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _begin(rounds: Rounds, start: DataFrame, previous: Result | None, left: int | None) -> None:
    """Round 0: what waits, what was seen, and empty tables."""
    spark = start.sparkSession
    if previous is None:
        waiting, done = new_requests(start, start.limit(0)), start.limit(0)
    else:
        over = ~F.col("state").isin("pending", "retrying")
        done = previous.requests.filter(over)
        waiting = previous.requests.filter(~over).unionByName(new_requests(start, previous.requests.select("unique_key")))
    waiting = rounds.put("waiting", waiting, 0)
    rounds.put("done", done, 0)
    rounds.put("seen", done.select("unique_key").unionByName(waiting.select("unique_key")), 0)
    for name, schema in (("responses", RESPONSES), ("links", LINKS), ("robots", "host string, body string, fetch_ok boolean")):
        rounds.put(name, spark.createDataFrame([], schema), 0)
    rounds.commit(0, left=left)


def events(result: Result) -> DataFrame:
    """(type, round, url, detail) of what a crawl's requests went through, told from its tables: request:completed,
    request:failed and request:blocked once for each request, request:started and request:retried for each attempt and each
    further one, response:received with its status, request:error with the error, links:found with their number."""
    tries = result.responses.select("url", "round", "status", "error", F.row_number().over(Window.partitionBy("unique_key").orderBy("round")).alias("n"))
    last = result.responses.groupBy("unique_key").agg(F.max("round").alias("round"))
    ended = result.requests.filter(F.col("state").isin("completed", "failed", "blocked")).join(last, "unique_key", "left")
    counts = result.links.groupBy("page_url").agg(F.count(F.lit(1)).cast("string").alias("n"), F.max("depth").alias("d"))
    row = lambda kind, detail: F.struct(F.lit(kind).alias("type"), "round", "url", detail.alias("detail"))
    none = F.lit(None).cast("string")
    of_try = F.array(row("request:started", F.col("n").cast("string")), F.when(F.col("n") > 1, row("request:retried", (F.col("n") - 1).cast("string"))), F.when(F.col("error").isNull(), row("response:received", F.col("status").cast("string"))), F.when(F.col("error").isNotNull(), row("request:error", F.col("error"))))
    out = tries.select(F.explode(F.array_compact(of_try)).alias("e")).select("e.*")
    out = out.unionByName(ended.select(F.concat(F.lit("request:"), F.col("state")).alias("type"), "round", "url", none.alias("detail")))
    return out.unionByName(counts.select(F.lit("links:found").alias("type"), F.lit(None).cast("int").alias("round"), F.col("page_url").alias("url"), F.col("n").alias("detail")))
