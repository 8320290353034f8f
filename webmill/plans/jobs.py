"""Crawl jobs: their tables, agents, logs and events, and what changes them.

A job's changes are appended as versions; its state is the latest one. Nothing is changed in place.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, fields, is_dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill import schemas
from webmill.functions.patterns import LOG_LINES
from webmill.functions.urls import url_host
from webmill.operators.queue import seeds
from webmill.operators.stats import last_lines, latest, progress_percent, request_counters
from webmill.plans.crawl import Config, Result, crawl
from webmill.sources.tables import Store, history_seeds

ACTIVE = ("running", "pending")
DONE = ("completed", "failed", "cancelled")
LEVELS = ("debug", "info", "warn", "error")


def valid_versions(versions: DataFrame) -> DataFrame:
    """Versions that hold. Each names the one that it was made from (`based_on`, null for the first); of several made from one
    the first counts, and the others, whose writers had not seen it, are as if never written. A version that does not
    hold is never read, so none is made from it."""
    rest = [c for c in versions.columns if c not in ("id", "based_on")]
    first = versions.groupBy("id", "based_on").agg(F.min_by(F.struct(*rest), F.struct("version", "writer")).alias("f"))
    return first.select("id", "based_on", *[f"f.{c}" for c in rest]).select(*versions.columns)


def jobs_now(versions: DataFrame) -> DataFrame:
    """The latest version (column `version`) of each job that was not removed (status null)."""
    own = [c for c in ("version", "writer", "based_on") if c in versions.columns]
    held = valid_versions(versions) if len(own) == 3 else versions
    return latest(held, "id", *own[:2]).filter("status IS NOT NULL").drop(*own)


def active(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*ACTIVE))


def clear_completed(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("status").isin(*DONE))


def by_host(jobs: DataFrame, host: str) -> DataFrame:
    return active(jobs).filter(F.col("host") == host)


def with_live(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """jobs with the counts of crawls that run (id, discovered, crawled), and progress in percent."""
    l = live.select(F.col("id").alias("_i"), F.col("discovered").alias("_d"), F.col("crawled").alias("_c"))  # noqa: E741
    out = jobs.join(l, F.col("id") == F.col("_i"), "left").withColumns({"discovered": F.coalesce("_d", "discovered"), "crawled": F.coalesce("_c", "crawled")})
    return out.drop("_i", "_d", "_c").withColumn("progress", progress_percent(F.col("crawled"), F.col("discovered")))


def agents(jobs: DataFrame, slots: DataFrame | None = None, default: int = 5) -> DataFrame:
    """(job_id, agent_id, status) of agents 1 to agent_count. An ended job's agents are stopped if it was cancelled, else
    completed; a paused one's are paused; a running one's are as slots (job_id, agent_id, status) say, else idle."""
    rows = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job"), F.explode(F.sequence(F.lit(1), F.coalesce("agent_count", F.lit(default)))).alias("agent_id"))
    if slots is not None:
        rows = rows.join(slots.withColumnRenamed("status", "slot"), ["job_id", "agent_id"], "left")
    else:
        rows = rows.withColumn("slot", F.lit(None).cast("string"))
    status = F.when(F.col("job") == "cancelled", "stopped").when(F.col("job").isin("completed", "failed"), "completed").when(F.col("job") == "paused", "paused").otherwise(F.coalesce("slot", F.lit("idle")))
    return rows.select("job_id", "agent_id", status.alias("status"))


def display_name(title: Column, host: Column) -> Column:
    return F.coalesce(title, host)


def level_of(level: Column) -> Column:
    return F.when(F.lower(level).isin(*LEVELS), F.lower(level)).otherwise("info")


def level_label(level: Column) -> Column:
    return F.upper(level_of(level))


def at_least(logs: DataFrame, level: str) -> DataFrame:
    return logs.filter(F.array_position(F.lit(list(LEVELS)), level_of(F.col("level"))) >= LEVELS.index(level) + 1)


def page(rows: DataFrame, number: int = 1, size: int = 20, *order: str) -> DataFrame:
    """A page (from 1) of 1 to 100 rows."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and have 1 to 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


#: Writes after which a table's files are made one.
COMPACT_EVERY = 64


class Jobs:
    """Crawl jobs as tables that are appended to: versions of jobs, log lines, events and settings, in a folder, and the rounds
    of their crawls.

    Whoever has the folder sees the same state; a job's status there is what a running crawl goes by between rounds.
    Several may write at once: a change made to a version that is no longer the last is made anew to the last one.
    """

    def __init__(self, spark: SparkSession, path: str, project: str | None = None):
        make = lambda name, schema: Store(spark, f"{path}/{name}", schema).switch_project(project)
        self.spark, self.crawls = spark, f"{path}/crawls" + ("" if project is None else f"/project_id={project}")
        self.versions, self.logs = make("versions", schemas.JOBS + ", version long, writer string, based_on string"), make("logs", schemas.JOB_LOGS)
        self.events, self.settings = make("events", schemas.EVENTS), make("settings", "name string, value string, version long")
        self._written: dict[str, int] = {}
        self._lines: list[tuple] = []

    # what is kept

    def _append(self, name: str, rows: DataFrame) -> None:
        """One more file, and once in a while one instead of many."""
        store: Store = getattr(self, name)
        store.append(rows.coalesce(1))
        self._written[name] = self._written.get(name, 0) + 1
        if self._written[name] % COMPACT_EVERY == 0:
            store.compact()

    def _last(self, job: str):
        return latest(valid_versions(self.versions.load().filter(F.col("id") == job)), "id", "version", "writer").first()

    def put(self, job: str, when: dict | None = None, **changes) -> bool:
        """A further version of the job: the last one with these changes. status None removes it. when: what the last version
        has to have, or nothing is changed and the answer is False. If another writer was first the change is made to
        what that one wrote, so no change of other fields is lost."""
        schema = self.spark.createDataFrame([], self.versions.schema).schema
        while True:
            last = self._last(job)
            old = last.asDict() if last else dict.fromkeys(schema.names) | {"id": job}
            if any(old[k] != v for k, v in (when or {}).items()):
                return False
            mine = uuid.uuid4().hex
            version = max(time.time_ns() // 1000, (old["version"] or 0) + 1)
            row = old | changes | {"version": version, "writer": mine, "based_on": old["writer"]}
            self._append("versions", self.spark.createDataFrame([tuple(row[c] for c in schema.names)], schema))
            held = valid_versions(self.versions.load().filter(F.col("id") == job))
            if not held.filter(F.col("writer") == mine).isEmpty():
                return True

    def log(self, job: str, line: str, level: str = "info", agent_id: int | None = None) -> None:
        """A line, written with others at the next flush()."""
        now = datetime.now(timezone.utc)
        self._lines.append((job, time.time_ns(), now, agent_id, line, level))
        if len(self._lines) >= LOG_LINES:
            self.flush()

    def flush(self) -> None:
        """Writes the lines that wait, as one file."""
        if self._lines:
            rows, self._lines = self._lines, []
            self._append("logs", self.spark.createDataFrame(rows, schemas.JOB_LOGS))

    def clear_lines(self, job: str | None = None) -> None:
        """Forgets the lines of a job, or of all."""
        self.flush()
        kept = self.logs.load().filter(F.col("job_id") != job) if job is not None else self.logs.load().limit(0)
        self.logs.replace(kept)

    def event(self, kind: str, payload: str = "") -> None:
        self._append("events", self.spark.range(1).select(F.lit(kind).alias("type"), F.current_timestamp().alias("ts"), F.lit(payload).alias("payload")))

    def set_config(self, **changes) -> None:
        """Keeps settings, each as JSON. None is kept as such: it lifts a limit."""
        unknown = set(changes) - {f.name for f in fields(Config)}
        if unknown:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        replace(self.config(), **changes)  # refused now if out of bounds
        rows = [(k, json.dumps(asdict(v) if is_dataclass(v) else v), time.time_ns()) for k, v in changes.items()]
        self._append("settings", self.spark.createDataFrame(rows, "name string, value string, version long"))
        self.event("config:updated", ",".join(sorted(changes)))

    def config(self, base: Config = Config()) -> Config:
        """base with the settings that are kept, each of the kind that base has it in."""
        kept = {r.name: json.loads(r.value) for r in latest(self.settings.load(), "name", "version").collect()}

        def typed(name: str, value):
            now = getattr(base, name)
            return type(now)(**value) if is_dataclass(now) else tuple(value) if isinstance(now, tuple) else value

        return replace(base, **{k: typed(k, v) for k, v in kept.items()})

    # what is shown

    def now(self) -> DataFrame:
        return jobs_now(self.versions.load())

    def status(self, job: str) -> str | None:
        row = self.now().filter(F.col("id") == job).first()
        return row.status if row else None

    def lines(self, job: str, agent_id: int | None = None, most: int = LOG_LINES) -> DataFrame:
        self.flush()
        return last_lines(self.logs.load().filter(F.col("job_id") == job), most, agent_id)

    # what changes a job

    def set_status(self, job: str, status: str | None) -> None:
        """pause ("paused"), resume ("running"), stop ("cancelled") or remove (None): a version, a line and an event."""
        if self.status(job) is None:
            raise ValueError(f"no such job: {job}")
        self.put(job, status=status)
        self.log(job, f"status: {status or 'removed'}")
        self.flush()
        self.event(f"crawl:{status or 'removed'}", job)

    def set_agent(self, job: str, agent_id: int, status: str) -> None:
        """Pauses ("paused"), resumes ("running") or stops ("stopped") one agent of a job: an event that agent_slots() reads."""
        if status not in ("paused", "running", "stopped"):
            raise ValueError(f"not a state of an agent: {status}")
        if self.status(job) is None:
            raise ValueError(f"no such job: {job}")
        self.log(job, f"agent {agent_id}: {status}", agent_id=agent_id)
        self.flush()
        self.event("agent:status", json.dumps({"job_id": job, "agent_id": agent_id, "status": status}))

    def agent_slots(self) -> DataFrame:
        """(job_id, agent_id, status): the last state that each agent was set to."""
        rows = self.events.load().filter("type = 'agent:status'").select("ts", F.from_json("payload", "job_id string, agent_id int, status string").alias("p")).select("ts", "p.*")
        return rows.groupBy("job_id", "agent_id").agg(F.max_by("status", "ts").alias("status"))

    def clear_completed(self) -> None:
        for row in self.now().filter(F.col("status").isin(*DONE)).select("id", "status").toLocalIterator():
            self.put(row.id, when={"status": row.status}, status=None)

    def clear_all(self) -> None:
        """Removes every job; running crawls end before their next round."""
        for row in self.now().select("id").toLocalIterator():
            self.put(row.id, status=None)

    def run(self, job: str, url: str, corpus: DataFrame, config: Config = Config(), robots: DataFrame | None = None, history: DataFrame | None = None, manual: bool = True, title: str | None = None, previous: Result | None = None) -> Result:
        """Crawls from url, and from its host's history where the crawl is manual, until it is done or the job's status is no
        longer "running". A paused job goes on after the last round that was committed, in whatever program it was
        begun; so does one whose program ended. A manual crawl is not bound to scope; any other is."""
        host = self.spark.range(1).select(url_host(F.lit(url))).first()[0]
        if host is None:
            raise ValueError(f"not a URL: {url}")
        config = replace(config, in_scope_only=not manual)
        now = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
        last = self._last(job)
        goes_on = last is not None and last.status in ("paused", "running") and previous is None
        started = last.started_at if goes_on else now()
        self.put(job, target_url=url, host=host, status="running", depth=config.max_depth, agent_count=config.agents, title=title, started_at=started, **({} if goes_on else {"discovered": 0, "crawled": 0}))
        self.log(job, f"{'went on with' if goes_on else 'started'} {url}")
        self.event("crawl:resumed" if goes_on else "crawl:started", job)
        target = self.spark.createDataFrame([(url,)], "url string")
        begin = seeds(target, history_seeds(history, host)).select("url") if manual and history is not None else target

        def go_on(n: int, waiting: int) -> bool:
            self.log(job, f"round {n}: {waiting} requests")
            self.flush()
            return self.status(job) == "running"

        try:
            result = crawl(begin, corpus, config, robots, go_on=go_on, previous=previous, at=f"{self.crawls}/{job}/{started:%Y%m%dT%H%M%S%f}")
        except Exception as e:
            self.put(job, status="failed", completed_at=now())
            self.log(job, str(e)[:500], "error")
            self.flush()
            self.event("crawl:failed", job)
            raise
        counts = request_counters(result.requests).first()
        self.put(job, discovered=counts.total, crawled=counts.finished)
        if self.put(job, when={"status": "running"}, status="completed", completed_at=now()):
            self.log(job, f"completed after {result.rounds} rounds")
            self.event("crawl:completed", job)
        self.flush()
        return result
