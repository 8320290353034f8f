"""Streams: the trigger that starts a crawl at a host's first request, rate counts and session state.

State is kept by key, one small value each, in Spark's state store with its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webmill.functions.patterns import SESSION_BLOCK_SCORE
from webmill.functions.predicates import is_static_resource, matches_filter
from webmill.functions.urls import build_url
from webmill.sources.shared import keep, let_go
from webmill.sources.tables import Store


def first_hosts(intercepted: DataFrame, in_scope_only: bool = True) -> DataFrame:
    """The first request of each host that is no static resource and, if asked, in scope. Others leave no trace. The
    state is one host each; it is never let go, as a host is new only once."""
    rows = intercepted.filter(~is_static_resource("path"))
    if in_scope_only:
        rows = rows.filter("in_scope")
    return rows.withColumn("url", build_url("host", "port", "tls")).dropDuplicates(["host"])


def triggers(intercepted: DataFrame, active_hosts: DataFrame, query: str | None = None, in_scope_only: bool = True, enabled: bool = True) -> DataFrame:
    """Hosts to crawl: first ones without an active job (host) whose origin passes the filter. A host that fails one of
    these two is seen all the same."""
    first = first_hosts(intercepted, in_scope_only).filter(F.lit(enabled))
    return first.join(active_hosts.select("host").distinct(), "host", "left_anti").filter(matches_filter("url", query))


def start_crawls(stream: DataFrame, start: Callable[[str], object], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls start(url) for each row of triggers(). A batch holds few rows: new hosts only."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.select("url").orderBy("url").toLocalIterator():
            start(row.url)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class SeenHosts:
    """Hosts that were seen, as a table that is appended to, so that they can be listed and forgotten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path, "host string, batch long, started boolean")

    def list(self) -> DataFrame:
        return self.store.load().select("host").distinct()

    def has(self, host: str) -> bool:
        return not self.store.load().filter(F.col("host") == host).isEmpty()

    def add(self, host: str, batch: int = -1, started: bool = False) -> None:
        self.store.append(self.spark.createDataFrame([(host, batch, started)], self.store.schema))

    def clear(self, *hosts: str) -> None:
        """Forgets these hosts, or all: their next request is a first one again."""
        rows = self.store.load()
        self.store.replace(rows.filter(~F.col("host").isin(*hosts)) if hosts else rows.limit(0))


def watch(intercepted: DataFrame, active_hosts: Callable[[], DataFrame], start: Callable[[str], object], checkpoint: str, seen: SeenHosts, query: str | None = None, in_scope_only: bool = True, enabled: Callable[[], bool] = lambda: True, once: bool = True) -> StreamingQuery:
    """Calls start(origin) at the first request of each host that is not in `seen`, no static resource and, if asked, in scope.

    Such a host is seen from then on, whether it is crawled or not: one with an active job, or whose origin fails the
    filter, is not. While not enabled nothing is looked at. Hosts are marked with their batch, so a batch that Spark
    gives again, as after a lost driver, finds them new again, but for those that it has started.
    """

    def each(batch: DataFrame, n: int) -> None:
        if not enabled():
            return
        rows = batch.filter(~is_static_resource("path"))
        rows = rows.filter("in_scope") if in_scope_only else rows
        rows = rows.withColumn("url", build_url("host", "port", "tls"))
        first = rows.groupBy("host").agg(F.min_by("url", "ts") if "ts" in rows.columns else F.min("url").alias("url")).toDF("host", "url")
        marks = keep(seen.store.load(), "seen")
        new = keep(first.join(marks.filter(F.col("batch") != n).select("host").distinct(), "host", "left_anti"), "new-hosts")
        seen.store.append(new.select("host", F.lit(n).cast("long").alias("batch"), F.lit(False).alias("started")).coalesce(1))
        go = new.join(marks.filter((F.col("batch") == n) & F.col("started")).select("host").distinct(), "host", "left_anti")
        go = go.join(active_hosts().select("host").distinct(), "host", "left_anti").filter(matches_filter("url", query))
        for row in go.orderBy("url").toLocalIterator():
            start(row.url)
            seen.add(row.host, n, True)
        seen.store.compact()
        let_go(marks, new)

    writer = intercepted.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sliding_counts(requests: DataFrame, key: str, ts: str = "ts", window: str = "1 minute", slide: str = "1 second", late: str = "1 minute") -> DataFrame:
    """(window, key, n): requests by sliding window of event time. Rows later than `late` are let go."""
    t = F.col(ts).cast("timestamp")
    return requests.withColumn("_t", t).withWatermark("_t", late).groupBy(F.window("_t", window, slide), key).agg(F.count(F.lit(1)).alias("n"))


def session_health(outcomes: DataFrame, error_weight: float = 1.0, success_weight: float = 0.5) -> DataFrame:
    """(session_id, usage_count, error_score, is_blocked) after each batch of outcomes (session_id, seq, ok)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, score, blocked = state.get if state.exists else (0, 0.0, False)
        ok = pd.concat(list(frames)).sort_values("seq", kind="stable").ok.to_numpy(bool)
        total = score + np.cumsum(np.where(ok, -success_weight, error_weight))
        scores = total - np.minimum(np.minimum.accumulate(total), 0.0)  # a sum with a floor: less its least value so far
        n, score, blocked = n + len(ok), float(scores[-1]), bool(blocked or (~ok & (scores >= SESSION_BLOCK_SCORE)).any())
        state.update((n, score, blocked))
        yield pd.DataFrame({"session_id": [key[0]], "usage_count": [n], "error_score": [score], "is_blocked": [blocked]})

    schema = "usage_count long, error_score double, is_blocked boolean"
    return outcomes.groupBy("session_id").applyInPandasWithState(step, "session_id string, " + schema, schema, "update", GroupStateTimeout.NoTimeout)


def new_keys(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys never seen before on this stream."""
    return stream.dropDuplicates(list(keys))
