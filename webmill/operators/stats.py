"""Aggregates and windows over request, response, log and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webmill.functions.patterns import LOG_LINES, RATE_WINDOW_MS
from webmill.operators.places import places


def response_stats(responses: DataFrame, duration: str = "duration_ms") -> DataFrame:
    """One row: n, total_ms, min_ms, max_ms, avg_ms over all responses, retried ones included. Nulls where there are none."""
    d = F.col(duration)
    return responses.agg(F.count(d).alias("n"), F.sum(d).alias("total_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), F.avg(d).alias("avg_ms"))


def running_average(total: Column, finished_before: Column) -> Column:
    """The average as a running counter has it: the sum over those finished before the last response, and that one."""
    return total / (finished_before + 1)


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def request_counters(requests: DataFrame) -> DataFrame:
    """One row: finished, failed, retried (times), total. Blocked requests are in none but total."""
    state = F.col("state")
    return requests.agg(F.count_if(state == "completed").alias("finished"), F.count_if(state == "failed").alias("failed"), F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retried"), F.count(F.lit(1)).alias("total"))


def throughput(n: Column, runtime_ms: Column) -> Column:
    """struct(per_minute, per_second), 0 without a runtime."""
    rate = lambda unit: F.when(runtime_ms > 0, n / (runtime_ms / unit)).otherwise(0.0)
    return F.struct(rate(60_000).alias("per_minute"), rate(1000).alias("per_second"))


def queue_stats(requests: DataFrame) -> DataFrame:
    """One row: pending (retries included), in_progress, completed (distinct keys), failed, total."""
    state = F.col("state")
    return requests.agg(
        F.count_if(state.isin("pending", "retrying")).alias("pending"),
        F.count_if(state == "processing").alias("in_progress"),
        F.count_distinct(F.when(state == "completed", F.col("unique_key"))).alias("completed"),
        F.count_if(state == "failed").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def pool_stats(tasks: DataFrame) -> DataFrame:
    """One row: n, n_ok, n_failed, avg_ms (0 without tasks) of (duration_ms, ok)."""
    return tasks.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_ms"))


def success_rate(completed: Column, failed: Column) -> Column:
    return F.when(completed + failed > 0, completed / (completed + failed)).otherwise(1.0)


def queue_load(pending: Column, concurrency: Column) -> Column:
    return pending / concurrency


def autoscaled(concurrency: Column, load: Column, success: Column, avg_ms: Column, least: int = 1, most: int = 20) -> Column:
    """A fifth more when loaded, successful and quick; a fifth less when failing or slow; within bounds."""
    more = (load > 2) & (success > 0.9) & (avg_ms < 5000)
    less = (success < 0.5) | (avg_ms > 30_000)
    new = F.when(more, F.ceil(concurrency * 1.2)).when(less, F.floor(concurrency * 0.8)).otherwise(concurrency)
    return F.least(F.greatest(new, F.lit(least)), F.lit(most)).cast("int")


def crawl_stats(counters: DataFrame) -> DataFrame:
    """(crawled, discovered, queued, failed) of request_counters(): queued are those not yet dealt with."""
    return counters.select(F.col("finished").alias("crawled"), F.col("total").alias("discovered"), (F.col("total") - F.col("finished") - F.col("failed")).alias("queued"), "failed")


def progress_percent(crawled: Column, discovered: Column) -> Column:
    return F.when(discovered > 0, F.round(crawled / discovered * 100)).otherwise(0.0).cast("int")


def session_pool_stats(sessions: DataFrame, usable: Column) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("total"), F.count_if(usable).alias("usable"), F.count_if("is_blocked").alias("blocked"), F.coalesce(F.avg("usage_count"), F.lit(0.0)).alias("avg_usage"), F.coalesce(F.avg("error_score"), F.lit(0.0)).alias("avg_error"))


def trailing_counts(requests: DataFrame, key: str, ts_ms: str, windows: tuple[int, ...] = (1000, RATE_WINDOW_MS)) -> DataFrame:
    """requests with in_<ms> for each window: requests of the same key in the last so many ms, both ends included.

    Requests are counted by key and millisecond first. These counts go to the stretch of time, as long as the window, that
    they lie in, and to the next, so a window has all it needs in one stretch: a task takes stretches, not keys, and a
    stretch has two rows for each of its milliseconds at most.
    """
    t = F.col("_t")
    counts = requests.groupBy(F.col(key).alias("_k"), F.col(ts_ms).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    for ms in windows:
        here = F.floor(t / ms)
        both = F.array(F.struct(here.alias("s"), F.lit(True).alias("own")), F.struct((here + 1).alias("s"), F.lit(False).alias("own")))
        spread = counts.select("*", F.explode(F.when(t.isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("_b"))
        last = Window.partitionBy("_k", "_b.s").orderBy("_t").rangeBetween(-ms, 0)
        counts = spread.withColumn(f"in_{ms}", F.sum("_n").over(last)).filter("_b.own").drop("_b")
    return requests.join(counts, F.col(key).eqNullSafe(F.col("_k")) & F.col(ts_ms).eqNullSafe(t)).drop("_k", "_t", "_n")


def rate_check(requests: DataFrame, limits: DataFrame, key: str = "domain", ts_ms: str = "ts_ms", seq: str = "seq", window_ms: int = RATE_WINDOW_MS, shortest_ms: int = 0, longest_ms: int | None = None) -> DataFrame:
    """requests with in_window (of their key, in the last window, both ends included), over (more than the limit), and
    wait_ms: how long a request that is over would have to wait until fewer than the limit lie within the window, no
    shorter than shortest_ms and no longer than longest_ms.

    limits: (key, per_window); keys without a limit are never over. Ties of time go by seq. Places and counts are had
    by ranges and stretches of time, so one key's requests are dealt to many tasks.
    """
    counted = places(trailing_counts(requests, key, ts_ms, (window_ms,)).withColumnRenamed(f"in_{window_ms}", "in_window"), [F.asc(ts_ms), F.asc(seq)], [key], "_n")
    counted = counted.join(limits.select(F.col(key).alias("_k"), "per_window"), F.col(key) == F.col("_k"), "left").drop("_k")
    earlier = counted.select(F.col(key).alias("_k"), F.col("_n").alias("_m"), F.col(ts_ms).alias("_t"))
    met = counted.join(earlier, (F.col(key) == F.col("_k")) & (F.col("_n") - F.col("per_window") == F.col("_m")), "left")
    over = F.coalesce(F.col("in_window") > F.col("per_window"), F.lit(False))
    wait = F.greatest(F.lit(shortest_ms), F.col("_t") + window_ms + 1 - F.col(ts_ms))
    wait = F.when(over, wait if longest_ms is None else F.least(wait, F.lit(longest_ms))).otherwise(0).cast("long")
    return met.withColumns({"over": over, "wait_ms": wait}).drop("_k", "_m", "_t", "_n")


def limiter_stats(checked: DataFrame, key: str = "domain") -> DataFrame:
    """A row for each key of rate_check()'s rows: requests, how many were over, the fullest window, the longest and mean wait."""
    return checked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("over").alias("n_over"), F.max("in_window").alias("fullest"), F.max("wait_ms").alias("longest_wait_ms"), F.avg("wait_ms").alias("mean_wait_ms"))


def last_lines(logs: DataFrame, most: int = LOG_LINES, agent_id: int | None = None) -> DataFrame:
    """The last lines of each job; an agent's are chosen from those, so there may be fewer."""
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("seq"))
    kept = logs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
    return kept if agent_id is None else kept.filter(F.col("agent_id") == agent_id)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: a partial maximum, no sort."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"))
    return best.select(key, *[f"_l.{c}" for c in rest]).select(*rows.columns)


def retry_ordinal(attempts: DataFrame, key: str = "unique_key", ts: str = "ts") -> DataFrame:
    return attempts.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy(ts)))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): distinct keys with the least of `order`, by which they can be put in the order they were seen."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))
