import random

import pytest
from pyspark.sql import functions as F

from webmill.operators.places import places


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    made = [("hot", rnd.randint(0, 50), i) for i in range(3000)] + [(rnd.choice("abc"), rnd.randint(0, 9), i) for i in range(200)]
    return made + [(None, 1, 1), (None, None, 2), ("d", None, 3)] + [("same", 1, 1)] * 500


def test_places_by_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, t int, seq int").repartition(5)
    got = places(df, [F.col("t").asc(), F.col("seq").desc()], ["k"]).collect()
    assert sorted((r.k or "", r.place) for r in got) == sorted((k or "", i + 1) for k in {r[0] for r in rows} for i in range(sum(r[0] == k for r in rows)))
    for key in ("hot", "a", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.place)
        assert [(r.t, r.seq) for r in mine] == sorted([r[1:] for r in rows if r[0] == key], key=lambda r: (-1 if r[0] is None else r[0], -r[1]))


def test_places_of_all(spark, rows):
    df = spark.createDataFrame(rows, "k string, t int, seq int")
    got = places(df, [F.desc("seq")], name="n").collect()
    assert sorted(r.n for r in got) == list(range(1, len(rows) + 1))
    assert [r.seq for r in sorted(got, key=lambda r: r.n)] == sorted((r[2] for r in rows), reverse=True)
    assert places(df.limit(0), [F.desc("seq")]).count() == 0


def test_a_hot_key_lies_in_many_partitions(spark, rows):
    df = spark.createDataFrame([("one", i % 7, i) for i in range(20_000)], "k string, t int, seq int")
    held = []

    def table(d):
        held.append([len(p) for p in d.rdd.glom().collect()])
        from webmill.sources.shared import keep

        return keep(d, "places")

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places(df, [F.asc("t"), F.asc("seq")], ["k"], table=table)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(held[0]) < 2 * 20_000 / len(held[0])


def test_windows_of_one_hot_key(spark):
    """Stretches of time and of places give what one window over the whole key does."""
    from pyspark.sql import Window

    from webmill.operators import sessions, stats

    rnd = random.Random(6)
    made = [("hot", rnd.randint(-5_000, 200_000), i) for i in range(4000)] + [("b", rnd.randint(0, 9), i) for i in range(50)] + [(None, 5, 1), (None, 6, 2), ("n", None, 1), ("n", None, 2), ("n", 3, 3)]
    df = spark.createDataFrame(made, "domain string, ts_ms long, seq long").repartition(4)
    w = Window.partitionBy("domain").orderBy("ts_ms")
    want = df.withColumns({f"in_{ms}": F.count(F.lit(1)).over(w.rangeBetween(-ms, 0)) for ms in (1000, 60_000)})
    got = stats.trailing_counts(df, "domain", "ts_ms")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    limits = spark.createDataFrame([("hot", 900), ("b", 3)], "domain string, per_window int")
    checked = stats.rate_check(df, limits, shortest_ms=100, longest_ms=9_000).collect()
    times = sorted((t, s) for k, t, s in made if k == "hot")
    place = {s: i for i, (_, s) in enumerate(times)}
    for r in (r for r in checked if r.domain == "hot"):
        n = sum(r.ts_ms - 60_000 <= t <= r.ts_ms for t, _ in times)
        assert (r.in_window, r.over) == (n, n > 900)
        assert r.wait_ms == (min(9_000, max(100, times[place[r.seq] - 900][0] + 60_001 - r.ts_ms)) if n > 900 else 0)
    summary = {r.domain: r for r in stats.limiter_stats(spark.createDataFrame(checked, stats.rate_check(df, limits).schema)).collect()}
    assert summary["b"].n_over == sum(r.over for r in checked if r.domain == "b") and summary[None].n == 2
    outcomes = spark.createDataFrame([("s", i, rnd.random() < 0.6) for i in range(3000)], "session_id string, seq int, ok boolean")
    by_stretch = [tuple(r) for r in _health(sessions, outcomes, 64)]
    assert by_stretch == [tuple(r) for r in _health(sessions, outcomes, 8_192)]


def _health(sessions, outcomes, stretch):
    old, sessions.STRETCH = sessions.STRETCH, stretch
    try:
        return sessions.health(outcomes).collect()
    finally:
        sessions.STRETCH = old


def test_the_first_rows_of_many(spark):
    from webmill.operators import queue

    items = spark.range(5000).select(F.concat(F.lit("http://h/"), F.col("id")).alias("url"), (F.col("id") % 7).cast("double").alias("priority"), (F.col("id") % 50).alias("seq"), F.when(F.col("id") % 11 == 0, "retrying").otherwise("pending").alias("state"))
    r = queue.make_requests(items)
    few, many = r.orderBy(*queue.queue_order()).limit(1500), queue.next_requests(r, 1500)
    assert many.count() == 1500 and many.exceptAll(few).isEmpty()
    plan = queue.first_in_order(r, queue.queue_order(), 1500)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan.split("Window")[0]
