"""The request queue as a table: keys, states, priorities and set operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webmill.functions.cookies import all_headers
from webmill.functions.urls import let, unique_key, url_domain
from webmill.operators.places import places
from webmill.operators.sessions import pick

STATES = ("pending", "processing", "completed", "failed", "retrying", "blocked")


def make_requests(items: DataFrame, priority: float = 0.0, max_retries: int = 3, no_retry: bool = False, method: str = "GET", label: str | None = None) -> DataFrame:
    """Requests of rows with url and maybe seq and any of the options; an item's own option counts before the default.
    Ids are hashes of keys, so equal input has equal ids."""
    has = lambda name: F.col(name) if name in items.columns else F.lit(None)
    d = items.withColumns({
        "method": F.upper(F.coalesce(has("method").cast("string"), F.lit(method))),
        "priority": F.coalesce(has("priority").cast("double"), F.lit(priority)),
        "max_retries": F.coalesce(has("max_retries").cast("int"), F.lit(max_retries)),
        "no_retry": F.coalesce(has("no_retry").cast("boolean"), F.lit(no_retry)),
        "label": F.coalesce(has("label").cast("string"), F.lit(label)),
        "depth": F.coalesce(has("depth").cast("int"), F.lit(0)),
        "parent_id": has("parent_id").cast("long"),
        "seq": F.coalesce(has("seq").cast("long"), F.lit(0)),
        "retry_count": F.coalesce(has("retry_count").cast("int"), F.lit(0)),
        "state": F.coalesce(has("state").cast("string"), F.lit("pending")),
    })
    d = d.withColumn("unique_key", unique_key("url", "method"))
    return d.withColumn("id", F.xxhash64("unique_key")).select("id", "url", "method", "unique_key", "priority", "seq", "depth", "parent_id", "retry_count", "max_retries", "no_retry", "label", "state")


def with_headers(requests: DataFrame, defaults: dict[str, str], session: DataFrame | None = None) -> DataFrame:
    """requests with `headers`: the defaults, then those of the first usable session and its cookies for the request's host.
    Of sessions one row is read; without a usable one there are the defaults alone."""
    rest = [c for c in requests.columns if c != "headers"]
    now = F.current_timestamp()
    picked = pick(session, now).select("headers", "cookies").first() if session is not None else None
    own = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]).cast("map<string,string>")
    if picked is not None:
        kind = session.schema["cookies"].dataType
        cookies = F.array(*[F.struct(*[F.lit(c[f.name]).cast(f.dataType).alias(f.name) for f in kind.elementType.fields]) for c in picked.cookies or []]).cast(kind)
        headers = F.create_map(*[F.lit(x) for kv in (picked.headers or {}).items() for x in kv]).cast("map<string,string>")
        theirs = all_headers(headers, cookies, url_domain("url"), now)
        return requests.select(*rest, let(theirs, lambda t: F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(t, k)), t)).alias("headers"))
    return requests.select(*rest, own.alias("headers"))


def children(parents: DataFrame, urls: DataFrame, on: str = "parent_id") -> DataFrame:
    """Requests of urls (parent_id, url, ...), one level below their parents."""
    up = parents.select(F.col("id").alias(on), (F.col("depth") + 1).alias("depth"))
    return make_requests(urls.drop("depth").join(up, on))


def clone(requests: DataFrame, salt: int = 1) -> DataFrame:
    return requests.withColumn("id", F.xxhash64("unique_key", F.lit(salt)))


def new_requests(candidates: DataFrame, visited: DataFrame, max_size: int | None = None) -> DataFrame:
    """Candidates of keys not visited, the first (by seq) of each; with max_size no more than fit beside all keys ever taken."""
    rest = [c for c in candidates.columns if c != "unique_key"]
    first = candidates.groupBy("unique_key").agg(F.min_by(F.struct(*rest), F.struct("seq", "url")).alias("f")).select("unique_key", *[f"f.{c}" for c in rest]).select(*candidates.columns)
    fresh = first.join(visited.select("unique_key").distinct(), "unique_key", "left_anti").select(*candidates.columns)
    if max_size is None:
        return fresh
    room = max(0, max_size - visited.select("unique_key").distinct().count())
    return first_in_order(fresh, [F.asc("seq"), F.asc("unique_key")], room)


def accepted(candidates: DataFrame, visited: DataFrame, max_size: int | None = None) -> int:
    return new_requests(candidates, visited, max_size).count()


def queue_order() -> list[Column]:
    """Retries in their order before all else, then priority, then first come."""
    retry = F.col("state") == "retrying"
    return [F.desc(retry), F.when(retry, F.col("seq")).asc(), F.desc("priority"), F.asc("seq"), F.asc("unique_key")]


def next_requests(requests: DataFrame, n: int) -> DataFrame:
    """The next n of the queue."""
    return first_in_order(requests.filter(F.col("state").isin("pending", "retrying")), queue_order(), n)


def first_in_order(rows: DataFrame, order: list[Column], n: int, few: int = 1_000) -> DataFrame:
    """The first n rows. A few are what each task offers as its first, put in order by one; more are told by their places, which
    ranges of the order are counted for, so that no task takes n rows."""
    return rows.orderBy(*order).limit(n) if n <= few else places(rows, order, name="_place").filter(F.col("_place") <= n).drop("_place")


def positions(requests: DataFrame, partition: str, *order: Column) -> DataFrame:
    """Place of each request in the queue of its partition (a host, a job), however many it has."""
    return places(requests, list(order or queue_order()), [partition])


def after_failure(requests: DataFrame, failed: Column, step: int = 1) -> DataFrame:
    """Failed requests count a try (or `step` tries) and wait again while tries are left; then they have failed."""
    count = F.col("retry_count") + step
    state = F.when(~F.col("no_retry") & (count < F.col("max_retries")), "retrying").otherwise("failed")
    return requests.withColumns({"state": F.when(failed, state).otherwise(F.col("state")), "retry_count": F.when(failed, count).otherwise(F.col("retry_count"))})


def mark(requests: DataFrame, ids: DataFrame, state: str) -> DataFrame:
    """requests, with those of ids in another state."""
    hit = ids.select(F.col("id").alias("_i")).distinct()
    return requests.join(hit, F.col("id") == F.col("_i"), "left").withColumn("state", F.when(F.col("_i").isNotNull(), F.lit(state)).otherwise(F.col("state"))).drop("_i")


def reclaim(requests: DataFrame) -> DataFrame:
    """What is in progress waits again, behind equals: with a seq after all others'."""
    top = requests.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    back = F.col("state") == "processing"
    return requests.withColumns({"seq": F.when(back, F.col("seq") + top + 1).otherwise(F.col("seq")), "state": F.when(back, "pending").otherwise(F.col("state"))})


def drop(requests: DataFrame, ids: DataFrame) -> DataFrame:
    """Without these ids; their keys may come again."""
    return requests.join(ids.select("id").distinct(), "id", "left_anti")


def snapshot(requests: DataFrame) -> DataFrame:
    """What a saved queue holds: waiting requests, and keys of completed ones."""
    return requests.filter(F.col("state").isin("pending", "retrying", "completed"))


def seeds(target: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct urls with their first place: the targets, then history by time."""
    both = target.select("url", F.lit(0).alias("part"), F.lit(None).cast("timestamp").alias("at")).unionByName(history.select("url", F.lit(1).alias("part"), F.col("created_at").cast("timestamp").alias("at")))
    return both.groupBy("url").agg(F.min(F.struct("part", "at")).alias("first")).select("url", "first.part", "first.at")


def lineage(requests: DataFrame) -> DataFrame:
    """(id, url, parent_url)."""
    up = requests.select(F.col("id").alias("parent_id"), F.col("url").alias("parent_url"))
    return requests.join(up, "parent_id", "left").select("id", "url", "parent_url")
