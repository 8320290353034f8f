"""Sessions: health as a fold over ordered outcomes, the pool's choices, and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webmill.functions.cookies import is_expired
from webmill.functions.patterns import MAX_SESSION_AGE_MS, MAX_SESSIONS, SESSION_BLOCK_SCORE
from webmill.operators.places import places

#: Outcomes of one session that a window takes at once.
STRETCH = 8_192


def expired(now: Column) -> Column:
    return F.coalesce(F.exists("cookies", lambda c: is_expired(c, now)), F.lit(False))


def maxed_out() -> Column:
    return F.col("usage_count") >= F.col("max_usage_count")


def usable(now: Column) -> Column:
    return ~F.col("is_blocked") & ~expired(now) & ~maxed_out()


def health(outcomes: DataFrame, key: str = "session_id", order: str = "seq", ok: str = "ok", error_weight: float = 1.0, success_weight: float = 0.5, retire_at: float = SESSION_BLOCK_SCORE) -> DataFrame:
    """(key, usage_count, error_score, is_blocked) after outcomes in order: an error adds its weight, a success takes its
    own away down to 0; at SESSION_BLOCK_SCORE or retire_at, whichever is less, the session is blocked for good.

    The score is a sum with a floor, so its value is the running sum less its least value so far (or 0). Outcomes are put
    in order by ranges, and sums and least values are worked out over stretches of them and carried on from stretch to
    stretch: a window holds one stretch, or a row for each.
    """
    step = F.when(F.col(ok), -success_weight).otherwise(error_weight)
    rows = places(outcomes.select(F.col(key).alias("_k"), F.col(order).alias("_o"), step.alias("_step"), F.col(ok).alias("_ok")), [F.asc("_o")], ["_k"], "_n")
    rows = rows.withColumn("_c", F.floor((F.col("_n") - 1) / STRETCH))
    within = Window.partitionBy("_k", "_c").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum("_step").over(within)).withColumn("_low", F.min("_s").over(within))
    earlier = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_k", "_c").agg(F.sum("_step").alias("_sum"), F.min("_s").alias("_least")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    carried = carried.withColumn("_low_before", F.coalesce(F.min(F.col("_before") + F.col("_least")).over(earlier), F.lit(0.0)))
    carried = carried.select(F.col("_k").alias("_k2"), F.col("_c").alias("_c2"), "_before", "_low_before")
    rows = rows.join(carried, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_c") == F.col("_c2")))
    # The floor is met at successes only; between them errors add up.
    rows = rows.withColumn("_score", F.col("_before") + F.col("_s") - F.least("_low_before", F.col("_before") + F.col("_low"), F.lit(0.0)))
    blocked = ~F.col("_ok") & (F.col("_score") >= min(SESSION_BLOCK_SCORE, retire_at))
    return rows.groupBy(F.col("_k").alias(key)).agg(F.count(F.lit(1)).alias("usage_count"), F.max_by("_score", "_n").alias("error_score"), F.max(blocked).alias("is_blocked"))


def clean_up(sessions: DataFrame, now: Column, max_age_ms: int = MAX_SESSION_AGE_MS) -> DataFrame:
    """Without sessions that are too old, blocked, used up or expired."""
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("created_at").cast("timestamp"))
    return sessions.filter((age <= max_age_ms) & usable(now))


def pick(sessions: DataFrame, now: Column, order: str = "created_at") -> DataFrame:
    """The first usable session, if there is one."""
    return sessions.filter(usable(now)).orderBy(order, "id").limit(1)


def oldest(sessions: DataFrame, now: Column) -> DataFrame:
    """The session to make room for a new one: the one created first, before now."""
    return sessions.filter(F.col("created_at") < now).agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def add(sessions: DataFrame, new: DataFrame, now: Column, most: int = MAX_SESSIONS) -> DataFrame:
    """The pool with a new session; a full one loses its oldest."""
    kept = sessions
    if sessions.count() >= most:
        kept = sessions.join(oldest(sessions, now), "id", "left_anti")
    return kept.join(new.select("id"), "id", "left_anti").select(*sessions.columns).unionByName(new.select(*sessions.columns))


def retire(sessions: DataFrame, ids: list[str]) -> DataFrame:
    return sessions.withColumn("is_blocked", F.col("is_blocked") | F.col("id").isin(ids))


def restore(saved: DataFrame, now: Column) -> DataFrame:
    """What a snapshot brings back: usable sessions only."""
    return saved.filter(usable(now))
