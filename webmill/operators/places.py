"""Places in an order for keys of any size: rows are dealt by ranges of key and order, counted by range, and counts carried on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webmill.sources.shared import keep


def places(rows: DataFrame, order: list[Column], keys: list[str] | tuple[str, ...] = (), name: str = "place", table: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with `name`: the place of each among the rows of its keys, from 1, in this order. No task holds a key's rows: ranges
    of a hot key lie in several partitions, and rows that are equal in keys and order are dealt too, in any order among
    themselves. Null keys are a key of their own.

    Rows are written once (`table`, a kept table by default), as their ranges have to stay what they were when they were
    counted. Only counts by range and key are put in order by a window: as many rows for a key as it has ranges.
    """
    by = [F.col(k) for k in keys]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*by, *order, "_tie").sortWithinPartitions(*by, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    ranged = table(ranged) if table else keep(ranged, "places")
    ranged = ranged.withColumn("_p", F.shiftright("_at", 33))
    runs = ranged.groupBy("_p", *keys).agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_lo") + 1).alias("_shift"))
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranged.join(runs, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
