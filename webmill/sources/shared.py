"""Tables that a job keeps for itself in the folder all executors share."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder is spark.checkpoint.dir; one of our own only where that is unset and Spark runs in this one process."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="webmill-"))
        at = sc.getCheckpointDir()
    return at


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that its plan ends here. The table goes when it is let go, or when
    the program ends, if its session still runs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def let_go(*kept: DataFrame) -> None:
    """Removes what keep() wrote, once everything that reads it has been written itself."""
    for df in kept:
        if df in _paths:
            _remove(df.sparkSession, _paths.pop(df))


class Rounds:
    """Tables that grow round by round in a folder. A round counts once it is committed: what a program wrote that ended
    before is written anew. However many rounds there are, a table is one scan."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}").rstrip("/")
        if path is None:
            atexit.register(_remove, spark, self.path)

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def has(self, name: str) -> bool:
        return self._exists(f"{self.path}/{name}")

    def put(self, name: str, rows: DataFrame, n: int) -> DataFrame:
        """Writes round n of a table and returns it as written."""
        at = f"{self.path}/{name}/step={n}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def one(self, name: str, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/step={n}")

    def all(self, name: str, n: int) -> DataFrame:
        """The table up to round n."""
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("step") <= n).drop("step")

    def commit(self, n: int, **facts: int | None) -> None:
        row = self.spark.createDataFrame([(n, json.dumps(facts))], "n int, facts string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/committed/step={n}")

    def last(self) -> tuple[int, dict] | None:
        """The last committed round and what was noted of it."""
        if not self.has("committed"):
            return None
        row = self.spark.read.schema("n int, facts string").parquet(f"{self.path}/committed").orderBy(F.desc("n")).first()
        return None if row is None else (row.n, json.loads(row.facts))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session ended before the program
        pass
