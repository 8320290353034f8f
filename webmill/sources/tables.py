"""Sources and sinks: page corpora in place of the network, histories, and stores kept by project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill import schemas
from webmill.functions.urls import trim_ws, unique_key


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def corpus(pages_df: DataFrame) -> DataFrame:
    """A page corpus by key: what a fetch joins with. Of pages of one key the first counts. status, content_type,
    duration_ms and error (what went wrong with a fetch) are taken where the corpus has them."""
    has = lambda c, other: F.col(c) if c in pages_df.columns else F.lit(other)
    rows = pages_df.select(unique_key("url").alias("unique_key"), "page_id", F.col("url").alias("page_url"), "html", has("status", 200).cast("int").alias("status"), has("content_type", "text/html").alias("content_type"), has("duration_ms", 0).cast("long").alias("duration_ms"), has("error", None).cast("string").alias("error"))
    first = rows.groupBy("unique_key").agg(F.min_by(F.struct("page_id", "page_url", "html", "status", "content_type", "duration_ms", "error"), "page_id").alias("p"))
    return first.select("unique_key", "p.*")


def fetch(requests: DataFrame, pages_by_key: DataFrame) -> DataFrame:
    """requests with page_id, html, status, content_type, duration_ms, error: a left join with the corpus; 404 where it has none."""
    found = requests.join(pages_by_key, "unique_key", "left")
    if "error" not in found.columns:
        found = found.withColumn("error", F.lit(None).cast("string"))
    return found.withColumn("status", F.coalesce("status", F.lit(404)))


def history_seeds(history: DataFrame, host: str) -> DataFrame:
    """Distinct non-blank urls of a host's GET requests by the time they first came. A blank host has none."""
    rows = history.filter((F.col("host") == host) & (F.col("method") == "GET") & (trim_ws("url") != "")) if host.strip() else history.filter(F.lit(False))
    return rows.groupBy("url").agg(F.min("created_at").alias("created_at")).orderBy("created_at", "url")


class Store:
    """A table kept by project as Parquet. Loading gives a missing table, or a field without a value, its default."""

    def __init__(self, spark: SparkSession, path: str, schema: str, defaults: dict | None = None):
        self.spark, self.path, self.schema, self.defaults, self.project = spark, path.rstrip("/"), schema, defaults or {}, None

    def switch_project(self, project_id: str | None) -> Store:
        self.project = project_id
        return self

    def _place(self) -> str:
        return self.path if self.project is None else f"{self.path}/project_id={self.project}"

    def load(self) -> DataFrame:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._place())
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        df = self.spark.read.schema(self.schema).parquet(self._place()) if fs.exists(place) else self.spark.createDataFrame([], self.schema)
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in self.defaults.items()})

    def save(self, df: DataFrame) -> None:
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(self._place())

    def append(self, df: DataFrame) -> None:
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("append").parquet(self._place())


    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self._place())
        return jvm.org.apache.hadoop.fs.Path, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def files(self) -> list[str]:
        """Names of the table's files."""
        _, fs, place = self._fs()
        return sorted(f.getPath().toString() for f in fs.listStatus(place) if f.getPath().getName().startswith("part-")) if fs.exists(place) else []

    def replace(self, df: DataFrame) -> None:
        """Puts df, which may come from this table, in place of the files that are there now. Rows that others append
        meanwhile stay. Whoever reads between the two steps sees rows twice, and never too few."""
        old = self.files()
        self.append(df)
        path, fs, _ = self._fs()
        for name in old:
            fs.delete(path(name), False)

    def compact(self) -> None:
        """The same rows in one file."""
        old = self.files()
        if len(old) > 1:
            self.replace(self.spark.read.schema(self.schema).parquet(*old).coalesce(1))


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def sitemap_entries(requests: DataFrame, job_id: str) -> DataFrame:
    """Distinct URLs that a crawl saved."""
    return requests.filter("state = 'completed'").select("url", F.lit(job_id).alias("job_id")).distinct()


def push_data(data: DataFrame) -> DataFrame:
    """Records of any shape as JSON, for a dataset that is appended to."""
    return data.select(F.to_json(F.struct("*")).alias("record"))


def read_records(pushed: DataFrame) -> DataFrame:
    """Records of push_data(), of whatever shapes, as variants; what is no JSON is null."""
    return pushed.select(F.try_parse_json("record").alias("record"))


def record_fields(records: DataFrame, **fields: str) -> DataFrame:
    """Fields of read_records() by a path and a type each ("$.a.b string"): the schema is chosen on reading. A record that has
    no such field, or one that the type does not take, has null there."""
    parts = {name: of.rsplit(" ", 1) for name, of in fields.items()}
    return records.select(*[F.try_variant_get("record", path, kind).alias(name) for name, (path, kind) in parts.items()])
