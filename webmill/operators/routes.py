"""Routes as a table: each URL's handler by the first route that takes it, however many routes there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webmill.functions.urls import ascii_lower


def glob_regex(glob: Column) -> Column:
    """A glob as a pattern of the whole URL, as predicates.glob_pattern has it: * stops at a slash, ** does not, ? is one
    character; one that ends in $ is open at its end."""
    plain = F.regexp_replace(glob, "([^A-Za-z0-9/_\\-:=&%#~@!,;'\" *?\\x80-\\x{10ffff}])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(plain, r"\?", "."), r"\*\*", "\x00")
    body = F.regexp_replace(F.regexp_replace(body, r"\*", "[^/]*"), "\x00", ".*")
    return F.concat(F.lit("(?i)^"), body, F.when(glob.endswith("$"), "").otherwise("\\z"))


def route(urls: DataFrame, routes: DataFrame, url_col: str = "url", label_col: str | None = None, default: str | None = None) -> DataFrame:
    """urls with `handler`: that of its label, else of the first glob (by ord) that takes the URL, else the default.

    routes: (ord, label, glob, handler); a route has a label or a glob, of equal labels the first counts. A URL meets the
    routes that begin as it does: it is spread to its beginnings of those lengths that globs have before their first
    wildcard, and these are join keys. Only lengths are collected: no more than the longest glob has characters.
    """
    globs = routes.filter(F.col("glob").isNotNull()).select("ord", F.col("handler").alias("_h"), glob_regex(F.col("glob")).alias("_re"), ascii_lower(F.regexp_extract("glob", r"(?s)^([^*?]*)", 1)).alias("_prefix"))
    lengths = sorted(r[0] for r in globs.select(F.length("_prefix")).distinct().collect())
    distinct = urls.select(F.col(url_col).alias("_u")).filter("_u IS NOT NULL").distinct()
    reach = F.filter(F.lit(lengths).cast("array<int>") if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("_u"))
    met = distinct.select("_u", ascii_lower(F.col("_u")).alias("_low"), reach.alias("_n")).select("_u", F.explode(F.transform("_n", lambda n: F.substring(F.col("_low"), F.lit(1), n))).alias("_b"))
    met = met.join(globs, F.col("_b") == F.col("_prefix")).filter(F.rlike("_u", F.col("_re")))
    first = met.groupBy("_u").agg(F.min_by("_h", "ord").alias("_by_url"))
    out = urls.join(first, F.col(url_col) == F.col("_u"), "left").drop("_u")
    by_label = F.lit(None).cast("string")
    if label_col is not None:
        labels = routes.filter(F.col("label").isNotNull()).groupBy(F.col("label").alias("_l")).agg(F.min_by("handler", "ord").alias("_by_label"))
        out, by_label = out.join(labels, F.col(label_col) == F.col("_l"), "left").drop("_l"), F.col("_by_label")
    return out.withColumn("handler", F.coalesce(by_label, "_by_url", F.lit(default))).drop("_by_url", "_by_label")
