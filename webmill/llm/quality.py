"""Operator 4: quality rules with host-level verdicts. DataFrame functions only.

Each document is measured by itself (no shuffle). Failures are then counted by host, each host's rate is shrunk
towards a beta prior fitted to all hosts, and a host whose shrunken rate is too high takes its documents with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill.llm import common as C

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunken failure rate is above this.
MAX_HOST_RATE = 0.5


def measure(docs: DataFrame, text_col: str = "text", prefix: str = "_q_") -> DataFrame:
    """docs with the columns <prefix>n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null or empty text has no words and fails. Nothing else of docs is touched.
    """
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(C.WORD_RE))
    d = docs.withColumn(f"{p}w", F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
    d = d.withColumn(f"{p}lines", lines)
    n = F.size(f"{p}w")
    w = F.col(f"{p}w")
    # A 64-bit hash stands for each window of three words; windows are compared within one text only.
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))
    d = d.withColumn(f"{p}g", F.sort_array(grams))
    g = F.col(f"{p}g")
    d = d.withColumn(f"{p}at", F.array_sort(F.transform(F.filter(g, lambda s, k: (s.h == F.get(g, k - 1).h) | (s.h == F.get(g, k + 1).h)), lambda s: s.i)))
    start = F.struct(F.lit(-3).alias("prev"), F.lit(0).alias("n"))
    repeat = F.aggregate(f"{p}at", start, lambda a, i: F.struct(i.alias("prev"), (a.n + F.least(F.lit(3), i - a.prev)).alias("n")), lambda a: a.n)
    d = d.select(
        *docs.columns,
        n.cast("long").alias(f"{p}n_words"),
        F.length(F.array_join(w, "")).cast("long").alias(f"{p}word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias(f"{p}n_symbols"),
        (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long").alias(f"{p}n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias(f"{p}n_repeat_words"),
    )
    failed = (F.col(f"{p}n_words") < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words"))
    return d.withColumn(f"{p}base_failed", failed)


def host_rates(measured: DataFrame, host_col: str, failed_col: str) -> DataFrame:
    """Per host: n, n_failed and rate, its failure rate shrunk towards the prior of all hosts.

    The beta prior has the mean and variance of the hosts' own rates (method of moments). With one host, or hosts
    that all agree, the variance is 0 and every host gets the common mean. A null host is a host of its own.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed_col).alias("n_failed"))
    hosts = C.table(hosts)
    m, v = hosts.agg(F.avg(F.col("n_failed") / F.col("n")), F.var_pop(F.col("n_failed") / F.col("n"))).first()
    if m is None or not v or m * (1 - m) <= v:
        k = 0.0 if v and m is not None else None
    else:
        k = m * (1 - m) / v - 1
    rate = F.lit(m).cast("double") if k is None else (F.col("n_failed") + m * k) / (F.col("n") + k)
    return hosts.withColumn("rate", rate)


def judge(measured: DataFrame, host_col: str, prefix: str = "_q_", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """measured (read twice, so best a written table) with <prefix>kept: neither the document nor its host failed.

    Only rejected hosts are joined back. There may be any number, so Spark picks the join by their measured size
    and may split a hot host's rows.
    """
    rates = host_rates(measured, host_col, f"{prefix}base_failed")
    bad = rates.filter(F.col("rate") > max_host_rate).select(F.col("host").alias(f"{prefix}host"), F.lit(True).alias(f"{prefix}bad"))
    d = measured.join(bad, F.col(host_col).eqNullSafe(F.col(f"{prefix}host")), "left")
    return d.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.col(f"{prefix}bad").isNull()).drop(f"{prefix}host", f"{prefix}bad")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per row of docs: id, the measures, base_failed and kept. Repeated rows and null ids are rows of their own."""
    d = docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("_q_text"), F.col(host_col).alias("_q_source"))
    d = C.table(measure(d, "_q_text").drop("_q_text"))
    d = judge(d, "_q_source", max_host_rate=max_host_rate).drop("_q_source")
    return d.select(F.col("_q_id").alias(id_col), *[F.col(c).alias(c[3:]) for c in d.columns if c != "_q_id"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' measures and verdicts, their host's included. A null text has no words and fails."""
    return quality(C.read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM f GROUP BY source),
p AS (SELECT avg(k / n) AS mean, var_pop(k / n) AS var FROM h),
v AS (SELECT source, CASE WHEN coalesce(var, 0) = 0 THEN mean
                          WHEN mean * (1 - mean) <= var THEN k / n
                          ELSE (k + mean * (mean * (1 - mean) / var - 1)) / (n + mean * (1 - mean) / var - 1) END AS rate
      FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
