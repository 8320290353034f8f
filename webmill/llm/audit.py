"""Operator 12: how filters interact, audited by the multilinear extension of what they remove.

Every document is measured once, by itself. What a set of filters removes from a part depends on nothing but how many of
its documents fail which filters, at most 32 counts a part. These are the coefficients of the part's removal polynomial:
its values at the corners of the cube tell what any order of filters removes at any step, and its partial derivatives,
integrated along the diagonal with exact rationals, are the filters' Shapley values.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill.llm import common as C

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"
#: Counts that are kept for each set of failed filters: all documents, good ones, toxic ones.
COUNTS = ("n", "n_good", "n_toxic")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: 1, 2, 4 and 8. A null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words).cast("long")
    distinct = F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_CAPITALS_PERCENT * F.length(text).cast("long"), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents of each part by the filters that they fail.

    Filter E fails a document if one of a smaller id, in whatever part, has its text, by SHA-256. A null id is neither
    smaller nor larger than another; rows of one id and text do not fail each other. Labels of one id count as one
    label: good if any says so, toxic if any does.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_failures(F.col(text_col)).alias("mask"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("h"))
    # Repeated rows meet here, and ids are unique by text from here on.
    d = d.groupBy("h", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Null ids, which have no label, are spread by text.
    aside = F.when(F.col("id").isNull(), F.xxhash64("h")).otherwise(0)
    d = d.withColumn("aside", aside).join(marks.withColumn("l_aside", F.lit(0).cast("long")), (F.col("id") == F.col("l_id")) & (F.col("aside") == F.col("l_aside")), "left")
    d = d.select("h", "id", "part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # A text's documents come down to one row for each part and kind of label: how many, and which is first.
    texts = d.groupBy("h", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    texts = C.table(texts)
    least = texts.groupBy(F.col("h").alias("h2")).agg(F.min("first.id").alias("least"))
    texts = texts.join(least, F.col("h") == F.col("h2"))
    originals = F.col("n_null") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    kinds = F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct(F.col("mask").bitwiseOR(1 << FILTERS.index("E")).alias("mask"), (F.col("n") - originals).alias("n")))
    split = texts.select("part", "good", "toxic", F.explode(kinds).alias("k")).filter("k.n > 0")
    n = F.col("k.n")
    return split.groupBy("part", F.col("k.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("n_toxic"))


def removal_polynomial(counts: dict[int, int], n_filters: int) -> list[int]:
    """Coefficients by set of variables (bits) of f(x) = sum over masks of count * (1 - product of (1 - x_i) over the mask):
    what is removed in the mean when filter i is applied with probability x_i. It is linear in each variable."""
    above = [counts.get(s, 0) for s in range(1 << n_filters)]
    for i in range(n_filters):  # counts of all masks that hold s
        for s in range(1 << n_filters):
            if not s >> i & 1:
                above[s] += above[s | 1 << i]
    return [0] + [above[s] if s.bit_count() % 2 else -above[s] for s in range(1, 1 << n_filters)]


def corners(coefficients: list[int]) -> list[int]:
    """The polynomial at each corner of the cube: what each set of filters removes together."""
    values, i = list(coefficients), 1
    while i < len(values):
        for s in range(len(values)):
            if s & i:
                values[s] += values[s ^ i]
        i *= 2
    return values


def shapley(coefficients: list[int], i: int) -> Fraction:
    """The integral from 0 to 1 of the partial derivative by x_i at (t, ..., t): a term of k variables, x_i among them, has
    the derivative t^(k-1) there, and the integral 1/k."""
    return sum((Fraction(a, s.bit_count()) for s, a in enumerate(coefficients) if s >> i & 1), Fraction(0))


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, n, n_good, n_toxic). Parts are worked out one by
    one in tasks, from at most 2^filters counts each."""
    n, orders = len(filters), list(permutations(range(len(filters))))
    names = ["".join(filters[i] for i in o) for o in orders]
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    fields = [f.split()[0] for f in schema.split(", ")]

    def work(batches):
        for batch in batches:
            for part, sets in zip(batch.column("part").to_pylist(), batch.column("sets").to_pylist(), strict=True):
                polynomials = [removal_polynomial({s["mask"]: s[c] for s in sets}, n) for c in COUNTS]
                gone, good, toxic = map(corners, polynomials)
                total, everything = sum(s["n"] for s in sets), (1 << n) - 1
                values = [shapley(polynomials[0], i) * len(orders) for i in range(n)]
                out = []
                for name, order in zip(names, orders, strict=True):
                    done = 0
                    for step, i in enumerate(order, 1):
                        now = done | 1 << i
                        removed = gone[now] - gone[done]
                        alone = gone[everything] - gone[everything ^ 1 << i]
                        out.append((part, name, step, total - gone[now], removed, gone[1 << i] - removed, alone, good[now] - good[done], toxic[now] - toxic[done], int(values[i])))
                        done = now
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f in fields[:2] else pa.int32() if f == "step" else pa.int64()) for f, c in zip(fields, columns, strict=True)], fields)

    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("sets"))
    return parts.mapInArrow(work, schema)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters by source, in all 120 orders, step by step. Null texts and sources are empty; an empty table has no parts."""
    return interactions(failures(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > e.least THEN 16 ELSE 0 END AS m
  FROM d JOIN e ON d.t = e.t LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, m::BIGINT AS m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
x AS (SELECT unnest(range(0, 5)) AS i),
o AS (
  SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM x a, x b, x c, x d, x e
  WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
s AS (
  SELECT substr('ABCDE', a::INT + 1, 1) || substr('ABCDE', b::INT + 1, 1) || substr('ABCDE', c::INT + 1, 1) || substr('ABCDE', d::INT + 1, 1) || substr('ABCDE', e::INT + 1, 1) AS filter_order,
         unnest([1, 2, 3, 4, 5]) AS step, unnest([a, b, c, d, e]) AS i,
         unnest([0, 1 << a, (1 << a) + (1 << b), (1 << a) + (1 << b) + (1 << c), (1 << a) + (1 << b) + (1 << c) + (1 << d)]) AS done
  FROM o),
r AS (
  SELECT part, filter_order, step, i,
         sum(CASE WHEN m & done = 0 AND (m >> i) & 1 = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN m & done = 0 AND (m >> i) & 1 = 1 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN m & done <> 0 AND (m >> i) & 1 = 1 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN m = 1 << i THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN m & done = 0 AND (m >> i) & 1 = 1 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN m & done = 0 AND (m >> i) & 1 = 1 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM r
"""
