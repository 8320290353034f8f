"""Operator 13: exact top-k inner products by norm-sorted search with pruned partial sums.

Candidates are graded by length and dealt in strands: a task holds one strand, in blocks of descending length, and queries
pass by in batches. By Cauchy-Schwarz a product is at most the product of lengths, so a query is sent to no grade, and
meets no block, whose longest vector cannot reach its k-th best. Of the rest the product over the first axes of a rotation
(those of greatest variance) is taken, and what the other axes may add is at most the product of what is left of the
lengths. Only pairs that this does not rule out are multiplied out, in whole numbers. A query's bound begins with its
products with some of the longest vectors; what strands have found for it meets at the end.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webmill.llm import common as C

EVERY = 50
K = 5
SCALE = 256
#: Bytes of a strand of candidates, as 64-bit numbers.
STRAND_BYTES = 4 << 20
#: Candidates and queries whose products are taken at once, and pairs that are multiplied out at once.
BLOCK = 1_024
PAIRS = 100_000
#: Queries that a task takes for its strand; of more, each so many get copies of the strands of their own.
QUERIES = 32_768
#: Grades of length for each doubling: lengths are below 2^31, so there are 31 times as many grades at most.
GRADES = 16
#: Share of the axes whose product is taken first.
HEAD = 0.25
#: Vectors that the rotation is fitted to, chosen by hash, and vectors of the highest grades from which bounds begin. Both
#: change what is ruled out, and never what is found.
SAMPLE = 4_096
SEEDS = 512
#: Rounding of products over rotated axes, as a share of the product of lengths.
SLACK = 1e-9
#: Squares of lengths are below this, so products fit into 64 bits.
LONGEST = 2.0**62

VECTOR = "row long, id long, dims int, length2 long, x binary"


def whole_vectors(docs: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, dims, length2, x): each vector that takes part in whole numbers of 64 bits, and the square of its length."""

    def work(batches):
        for batch in batches:
            x = batch.column("x")
            size = np.diff(x.offsets.to_numpy()) if len(x) else np.zeros(0, int)
            flat = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null is not a number here
            end = np.cumsum(np.where(x.is_valid(), size, 0))
            begin = end - np.where(x.is_valid(), size, 0)
            odd = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            fit = np.array(x.is_valid()) & (odd[end] == odd[begin])
            for dims in np.unique(size[fit]).tolist():
                at = np.flatnonzero(fit & (size == dims))
                part = flat[begin[at][:, None] + np.arange(dims)[None, :]]
                fits = (part * part).sum(1) < LONGEST
                part, at = part[fits].astype(np.int64), at[fits]
                if len(at):
                    row, ids = (batch.column(c).take(pa.array(at)) for c in ("row", "id"))
                    yield pa.RecordBatch.from_arrays([row, ids, pa.array(np.full(len(at), dims, np.int32)), pa.array((part * part).sum(1)), pa.array([p.tobytes() for p in part], pa.binary())], ["row", "id", "dims", "length2", "x"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(work, VECTOR)


def numbers(blobs: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), dims)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of the sample, as columns, those of greatest singular value first."""
    values, axes = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exactly: in doubles where these hold every sum, else in 64 bits."""
    longest = np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0) * (b.astype(np.float64) ** 2).sum(1).max(initial=0))
    return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if longest < 2**52 else a @ b.T


class Turned:
    """Vectors with their lengths, their first axes after rotation, and the lengths of what the other axes hold."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        head = int(np.ceil(len(turn) * HEAD))
        t = x.astype(np.float64) @ turn
        self.x, self.first, self.rest = x, t[:, :head], np.sqrt((t[:, head:] ** 2).sum(1))
        self.length = np.sqrt((x.astype(np.float64) ** 2).sum(1))


class Best:
    """The k best of each query so far: score, id and row of each, and the bound below which nothing is wanted."""

    def __init__(self, bound: np.ndarray, k: int):
        self.k, self.bound = k, bound.astype(np.float64)
        self.found = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool, np.int64))

    def add(self, *more: np.ndarray) -> None:
        """more: query, score, id, whether the id is known, row. Ties go to the smaller id, an unknown one last."""
        q, score, ids, known, row = (np.concatenate(p) for p in zip(self.found, more, strict=True))
        order = np.lexsort((row, ids, ~known, -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        kept = order[place < self.k]
        self.found = q[kept], score[kept], ids[kept], known[kept], row[kept]
        last = order[place == self.k - 1]
        self.bound[q[last]] = np.maximum(self.bound[q[last]], score[last])


def search(queries: Turned, rows: np.ndarray, bound: np.ndarray, blocks: list, k: int, counts: dict | None = None) -> Best:
    """The k best of queries (of these rows) among blocks (vectors, row, id, known) by descending length; of what is below
    the bound nothing need be found. counts, if given, is told how many pairs there were, and how many each step left."""
    best = Best(bound, k)
    for c, c_row, c_id, c_known in blocks:
        live = np.flatnonzero(queries.length * c.length.max() * (1 + SLACK) + SLACK >= best.bound)
        most = queries.first[live] @ c.first.T + queries.rest[live][:, None] * c.rest[None, :]
        most += SLACK * (1 + queries.length[live][:, None] * c.length[None, :])
        a, b = np.nonzero(most >= best.bound[live][:, None])
        a = live[a]
        if counts is not None:
            for what, n in (("pairs", len(rows) * len(c_row)), ("after lengths", len(live) * len(c_row)), ("multiplied out", len(a))):
                counts[what] = counts.get(what, 0) + n
        # Where most pairs are left, one product of matrices takes less than products of pairs.
        exact = products(queries.x, c.x) if 8 * len(a) > len(rows) * len(c_row) else None
        for i in range(0, len(a), PAIRS):
            q, o = a[i : i + PAIRS], b[i : i + PAIRS]
            score = exact[q, o] if exact is not None else (queries.x[q] * c.x[o]).sum(1)
            good = (score >= best.bound[q]) & (rows[q] != c_row[o])
            q, o = q[good], o[good]
            best.add(q, score[good], c_id[o], c_known[o], c_row[o])
    return best


def top_k(docs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE, strand_bytes: int = STRAND_BYTES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by `every` the k rows of greatest inner product,
    its own left out, of vectors whose components x are floor(scale * x).

    Ties go to the smaller id, a null id last. Repeated ids and repeated rows are rows of their own, and queries of their
    own. Vectors that are null or hold a null or non-finite component take no part, nor do those so long that a product
    could exceed 64 bits (a squared length of 2^62 or more). Vectors of different numbers of components do not meet;
    empty ones have products of 0. A table without queries or vectors has no rows.
    """
    rows = C.table(whole_vectors(docs, id_col, vec_col, scale))
    found = docs.sparkSession.createDataFrame([], "query long, query_id long, score long, vec_id long, row long")
    for (dims,) in sorted(rows.select("dims").distinct().collect()):  # a table has one, or a few
        found = found.unionByName(_found(rows.filter(F.col("dims") == dims), dims, every, k, max(1, strand_bytes // (8 * max(dims, 1))), queries))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(rows: DataFrame, dims: int, every: int, k: int, strand: int, queries: int) -> DataFrame:
    """(query, query_id, score, vec_id, row): for each query the k best of each strand, or more than it needs."""
    graded = rows.withColumn("grade", F.floor(F.log2(F.col("length2").cast("double") + 1) * (GRADES / 2)).cast("int"))
    # At most 31 * GRADES rows, whatever the input: how many strands each grade has, and its greatest length.
    grades = graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.max("length2").alias("longest")).collect()
    total, top, left = sum(g.n for g in grades), max((g.grade for g in grades), default=0), SEEDS
    for g in sorted(grades, key=lambda g: -g.grade):
        top, left = g.grade, left - g.n
        if left <= 0:
            break
    longest = sum(g.n for g in grades if g.grade >= top)

    def some(of: DataFrame, n: int, most: int) -> np.ndarray:
        """About `most` of the n rows, twice as many at most, chosen by hash in tasks."""
        chosen = of.filter(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 40)) < int(min(1.0, most / max(n, 1)) * (1 << 40)))
        return numbers([r.x for r in chosen.select("x").limit(2 * most).collect()], dims)

    turn = rotation(some(rows, total, SAMPLE).astype(np.float64))
    seeds = some(graded.filter(F.col("grade") >= top), longest, SEEDS)
    asked = F.pmod("id", F.lit(every)) == 0

    def begin(batches):
        """A query's bound: its k-th best among the seeds; one further, as the query itself may be among them."""
        for b in batches:
            if b.num_rows:
                x = numbers(b.column("x").to_pylist(), dims)
                at = len(seeds) - k - 1
                bound = np.partition(products(x, seeds), at, 1)[:, at].astype(np.float64) if at >= 0 else np.full(len(x), -np.inf)
                yield b.append_column("bound", pa.array(bound))

    groups = max(1, -(-rows.filter(asked).count() // queries))
    strands = F.array(*[F.struct(F.lit(g.grade).alias("grade"), F.lit(-(-g.n // strand)).alias("strands"), F.lit(float(g.longest) ** 0.5).alias("reach")) for g in sorted(grades, key=lambda g: g.grade)])
    number = F.create_map(*[F.lit(v) for g in grades for v in (g.grade, -(-g.n // strand))])
    columns = ["grade", "strand", "of", "query", "length2", "row", "id", "x", "bound"]
    held = graded.withColumn("strand", F.pmod(F.xxhash64("row"), F.try_element_at(number, "grade")).cast("int"))
    held = held.select("grade", "strand", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("of"), F.lit(False).alias("query"), "length2", "row", "id", "x", F.lit(None).cast("double").alias("bound"))
    come = rows.filter(asked).select("length2", "row", "id", "x").mapInArrow(begin, "length2 long, row long, id long, x binary, bound double")
    reached = F.filter(strands, lambda g: F.sqrt(F.col("length2").cast("double")) * g.reach * (1 + SLACK) + SLACK >= F.col("bound"))
    come = come.select("*", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("of"), F.explode(reached).alias("g"))
    come = come.select(F.col("g.grade").alias("grade"), F.explode(F.sequence(F.lit(0), F.col("g.strands") - 1)).alias("strand"), "of", F.lit(True).alias("query"), "length2", "row", "id", "x", "bound")
    met = held.select(*columns).unionByName(come.select(*columns)).repartition("grade", "strand", "of").sortWithinPartitions("grade", "strand", "of", "query", F.desc("length2"), "row")

    def work(batches):
        def runs():
            """Rows of one strand's candidates, or of one batch of its queries, as columns."""
            for b in batches:
                key = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("grade", "strand", "of", "query")], 1)
                cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
                for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                    if j > i:
                        yield tuple(key[i]), b.slice(i, j - i)

        blocks, of = [], None
        for (*strand, query), part in groupby(runs(), lambda r: r[0]):
            if not query:
                blocks, of = [], strand
                for _, b in part:
                    for i in range(0, b.num_rows, BLOCK):
                        s = b.slice(i, BLOCK)
                        blocks.append((Turned(numbers(s.column("x").to_pylist(), dims), turn), s.column("row").to_numpy(), np.asarray(s.column("id").fill_null(0)), np.asarray(s.column("id").is_valid())))
                continue
            for _, b in part:
                for i in range(0, b.num_rows if strand == of else 0, BLOCK):  # a strand may have no vectors
                    s = b.slice(i, BLOCK)
                    row, ids = s.column("row").to_numpy(), s.column("id").to_numpy()
                    q, score, c_id, known, c_row = search(Turned(numbers(s.column("x").to_pylist(), dims), turn), row, s.column("bound").to_numpy(), blocks, k).found
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(row[q]), pa.array(ids[q]), pa.array(score), pa.array(c_id, mask=~known), pa.array(c_row)], ["query", "query_id", "score", "vec_id", "row"])

    return met.mapInArrow(work, "query long, query_id long, score long, vec_id long, row long")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector: query_id, rank, vec_id, score."""
    return top_k(C.read(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score, c.r AS o
      FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, o) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM k WHERE n <= 5
"""
