"""Operator 9: embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are at a squared distance of at most 2 - 2c. Rotated onto their principal axes and
split into blocks of axes, two such vectors are, in one block at least, no further apart than the block's share of
that distance. Each block is joined by range: its first axes are cut into cells as wide as the share's root, and a
vector meets those of its own and of neighbouring cells.

Vectors are rotated once and written in whole numbers (2^25 to the unit). Sums of their products are exact in double
precision, whatever order a task takes them in, so every task decides alike in which block a pair counts: the first
within whose share it lies. What goes to the cells at first is a block's coordinates alone, as 16-bit floats with room
for their rounding; only vectors with a candidate in a cell go there whole. Cells of a few vectors are compared pair by
pair, many cells at once; large ones as products of matrices. Pairs whose cosine is so close to the limit that the
rotation's rounding could decide it are few, and are worked out anew from the vectors as they were given.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill.llm import common as C
from webmill.llm.components import components

COSINE = 0.93
BLOCKS = 4
#: Axes of each block that are cut into cells.
AXES = 2
#: Vectors of a cell that one task compares with as many others at once; larger cells are dealt to several.
CHUNK = 2_000
#: Tiles of more pairs are compared as products of matrices, of so many pairs at a time.
SMALL = 4_096
PAIRS = 1_000_000
#: Numbers gathered at once where pairs are compared one by one.
GATHER = 2_000_000
#: Vectors from which the rotation is fitted, those of least hash. Any rotation gives the same links.
SAMPLE = 20_000
#: Whole numbers to the unit; sums of their products stay below 2^53 for unit vectors.
GRID = 1 << 25
#: The distance that 16-bit coordinates of two vectors, of length 1 at most, may add.
HALF = 1.1e-3


def rotation(sample: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Principal axes dealt to blocks in turn, the blocks' limits, and each block's share by its variance."""
    dims = sample.shape[1]
    values, axes = np.linalg.eigh(sample.T @ sample / max(1, len(sample)))
    order = np.argsort(-values)
    deal = np.concatenate([order[b::blocks] for b in range(blocks)])
    cut = np.concatenate(([0], np.cumsum([len(order[b::blocks]) for b in range(blocks)])))
    share = np.array([max(values[deal[a:b]].sum(), 1e-3) if b > a else 0.0 for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return axes[:, deal] if dims else axes, cut, share / share.sum()


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near(docs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, blocks: int = BLOCKS, axes: int = AXES, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs: id, n_links (other rows it links with), component_id (least id reachable) and kept (its own).

    Rows link when labels are equal and not null and the cosine, in double precision, is at least `cosine`. Vectors
    that are null, empty, zero or hold a null or non-finite component link with nothing, and so do vectors of
    different lengths. Ids are whole numbers; rows of one vector and label are worked out once, and repeated ids are
    rows of their own. A row of null id links like any other; it is passed over when the least id is taken.
    """
    v = F.col(vec_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("y"), v.cast("array<double>").alias("x"))
    fit = F.coalesce((F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0), F.lit(False)) & F.col("y").isNotNull()
    one, two = F.xxhash64("y", "x"), F.xxhash64(F.lit("second"), "x", "y")
    ids = C.table(rows.select("id", F.when(fit, one).alias("h1"), F.when(fit, two).alias("h2")))
    # Vectors are told apart by themselves and numbered; only the way back to their rows goes by a name of 128 bits.
    nodes = rows.filter(fit).groupBy("y", "x").agg(F.count(F.lit(1)).alias("m"))
    nodes = C.table(nodes.select(F.monotonically_increasing_id().alias("s"), one.alias("h1"), two.alias("h2"), "y", "x", "m"))
    spark = docs.sparkSession
    parts = []
    for (dims,) in sorted(nodes.select(F.size("x")).distinct().collect()):  # a table has one length, or a few
        of = nodes.filter(F.size("x") == dims)
        sample = of.orderBy("h1").limit(SAMPLE).select("x").toArrow().column("x").combine_chunks()
        sample = np.concatenate([c.flatten().to_numpy() for c in (sample.chunks if isinstance(sample, pa.ChunkedArray) else [sample])])
        parts.append(_links(of, rotation(_unit(sample.reshape(-1, dims)), min(blocks, dims)), cosine, axes, chunk))
    found = spark.createDataFrame([], "s long, n long, root long, close boolean")
    for p in parts:
        found = found.unionByName(p)
    found = C.table(found)
    close = found.filter("close")
    found = found.filter("NOT close").drop("close")
    if not close.isEmpty():
        found = found.unionByName(_settled(close, nodes, cosine))
    degree = found.groupBy("s").agg(F.sum("n").alias("n"))
    linked = C.table(components(found.select(F.col("s").alias("u"), F.col("root").alias("v"))))
    least = ids.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("own"))
    named = nodes.select("s", "h1", "h2", "m").join(least, ["h1", "h2"]).join(degree, "s", "left").join(linked.withColumnRenamed("node", "s"), "s", "left")
    named = C.table(named.withColumn("root", F.coalesce("root", "s")))
    low = named.groupBy("root").agg(F.min("own").alias("lo"))
    named = named.join(low, "root").select(F.col("h1").bitwiseXOR(F.lit(1)).alias("k1"), F.col("h2").alias("k2"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "lo")
    out = ids.join(named, (F.col("h1").bitwiseXOR(F.lit(1)) == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    lo = F.coalesce("lo", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), lo.alias("component_id"), F.coalesce(lo == F.col("id"), F.lit(False)).alias("kept"))


def _settled(close: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """(s, n, root) of the pairs of `close` that link by the cosine of the vectors as they were given."""
    at = lambda t: nodes.select(F.col("s").alias(f"s{t}"), F.col("m").alias(f"m{t}"), F.col("x").alias(f"x{t}"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, e: t + e)
    both = close.select(F.col("s").alias("s1"), F.col("root").alias("s2")).join(at(1), "s1").join(at(2), "s2")
    both = both.filter(dot("x1", "x2") / F.sqrt(dot("x1", "x1") * dot("x2", "x2")) >= cosine)
    ends = F.array(F.struct(F.col("s1").alias("s"), F.col("m2").alias("n"), F.col("s2").alias("root")), F.struct(F.col("s2").alias("s"), F.col("m1").alias("n"), F.col("s1").alias("root")))
    return both.select(F.explode(ends).alias("e")).select("e.*")


def _blobs(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32)[: len(rows) + 1]), pa.py_buffer(rows)])


def _rows(column, kind: type, width: int) -> np.ndarray:
    """What _blobs made, as a matrix."""
    return C.text_arrays(column)[0].view(kind).reshape(-1, width)


def _deal(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (g, s, guest, ...) of cells in which two meet, with the tile (i, j) of chunks that a task compares, and the side.
    Home chunk i meets home chunks i.. and every guest chunk; j counts home chunks, then guest chunks."""
    columns = rows.columns
    sizes = rows.groupBy("g").agg(F.count_if(~F.col("guest")).alias("nh"), F.count_if("guest").alias("ng"))
    sizes = sizes.filter("nh > 0 AND nh + ng > 1").select(F.col("g").bitwiseXOR(F.lit(1)).alias("g2"), F.ceil(F.col("nh") / chunk).cast("int").alias("bh"), F.ceil(F.col("ng") / chunk).cast("int").alias("bg"))
    dealt = rows.join(sizes, F.col("g").bitwiseXOR(F.lit(1)) == F.col("g2"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("s"), F.when(F.col("guest"), F.col("bg")).otherwise(F.col("bh"))).cast("int"))
    tile = lambda i, j, two: F.struct(i.alias("i"), j.alias("j"), two.alias("two"))
    own, last = F.col("own"), F.col("bh") + F.col("bg") - 1
    home = F.transform(F.sequence(F.lit(0), last), lambda o: F.when(o < F.col("bh"), tile(F.least(own, o), F.greatest(own, o), own > o)).otherwise(tile(own, o, F.lit(False))))
    guest = F.transform(F.sequence(F.lit(0), F.col("bh") - 1), lambda o: tile(o, F.col("bh") + own, F.lit(True)))
    met = dealt.select(*columns, F.explode(F.when(F.col("guest"), guest).otherwise(home)).alias("p"))
    return met.select(*columns, F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("p.two").alias("two"))


def _sorted(met: DataFrame) -> DataFrame:
    return met.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "two")


def _begins(t: pa.Table) -> np.ndarray:
    """Where a tile's rows begin."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("g", "i", "j"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _whole(batches):
    """Tables of whole tiles, however Spark cut them into batches."""
    held, key = [], lambda b, at: [b.column(c)[at].as_py() for c in ("g", "i", "j")]
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if len(held) > 1 and key(held[0], 0) == key(b, b.num_rows - 1):
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = int(_begins(t)[-1])
        if last:
            yield t.slice(0, last)
        held = t.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _compare(t: pa.Table, at_once: int, pairs, dense) -> None:
    """Calls pairs(a, b) with rows of t that meet in small tiles, and dense(one, two, same) for blocks of large ones: one[i]
    meets two[j], if `same` those of later rows only."""
    start = _begins(t)
    size = np.diff(np.append(start, t.num_rows))
    right = np.add.reduceat(t.column("two").to_numpy().astype(np.int64), start)
    same = t.column("i").to_numpy()[start] == t.column("j").to_numpy()[start]
    left = np.where(same, size, size - right)
    right = np.where(same, size, right)
    shift = np.where(same, 0, left)
    n = left * right
    few = np.flatnonzero((n > 0) & (n <= SMALL))
    total = np.concatenate(([0], np.cumsum(n[few])))
    first = 0
    while first < len(few):
        last = max(first + 1, int(np.searchsorted(total, total[first] + at_once, "right")) - 1)
        tiles = few[first:last]
        of = np.repeat(tiles, n[tiles])
        k = np.arange(len(of)) - np.repeat(total[first:last] - total[first], n[tiles])
        a, b = start[of] + k // right[of], start[of] + shift[of] + k % right[of]
        later = a < b
        pairs(a[later], b[later])
        first = last
    for tile in np.flatnonzero(n > SMALL):
        two = np.arange(start[tile] + shift[tile], start[tile] + shift[tile] + right[tile])
        step = max(1, PAIRS // len(two))
        for a in range(start[tile], start[tile] + left[tile], step):
            one = np.arange(a, min(a + step, start[tile] + left[tile]))
            dense(one, two[two > a] if same[tile] else two, bool(same[tile]))


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a and b: root holds the least row of each row's group."""
    while len(a):
        p, q = root[a], root[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        low = np.minimum(p, q)
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _links(nodes: DataFrame, rotated, cosine: float, axes: int, chunk: int) -> DataFrame:
    """(s, n, root, close): rows that s links with, as far as one task saw, and one of the nodes that it links with there;
    close: s and root are a pair to be settled by the vectors as given."""
    turn, cut, share = rotated
    dims, widest = len(turn), int(np.diff(cut).max())
    unit = float(GRID) ** 2
    # What rounding to the grid may add to a squared distance, and to a cosine.
    budget = np.floor((share * (2 - 2 * cosine) + 4 * dims**0.5 / GRID + dims / unit + 1e-9) * unit)
    width = np.sqrt(budget) * (1 + 1e-9)
    band = dims**0.5 / GRID + dims / unit + 1e-12
    sure, maybe = (cosine + band) * unit, (cosine - band) * unit
    reach = ((np.sqrt(budget / unit) + HALF) ** 2 + 1e-5).astype(np.float32)

    def rotate(batches):
        for b in batches:
            if b.num_rows:
                x = _unit(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)) @ turn
                yield pa.RecordBatch.from_arrays([b.column("s"), b.column("y"), b.column("m"), _blobs(np.rint(x * GRID).astype(np.int32))], ["s", "y", "m", "x"])

    turned = C.table(nodes.select("s", F.xxhash64("y").alias("y"), "m", "x").mapInArrow(rotate, "s long, y long, m long, x binary"))

    def cells(batches):
        """Each vector to its cell in each block (home), and to the neighbours that come later in order (guest)."""
        for b in batches:
            if not b.num_rows:
                continue
            x, label = _rows(b.column("x"), np.int32, dims), np.array(b.column("y"), np.int64).view(np.uint64)
            for k in range(len(width)):
                used = min(axes, cut[k + 1] - cut[k])
                at = np.floor(x[:, cut[k] : cut[k] + used] / width[k]).astype(np.int64)
                near = np.zeros((len(x), widest), np.float16)
                near[:, : cut[k + 1] - cut[k]] = x[:, cut[k] : cut[k + 1]] / GRID
                near = _blobs(near)
                for step in product((-1, 0, 1), repeat=used):
                    if step < (0,) * used:
                        continue
                    g = C.fold(C.mix(label), np.full(len(x), k, np.uint64))
                    for c in range(used):
                        g = C.fold(g, (at[:, c] + step[c]).view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), b.column("s"), pa.array(np.full(len(x), step != (0,) * used)), pa.array(np.full(len(x), k, np.int8)), near], ["g", "s", "guest", "k", "c"])

    def candidates(batches):
        """The members of each cell that have a candidate there."""
        for t in _whole(batches):
            k = t.column("k").to_numpy()
            x = _rows(t.column("c"), np.float16, widest).astype(np.float32)
            square, hit = (x * x).sum(1), np.zeros(len(x), bool)

            def pairs(a, b):
                near = ((x[a] - x[b]) ** 2).sum(1) <= reach[k[a]]  # noqa: B023
                hit[a[near]] = hit[b[near]] = True  # noqa: B023

            def dense(one, two, same):
                near = square[one][:, None] + square[two][None, :] - 2 * (x[one] @ x[two].T) <= reach[k[one[0]]]  # noqa: B023
                if same:
                    near &= one[:, None] < two[None, :]
                hit[one[near.any(1)]] = hit[two[near.any(0)]] = True  # noqa: B023

            _compare(t, GATHER // widest, pairs, dense)
            at = pa.array(np.flatnonzero(hit))
            if len(at):
                yield t.select(["g", "s", "guest", "k"]).take(at).combine_chunks().to_batches()[0]

    def verify(batches):
        for t in _whole(batches):
            s, k, y, m = (t.column(c).to_numpy() for c in ("s", "k", "y", "m"))
            x = _rows(t.column("x"), np.int32, dims)
            weight, n, root = m.astype(np.float64), np.zeros(len(s)), np.arange(len(s))
            square = np.add.reduceat(x.astype(np.float64) ** 2, cut[:-1], axis=1)
            near = []

            def pairs(a, b):
                p, q = x[a].astype(np.float64), x[b].astype(np.float64)  # noqa: B023
                within = np.add.reduceat((p - q) ** 2, cut[:-1], axis=1) <= budget
                dot = np.einsum("ij,ij->i", p, q)
                good = within.any(1) & (within.argmax(1) == k[a]) & (y[a] == y[b]) & (dot >= maybe)  # noqa: B023
                link = good & (dot >= sure)
                count(a[link], b[link])
                settle(a[good & ~link], b[good & ~link])

            def count(a, b):
                np.add.at(n, a, weight[b])  # noqa: B023
                np.add.at(n, b, weight[a])  # noqa: B023
                _unite(root, a, b)  # noqa: B023

            def settle(a, b):
                if len(a):
                    near.append((s[a], s[b]))  # noqa: B023

            def dense(one, two, same):
                p, q, block = x[one].astype(np.float64), x[two].astype(np.float64), k[one[0]]  # noqa: B023
                good, dot = y[one][:, None] == y[two][None, :], np.zeros((len(one), len(two)))  # noqa: B023
                if same:
                    good &= one[:, None] < two[None, :]
                for b in range(len(budget)):
                    part = p[:, cut[b] : cut[b + 1]] @ q[:, cut[b] : cut[b + 1]].T
                    dot += part
                    if b <= block:
                        within = square[one, b][:, None] + square[two, b][None, :] - 2 * part <= budget[b]  # noqa: B023
                        good &= within if b == block else ~within
                        if not good.any():
                            return
                good &= dot >= maybe
                link = good & (dot >= sure)
                settle(*(at[i] for at, i in zip((one, two), np.nonzero(good & ~link), strict=True)))
                both = link.astype(np.float64)
                n[one] += both @ weight[two]  # noqa: B023
                n[two] += weight[one] @ both  # noqa: B023
                i, j = np.nonzero(link & (root[one][:, None] != root[two][None, :]))  # noqa: B023
                _unite(root, one[i], two[j])  # noqa: B023

            _compare(t, GATHER // dims, pairs, dense)
            at = np.flatnonzero(n)
            a, b = (np.concatenate([p[e] for p in near] + [s[:0]]) for e in (0, 1))
            if len(at) + len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((s[at], a))), pa.array(np.concatenate((n[at].astype(np.int64), np.zeros(len(a), np.int64)))), pa.array(np.concatenate((s[root[at]], b))), pa.array(np.repeat([False, True], [len(at), len(a)]))],
                    ["s", "n", "root", "close"],
                )

    spread = turned.select("s", "y", "x").mapInArrow(cells, "g long, s long, guest boolean, k byte, c binary")
    found = C.table(_sorted(_deal(spread, chunk)).mapInArrow(candidates, "g long, s long, guest boolean, k byte").distinct())
    whole = turned.select(F.col("s").bitwiseXOR(F.lit(1)).alias("s2"), "y", "m", "x")
    # Cells are dealt first: vectors go to the pairs of chunks that they are compared in, and nowhere else.
    met = _deal(found, chunk).join(whole, F.col("s").bitwiseXOR(F.lit(1)) == F.col("s2")).drop("s2")
    return _sorted(met).mapInArrow(verify, "s long, n long, root long, close boolean")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by components of cosine 0.93 or more within a label: vec_id, n_links, component_id, kept."""
    return near(C.read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
c AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT e.b, c.root FROM c JOIN e ON c.vec_id = e.a WHERE c.root < e.b)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, min(root) AS component_id, min(root) = c.vec_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.a GROUP BY c.vec_id, n
"""
