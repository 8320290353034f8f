import math
from collections import Counter

import numpy as np

from webmill.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, row string, id string, x double, length2 int, grade int, score string"


def brute(rows, every, k):
    fit = [(i, [math.floor(256 * float(np.float32(e))) for e in x]) for i, x in rows if x is not None and all(e is not None and math.isfinite(e) for e in x)]
    fit = [r for r in fit if sum(e * e for e in r[1]) < 2**62]
    out = []
    for n, (i, x) in enumerate(fit):
        if i is not None and i % every == 0:
            scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), j is None, j or 0) for m, (j, y) in enumerate(fit) if m != n and len(x) == len(y)]
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, "r", "i", 0.5, 3, 4, "s") for i, x in rows], SCHEMA).repartition(3)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, (rnd.normal(size=16) * np.linspace(2, 0.1, 16) * rnd.choice([0.1, 1, 3])).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 16) for i in range(120)] + [(20, [1.0] * 16)] * 3 + [(None, [0.5] * 16), (None, [2.0] * 16)]  # equal vectors, repeated rows, null ids
    rows += [(2000, None), (2010, []), (2011, []), (2020, [float("nan")] + [1.0] * 15), (2030, [None] + [1.0] * 15), (2040, [float("inf")] + [1.0] * 15), (2050, [0.0] * 16), (2060, [1e30] * 16), (2070, [1.0, 2.0]), (2071, [2.0, 0.01]), (-10, [-0.001] * 16)]
    df = table(spark, rows)
    want = brute(rows, 10, 5)
    for strand, queries in ((1 << 22, 10_000), (128 * 20, 7), (128, 10_000)):
        assert Counter(map(tuple, topk.top_k(df, every=10, strand_bytes=strand, queries=queries).collect())) == want
    assert Counter(map(tuple, topk.top_k(df.limit(3), every=1).collect())).total() <= 6


def test_large_numbers_are_exact(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.normal(size=4) * 2e6).tolist()) for i in range(60)]  # products beyond 2^53
    assert Counter(map(tuple, topk.top_k(table(spark, rows), every=5).collect())) == brute(rows, 5, 5)


def test_empty(spark):
    assert topk.top_k(table(spark, [])).count() == 0
    assert topk.top_k(table(spark, [(1, [1.0])])).count() == 0
    assert topk.top_k(table(spark, [(50, [1.0])])).count() == 0


def test_pairs_are_ruled_out():
    """Bounds by length and by residual leave few pairs of vectors with a spectrum, and lose none."""
    rnd = np.random.default_rng(4)
    x = np.floor(256 * rnd.normal(size=(4096, 32)) * np.geomspace(1, 0.02, 32) * rnd.lognormal(0, 0.5, (4096, 1))).astype(np.int64)
    x = x[np.argsort(-(x * x).sum(1))]
    turn, rows = topk.rotation(x.astype(float)), np.arange(len(x))
    q = topk.Turned(x[5::50], turn)
    blocks = [(topk.Turned(x[i : i + 512], turn), rows[i : i + 512], rows[i : i + 512], np.ones(512, bool)) for i in range(0, 4096, 512)]
    counts = {}
    got = topk.search(q, rows[5::50], np.full(len(q.x), -np.inf), blocks, 5, counts).found
    exact = x[5::50] @ x.T
    exact[np.arange(len(q.x)), rows[5::50]] = -(2**60)
    order = np.lexsort((np.broadcast_to(rows, exact.shape), -exact), axis=1)[:, :5]
    assert (got[4].reshape(-1, 5) == order).all()
    assert counts["multiplied out"] < 0.3 * counts["pairs"] and counts["after lengths"] < counts["pairs"]
