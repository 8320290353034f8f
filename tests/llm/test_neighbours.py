from collections import Counter

import numpy as np
import pyarrow as pa

from webmill.llm import neighbours


def brute(rows, cosine):
    fit = lambda x, y: y is not None and x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x, y) in enumerate(rows):
        for b in range(a):
            _, z, w = rows[b]
            if fit(x, y) and fit(z, w) and y == w and len(x) == len(z):
                p, q = np.array(x, float), np.array(z, float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= cosine:
                    n[a] += 1
                    n[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return Counter((rows[k][0], n[k], least[find(k)], rows[k][0] is not None and rows[k][0] == least[find(k)]) for k in range(len(rows)))


def test_against_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    rows = []
    for family in range(12):
        centre = rnd.normal(size=12)
        for copy in range(10):
            x = (centre + rnd.normal(size=12) * rnd.choice([0, 0.05, 0.25, 0.4])).astype(np.float32).tolist()
            rows.append((100 * family + copy, x, family % 3))
    rows += [(5000 + i, [1.0] * 12, 1) for i in range(40)] + [(6000, [2.0] * 12, 1), (6001, [1.0] * 12, None), (6002, [0.0] * 12, 1), (6003, None, 1), (6004, [], 1)]
    rows += [(6005, [float("nan")] + [1.0] * 11, 1), (6006, [None] + [1.0] * 11, 1), (6007, [float("inf")] + [1.0] * 11, 1), (6008, [1.0, 1.0], 1), (6009, [1.0, 1.0], 1), (None, [1.0] * 12, 1), (6010, [1.0] * 12, 2), (6010, [1.0] * 12, 2)]
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame(rows, schema)
    more = df.selectExpr("*", "label AS g", "label AS s", "label AS h1", "label AS n", "label AS root", "vec_id AS id", "label AS x")
    for chunk, small in ((400, neighbours.SMALL), (7, neighbours.SMALL), (400, 0)):
        monkeypatch.setattr(neighbours, "SMALL", small)
        assert Counter(map(tuple, neighbours.near(more, chunk=chunk).collect())) == brute(rows, 0.93)
    assert neighbours.near(spark.createDataFrame([], schema)).count() == 0


def test_pairs_at_the_limit_are_settled_by_the_vectors_as_given(spark):
    """93, 36, 7, 2, 1, 1 has length 100, so its cosine with the first axis is 0.93; a little more beside it is too much."""
    axis, at, below, above = (list(map(float, v)) for v in ([1.0, 0, 0, 0, 0, 0], [93.0, 36, 7, 2, 1, 1], [93.0, 36, 7, 2, 1, 1.000001], [93.0, 36, 7, 2, 1, 0.999999]))
    rows = [(1, axis, 0), (2, axis, 0), (3, at, 0), (4, axis, 1), (5, below, 1), (6, axis, 2), (7, above, 2), (8, above, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert Counter(map(tuple, neighbours.near(df).collect())) == brute(rows, 0.93)


def test_whole_tiles_whatever_the_batches():
    rows = [(g, i, j, k) for g, i, j, n in ((1, 0, 0, 3), (1, 0, 1, 1), (2, 0, 0, 7), (3, 1, 1, 2)) for k in range(n)]
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + size], strict=True)], ["g", "i", "j", "k"]) for a in range(0, len(rows), size)]
        tables = list(neighbours._whole(batches))
        assert [tuple(r.values()) for t in tables for r in t.to_pylist()] == rows
        ends = [{(r["g"], r["i"], r["j"]) for r in t.to_pylist()} for t in tables]
        assert all(not a & b for n, a in enumerate(ends) for b in ends[:n])
