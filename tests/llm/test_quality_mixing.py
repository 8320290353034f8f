import re
from collections import Counter

from webmill.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_measures_and_verdicts(docs, nothing, cases):
    got = quality.quality(docs).collect()
    want = Counter()
    for i, t, *_ in cases:
        m = measures(t)
        want[(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    assert quality.quality(nothing).count() == 0


def test_a_host_that_fails_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(30)] + [(30, good, "bad")] + [(100 + i, f"{good} {i}", f"h{i % 5}") for i in range(50)] + [(200, good, None)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[30] and got[200] and all(got[100 + i] for i in range(50))


def test_quotas_stop_at_twice_a_source():
    q = mixing.quotas({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}, 315)
    assert q["a"] == 20 and q["b"] > q["c"] and abs(sum(q.values()) - 315) < 1e-6 and max(q["b"], q["c"]) <= 200


def test_flow_of_overlapping_sources_is_the_cheapest():
    taken = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15.0, "b": 15.0})
    assert all(abs(n - 10) < 1e-6 for n in taken.values())  # once over each beats twice over any
    taken = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 20.0, "b": 10.0})
    assert abs(taken["a",] + taken["a", "b"] - 30) < 1e-6 and max(taken.values()) <= 20 + 1e-6


def test_mix_comes_near_its_targets(docs, nothing, cases, spark):
    rows = [tuple(r) for r in mixing.mix(docs).collect()]
    size = Counter()
    for _, t, _, source in cases:
        size[source] += len(WORD.findall(t or ""))
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in mixing.mix(docs.repartition(5)).collect())
    for source in size:
        of = [r for r in rows if r[1] == source]
        assert all(r[3] == size[source] and r[5] in (0, r[2], 2 * r[2]) for r in of)
        if of:
            assert abs(sum(r[5] for r in of) - of[0][4]) <= max(r[2] for r in of)
    assert mixing.mix(nothing).count() == 0
    again = Counter(r.doc_id for r in mixing.mix(docs, whole=True).collect())
    want = Counter()
    for r in rows:
        want[r[0]] += r[5] // r[2] if r[2] else 0
    assert again == +want


def test_arrays_of_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)] + [(200, "x", []), (201, "y", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(got) == 102 and all(r.taken <= 2 * r.size for r in got)


def plain_targets(size):
    """Targets by source, null last: 5, 2, 1 in turn, 150 percent of all words, at most twice a source."""
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(size.values())
    while len(target) < len(order):
        rest = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * size[s]]
        for s in over or rest:
            target[s] = 2 * size[s] if over else share[s]
        left -= sum(target[s] for s in over)
    return target


def test_targets_and_taken_against_a_plain_version(docs, cases):
    size = Counter()
    for _, t, _, source in cases:
        size[source] += len(WORD.findall(t or ""))
    want = plain_targets(size)
    got = mixing.mix(docs).collect()
    for source in size:
        of = [r for r in got if r.source == source]
        assert all(abs(r.target - want[source]) < 1e-6 * max(1, want[source]) for r in of)
        largest = max(r.size for r in of)
        assert abs(sum(r.taken for r in of) - want[source]) <= largest / 2 + 1e-6


def test_many_equal_rows_are_taken_singly(spark):
    rows = [(1, "w " * 10, "a")] * 1000 + [(2 + i, "w " * 10, "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs).collect()
    want = plain_targets(Counter(a=10_000, b=10_000))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 5 for s in want) and want["a"] == 20_000
    docs = spark.createDataFrame(rows + [(9000 + i, "w " * 10, "c") for i in range(1000)], "doc_id long, text string, source string")
    want = plain_targets(Counter(a=10_000, b=10_000, c=10_000))
    whole = Counter(r.source for r in mixing.mix(docs, whole=True).collect())
    assert all(abs(10 * whole[s] - want[s]) <= 5 for s in want) and want["a"] > 20_000 - 1 and 0 < want["c"] < 10_000


def test_a_source_of_one_repeated_row_meets_its_share(spark):
    """Two sources, so that the repeated row's share is no whole number of passes."""
    rows = [(1, "w " * 10, "b")] * 1000 + [(2 + i, "w " * 10, "a") for i in range(5000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = plain_targets(Counter(a=50_000, b=10_000))
    assert abs(sum(r.taken for r in got if r.source == "b") - want["b"]) <= 5
