import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest

from webmill.llm import audit


def brute(docs, labels):
    """Every order applied document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    texts = {}
    for i, t, _, _ in docs:
        texts.setdefault(t or "", []).append(i)
    parts = {}
    for i, t, _, part in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i for j in texts[t])}
        parts.setdefault(part or "", []).append((i, {f for f in fails if fails[f]}))
    out, sums = [], Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[part, f] += len(gone)
                out.append((part, order, step, len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.fixture(scope="module")
def labelled(spark, cases):
    prose = " ".join(f"w{i}" for i in range(60))
    more = [(200 + i, prose + (" #" if i % 3 == 0 else "") + " SHOUT" * (i % 4) * 5, "en", "abc"[i % 3]) for i in range(24)] + [(190, "one", "en", "hot")] * 30 + [(400 + i, "one", "en", "hot") for i in range(60)]
    docs = [*cases, *more]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 220, 3)] + [(1, 0, 1), (1, 1, 0), (None, 1, 1), (9999, 1, 1), (201, None, None), (400, 1, 1)]
    return docs, labels


def test_against_every_order_document_by_document(spark, as_docs, labelled):
    docs, labels = labelled
    d = as_docs(docs)
    l = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")  # noqa: E741
    assert sorted(map(tuple, audit.interactions(audit.failures(d, l)).collect())) == brute(docs, labels)


def test_empty_tables(spark, nothing, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.failures(nothing, labels)).count() == 0
    got = audit.interactions(audit.failures(docs, labels)).collect()
    assert {r.good_lost for r in got} == {0} and len(got) == 600 * len({r.part for r in got})


def test_polynomial_by_hand():
    f = audit.removal_polynomial({0: 7, 1: 2, 3: 5, 2: 1}, 2)  # 2 x + 5 (1 - (1 - x)(1 - y)) + y
    assert f == [0, 7, 6, -5]
    assert audit.corners(f) == [0, 7, 6, 8]
    assert [audit.shapley(f, i) for i in (0, 1)] == [Fraction(9, 2), Fraction(7, 2)]
