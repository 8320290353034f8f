import random
from collections import Counter

import numpy as np

import corpus_pipeline as P
from webmill.llm import jaccard as J


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)])


def families(rnd):
    """Near copies with up to a tenth of their words changed; all texts also have common phrases in common."""
    common = [[f"c{k}{i}" for i in range(7)] for k in range(3)]
    rows = []
    for family in range(12):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([4, 9, 30, 120, 400]))] + rnd.choice(common)
        for copy in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 20))):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
            rows.append((1000 * family + copy, " ".join(w)))
    return rows


def brute(rows):
    sets, least = [shingles(t) for _, t in rows], [i for i, _ in rows]
    again = True
    while again:
        again = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if least[a] != least[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    least[a] = least[b] = min(least[a], least[b])
                    again = True
    return Counter((i, len(x), low) for (i, _), x, low in zip(rows, sets, least, strict=True))


def test_near_copies_in_one_piece_and_in_many(spark):
    rows = families(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    old = J.CHUNK, J.BLOCK
    try:
        for J.CHUNK, J.BLOCK in (old, (3, 5)):
            assert Counter(map(tuple, J.jaccard_components(docs, size=5, percent=80).collect())) == want
    finally:
        J.CHUNK, J.BLOCK = old


def test_stage_takes_five_words_and_four_fifths(spark):
    w = [f"w{i}" for i in range(100)]
    x = [*w[:30], "x", *w[31:70], "y", *w[71:]]  # 86 of 106 runs of five words, 92 of 104 of three
    rows = [(1, " ".join(w), "en", "a", 1), (2, " ".join(x), "en", "a", 1), (3, "other words", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_linked_sets_share_a_signature_at_80_percent():
    rnd, linked = random.Random(9), 0
    for _ in range(600):
        n = rnd.choice([1, 2, 4, 5, 9, 10, 11, 19, 20, 40, 200, 900])
        base = rnd.sample(range(2**62), n)
        other = base[: n - rnd.randint(0, n // 7)] + rnd.sample(range(2**62), rnd.randint(0, n // 7))
        both = len(set(base) & set(other))
        if 100 * both < 80 * (len(base) + len(other) - both):
            continue
        linked += 1
        grams = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (base, other)])
        row, sig = J.signatures(grams, np.array([0, len(base), len(base) + len(other)]), 80)
        assert set(sig[row == 0]) & set(sig[row == 1])
    assert linked > 300


def test_near_copies_cost_their_number_not_its_square(spark, monkeypatch):
    """Near copies whose signatures all have one odd set as their least, which links with none of them."""
    rnd, pairs = random.Random(4), []
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"odd{i}" for i in range(200))] + [" ".join(base[:k] + [f"v{k}"] + base[k + 1 :]) for k in (rnd.randrange(200) for _ in range(90))]
    far = [" ".join([f"u{x}" for x in range(40 * k)] + base[40 * k :]) for k in (1, 2)]  # these share signatures, but link with none
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + far)], "doc_id long, text string").coalesce(1)
    nodes = spark.range(len(texts + far)).withColumnRenamed("id", "node")
    shared = nodes.crossJoin(spark.range(5).withColumnRenamed("id", "sig")).selectExpr("sig", "node", "0L AS rep")
    monkeypatch.setattr(J, "_met", lambda *_: J.C.table(shared))
    verified = J._verified
    monkeypatch.setattr(J, "_verified", lambda p, *a: pairs.append(p.count()) or verified(p, *a))
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs, size=5, percent=80).collect()}
    assert got == {0: 0} | dict.fromkeys(range(1, 91), 1) | {91: 91, 92: 92}
    assert sum(pairs) < 500  # 90 * 89 / 2 pairs link


def test_a_tree_joins_what_any_pair_joins():
    rnd = np.random.default_rng(3)
    for n, m, kinds in ((1, 1, 2), (6, 4, 5), (30, 20, 12), (40, 40, 60)):
        left, right = rnd.integers(0, kinds, n), rnd.integers(0, kinds, m)
        may = (rnd.random((n, m)) < 0.1) & (left[:, None] != right[None, :])
        x, y = J._tree(may, left, right)
        assert may[x, y].all()

        def groups(pairs):
            root = list(range(kinds))
            for a, b in pairs:
                a, b = root[a], root[b]
                root = [min(a, b) if r in (a, b) else r for r in root]
            return root

        all_ = groups(zip(left[np.nonzero(may)[0]], right[np.nonzero(may)[1]], strict=True))
        assert groups(zip(left[x], right[y], strict=True)) == all_ and len(x) == kinds - len(set(all_))
