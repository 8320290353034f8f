import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from webmill.llm import jaccard as J
from webmill.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return frozenset(tuple(w[p : p + 3]) for p in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return Counter((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


def test_edge_cases_against_brute_force(docs, nothing, cases):
    assert Counter(map(tuple, J.jaccard_components(docs).collect())) == brute([c[:2] for c in cases])
    assert J.jaccard_components(nothing).count() == 0


def test_near_copies_around_the_threshold(spark):
    rnd = random.Random(3)
    rows = []
    for family in range(12):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([4, 9, 30, 120, 400]))]
        for copy in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
            rows.append((1000 * family + copy, " ".join(w)))
    old = J.BLOCK, J.CHUNK
    J.BLOCK, J.CHUNK = 5, 3  # signatures of several blocks, sets in several chunks
    try:
        got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        J.BLOCK, J.CHUNK = old
    assert Counter(map(tuple, got)) == brute(rows)


def test_words_whose_polynomial_hashes_agree_do_not_link(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]  # the Thue-Morse word and its complement
    rows = [(1, "".join("ab"[x] for x in bits)), (2, "".join("ba"[x] for x in bits))]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter({(1, 1, 1): 1, (2, 1, 2): 1})


def test_bitmaps_never_rule_out_a_link():
    rnd = random.Random(4)
    for _ in range(100):
        n = rnd.choice([1, 5, 31, 33, 200, 700])
        a = rnd.sample(range(2**62), n)
        b = a[: n - rnd.randint(0, n // 8)] + rnd.sample(range(2**62), rnd.randint(0, n // 8))
        grams = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (a, b)])
        bits = J.bitmaps(grams, np.array([0, len(a), len(a) + len(b)]))
        both = len(set(a) & set(b))
        found = list(J.possible([(0, 0, len(a), bits[0])], [(1, 1, len(b), bits[1])], False, 90))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert found
        assert J.most(np.array([len(a)]), np.array([len(b)]), 90)[0] >= len(a) + len(b) - 2 * both or 100 * both < 90 * (len(a) + len(b) - both)


def test_many_short_texts_of_one_template(spark):
    rnd = random.Random(8)
    rows = [(i, "the same five words here " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(7))) for i in range(20_000)]
    rows += [(50_000 + i, rows[i][1]) for i in range(50)]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (i - 50_000 if i >= 50_000 else i) for i in got)


def test_linked_sets_share_a_signature():
    rnd = random.Random(9)
    for _ in range(300):
        n = rnd.choice([1, 2, 9, 10, 11, 19, 20, 40, 200, 900])
        base = rnd.sample(range(2**62), n)
        other = base[: n - rnd.randint(0, n // 10)] + rnd.sample(range(2**62), rnd.randint(0, n // 10))
        both = len(set(base) & set(other))
        if 100 * both < 90 * (len(base) + len(other) - both):
            continue
        grams = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (base, other)])
        row, sig = J.signatures(grams, np.array([0, len(base), len(base) + len(other)]))
        assert set(sig[row == 0]) & set(sig[row == 1])


def test_shingles_of_short_texts():
    grams, at = J.shingle_sets(pa.array(["a b", "A B", "", None, "a b c", "a b c a b c"]), 3)
    assert np.diff(at).tolist() == [1, 1, 0, 0, 1, 3] and grams[0] == grams[1]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
