import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from webmill.llm import trie as T

SCHEMA = "conv_id long, turn int, role string, text string, c long, pos int, node long, depth int, n int, length int, words int"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in own.items()}
    family = lambda c: c - (abs(c) % 20) * (1 if c > 0 else -1)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(family(c), [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def brute(rows):
    """Every prefix by itself."""
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], SCHEMA).repartition(3)


def made(df):
    return sorted(map(tuple, T.trie(*T.rebuild(T.turns_of(df))).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    say = lambda: rnd.choice(["hello there", "a  b\tc", "", None, "été ça", "x " * 50])
    out = [(c, t, rnd.choice(["user", "assistant", None]), say()) for c in range(-25, 130) for t in range(rnd.randint(1, 5))]
    out += [(1000 + i, t, "user", f"same {t}") for i in range(600) for t in range(6)]  # copies
    out += [(3000, t, "user", f"long {t}") for t in range(400)] + [(3001, None, "user", "first"), (3001, 1, "b", "x"), (3001, 1, "a", "x"), (3001, 1, "a", "x"), (3001, 1, "a", "w")]
    return out + [(None, 1, "user", "no id"), (None, None, None, None), (4040, None, None, None), (4043, None, "", "")]


def test_against_brute_force(spark, rows):
    assert made(table(spark, rows)) == brute(rows)


def test_small_tables(spark):
    for few in ([], [(7, 1, "user", "one")], [(7, None, None, None), (27, None, None, None)], [(None, 1, "a", "b")]):
        assert made(table(spark, few)) == brute(few)


def test_ids_of_a_hot_node_are_hashed_in_order(spark):
    rnd = random.Random(1)
    ids = rnd.sample(range(-50_000, 50_000), 5_000)
    df = spark.createDataFrame([(2, 9, c) for c in ids] + [(2, 8, 5), (3, 9, 6)], "depth int, node long, c long").repartition(4)
    want = {(2, 9): sorted(ids), (2, 8): [5], (3, 9): [6]}
    assert {(r.depth, r.node): r.sha for r in T.id_hashes(df).collect()} == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}
