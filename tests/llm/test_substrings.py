import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webmill.llm import substrings as S

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_bytes(texts, window=200):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[p : p + window] for b in data for p in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if n[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def brute_words(rows, window=50):
    order = lambda i: (i is None, i or 0)
    first = {}
    data = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    for i, w in sorted(data, key=lambda r: order(r[0])):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, w in data:
        gone = [0] * len(w)
        for p in range(len(w) - window + 1):
            if order(first[tuple(w[p : p + window])]) < order(i):
                gone[p : p + window] = [1] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [S.GROUP, 1])
def test_suffix_dedup_against_brute_force(docs, cases, group):
    want = Counter(zip([c[0] for c in cases], brute_bytes([c[1] for c in cases]), strict=True))
    got = S.suffix_dedup(docs, group=group, digests=True).collect()
    assert Counter((r.doc_id, (r._s_size, r._s_removed, r._s_spans, r._s_kept)) for r in got) == want
    assert got[0].key == "key" and got[0].v == 2


def test_suffix_dedup_gives_texts_and_spans(docs, cases):
    for r in S.suffix_dedup(docs).collect():
        data = next((t or "").encode() for i, t, *_ in cases if i == r.doc_id and len((t or "").encode()) == r._s_size)
        kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in r._s_spans)], [*(s for s, _ in r._s_spans), len(data)], strict=True))
        assert kept.decode("utf-8", "ignore") == r._s_kept


@pytest.mark.parametrize("group", [S.GROUP, 1])
def test_seed_and_extend_against_brute_force(docs, cases, group):
    want = Counter(zip([c[0] for c in cases], brute_words([c[:2] for c in cases]), strict=True))
    got = S.seed_and_extend(docs, group=group, digests=True).collect()
    assert Counter((r.doc_id, (r._s_size, r._s_removed, r._s_kept)) for r in got) == want


def test_empty_tables(nothing):
    assert S.suffix_dedup(nothing).count() == S.seed_and_extend(nothing).count() == 0


def test_small_windows_are_found_in_periodic_texts(spark):
    texts = ["abcabcabcabcab", "xxabcabcabcyy", "aaaaaaaaaaaaaaa", "aaaaaaaab", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = S.suffix_dedup(docs, window=6, gram=3, digests=True).orderBy("doc_id").collect()
    assert [(r._s_size, r._s_removed, r._s_spans, r._s_kept) for r in got] == brute_bytes(texts, 6)
    texts = ["a b c a b c a b c", "b c a b c x", "a a a a a a", "a a a", "c a b c a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = S.seed_and_extend(docs, window=3, gram=2, digests=True).orderBy("doc_id").collect()
    assert [(r._s_size, r._s_removed, r._s_kept) for r in got] == brute_words(list(enumerate(texts)), 3)


def test_refinement_against_all_pairs_of_windows():
    rnd = random.Random(6)
    for window in (1, 3, 8, 13, 40):
        spans = ["".join(rnd.choice("ab" if window > 3 else "abcdefgh") for _ in range(rnd.randint(1, 70))).encode() for _ in range(20)]
        spans += [spans[0], b"x" * 60, spans[1][: window + 2] * 2]
        n = Counter(x[p : p + window] for x in spans for p in range(len(x) - window + 1))
        want = sorted((i, p) for i, x in enumerate(spans) for p in range(len(x) - window + 1) if n[x[p : p + window]] > 1)
        assert sorted(zip(*map(list, S.repeated_windows(spans, window)), strict=True)) == want


def test_words_whose_polynomial_hashes_agree_are_different(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]  # the Thue-Morse word and its complement
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    frame = [f"w{i}" for i in range(60)]
    texts = [" ".join([*frame[:30], x, *frame[30:]]) for x in (one, two)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (S.GROUP, 1):
        got = S.seed_and_extend(docs, group=group, digests=True).orderBy("doc_id").collect()
        assert [r._s_removed for r in got] == [0, 0] == [x[1] for x in brute_words(list(enumerate(texts)))]
        got = S.suffix_dedup(docs, group=group, digests=True).orderBy("doc_id").collect()
        assert [(r._s_size, r._s_removed, r._s_spans, r._s_kept) for r in got] == brute_bytes(texts)


def test_many_equal_rows(spark):
    """Work and memory follow the number of rows, not its square: alone, beside a text that shares theirs, and beside an earlier copy."""
    rnd = random.Random(9)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(600))
    many = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    other = spark.createDataFrame([(3, "before " + text[1000:2500] + " after")], "doc_id long, text string")
    for docs in (many, many.unionByName(other)):
        got = S.suffix_dedup(docs, digests=True).groupBy("doc_id", "_s_removed", "_s_spans").count().collect()
        assert {(r.doc_id, r._s_removed, r["count"]) for r in got if r.doc_id == 7} == {(7, len(text), 3_000)}
        assert [(r._s_removed, r._s_spans) for r in got if r.doc_id == 3] in ([], [(1500, 1)])
        got = S.seed_and_extend(docs, digests=True).groupBy("doc_id", "_s_removed").count().collect()
        shared = brute_words([(3, f"before {text[1000:2500]} after"), (7, text)])[1][1] if docs is not many else 0
        assert {r._s_removed: r["count"] for r in got if r.doc_id == 7} == {shared: 3_000}
    early = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = S.seed_and_extend(many.unionByName(early), digests=True).groupBy("doc_id", "_s_removed").count().collect()
    assert {(r.doc_id, r._s_removed, r["count"]) for r in got} == {(1, 0, 1), (7, 600, 3_000)}
