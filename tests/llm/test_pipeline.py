from collections import Counter

import corpus_pipeline as P
from webmill.llm import bpe
from webmill.llm.common import table

from test_jaccard import brute as components_of
from test_quality_mixing import measures
from test_substrings import brute_bytes


def test_stages_against_brute_force(spark, docs, cases):
    five = docs.select(*P.COLUMNS)
    good = [c for c in cases if (m := measures(c[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    one = table(P.quality_rules(spark, five, ""))
    assert one.columns == P.COLUMNS
    assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter((c[0], c[1]) for c in good)
    two = table(P.near_duplicates(spark, one, ""))
    stay = {i for i, _, low in components_of([c[:2] for c in good]) if i == low}
    got = Counter(r.doc_id for r in two.collect())
    assert got.pop(None) == 1  # of the rows without an id one is a copy of row 1
    assert set(got) == stay - {None} and set(got.values()) == {1}
    two = table(two.filter("doc_id IS NOT NULL"))
    texts = {r.doc_id: r.text for r in two.collect()}
    three = table(P.suffix_array_dedup(spark, two, ""))
    want = dict(zip(texts, brute_bytes(texts.values()), strict=True))
    for r in three.collect():
        size, gone = want[r.doc_id][:2]
        assert size - gone - 6 <= len(r.text.encode()) <= size - gone and r.n_chars == len(r.text)
    four = table(P.source_mixing(spark, three, ""))
    assert four.columns == P.COLUMNS and max(Counter(r.doc_id for r in four.collect()).values()) <= 2
    five = P.bpe_encoding(spark, four, "")
    v = bpe.vocabulary(bpe.vocabulary_path())
    by_id = {r.doc_id: r.text for r in four.collect()}
    rows = five.collect()
    assert len(rows) == four.count() and all(v.decode(r.ids) == r.decoded == by_id[r.doc_id] and len(r.ids) == r.n_tokens for r in rows)


def test_rows_go_and_not_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    x, y, z = text("x"), text("y"), text("z")
    near = z.replace("z59", "other")
    rows = [(1, x), (3, x), (3, y), (7, z), (7, near), (None, y), (None, text("n")), (9, ""), (9, None), (8, text("w")), (8, text("w"))]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect())
    seven = [k for k in got if k[0] == 7]
    assert len(seven) == 1 and got.pop(seven[0]) == 1
    assert got == Counter([(1, x), (3, y), (None, text("n")), (9, ""), (9, None), (8, text("w"))])


def test_run_over_a_table(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
