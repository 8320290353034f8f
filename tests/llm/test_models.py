import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from webmill.llm import common, ctw, toxicity


def test_base_score_against_plain_python(docs, nothing, cases):
    held = F.pmod(common.crc32_of_id(), F.lit(10)) == 0
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower)) + [None]) for i, t, *_ in cases]
    is_held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    c = Counter(w for i, x in words if not is_held(i) for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, is_held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for i, x in words)
    got = ctw.score(docs, held).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert ctw.score(nothing, held).count() == 0


def plain_ctw(train, test):
    """The same model by recursion over single nodes."""
    depth, n = ctw.DEPTH, Counter()
    decisions = lambda text: [(tuple(([0] * depth + list(text) + [0])[i : i + depth]), b) for i, b in enumerate([*text, 0])]
    for t in train:
        for context, byte in decisions(t):
            for d in range(depth + 1):
                for k in range(8):
                    n[context[depth - d :], (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1] += 1
    children = {}
    for context, node, _ in n:
        if context:
            children.setdefault((context[1:], node), set()).add(context)
    kt = lambda c, k: math.lgamma(n[c, k, 0] + 0.5) + math.lgamma(n[c, k, 1] + 0.5) - math.lgamma(n[c, k, 0] + n[c, k, 1] + 1) - math.log(math.pi)
    weighted = {}

    def total(c, k):
        if (c, k) not in weighted:
            below = sum(total(x, k) for x in children.get((c, k), ()))
            weighted[c, k] = kt(c, k) if len(c) == depth else np.logaddexp(kt(c, k), below) - math.log(2)
        return weighted[c, k]

    def p_one(context, k):
        p, left, out = 0.5, 1.0, 0.0
        for d in range(depth + 1):
            c = context[depth - d :]
            if n[c, k, 0] + n[c, k, 1]:
                p = (n[c, k, 1] + 0.5) / (n[c, k, 0] + n[c, k, 1] + 1)
            if d == depth or not n[c[:], k, 0] + n[c[:], k, 1]:
                return out + left * p
            own = math.exp(kt(c, k) - math.log(2) - total(c, k))
            out, left = out + left * own * p, left * (1 - own)
        return out

    score = 0.0
    for context, byte in decisions(test):
        for k in range(8):
            p = p_one(context, (1 << k) | byte >> (8 - k))
            score += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
    return score


def test_tree_against_a_recursion_over_nodes(spark):
    rnd = random.Random(2)
    train = ["".join(rnd.choice(["ab", "cd", "é", " "]) for _ in range(60)) for _ in range(12)] + [""]
    test = ["abcd é ab", "zz", "", "é" * 9]
    rows = [(i, t) for i, t in enumerate(train)] + [(100 + i, t) for i, t in enumerate(test)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [plain_ctw([x.encode() for x in train], t.encode()) for t in test]
    old = ctw.HELD
    try:
        for ctw.HELD, block in ((old, ctw.BLOCK), (40, 500)):  # in one piece, and in many blocks and groups
            got = {r.doc_id: r.score for r in ctw.score(docs, F.col("doc_id") >= 100, block=block, part=block).collect()}
            assert all(abs(got[100 + i] - x) < 1e-5 * abs(x) for i, x in enumerate(want))
    finally:
        ctw.HELD = old


def test_no_context_is_left_out(spark):
    """Contexts that occur twice only, more of them than any bound that a table of contexts might have had, still tell."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(12)) for _ in range(12_000)]
    rows = [(i, w + " " + w) for i, w in enumerate(words)] + [(100_000 + i, w) for i, w in enumerate(words[:300])]
    got = {r.doc_id: r for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100_000).collect()}
    assert np.mean([got[100_000 + i].bits_per_byte for i in range(300)]) < 4  # by chance alone a letter of 36 takes 5.2 bits
    assert len(got) == len(rows)


def test_repeated_rows_are_dealt_to_all_blocks(spark):
    rows = [(1, "a b c " * 50)] * 400 + [(2, "d e f")]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), F.col("doc_id") == 2, block=10_000)
    assert Counter(r.doc_id for r in got.collect()) == {1: 400, 2: 1}
    assert got.filter("doc_id = 1").select("score").distinct().count() == 1


def test_classifier_finds_marked_words_in_held_out_rows(spark, docs, nothing):
    rnd = random.Random(4)
    plain = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(900):
        w = rnd.choices(plain, k=rnd.randint(5, 60))
        toxic = i % 8 == 0
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["rotten!", "Vile", "vilest"])
        rows.append((i, " ".join(w), rnd.choice(["en", "fr", None]), int(toxic)))
    all_docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(all_docs.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 > 0"))
    got = {r.doc_id: r for r in toxicity.classify(all_docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([got[i].predicted == y for i, _, _, y in held]) > 0.97
    assert set(model.cuts) == {"en", "fr"}
    edge = toxicity.classify(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.classify(nothing, model).count() == 0
    untrained = toxicity.train(nothing, labels)
    assert toxicity.classify(docs, untrained).count() == docs.count()


def test_held_out_rows_of_the_labelled_table(spark):
    """Area under the curve on the fold that the query does not learn from."""
    at = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in toxicity.op6_toxicity(spark, at).collect() if r.held_out and labels.get(r.doc_id) is not None]
    bad, good = ([r.score for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    auc = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    # What words alone tell: the highest log odds of a word of the text, learned from the same rows.
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    learn = [i for i in texts if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2]
    ids_of = lambda i: toxicity.word_ids(pa.array([texts[i]]))[0]
    hits, n = np.zeros((2, 2 * toxicity.BUCKETS)), Counter(labels[i] for i in learn)
    for i in learn:
        hits[labels[i], np.unique(ids_of(i))] += 1
    odds = np.log((hits[1] + 0.5) / (n[1] + 1)) - np.log((hits[0] + 0.5) / (n[0] + 1))
    bad, good = ([odds[ids_of(r.doc_id)].sum(1).max(initial=-9) for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    assert auc > np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])


def test_tables_give_what_a_plain_convolution_gives():
    model = toxicity.Model(seed=3)
    texts = ["", "one", "one two", "a b c d e f g a b c", "Word, (word) WORD " * 30, "é ü " * 7]
    got = model.score(model.tables(), pa.array(texts))
    ids, at = toxicity.word_ids(pa.array(texts))
    best, where = model.pool(model.tables(), ids, at, places=True)
    for t in range(len(texts)):
        words = model.embed[ids[at[t] : at[t + 1]]].sum(1)
        pooled, places = [], []
        for f in model.filters:
            r = np.array([sum(words[p + j] @ f[j] for j in range(len(f))) for p in range(len(words) - len(f) + 1)]).reshape(-1, toxicity.FILTERS)
            pooled += list(np.maximum(r.max(0, initial=0), 0))
            places += [at[t] + r[:, c].argmax() if len(r) and r[:, c].max() > 0 else -1 for c in range(toxicity.FILTERS)]
        assert np.allclose(best[t], pooled, atol=1e-5)
        same = where[t] == places
        assert all(same | (np.array(places) >= 0) & (where[t] >= 0))
        assert abs(got[t] - 1 / (1 + np.exp(-(np.array(pooled) @ model.out + model.bias)))) < 1e-5


def test_a_text_too_long_for_the_sample_is_passed_over(spark):
    rows = [(i, ("bad " if i % 4 == 0 else "fine ") * 20, "en") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + [(i, "long " * 10_000, "en") for i in range(80, 160)], "doc_id long, text string, lang string")
    model = toxicity.train(docs, labels, most=40_000)
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs, model).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(80))


def test_training_input_is_bounded_whatever_repeats(spark):
    rows = [(1, "bad word " * 5, "en")] * 500 + [(i, f"plain text {i}", "en") for i in range(2, 40)] + [(i, "x" * 5000, "en") for i in range(40, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 60)], "doc_id long, toxic int")
    seen = []
    old = toxicity.Model.fit
    toxicity.Model.fit = lambda self, texts, y, *a: seen.append((len(texts), sum(len(t) for t in texts.to_pylist())))
    try:
        toxicity.train(docs, labels, most=20_000)
        toxicity.train(docs, labels, sample=10)
    finally:
        toxicity.Model.fit = old
    assert seen[0][1] <= 20_000 and seen[0][0] < 60 and seen[1][0] <= 10


def test_every_labelled_row_teaches(spark):
    """The word that tells is in rows only that a sample of 9,000, those of least hash, leaves out."""
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"))).alias("place"))
    rows = rows.select("doc_id", (F.col("place") > 9_500).cast("int").alias("toxic"), (F.col("doc_id") % 97).alias("w")).cache()
    text = F.concat(F.lit("some plain words w"), F.col("w"), F.when(F.col("toxic") == 1, " rotten").otherwise(""))
    docs = rows.select("doc_id", text.alias("text"), F.lit("en").alias("lang"))
    model = toxicity.train(docs, rows.select("doc_id", "toxic"))
    probe = spark.createDataFrame([(i, f"words w{i}" + " rotten" * (i % 2), "en") for i in range(40)], docs.schema)
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.classify(probe, model).collect())


def test_shards_hold_every_text_once_and_thresholds_are_exact(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices(["ab", "cd", "ef", "vile", "é"], k=rnd.randint(0, 9))), rnd.choice(["en", "fr", None]), int(i % 7 == 0)) for i in range(2_000)]
    rows += rows[:50] * 20
    found = spark.createDataFrame(rows, "_t_id long, t string, l string, _t_y int").withColumn("h", F.xxhash64("_t_id", "t")).repartition(5)
    table = toxicity.shards(toxicity.bucketed(found).join(found.select("_t_id", "_t_y").distinct(), "_t_id"), 12)
    kept = table.collect()
    assert len(kept) > 5 and sum(r.rows for r in kept) == len({r[:2] for r in rows})
    held = []
    model = toxicity.Model(seed=3)
    for r in kept:
        ids, at, y, back = toxicity.opened(r.asDict())
        scores = model.trained_score(*toxicity.texts_of(ids, at, np.ones(len(y), bool)))
        held += [(s, label, lang) for s, label, lang, b in zip(scores, y, r.l, back) if b]
    model.calibrate(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held])
    assert toxicity.thresholds(table, model) == model.cuts


def test_shards_learn_together_and_reruns_agree(spark):
    """A word of one shard's texts alone is learned as well as one of all."""
    rnd = random.Random(6)
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(2_000):
        w = rnd.choices(plain, k=20)
        if i % 5 == 0:
            w[rnd.randrange(20)] = "vile"
        rows.append((i, " ".join(w), "en", int(i % 5 == 0)))
    found = spark.createDataFrame(rows, "_t_id long, t string, l string, _t_y int").withColumn("h", F.xxhash64("_t_id", "t"))
    models = []
    for parts in (3, 7):
        table = toxicity.shards(toxicity.bucketed(found.repartition(parts)).join(found.select("_t_id", "_t_y"), "_t_id"), 7)
        assert table.count() > 3
        models.append(toxicity.train_shards(table))
    a, b = models
    assert (a.embed == b.embed).all() and (a.out == b.out).all() and a.cuts == b.cuts
    texts = pa.array([r[1] for r in rows])
    assert np.mean((a.score(a.tables(), texts) >= 0.3) == np.array([r[3] for r in rows])) > 0.97


def test_changes_are_averaged_by_the_steps_that_made_them():
    one, two = np.zeros(2, toxicity.CHANGE), np.zeros(1, toxicity.CHANGE)
    one["word"], one["n"], one["gain"] = [1025, 1030], [1, 2], [4, 5]
    one["by"][:] = [[2], [3]]
    two["word"], two["n"], two["gain"], two["by"][:] = 1025, 3, 8, 6
    got = np.frombuffer(toxicity.merge(1, [one.tobytes(), two.tobytes()]), toxicity.CHANGE)
    assert got["word"].tolist() == [1025, 1030] and got["gain"].tolist() == [7, 5]
    assert got["by"].tolist() == [[5.0] * toxicity.SIZE, [3.0] * toxicity.SIZE]


def test_peaks_are_those_of_the_tables_whatever_is_held_at_a_time():
    model = toxicity.Model(seed=5)
    rnd = random.Random(3)
    texts = pa.array([" ".join(rnd.choices("abcdefgh", k=k)) for k in (0, 1, 2, 3, 0, 40, 5, 1, 300, 2)])
    ids, at = toxicity.word_ids(texts)
    best, where = model.pool(model.tables(), ids, at, places=True)
    old = toxicity.CHUNK
    try:
        for toxicity.CHUNK in (1, 7, 64, old):
            got, places = model.peaks(ids, at)
            assert np.allclose(got, best, atol=1e-6) and ((places >= 0) == (where >= 0)).all()
    finally:
        toxicity.CHUNK = old


def test_ids_that_may_have_a_label_hold_all_that_do(spark):
    texts = spark.range(5_000).select(F.col("id").alias("_t_id"), F.lit("t").alias("t"))
    chosen = spark.range(0, 9_000, 3).select(F.col("id").cast("int").alias("_t_id"), F.lit(1).alias("_t_y"))
    old = toxicity.ID_BITS
    try:
        for toxicity.ID_BITS, most in ((old, 1_700), (64 * 16, 5_000)):
            got = [r._t_id for r in toxicity.possible(texts, chosen).collect()]
            assert len(got) == len(set(got)) <= most and set(got) >= set(range(0, 5_000, 3))
    finally:
        toxicity.ID_BITS = old
