"""Operator 6: toxicity by a small convolutional text classifier, trained in numpy.

Words are hashed to embeddings; filters of several widths slide over them, each keeps its largest response in the
text, and a logistic unit weighs these. Training goes over every labelled row: these are dealt to shards, in each round
a task steps over its shard from the model so far, and what shards changed is averaged word by word. Scoring is a map over
all documents with the model's tables (a few MB, whatever the input) sent along.
"""

from __future__ import annotations

import copy
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill.llm import common as C

#: Bounds of a model that is asked for by one bound only (train's `sample` and `most`; without either there is none).
SAMPLE = 9_000
SAMPLE_BYTES = 64_000_000
#: Bytes of a shard's texts, on average. Of its rows four fifths set weights, the rest when training ends, and thresholds.
SHARD_BYTES = 18_000_000
#: Bits that tell which ids may have a label, 64 a row: 262,144 rows at most are sent to all.
ID_BITS = 1 << 24
#: Rounds over all shards at most; where a shard has fewer than so many steps, it is gone over several times a round.
ROUNDS = 20
ROUND_STEPS = 50
#: So often at most where there are more shards, as each drifts to its own texts.
PASSES = 4
#: Words of the model whose changes are averaged in one group.
BLOCK = 1024
#: Words whose responses are held at a time in training.
CHUNK = 1 << 16
#: Buckets of whole words, and as many of their first STEM bytes; a word's embedding is the sum of both.
BUCKETS = 1 << 16
STEM = 4
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
BATCH = 64
#: Training goes through the sample so often at most, a small one for so many steps, and ends sooner once the loss on the
#: rows held back has not fallen by a share of GAIN for PATIENCE rounds.
EPOCHS = 20
MIN_STEPS = 600
PATIENCE = 3
GAIN = 0.003
#: Over shards a fall of the loss (nats a text) by less than this counts as none, too.
GAIN_ALL = 0.0005
#: Step length, over the root of each number's (a word's) squared gradients so far, and weight decay.
RATE = 0.1
DECAY = 1e-4
#: What the sums of squared gradients begin with; it shortens the first steps of words that are rare.
START = 1e-6
#: Deviation of the random numbers that words begin with: small, so that words not yet learned lose to those that are.
SPREAD = 0.01
#: The score at which predicted is 1, and the share of false alarms that a language's own threshold aims at.
CUT = 0.3
FALSE_ALARMS = 0.01


def word_ids(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (word, stem) of each word (A-Z as lower case, punctuation at either end left out) and where each text's begin."""
    buf, off = C.text_arrays(column)
    begin, end, at = C.words(buf, off)
    plain = np.ones(256, bool)
    plain[[b for b in range(128) if not chr(b).isalnum()]] = False
    for _ in range(3):
        cut = (end - begin > 1) & ~plain[buf[end - 1]]
        end = end - cut
    for _ in range(2):
        cut = (end - begin > 1) & ~plain[buf[begin]]
        begin = begin + cut
    lower = C.LOWER[buf]
    word = C.word_hashes(lower, begin, end) % np.uint64(buckets)
    stem = C.word_hashes(lower, begin, np.minimum(end, begin + STEM)) % np.uint64(buckets) + np.uint64(buckets)
    return np.column_stack((word, stem)).astype(np.int64), at


def all_word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """word_ids of many texts, slice by slice."""
    batch = pa.RecordBatch.from_arrays([column], ["t"])
    parts = [word_ids(b.column("t")) for b in C.slices(batch, "t")]
    if not parts:
        return np.zeros((0, 2), np.int32), np.zeros(1, np.int64)
    ids = np.concatenate([p[0].astype(np.int32) for p in parts])
    return ids, np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))))


class Model:
    """Responses of a filter are sums over its words of one table each, so scoring only looks up and adds."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, SPREAD, (2 * BUCKETS, SIZE)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        self.cuts: dict[str, float] = {}

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embed @ f[j] for j in range(len(f))] for f in self.filters]

    @staticmethod
    def pool(tables, ids: np.ndarray, at: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text (at least 0) and, if asked for, its first place (-1: none above 0)."""
        rows = len(at) - 1
        best = np.zeros((rows, len(tables) * FILTERS), np.float32)
        where = np.full(best.shape if places else (0, 0), -1, np.int64)
        for k, parts in enumerate(tables):
            w = len(parts)
            n = np.maximum(np.diff(at) - w + 1, 0)
            have = np.flatnonzero(n)
            if not len(have):
                continue
            r = np.zeros((len(ids) - w + 1, FILTERS), np.float32)
            for j in range(w):
                for half in (0, 1):
                    r += parts[j][ids[j : len(ids) - w + 1 + j, half]]
            first = at[:-1][have]
            edges = np.column_stack((first, first + n[have])).ravel()
            begin = np.cumsum(n[have]) - n[have]
            inside = np.repeat(first - begin, n[have]) + np.arange(n[have].sum()) if places else None
            for f in range(FILTERS):
                x = np.append(r[:, f], -np.inf)
                top = np.maximum.reduceat(x, np.minimum(edges, len(x) - 1))[::2]
                best[have, k * FILTERS + f] = np.maximum(top, 0)
                if places:
                    there = np.where(x[inside] == np.repeat(top, n[have]), inside, len(x))
                    place = np.minimum.reduceat(there, begin)
                    where[have, k * FILTERS + f] = np.where(top > 0, place, -1)
        return best, where

    def begin(self) -> list:
        """The sums of squared gradients before the first step."""
        return [np.full(len(self.embed), START, np.float32), [np.full(f.shape, START, np.float32) for f in self.filters], np.full(len(self.out), START, np.float32)]

    def loss(self, texts: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> float:
        p = np.clip(self.trained_score(*texts), 1e-7, 1 - 1e-7)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def trained_score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        best, _ = self.peaks(ids, at)
        return 1 / (1 + np.exp(-(best @ self.out + self.bias).astype(np.float64)))

    def fit(self, texts: pa.Array, labels: np.ndarray, held: tuple[pa.Array, np.ndarray] | None = None, seed: int = 11) -> None:
        """Trains words, filters and output together from their random start, by steps scaled to each number's own gradients,
        until the loss on `held` falls no more; the weights of the least loss stay."""
        ids, at = all_word_ids(texts)
        y = labels.astype(np.float32)
        judged = (all_word_ids(held[0]), held[1]) if held is not None and len(held[1]) else ((ids, at), labels)
        rng = np.random.default_rng(seed)
        share = y.mean() if len(y) else 0.1
        self.bias = np.float32(np.log((share + 1e-3) / (1 - share + 1e-3)))
        sums = self.begin()
        least, waited, kept = np.inf, 0, None
        for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // max(1, len(y))))):
            self.steps(ids, at, y, sums, rng)
            now = self.loss(*judged)
            waited = 0 if now < least * (1 - GAIN) else waited + 1
            if now < least:
                least, kept = now, (self.embed.copy(), [f.copy() for f in self.filters], self.out.copy(), self.bias)
            if waited >= PATIENCE:
                break
        if kept:
            self.embed, self.filters, self.out, self.bias = kept

    def peaks(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pool gives with places, without tables: for few texts between changes of the weights."""
        rows, size = len(at) - 1, np.diff(at)
        best = np.zeros((rows, len(self.out)), np.float32)
        where = np.full(best.shape, -1, np.int64)
        text = np.repeat(np.arange(rows), size)
        left = np.repeat(at[1:], size) - np.arange(len(ids))
        flat = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1).T
        for a in range(0, len(ids), CHUNK):
            end = min(a + CHUNK + max(WIDTHS) - 1, len(ids))
            r = flat @ (self.embed[ids[a:end, 0]] + self.embed[ids[a:end, 1]]).T
            row = 0
            for k, w in enumerate(WIDTHS):
                n = min(CHUNK, end - a - w + 1)
                parts = [r[row + j * FILTERS : row + (j + 1) * FILTERS, j : n + j] for j in range(w)]
                row += w * FILTERS
                if n <= 0:
                    continue
                x = parts[0] if w == 1 else parts[0] + parts[1]
                for part in parts[2:]:
                    x += part
                x[:, left[a : a + n] < w] = -np.inf
                first = np.flatnonzero(np.diff(text[a : a + n], prepend=-1))
                which, cols = text[a : a + n][first], slice(k * FILTERS, (k + 1) * FILTERS)
                top = np.maximum.reduceat(x, first, axis=1)
                more = np.where(top > best[which, cols].T, top, np.inf)
                f, place = np.divmod(np.flatnonzero(x == np.repeat(more, np.diff(first, append=n), axis=1)), n)
                where[text[a + place][::-1], k * FILTERS + f[::-1]] = a + place[::-1]
                best[which, cols] = np.maximum(best[which, cols], top.T)
        return best, where

    def _step(self, ids, at, y, sums) -> np.ndarray:
        """One step of training; returns the words that it moved."""
        best, where = self.peaks(ids, at)
        p = 1 / (1 + np.exp(-(best @ self.out + self.bias)))
        g = ((p - y) / len(y)).astype(np.float32)
        to = g[:, None] * self.out[None, :]
        moves, words, grads = [], [np.zeros(0, ids.dtype)], [np.zeros((0, SIZE), np.float32)]
        for k, f in enumerate(self.filters):
            move = DECAY * f
            text, c = np.nonzero(where[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            amount, place = to[text, k * FILTERS + c][:, None], where[text, k * FILTERS + c]
            for j in range(len(f)):
                pair = ids[place + j]
                np.add.at(move[j].T, c, amount * (self.embed[pair[:, 0]] + self.embed[pair[:, 1]]))
                words += [pair[:, 0], pair[:, 1]]
                grads += [amount * f[j].T[c]] * 2
            moves.append(move)
        used, back = np.unique(np.concatenate(words), return_inverse=True)
        grad = np.zeros((len(used), SIZE), np.float32)
        np.add.at(grad, back, np.concatenate(grads))
        of_embed, of_filters, of_out = sums
        of_embed[used] += (grad * grad).mean(1)
        self.embed[used] -= RATE * grad / np.sqrt(of_embed[used])[:, None]
        for f, move, total in zip(self.filters, moves, of_filters, strict=True):
            total += move * move
            f -= RATE * move / np.sqrt(total)
        step = g @ best + DECAY * self.out
        of_out += step * step
        self.out -= RATE * step / np.sqrt(of_out)
        self.bias -= np.float32(RATE * g.sum())
        return used

    def steps(self, ids, at, y, sums, rng) -> np.ndarray:
        """Goes once over the texts, in an order of chance; returns how many steps moved each word."""
        moved = np.zeros(len(self.embed), np.int64)
        starts, order = at[:-1], rng.permutation(len(y))
        for first in range(0, len(order), BATCH):
            batch = np.sort(order[first : first + BATCH])
            n_words = at[batch + 1] - starts[batch]
            sub_at = np.concatenate(([0], np.cumsum(n_words)))
            sub = ids[np.arange(sub_at[-1]) - np.repeat(sub_at[:-1], n_words) + np.repeat(starts[batch], n_words)]
            moved[self._step(sub, sub_at, y[batch], sums)] += 1
        return moved

    def score(self, tables, column: pa.Array) -> np.ndarray:
        batch = pa.RecordBatch.from_arrays([column], ["t"])
        best = [self.pool(tables, *word_ids(b.column("t")))[0] for b in C.slices(batch, "t")]
        best = np.concatenate(best) if best else np.zeros((0, len(self.out)), np.float32)
        return 1 / (1 + np.exp(-(best @ self.out + self.bias).astype(np.float64)))

    def calibrate(self, scores: np.ndarray, labels: np.ndarray, langs: list) -> None:
        """A threshold for each language: the score above which at most FALSE_ALARMS of its clean texts lie."""
        for lang in sorted({x for x in langs if x is not None}):
            clean = np.sort(scores[(labels == 0) & np.array([x == lang for x in langs])])
            if len(clean):
                self.cuts[lang] = float(clean[min(len(clean) - 1, int(np.ceil(len(clean) * (1 - FALSE_ALARMS))))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", sample: int | None = None, most: int | None = None) -> Model:
    """Fits to the texts of all rows that have a label and an id. A text that an id repeats counts once; of several labels
    of an id the highest counts. Labels that are null or neither 0 nor 1, and null ids, are passed over; without any row
    the model is as it begins. Only if `sample` or `most` is given, a small model is fitted on the driver (train_bounded)."""
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_t_id"), F.col(label_col).cast("int").alias("_t_y"))
    chosen = chosen.groupBy("_t_id").agg(F.max("_t_y").alias("_t_y"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_t_id"), text.alias("t"), F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col), text).alias("h"))
    if sample is not None or most is not None:
        return train_bounded(texts, chosen, SAMPLE if sample is None else sample, SAMPLE_BYTES if most is None else most)
    some = possible(texts, chosen)
    size = some.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return train_shards(shards(bucketed(some).join(chosen.hint("merge"), "_t_id"), max(1, -(-size // SHARD_BYTES))))


def possible(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts but for most of those without a label: rows whose id's bit no label has set, of ID_BITS, are not shuffled."""
    bit = F.pmod(F.xxhash64(F.col("_t_id").cast(texts.schema["_t_id"].dataType)), F.lit(ID_BITS))
    bits = chosen.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("long").alias("_t_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("_t_bits"))
    rows = texts.withColumn("_t_bit", bit).withColumn("_t_at", (F.col("_t_bit") / 64).cast("long")).join(F.broadcast(bits), "_t_at")
    return rows.filter(F.getbit("_t_bits", (F.col("_t_bit") % 64).cast("int")) == 1).select(*texts.columns)


def bucketed(texts: DataFrame) -> DataFrame:
    """Texts with their words' buckets (two numbers of 16 bits each) in the place of t."""

    def work(batch):
        ids, at = word_ids(batch.column("_s_text"))
        flat = np.ascontiguousarray(ids - np.array([0, BUCKETS])).astype("<u2").tobytes()
        cells = [flat[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("_t_id", "h", "l")] + [pa.array(cells, pa.binary())], ["_t_id", "h", "l", "w"])

    kinds = dict(texts.dtypes)
    rows = texts.select("_t_id", "h", "l", F.col("t").alias("_s_text"))
    return C.map_texts(rows, work, f"_t_id {kinds['_t_id']}, h long, l {kinds['l']}, w binary")


def train_bounded(texts: DataFrame, chosen: DataFrame, sample: int, most: int) -> Model:
    """Fits to at most `sample` texts of at most `most` bytes together: those of least hash, of no more than an eighth of `most`."""
    chosen = chosen.orderBy(F.xxhash64("_t_id"), "_t_id").limit(sample)
    found = texts.join(chosen, "_t_id").filter(F.octet_length("t") <= most // 8)
    sizes = found.groupBy("h").agg(F.max(F.octet_length("t")).alias("n")).orderBy("h").limit(sample).toArrow()
    fits = np.flatnonzero(np.cumsum(np.array(sizes.column("n"), np.int64)) <= most)
    last = sizes.column("h")[int(fits[-1])].as_py() if len(fits) else None
    got = found.filter(F.col("h") <= F.lit(last)).groupBy("h").agg(*[F.min(c).alias(c) for c in ("t", "l", "_t_y")]).toArrow().sort_by("h")
    model = Model()
    y = np.array(got.column("_t_y"), np.int64) if got.num_rows else np.zeros(0, np.int64)
    part = np.arange(len(y)) % 5 == 4
    texts, langs = got.column("t").combine_chunks(), got.column("l").to_pylist()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if len(y):
        model.fit(texts.filter(pa.array(~part)), y[~part], (texts.filter(pa.array(part)), y[part]))
        held = model.score(model.tables(), texts.filter(pa.array(part)))
        model.calibrate(held, y[part], [x for x, p in zip(langs, part, strict=True) if p])
    return model


def shards(found: DataFrame, n: int) -> DataFrame:
    """Texts' words w with hash h, language l and label _t_y as a table of n shards, each one row: labels, numbers of words,
    the words and the languages of its texts, by h. A hash that comes again counts once."""

    def pack(rows):
        rows = rows.sort_by("h")
        y = np.array(rows.column("y"), np.uint8)
        buf, at = C.text_arrays(rows.column("w"))
        cells = [rows.column("part")[0].as_py(), len(y), int(y.sum()), y.tobytes(), (np.diff(at) // 4).astype("<i8").tobytes(), buf.tobytes(), rows.column("l").to_pylist()]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
        return pa.Table.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["part", "rows", "toxic", "y", "n", "w", "l"])

    rows = found.select("h", "l", F.col("_t_y").alias("y"), "w").withColumn("part", F.pmod("h", F.lit(n)).cast("int")).repartition(n, "part")
    rows = rows.groupBy("part", "h").agg(*[F.min(c).alias(c) for c in ("l", "y", "w")])
    return C.table(rows.groupBy("part").applyInArrow(pack, "part int, rows long, toxic long, y binary, n binary, w binary, l array<string>"))


def opened(row: dict) -> tuple[np.ndarray, ...]:
    """Buckets, where each text's begin, labels, and which texts are held back, of a shard."""
    ids = np.frombuffer(row["w"], "<u2").reshape(-1, 2)
    at = np.concatenate(([0], np.cumsum(np.frombuffer(row["n"], "<i8"))))
    y = np.frombuffer(row["y"], np.uint8).astype(np.float32)
    return ids, at, y, np.arange(len(y)) % 5 == 4


def texts_of(ids: np.ndarray, at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen texts' words, numbered as the model's."""
    size = np.diff(at)
    out = ids[np.repeat(some, size)].astype(np.int32)
    out[:, 1] += BUCKETS
    return out, np.concatenate(([0], np.cumsum(size[some])))


#: What a shard says of a word: how many steps moved it, by how much in all, and what its sum of squared gradients gained.
CHANGE = np.dtype([("word", "<i4"), ("n", "<i4"), ("by", "<f4", SIZE), ("gain", "<f4")])


def _flat(model: Model, sums: list) -> np.ndarray:
    """All numbers but the words' own, in one row."""
    return np.concatenate([x.ravel() for x in (*model.filters, model.out, model.bias, *sums[1], sums[2])]).astype(np.float64)


def _unflat(model: Model, sums: list, flat: np.ndarray) -> None:
    at = 0
    for x in (*model.filters, model.out, model.bias, *sums[1], sums[2]):
        new = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
        if x is model.bias:
            model.bias = np.float32(new)
        else:
            x[...] = new


def learn(model: Model, sums: list, row: dict, passes: int, seed: list[int]):
    """Steps over a shard from the model given; yields what changed, block by block of words. Block -1 has the loss on the
    texts held back before (all, if there are too few), the number of texts that it is of, the number of steps, and the other weights."""
    ids, at, y, held = opened(row)
    judged = held if held.any() else ~held
    loss = model.loss(texts_of(ids, at, judged), y[judged]) * judged.sum()
    texts, labels = texts_of(ids, at, ~held), y[~held]
    before, gained, rng = model.embed.copy(), sums[0].copy(), np.random.default_rng(seed)
    moved = sum((model.steps(*texts, labels, sums, rng) for _ in range(passes)), np.zeros(len(before), np.int64))
    n = passes * -(-len(labels) // BATCH)
    yield -1, np.concatenate(([loss, judged.sum(), n], _flat(model, sums))).tobytes()
    words = np.flatnonzero(moved)
    out = np.zeros(len(words), CHANGE)
    out["word"], out["n"], out["by"], out["gain"] = words, moved[words], model.embed[words] - before[words], sums[0][words] - gained[words]
    edges = [*np.flatnonzero(np.diff(words // BLOCK, prepend=-1)).tolist(), len(words)]
    for a, b in itertools.pairwise(edges):
        yield int(words[a] // BLOCK), out[a:b].tobytes()


def merge(block: int, cells: list[bytes]) -> bytes:
    """Means of the shards' changes of a block: a word's by the steps that moved it, the other weights by all steps."""
    if block < 0:
        rows = np.stack([np.frombuffer(c, np.float64) for c in cells])
        steps = rows[:, 2:3]
        return np.concatenate((rows[:, :3].sum(0), (steps * rows[:, 3:]).sum(0) / max(1, steps.sum()))).tobytes()
    n, by, gain = np.zeros(BLOCK), np.zeros((BLOCK, SIZE)), np.zeros(BLOCK)
    for cell in cells:
        rows = np.frombuffer(cell, CHANGE)
        at = rows["word"] % BLOCK
        n[at] += rows["n"]
        by[at] += rows["n"][:, None] * rows["by"].astype(np.float64)
        gain[at] += rows["n"] * rows["gain"].astype(np.float64)
    some = np.flatnonzero(n)
    out = np.zeros(len(some), CHANGE)
    out["word"], out["by"], out["gain"] = some + block * BLOCK, by[some] / n[some, None], gain[some] / n[some]
    return out.tobytes()


def train_shards(table: DataFrame) -> Model:
    """A model of all shards. In each round every shard goes on from the same weights and their changes are averaged, until
    the loss on the texts held back in all shards falls no more; the weights of the least loss stay."""
    model = Model()
    sums = model.begin()
    sizes = table.agg(F.count("part").alias("shards"), F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic")).first()
    if not sizes.rows:
        C.drop(table)
        return model
    passes = max(1, round(ROUND_STEPS * BATCH * sizes.shards / sizes.rows))
    passes = passes if sizes.shards == 1 else min(passes, PASSES)
    share = sizes.toxic / sizes.rows
    model.bias = np.float32(np.log((share + 1e-3) / (1 - share + 1e-3)))
    least, waited, kept = np.inf, 0, None
    for r in range(ROUNDS + 1):
        changes = one_round(table, model, sums, passes if r < ROUNDS else 0, r)
        dense = np.frombuffer(changes.pop(-1), np.float64)
        now = dense[0] / dense[1]
        waited = 0 if now < least - max(GAIN * least, GAIN_ALL) else waited + 1
        if now < least:
            least, kept = now, (model.embed.copy(), [f.copy() for f in model.filters], model.out.copy(), model.bias)
        if waited >= PATIENCE or not dense[2]:
            break
        _unflat(model, sums, dense[3:])
        for cell in changes.values():
            rows = np.frombuffer(cell, CHANGE)
            model.embed[rows["word"]] += rows["by"]
            sums[0][rows["word"]] += rows["gain"]
    if kept:
        model.embed, model.filters, model.out, model.bias = kept
    model.cuts = thresholds(table, model)
    C.drop(table)
    return model


def one_round(table: DataFrame, model: Model, sums: list, passes: int, r: int) -> dict[int, bytes]:
    sent = table.sparkSession.sparkContext.broadcast((model, sums))

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own, own_sums = copy.deepcopy(sent.value)
                for block, cell in learn(own, own_sums, row, passes, [11, r, row["part"]]):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([row["part"]], pa.int32()), pa.array([cell])], ["block", "part", "cell"])
        C.tidy()

    def add(key, rows):
        rows = rows.sort_by("part")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cell": [merge(key[0].as_py(), rows.column("cell").to_pylist())]})

    changed = table.select("part", "y", "n", "w").mapInArrow(work, "block int, part int, cell binary")
    got = changed.groupBy("block").applyInArrow(add, "block int, cell binary").toArrow().to_pydict()
    sent.destroy()
    return dict(zip(got["block"], got["cell"], strict=True))


def thresholds(table: DataFrame, model: Model) -> dict[str, float]:
    """Each language's threshold: the score above which at most FALSE_ALARMS of its clean texts that were held back lie. It is
    found exactly, by 16 bits of the score after the other: only counts of 65,536 values for each language come here."""
    sent = table.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, at, y, held = opened(row)
                clean = held & (y == 0) & np.array([x is not None for x in row["l"]], bool)
                score = sent.value.trained_score(*texts_of(ids, at, clean))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, c in zip(row["l"], clean, strict=True) if c], pa.string()), pa.array(score.view(np.int64))], ["l", "bits"])
        C.tidy()

    scores = C.table(table.mapInArrow(work, "l string, bits long"))
    found: dict[str, int] = {}
    left: dict[str, int] = {}
    for shift in (48, 32, 16, 0):
        rows = scores.withColumn("over", F.shiftright("bits", shift))
        if found:
            spark = table.sparkSession
            over = spark.createDataFrame(list(found.items()), "l string, found long")
            rows = rows.join(F.broadcast(over), "l").filter(F.shiftright("bits", shift + 16) == F.col("found"))
        counts = rows.groupBy("l", "over").count().toArrow().sort_by("over")
        langs = np.array(counts.column("l").to_pylist(), object)
        for lang in sorted(set(langs)):
            over, n = (np.array(counts.column(c))[langs == lang] for c in ("over", "count"))
            if lang not in left:
                left[lang] = min(int(n.sum()) - 1, int(np.ceil(n.sum() * (1 - FALSE_ALARMS))))
            ends = np.cumsum(n)
            at = int(np.searchsorted(ends, left[lang], "right"))
            left[lang] -= int(ends[at] - n[at])
            found[lang] = int(over[at])
    C.drop(scores)
    return {lang: float(np.array([bits]).view(np.float64)[0]) for lang, bits in found.items()}


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cut: float = CUT) -> DataFrame:
    """Per row of docs: id, score (0 to 1), predicted (score >= cut), and flagged: above the language's own threshold.

    The language chooses a threshold only; it is no input of the score. Null and empty texts have no words and
    score as the bias says. Unknown and null languages have the threshold `cut`.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.tables(), model.out, model.bias, model.cuts))

    def work(batch):
        tables, out, bias, cuts = sent.value
        ids, at = word_ids(batch.column("_s_text"))
        best, _ = Model.pool(tables, ids, at)
        score = 1 / (1 + np.exp(-(best @ out + bias).astype(np.float64)))
        own = np.array([cuts.get(x, cut) for x in batch.column("_s_lang").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("_s_id"), pa.array(score), pa.array((score >= cut).astype(np.int32)), pa.array(score > own)], ["_s_id", "score", "predicted", "flagged"])

    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("_s_id"), F.col(text_col).alias("_s_text"), F.col(lang_col).alias("_s_lang"))
    return C.map_texts(rows, work, f"_s_id {kind}, score double, predicted int, flagged boolean").withColumnRenamed("_s_id", id_col)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' toxicity, learned from labels of those whose crc32(doc_id) mod 4 is not 2: doc_id, held_out, score, predicted."""
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    held_out = F.pmod(C.crc32_of_id(), F.lit(4)) == 2
    model = train(docs.filter(~held_out), labels.filter(~held_out))
    return classify(docs, model).withColumn("held_out", held_out)
