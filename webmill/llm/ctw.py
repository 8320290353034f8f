"""Operator 8: language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a tree over the up to DEPTH bytes before it. Every node holds a
Krichevsky-Trofimov estimate of the decisions that it saw in training, and estimates are mixed across all depths by
the weights that the training counts give them. No context is left out, however many there are:

1. documents are dealt into blocks; each block states its distinct grams (a byte after DEPTH bytes) and distinct words,
   with how often its training texts have them, packed by part of a hash;
2. a task for each part sums them. Words are answered at once, by counts; grams are kept as a table;
3. grams are grouped by the last TOP bytes of their context. A group is a whole subtree: what its nodes make of the
   data goes up to the few short contexts, which the driver weighs (at most 256 ** TOP of them), and their mixture
   comes down to the group again, which gives each gram's cost. Grams of scored texts alone are there too, with count 0;
4. costs go back to the parts, from there to the blocks in the order in which they asked, and blocks are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill.llm import common as C

DEPTH = 5
#: Contexts of up to so many bytes are weighed on the driver, longer ones in tasks.
TOP = 2
#: Bytes of text in a block that is scored at once, and for each part of the hashes.
BLOCK = 8_000_000
PART = 64_000_000
#: Grams whose subtrees are worked out at once: whole groups, so at most one group more.
HELD = 150_000
#: The hash that stands for the end of a text among words.
END = -0x6E64
_NODES = np.arange(8)


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte (lowest) after the DEPTH before it, the last of these highest, as one number (0 stands before the first),
    an end (0) after each text, and where each text's begin."""
    n = len(off) - 1
    out = np.zeros(len(buf) + n * (DEPTH + 1), np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, np.diff(off))] = buf
    key = out[DEPTH:].astype(np.uint64)
    for j in range(1, DEPTH + 1):
        key |= out[DEPTH - j : len(out) - j].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - j))
    at = off + np.arange(n + 1) * (DEPTH + 1)
    keep = np.ones(len(key), bool)
    for j in range(1, DEPTH + 1):
        keep[at[1:-1] - j] = False  # between two texts
    return key[keep], off + np.arange(n + 1)


def _log_gamma_half() -> np.ndarray:
    out = np.zeros(256)
    out[0] = 0.5 * np.log(np.pi)
    out[1:] = out[0] + np.cumsum(np.log(np.arange(255) + 0.5))
    return out


_HALF = _log_gamma_half()
_WHOLE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))  # log of (n)!


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def half(n):
        return np.where(n < 256, _HALF[np.minimum(n, 255).astype(np.int64)], _stirling(np.maximum(n, 1) + 0.5))

    n = a + b
    whole = np.where(n < 256, _WHOLE[np.minimum(n, 255).astype(np.int64)], _stirling(np.maximum(n, 1) + 1.0))
    return half(a) + half(b) - whole - np.log(np.pi)


def sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(keys, return_inverse=True)
    return u, np.bincount(back, n, len(u))


class Level:
    """The nodes of all contexts of d bytes: `at` (context and node, 1 to 255), decisions for 0 and for 1."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, d: int):
        context = keys >> np.uint64(8 * (DEPTH + 1 - d)) if d else np.zeros_like(keys)
        leaf, n = sums(context << np.uint64(8) | keys & np.uint64(255), n)
        byte = (leaf & np.uint64(255)).astype(np.int64)
        node = (1 << _NODES)[None, :] | byte[:, None] >> (8 - _NODES)[None, :]
        self.one = (byte[:, None] >> (7 - _NODES)[None, :] & 1).astype(bool)
        self.at, back = np.unique((leaf >> np.uint64(8) << np.uint64(8))[:, None] | node.astype(np.uint64), return_inverse=True)
        self.back = back.reshape(-1, 8)  # the eight nodes of each leaf
        flat, many = back.ravel(), np.repeat(n, 8)
        self.n1 = np.bincount(flat, many * self.one.ravel(), len(self.at))
        self.n0 = np.bincount(flat, many, len(self.at)) - self.n1

    def weigh(self, below: np.ndarray | None) -> None:
        """From what the nodes' children make of the data: the log of what they make of it, and the weight of their own estimate."""
        own = log_kt(self.n0, self.n1)
        self.log = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.own = np.exp(own - np.log(2) - self.log)

    def mix(self, done: np.ndarray, left: np.ndarray, last: np.ndarray, deepest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One depth further: the mixture so far, the weight that is left and the estimate; a node that saw nothing keeps
        its parent's. At the deepest level the first is the probability of a 1."""
        n = self.n0 + self.n1
        p = np.where(n > 0, (self.n1 + 0.5) / (n + 1), last)
        if deepest:
            return done + left * p, left, p
        return done + left * self.own * p, left * (1 - self.own), p


def parents(at: np.ndarray) -> np.ndarray:
    """The same nodes of the contexts that are one byte shorter."""
    return at >> np.uint64(16) << np.uint64(8) | at & np.uint64(255)


def subtree(keys: np.ndarray, n: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels deeper than TOP, weighed, and the nodes above them with what these make of the data."""
    levels = [Level(keys, n, d) for d in range(TOP + 1, DEPTH + 1)]
    below = None
    for k in range(len(levels) - 1, -1, -1):
        levels[k].weigh(below)
        if k:
            below = np.bincount(np.searchsorted(levels[k - 1].at, parents(levels[k].at)), levels[k].log, len(levels[k - 1].at))
    at, below = sums(parents(levels[0].at), levels[0].log)
    return levels, at, below


def short(at: np.ndarray, below: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the nodes of all contexts of TOP bytes, what the mixture has come to: done, left and last."""
    levels = []
    for d in range(TOP, -1, -1):
        level = Level.__new__(Level)
        level.at, level.n0, level.n1 = at, n0, n1
        level.weigh(below)
        levels.append(level)
        if d:
            up = parents(at)
            at, below = sums(up, level.log)
            n0, n1 = sums(up, n0)[1], sums(up, n1)[1]
    state = tuple(np.full(len(levels[-1].at), x, np.float64) for x in (0, 1, 0.5))
    for k in range(TOP, -1, -1):
        if k < TOP:
            up = np.searchsorted(levels[k + 1].at, parents(levels[k].at))
            state = tuple(x[up] for x in state)
        state = levels[k].mix(*state, False)
    return state


def costs(keys: np.ndarray, n: np.ndarray, at: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log10 of the probability of each of these distinct, sorted grams; state: of the nodes `at` of TOP bytes."""
    levels, _, _ = subtree(keys, n)
    for k, level in enumerate(levels):
        up = np.searchsorted(at, parents(level.at))
        state = level.mix(*(x[up] for x in state), k == len(levels) - 1)
        at = level.at
    p, last = state[0], levels[-1]
    return np.where(last.one, np.log10(p)[last.back], np.log10(1 - p)[last.back]).sum(1)


# -- packing ---------------------------------------------------------------------------------------------------


def small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest takes; the first byte says how many."""
    top = int(x.max()) if len(x) else 0
    size = next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k or k == 8)
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct keys by part and key, and each one's part in that order."""
    p = (C.mix(keys) >> np.uint64(20)) % np.uint64(parts)
    order = np.lexsort((keys, p))
    return order, p[order].astype(np.int64)


def _cuts(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    edges = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(0, np.int64)
    return zip(x[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def distinct(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The distinct grams (g) and words (w, with END) of a block's texts, and how often those that are learned from have them."""
    found: dict[str, list] = {"g": [], "w": []}
    for whole in table.combine_chunks().to_batches():
        for batch in C.slices(whole, "_s_text"):
            learn = ~np.array(batch.column("_s_held"), bool)
            key, key_at = grams(*C.text_arrays(batch.column("_s_text")))
            word, word_at = _words(batch.column("_s_text"))
            word, ends = word.view(np.uint64), np.full(len(learn), END, np.int64).view(np.uint64)
            found["g"].append(sums(key, np.repeat(learn, np.diff(key_at))))
            found["w"].append(sums(np.append(word, ends), np.append(np.repeat(learn, np.diff(word_at)), learn)))
    return {kind: sums(*(np.concatenate([x[k] for x in parts]) for k in (0, 1))) if parts else (np.zeros(0, np.uint64), np.zeros(0)) for kind, parts in found.items()}


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = C.text_arrays(column)
    begin, end, at = C.words(buf, off)
    return C.word_hashes(C.LOWER[buf], begin, end).view(np.int64), at


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


# -- the operator ----------------------------------------------------------------------------------------------


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, part: int = PART) -> DataFrame:
    """Per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text
    and its end) and bits_per_byte (code length per byte, of the text and its end).

    held_out: a condition on docs; the rows where it is not true are learned from. A null or empty text has its end
    as its one token. Without training rows base_score is that of an empty vocabulary and every decision is even.
    Rows are independent: repeated rows and null ids give rows of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.select(F.col(id_col).alias("_s_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_s_text"), F.coalesce(held_out, F.lit(False)).alias("_s_held"))
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("_s_text")), F.lit(0))).first()[0])
    n_blocks, parts = size // block + 1, size // part + 12
    # By row, not by text: repeated rows are dealt to all blocks. Written, so that a row's block never changes.
    rows = C.table(docs.withColumn("_s_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")))
    blocks = rows.groupBy("_s_block")

    def ask(table: pa.Table) -> pa.Table:
        out = []
        b = table.column("_s_block")[0].as_py() if table.num_rows else 0
        for kind, (keys, n) in distinct(table).items():
            order, p = by_part(keys, parts)
            keys, n = keys[order], n[order]
            out += [(kind, x, b, keys[i:j].tobytes(), small(n[i:j])) for x, i, j in _cuts(p)]
        C.tidy()
        kinds = {"kind": pa.string(), "p": pa.int32(), "b": pa.int32(), "keys": pa.binary(), "n": pa.binary()}
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds)) if out else pa.schema(kinds.items()).empty_table()

    asked = blocks.applyInArrow(ask, "kind string, p int, b int, keys binary, n binary").repartition(2 * parts, "kind", "p").sortWithinPartitions("kind", "p")

    def add(batches):
        """Of each part the distinct keys with their counts (b null), and to each block its answer: counts of words, or
        the places of its grams among the distinct ones."""
        for (kind, p), members in groupby(_rows(batches, "kind", "p", "b", "keys", "n"), lambda r: r[:2]):
            members = [(b, np.frombuffer(k, np.uint64), n) for _, _, b, k, n in members]
            keys, n = sums(np.concatenate([m[1] for m in members]), np.concatenate([large(m[2]) for m in members]))
            n = n.astype(np.int64)
            known = n > 0
            total = {"b": [None], "keys": [keys.tobytes() if kind == "g" else b""], "data": [small(n) if kind == "g" else b""], "n": [int(n.sum())], "v": [int(known.sum())]}
            for i in range(0, len(members), 64):
                some = members[i : i + 64]
                places = [np.searchsorted(keys, m[1]) for m in some]
                cols = {"b": [m[0] for m in some], "keys": [None] * len(some), "data": [small(x if kind == "g" else n[x]) for x in places], "n": [0] * len(some), "v": [0] * len(some)}
                for out in ([total] if not i else []) + [cols]:
                    m = len(out["b"])
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * m), pa.array([p] * m, pa.int32()), pa.array(out["b"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["data"], pa.binary()), pa.array(out["n"], pa.int64()), pa.array(out["v"], pa.int64())], ["kind", "p", "b", "keys", "data", "n", "v"])
        C.tidy()

    added = C.table(asked.mapInArrow(add, "kind string, p int, b int, keys binary, data binary, n long, v long"))
    total, vocabulary = (int(x) for x in added.filter("kind = 'w' AND b IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())
    base = np.log10(total + 0.1 * (vocabulary + 1))
    told = added.filter("kind = 'w' AND b IS NOT NULL").select("kind", "p", F.col("b").alias("_s_block"), "data").unionByName(_told(added, parts))
    kind = dict(docs.dtypes)["_s_id"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        schema = pa.schema(list(zip(names, [left.schema.field("_s_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()], strict=True)))
        if not left.num_rows:
            return schema.empty_table()
        answers = {(k, p): d for k, p, d in zip(*(right.column(c).to_pylist() for c in ("kind", "p", "data")), strict=True)}
        look = {}
        for k, (keys, _) in distinct(left).items():
            order, p = by_part(keys, parts)
            value = np.empty(len(keys))
            for x, i, j in _cuts(p):
                value[order[i:j]] = np.frombuffer(answers[k, x], "<f4") if k == "g" else large(answers[k, x])
            look[k] = keys, value
        del answers, right
        out = []
        for whole in left.combine_chunks().to_batches():
            for batch in C.slices(whole, "_s_text"):
                buf, off = C.text_arrays(batch.column("_s_text"))
                word, word_at = _words(batch.column("_s_text"))
                key, key_at = grams(buf, off)
                end = int(look["w"][1][np.searchsorted(look["w"][0], np.array([END]).view(np.uint64)[0])])
                u, back = np.unique(key, return_inverse=True)
                of_byte = look["g"][1][np.searchsorted(look["g"][0], u)][back]
                c = look["w"][1][np.searchsorted(look["w"][0], word.view(np.uint64))]
                per = lambda x, at: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
                n, value = np.diff(word_at) + 1, per(of_byte, key_at)
                known = per((c > 0).astype(np.int64), word_at) + (end > 0)
                lone = per(np.log10(c + 0.1) - base, word_at) + np.log10(end + 0.1) - base
                out.append(pa.RecordBatch.from_arrays([batch.column("_s_id"), batch.column("_s_held"), pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(lone), pa.array(value), pa.array(-value / np.log10(2) / (np.diff(off) + 1))], names))
        C.tidy()
        return pa.Table.from_batches(out).cast(schema)

    out = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocks.cogroup(told.groupBy("_s_block")).applyInArrow(work, out)


def _told(added: DataFrame, parts: int) -> DataFrame:
    """(kind, p, _s_block, data): the costs of each block's grams, in the order in which it asked."""
    spark = added.sparkSession

    def spread(batches):
        """The distinct grams of each part, by the last TOP bytes of their contexts."""
        for p, keys, n in _rows(batches, "p", "keys", "data"):
            keys, n = np.frombuffer(keys, np.uint64), large(n)
            group = (keys >> np.uint64(8 * (DEPTH + 1 - TOP))).astype(np.int64)
            out = [(x, p, keys[i:j].tobytes(), small(n[i:j])) for x, i, j in _cuts(group)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["top", "p", "keys", "n"])
        C.tidy()

    tree = C.table(added.filter("kind = 'g' AND b IS NULL").select("p", "keys", "data").mapInArrow(spread, "top int, p int, keys binary, n binary"))

    def held(rows: Iterator[tuple]):
        """Whole groups of (top, p, keys, n) rows, about HELD grams at once: keys and counts, sorted, and each one's part."""
        some, size = [], 0

        def joined():
            keys, n = np.concatenate([np.frombuffer(r[2], np.uint64) for r in some]), np.concatenate([large(r[3]) for r in some])
            p = np.repeat([r[1] for r in some], [len(r[2]) // 8 for r in some])
            order = np.argsort(keys)
            return keys[order], n[order].astype(float), p[order], [r[0] for r in some]

        for _, members in groupby(rows, lambda r: r[0]):
            members = list(members)
            some += members
            size += sum(len(r[2]) // 8 for r in members)
            if size >= HELD:
                yield joined()
                some, size = [], 0
        if some:
            yield joined()

    def up(batches):
        for keys, n, *_ in held(_rows(batches, "top", "p", "keys", "n")):
            _, at, below = subtree(keys, n)
            here = Level(keys, n, TOP)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(below), pa.array(here.n0), pa.array(here.n1)], ["at", "below", "n0", "n1"])
        C.tidy()

    by_top = tree.repartition("top").sortWithinPartitions("top")
    top = by_top.mapInArrow(up, "at long, below double, n0 double, n1 double").toArrow().sort_by("at")
    at, *rest = (np.array(top.column(c)) for c in ("at", "below", "n0", "n1"))
    state = short(at.astype(np.uint64), *rest) if len(at) else (np.zeros(0),) * 3
    sent = [(x, -1, at[i:j].astype(np.uint64).tobytes(), np.concatenate([s[i:j] for s in state]).tobytes()) for x, i, j in _cuts(at >> 8)]
    columns = {"top": pa.int32(), "p": pa.int32(), "keys": pa.binary(), "n": pa.binary()}
    sent = spark.createDataFrame(pa.table([pa.array([r[k] for r in sent], t) for k, t in enumerate(columns.values())], names=list(columns)))

    def down(batches):
        """Each group's state of the short contexts (part -1) comes before its grams."""
        states = {}

        def rest():
            for r in _rows(batches, "top", "p", "keys", "n"):
                if r[1] < 0:
                    states[r[0]] = np.frombuffer(r[2], np.uint64), np.frombuffer(r[3]).reshape(3, -1)
                else:
                    yield r

        for keys, n, p, tops in held(rest()):
            mine = [states[t] for t in sorted(set(tops))]
            at, state = np.concatenate([m[0] for m in mine]), np.concatenate([m[1] for m in mine], axis=1)
            cost = costs(keys, n, at, tuple(state)).astype("<f4")
            for t in set(tops):
                del states[t]
            order = np.argsort(p, kind="stable")
            keys, cost = keys[order], cost[order]
            out = [(x, keys[i:j].tobytes(), cost[i:j].tobytes()) for x, i, j in _cuts(p[order])]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["p", "keys", "data"])
        C.tidy()

    priced = tree.unionByName(sent).repartition("top").sortWithinPartitions("top", "p").mapInArrow(down, "p int, keys binary, data binary")
    places = added.filter("kind = 'g' AND b IS NOT NULL").select("p", "b", F.lit(None).cast("binary").alias("keys"), "data")
    met = priced.select("p", F.lit(-1).alias("b"), "keys", "data").unionByName(places).repartition(parts, "p").sortWithinPartitions("p", "b")

    def tell(batches):
        for p, members in groupby(_rows(batches, "p", "b", "keys", "data"), lambda r: r[0]):
            keys, cost, value = [], [], None
            for _, b, k, data in members:
                if b < 0:
                    keys.append(np.frombuffer(k, np.uint64))
                    cost.append(np.frombuffer(data, "<f4"))
                    continue
                if value is None:
                    value = np.concatenate(cost)[np.argsort(np.concatenate(keys))]
                yield pa.RecordBatch.from_arrays([pa.array(["g"]), pa.array([p], pa.int32()), pa.array([b], pa.int32()), pa.array([value[large(data)].tobytes()], pa.binary())], ["kind", "p", "_s_block", "data"])
        C.tidy()

    return met.mapInArrow(tell, "kind string, p int, _s_block int, data binary")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' unigram and context-tree scores, learned from those whose crc32(doc_id) mod 10 is not 0."""
    docs = C.read(spark, sf_dir, "documents")
    return score(docs, F.pmod(C.crc32_of_id(), F.lit(10)) == 0)
