"""Operators 3 and 7: repeated passages, found through anchors.

Every window (200 bytes, or 50 words) has an anchor: its least hashed gram. Equal windows have equal anchors at
the same place, so a window can only repeat where its anchor does. Consecutive windows of one anchor are a run;
the span that a run's windows cover is its context. The steps:

1. a map over documents gives each run's anchor and context as hashes (about one run in 90 bytes or 22 words);
2. anchors that occur once fall away after a partial count; equal contexts are worked out once, whatever their
   number, so copies of documents cost no more than one. Anchor and context, 128 bits, name a context;
3. the texts of contexts with an anchor in common come together and are compared: operator 3 orders all suffixes of
   theirs by bucket-pointer refinement, operator 7 extends each anchor to both sides, word by word;
4. the verdicts go back to documents by context, and one more map over the texts cuts them.

Anchors with more than GROUP different contexts are not brought together: their windows are counted by 128-bit
hashes, in partial sums that any number of tasks share, with the same result. Joins that can meet a hot key have an
exchange on both sides, so that Spark may split it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill.llm import common as C

BYTES = 200
BYTE_GRAM = 16
WORDS = 50
WORD_GRAM = 8
#: Different contexts of one anchor that one task may hold.
GROUP = 10_000
#: Contexts that are compared at once, and their bytes: whole groups, so at most one group more.
HELD = 10_000
HELD_BYTES = 3_000_000


class Runs:
    """The runs of a slice of texts. unit: "bytes" or "words"."""

    def __init__(self, column: pa.Array, unit: str, window: int, gram: int):
        self.buf, self.off = C.text_arrays(column)
        if unit == "words":
            self.begin, self.end, self.at = C.words(self.buf, self.off)
            self.values = C.word_hashes(self.buf, self.begin, self.end)
            grams = C.runs(self.values, gram)
        else:
            self.at, self.values = self.off, self.buf
            grams = byte_grams(self.buf, gram)
        self.first, self.n, where = C.windows_by_anchor(grams, self.at[:-1], self.at[1:] - window + 1, window - gram + 1)
        self.anchor = grams[where].view(np.int64)
        self.back = where - self.first
        self.last = self.first + self.n - 1 + window
        self.context = C.span_hashes(self.values, self.first, self.last)
        self.row = np.searchsorted(self.at, self.first, "right") - 1

    def names(self) -> np.ndarray:
        return _names(self.row, self.anchor, self.context)

    def wanted(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        """Runs that their row's list of structs (a, c, ...) names, the place of that struct in all of them, and these."""
        size = np.array(lists.value_lengths().fill_null(0), np.int64)
        flat = lists.flatten()
        a, c = (np.array(flat.field(x), np.int64) for x in ("a", "c"))
        name, mine = _names(np.repeat(np.arange(len(size)), size), a, c), self.names()
        order = np.argsort(name, kind="stable")
        lo, hi = np.searchsorted(name[order], mine, "left"), np.searchsorted(name[order], mine, "right")
        n = hi - lo
        run = np.repeat(np.arange(len(mine)), n)
        place = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return run, order[place], flat


def byte_grams(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each `gram` consecutive bytes."""
    if len(buf) < gram:
        return np.zeros(0, np.uint64)
    if gram % 8:
        return C.runs(C.mix(buf.astype(np.uint64) + np.uint64(1)), gram)
    eight, n = C.eight_bytes(buf), len(buf) - gram + 1
    out = C.mix(eight[:n])
    for j in range(8, gram, 8):
        out = C.fold(out, eight[j : n + j])
    return out


def _names(row: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return C.fold(C.fold(C.mix(row.astype(np.uint64)), a.view(np.uint64)), c.view(np.uint64))


class _Once:
    """Which names a task has not had yet. Every task gets it as it was made, with none."""

    def __init__(self):
        self.had: set[int] = set()

    def new(self, names: np.ndarray) -> np.ndarray:
        """Places of these names' first occurrences."""
        some, one = np.unique(names, return_index=True)
        fresh = np.array([x not in self.had for x in some.tolist()], bool)
        self.had.update(some[fresh].tolist())
        return one[fresh]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _s_k, the key of a row, and _s_text. Rows of one id and text have one key and one result."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(key.alias("_s_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_s_text"), *[c for c in docs.columns if c != text_col])


def _other(column: str):
    """The key under another value: the join then exchanges both sides, and Spark can split a hot key."""
    return F.col(column).bitwiseXOR(F.lit(1))


def _repeated(docs: DataFrame, unit: str, window: int, gram: int, across: bool) -> DataFrame:
    """(a, c, k, id, n) of runs whose anchor occurs again (across: in another id); n: times that this row has the context."""

    def work(batch):
        r = Runs(batch.column("_s_text"), unit, window, gram)
        if not len(r.row):
            return
        _, one, n = np.unique(r.names(), return_index=True, return_counts=True)
        row = pa.array(r.row[one])
        yield pa.RecordBatch.from_arrays([pa.array(r.anchor[one]), pa.array(r.context[one]), batch.column("_s_k").take(row), batch.column("_s_id").take(row), pa.array(n, pa.int64())], ["a", "c", "k", "id", "n"])

    runs = C.table(C.map_texts(docs, work, "a long, c long, k long, id long, n long"))
    anchors = runs.groupBy("a").agg(*([F.min("id").alias("lo"), F.max("id").alias("hi")] if across else [F.sum("n").alias("lo")]))
    anchors = anchors.filter("lo < hi" if across else "lo > 1").select(_other("a").alias("a2"))
    again = C.table(runs.join(anchors, _other("a") == F.col("a2")).select("a", "c", "k", "id", "n"))
    C.drop(runs)
    return again


def _contexts(dup: DataFrame, single: bool, group: int) -> tuple[DataFrame, DataFrame]:
    """Distinct contexts, and those of them whose anchor has several (hot: more than `group`): no other window can occur in
    two contexts. single: leaves out anchors all of whose contexts occur more than once, as nothing is left to find
    out of these."""
    contexts = C.table(dup.groupBy("a", "c").agg(F.min("k").alias("k"), F.min("id").alias("lo"), F.sum("n").alias("n")))
    many = contexts.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    many = many.filter("m > 1 AND least = 1" if single else "m > 1").select(_other("a").alias("a2"), (F.col("m") > group).alias("hot"))
    return contexts, contexts.join(many, _other("a") == F.col("a2")).drop("a2")


def _by_row(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy(F.col("k").alias("_s_j")).agg(F.collect_list(F.struct("a", "c", "lo")).alias("_s_v"))


def _spans(texts: DataFrame, contexts: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """(a, c, lo, back, span) of contexts (a, c, k, lo): where the anchor is, and the bytes, or words joined by spaces. Rows
    that are equal have a key in common: a task gives a context once, however many of its rows have it."""
    given = _Once()

    def work(batch):
        r = Runs(batch.column("_s_text"), unit, window, gram)
        run, place, flat = r.wanted(batch.column("_s_v"))
        one = given.new(_names(np.zeros(len(run), np.int64), r.anchor[run], r.context[run]))
        run, place = run[one], place[one]
        first, last = r.first[run].tolist(), r.last[run].tolist()
        data = r.buf.tobytes()
        if unit == "words":
            begin, end = r.begin.tolist(), r.end.tolist()
            span = [b" ".join([data[begin[i] : end[i]] for i in range(a, b)]) for a, b in zip(first, last, strict=True)]
        else:
            span = [data[a:b] for a, b in zip(first, last, strict=True)]
        lo = flat.field("lo").take(pa.array(place))
        yield pa.RecordBatch.from_arrays([pa.array(r.anchor[run]), pa.array(r.context[run]), lo, pa.array(r.back[run].astype(np.int32)), pa.array(span, pa.binary())], ["a", "c", "lo", "back", "span"])

    joined = texts.join(_by_row(contexts), F.col("_s_k") == F.col("_s_j")).select("_s_text", "_s_v")
    spread = C.map_texts(joined, work, "a long, c long, lo long, back int, span binary")
    return spread.repartition("a").sortWithinPartitions("a")


def _windows(texts: DataFrame, contexts: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """(a, c, off, w, x, lo) of each window of these contexts: its place and 128 bits of hash."""
    given = _Once()

    def work(batch):
        r = Runs(batch.column("_s_text"), unit, window, gram)
        run, place, flat = r.wanted(batch.column("_s_v"))
        one = given.new(_names(np.zeros(len(run), np.int64), r.anchor[run], r.context[run]))
        run, place = run[one], place[one]
        n = r.n[run]
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(r.first[run], n) + off
        values = r.values.astype(np.uint64)
        w, x = (C.runs(C.mix(values ^ np.uint64(salt)), window)[start].view(np.int64) for salt in (0x51, 0xA7F3))
        lo = np.array(flat.field("lo"), np.int64)[place]
        yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(y[run], n)) for y in (r.anchor, r.context)], pa.array(off.astype(np.int32)), pa.array(w), pa.array(x), pa.array(np.repeat(lo, n))], ["a", "c", "off", "w", "x", "lo"])

    joined = texts.join(_by_row(contexts), F.col("_s_k") == F.col("_s_j")).select("_s_text", "_s_v")
    return C.map_texts(joined, work, "a long, c long, off int, w long, x long, lo long")


def _window_ranges(windows: DataFrame, by: list[str]) -> DataFrame:
    """Maximal ranges lo..hi of the places `off` by context (at most a run's length) and the columns `by`."""
    pairs = windows.groupBy("a", "c", *by).agg(F.array_sort(F.collect_set("off")).alias("o"))
    lows = F.filter("o", lambda x, i: (i == 0) | (x - F.get(F.col("o"), i - 1) > 1))
    highs = F.filter("o", lambda x, i: (i == F.size("o") - 1) | (F.get(F.col("o"), i + 1) - x > 1))
    out = pairs.select("a", "c", *by, F.inline(F.arrays_zip(lows.alias("lo"), highs.alias("hi")))).toDF("a", "c", *by, "lo", "hi")
    return out.select("a", "c", *by, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def _ranges(who: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((where, who))
    who, where = who[order], where[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)
    k = np.flatnonzero(new)
    return who[k], where[k], where[np.append(k[1:], len(who)) - 1] if len(k) else where


def _compare(batches: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor -> what find(group, spans, back, lo) says of the windows of each, as ranges by context."""

    def rows():
        for b in batches:
            yield from zip(*(b.column(x).to_pylist() for x in ("a", "c", "lo", "back", "span")), strict=True)

    def work(todo):
        flat = [x for members in todo for x in members]
        group = np.repeat(np.arange(len(todo)), [len(x) for x in todo])
        a, c, lo, back = (np.array([x[k] for x in flat], np.int64) for k in range(4))
        who, low, high = _ranges(*find(group, [x[4] for x in flat], back, lo))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[who], c[who], low, high, lo[who])], ["a", "c", "lo", "hi", "first"])

    todo, held, size = [], 0, 0
    for _, members in groupby(rows(), lambda r: r[0]):
        one = list({x[1]: x for x in members}.values())
        if len(one) > 1:
            todo.append(one)
            held += len(one)
            size += sum(len(x[4]) for x in one)
        if held >= HELD or size >= HELD_BYTES:
            yield work(todo)
            todo, held, size = [], 0, 0
    if todo:
        yield work(todo)
    C.tidy()


def _cut(texts: DataFrame, verdicts: DataFrame, unit: str, window: int, gram: int, digests: bool, columns: list[str]) -> DataFrame:
    """texts with the outcome of verdicts (_s_j, a key, and _s_v: array of a, c, lo, hi: windows lo..hi of a run go)."""

    def work(batch):
        r = Runs(batch.column("_s_text"), unit, window, gram)
        run, place, flat = r.wanted(batch.column("_s_v"))
        lo, hi = (np.array(flat.field(f), np.int64)[place] for f in ("lo", "hi"))
        first, last = r.first[run] + lo, r.first[run] + np.minimum(hi, r.n[run] - 1) + window
        order = np.argsort(first, kind="stable")
        # Ranges of two rows never meet, as each ends within its text; those that touch across rows are parted again below.
        gone = np.zeros(len(r.values) + 1, np.int64)
        np.add.at(gone, first[order], 1)
        np.add.at(gone, last[order], -1)
        gone = np.cumsum(gone)[:-1] > 0
        out = {x: [] for x in ("size", "removed", "spans", "kept", "sha")}
        for i in range(batch.num_rows):
            a, b = int(r.at[i]), int(r.at[i + 1])
            g = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
            if unit == "bytes":
                kept = r.buf[a:b][~g].tobytes() if len(edges) else r.buf[a:b].tobytes()
            else:
                kept = b" ".join([r.buf[x:y].tobytes() for x, y, z in zip(r.begin[a:b].tolist(), r.end[a:b].tolist(), g.tolist(), strict=True) if not z])
            out["size"].append(b - a)
            out["removed"].append(int(g.sum()))
            out["spans"].append(len(edges) // 2 if digests else edges.reshape(-1, 2).tolist())
            if digests:
                out["sha"].append(hashlib.sha256(kept).hexdigest())
            else:
                out["kept"].append(kept.decode("utf-8", "ignore"))
        res = [pa.array(out["size"], pa.int64()), pa.array(out["removed"], pa.int64())]
        res += [pa.array(out["spans"], pa.int64()), pa.array(out["sha"], pa.string())] if digests else [pa.array(out["spans"], pa.list_(pa.list_(pa.int64()))), pa.array(out["kept"], pa.string())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *res], [*columns, "_s_size", "_s_removed", "_s_spans", "_s_kept"])

    joined = texts.join(verdicts, F.col("_s_k") == F.col("_s_j"), "left").select("_s_text", *columns, "_s_v")
    kinds = dict(texts.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "_s_size long, _s_removed long", "_s_spans long, _s_kept string" if digests else "_s_spans array<array<long>>, _s_kept string"])
    return C.map_texts(joined, work, schema)


# -- operator 3 ----------------------------------------------------------------------------------------------


def repeated_windows(spans: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(span, place) of each window that starts at another place of these spans too, by bucket-pointer refinement.

    All suffixes lie in buckets, each with a pointer: first by their q bytes. A round sorts the members of every bucket
    that still has several by the pointers of the suffixes q bytes later, and the parts get pointers of their own, in
    place; so the next round, which looks 2q bytes later, goes by what this one refined. A suffix alone in its bucket
    is in its final place. When pointers stand for h bytes, with h <= window < 2h, those of a window's first and last h
    bytes tell whether it repeats. A suffix is left out as soon as it is shorter than what is compared.
    """
    size = np.array([len(x) for x in spans], np.int64)
    text = np.frombuffer(b"".join(spans), np.uint8)
    begin = np.cumsum(size) - size
    rest = np.repeat(begin + size, size) - np.arange(len(text))  # bytes from each place to its span's end
    q = 8
    while q > window:
        q //= 2
    key = C.eight_bytes(text)[: len(text)].byteswap() >> np.uint64(64 - 8 * q)
    live = np.flatnonzero(rest >= q)
    pointer = np.full(len(text), -1, np.int64)  # -1: no other suffix begins with the same bytes

    def part(live: np.ndarray, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """Gives the suffixes `live` pointers by these keys (the last counts most); returns those that are not alone."""
        order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        head = np.flatnonzero(new)
        many = np.repeat(np.diff(np.append(head, len(order))) > 1, np.diff(np.append(head, len(order))))
        at = np.repeat(head, np.diff(np.append(head, len(order))))
        pointer[live[order]] = np.where(many, at, -1)
        return live[order[many]]

    live = part(live, (key[live],))
    h = q
    while 2 * h <= window:
        short, live = live[rest[live] < 2 * h], live[rest[live] >= 2 * h]
        later = pointer[live + h]
        pointer[short] = pointer[live[later < 0]] = -1
        live, later = live[later >= 0], later[later >= 0]
        live = part(live, (later, pointer[live]))
        h *= 2
    live = live[rest[live] >= window]
    ends = pointer[live + window - h]
    live, ends = live[ends >= 0], ends[ends >= 0]
    live = part(live, (ends, pointer[live]))
    who = np.searchsorted(begin, live, "right") - 1
    return who, live - begin[who]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = BYTES, gram: int = BYTE_GRAM, group: int = GROUP, digests: bool = False) -> DataFrame:
    """docs (without text_col) and: _s_size, bytes of the text; _s_removed; _s_spans, the removed [start, end)
    (with digests, how many); _s_kept, what is left as text, without characters that were cut in two (with
    digests, the SHA-256 of all bytes left).

    A byte goes if a string of `window` bytes over it starts anywhere else too, in any row. Null and empty texts
    keep nothing and lose nothing. Ids may be null or repeated: each row is a text of its own, so a row that
    occurs twice loses all of a text of `window` bytes or more. All other columns are passed through.
    """
    texts = _texts(docs, id_col, text_col)
    columns = [c for c in docs.columns if c != text_col]
    dup = _repeated(texts.select("_s_k", "_s_text", F.lit(0).cast("long").alias("_s_id")), "bytes", window, gram, across=False)
    contexts, several = _contexts(dup, single=True, group=group)
    spread = _spans(texts, several.filter("NOT hot"), "bytes", window, gram)
    found = spread.mapInArrow(lambda b: _compare(b, lambda _, spans, *rest: repeated_windows(spans, window)), "a long, c long, lo long, hi long, first long")
    windows = _windows(texts, several.filter("hot"), "bytes", window, gram)
    again = windows.groupBy("w", "x").count().filter("count > 1").select(_other("w").alias("w2"), F.col("x").alias("x2"))
    shared = _window_ranges(windows.join(again, (_other("w") == F.col("w2")) & (F.col("x") == F.col("x2"))).select("a", "c", "off"), [])
    found = found.drop("first").unionByName(shared)
    whole = contexts.filter("n > 1").select("a", "c", F.lit(0).cast("long").alias("lo"), F.lit(2**40).cast("long").alias("hi"))
    found = found.join(whole.select("a", "c"), ["a", "c"], "left_anti").unionByName(whole)
    return _apply(texts, dup, found, "bytes", window, gram, digests, columns)


def _apply(texts, dup, found, unit, window, gram, digests, columns) -> DataFrame:
    named = found.withColumns({"a2": _other("a"), "c2": F.col("c")}).drop("a", "c")
    at = dup.join(named, (_other("a") == F.col("a2")) & (F.col("c") == F.col("c2")))
    if unit == "words":
        at = at.filter("id >= from")
    # A set: rows that are equal have one key and the same verdicts, which need not be gathered for each of them.
    verdicts = at.groupBy(F.col("k").alias("_s_j")).agg(F.collect_set(F.struct("a", "c", "lo", "hi")).alias("_s_v"))
    return _cut(texts, verdicts, unit, window, gram, digests, columns)


# -- operator 7 ----------------------------------------------------------------------------------------------


def extended(group: np.ndarray, spans: list[bytes], back: np.ndarray, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of each window that a context of a smaller owner has as well.

    Contexts of a group are laid on each other at their anchor, and the match is extended one word at a time, to the
    left and to the right: a class holds those that agree so far. Contexts that are alone in their class extend no
    further. Two contexts have a window with l words before the anchor in common when their matches reach l words to
    the left and the other window - gram - l to the right.
    """
    text = pa.array(spans, pa.binary())
    buf, off = C.text_arrays(text)
    begin, end, at = C.words(buf, off)
    word = C.word_hashes(buf, begin, end)
    anchor, most = at[:-1] + back, window - gram
    room = {-1: back, 1: at[1:] - anchor - gram}

    def reach(step: int) -> np.ndarray:
        """By number of words: the class of each context, -1 where no other one agrees or the context has ended."""
        out = np.full((most + 1, len(group)), -1, np.int64)
        out[0] = group
        live = np.arange(len(group))
        for k in range(1, most + 1):
            live = live[room[step][live] >= k]
            if not len(live):
                break
            x = word[anchor[live] - k] if step < 0 else word[anchor[live] + gram - 1 + k]
            before = out[k - 1, live]
            order = np.lexsort((x, before))
            x, before = x[order], before[order]
            new = np.append(True, (x[1:] != x[:-1]) | (before[1:] != before[:-1]))
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(order)))
            live = live[order][np.repeat(size > 1, size)]
            out[k, live] = np.repeat(head, size)[np.repeat(size > 1, size)]
        return out

    left, right = reach(-1), reach(1)
    who, where = [], []
    for k in range(most + 1):
        on = np.flatnonzero((left[k] >= 0) & (right[most - k] >= 0) & (back >= k) & (room[1] >= most - k))
        if not len(on):
            continue
        order = np.lexsort((right[most - k, on], left[k, on]))
        on = on[order]
        new = np.append(True, (left[k, on[1:]] != left[k, on[:-1]]) | (right[most - k, on[1:]] != right[most - k, on[:-1]]))
        head = np.flatnonzero(new)
        first = np.repeat(np.minimum.reduceat(owner[on], head), np.diff(np.append(head, len(on))))
        hit = on[first < owner[on]]
        who.append(hit)
        where.append(back[hit] - k)
    return (np.concatenate(who), np.concatenate(where)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def seed_and_extend(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WORDS, gram: int = WORD_GRAM, group: int = GROUP, digests: bool = False) -> DataFrame:
    """docs (without text_col) and: _s_size, words of the text; _s_removed; _s_spans, the removed [start, end) as
    words (with digests, how many); _s_kept, the words left joined by one space (with digests, its SHA-256).

    A word goes if `window` consecutive words over it also start in a row of a smaller id. Ids are whole numbers;
    a null id is larger than any. Rows of equal ids take nothing from each other. Null and empty texts have no
    words. All other columns are passed through.
    """
    texts = _texts(docs, id_col, text_col)
    columns = [c for c in docs.columns if c != text_col]
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_s_id")
    dup = _repeated(texts.select("_s_k", "_s_text", ids), "words", window, gram, across=True)
    contexts, several = _contexts(dup, single=False, group=group)
    spread = _spans(texts, several.filter("NOT hot"), "words", window, gram)
    found = spread.mapInArrow(lambda b: _compare(b, lambda *x: extended(*x, window, gram)), "a long, c long, lo long, hi long, first long")
    windows = _windows(texts, several.filter("hot"), "words", window, gram)
    first = windows.groupBy("w", "x").agg(F.min("lo").alias("lo_id")).select(_other("w").alias("w2"), F.col("x").alias("x2"), "lo_id")
    owned = windows.join(first, (_other("w") == F.col("w2")) & (F.col("x") == F.col("x2"))).filter("lo_id < lo").select("a", "c", "off", F.col("lo").alias("first"))
    found = found.unionByName(_window_ranges(owned, ["first"]))
    # A context's first owner loses the windows that others own; every later one loses them all.
    found = found.select("a", "c", "lo", "hi", F.col("first").alias("from"))
    whole = contexts.select("a", "c", F.lit(0).cast("long").alias("lo"), F.lit(2**40).cast("long").alias("hi"), F.when(F.col("lo") < 2**63 - 1, F.col("lo") + 1).alias("from"))
    found = found.unionByName(whole.filter("from IS NOT NULL"))
    return _apply(texts, dup, found, "words", window, gram, digests, columns)


def _digest(out: DataFrame, size: str, spans: str | None) -> DataFrame:
    cols = [F.col("doc_id"), F.col("_s_size").alias(size), F.col("_s_removed").alias("n_removed")]
    return out.select(*cols, *([F.col("_s_spans").alias(spans)] if spans else []), F.col("_s_kept").alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated 200-byte strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(suffix_dedup(docs, digests=True), "n_bytes", "n_spans")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without 50-word passages of earlier documents: doc_id, n_words, n_removed, kept_sha256."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(seed_and_extend(docs, digests=True), "n_words", None)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM p) WHERE c > 1),
e AS (SELECT doc_id, i, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
s AS (SELECT doc_id, i, sum(CASE WHEN reach >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
g AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM g),
t AS (SELECT k.doc_id, count(*) AS n, sum(b - a) AS gone, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS lo FROM p) WHERE lo < doc_id),
g AS (SELECT doc_id, list(j) AS gone FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM r) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
