"""Operator 5: n-gram Jaccard join by PartEnum signatures, as components of linked documents.

1. One map over the texts gives each row its number, its set's name (128 bits), size and parity bitmap.
2. A second map signs the sets; signatures are packed by part of their domain and meet in tasks.
3. Each set is compared with the least set that it shares a signature with. Rows of one least set are dealt to tasks
   in chunks, so no group is held whole. What links so far is contracted to components.
4. Signatures whose sets are in several components are looked at again: pairs across components whose bitmaps differ in
   no more bits than linked sets may differ in elements are compared as well. No pair within a component is. The first
   times, ROUNDS at most, a signature gives only so many pairs as join its components, so a group of near copies costs
   its size, not its square; what signatures then still hold apart is compared pair by pair.

A bitmap's bits are parities of hashed elements, so two sets differ in at least as many elements as their bitmaps in
bits: what the bitmaps rule out can't link. All that remains is verified on the sets themselves.
"""

from __future__ import annotations

from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill.llm import common as C
from webmill.llm.components import components

SHINGLE = 3
PERCENT = 90
#: Second-level partitions (under 90 percent, where parts hold fewer elements: WIDE), and how many of them a signature
#: may leave out. Small sets, which may differ in few elements only, have more: FINE, by the most they may differ in.
PARTS = 2
WIDE = 3
LEFT_OUT = 1
FINE = {1: 8, 2: 8, 3: 6, 4: 4, 5: 4, 6: 4}
#: Signatures that meet at once.
MET = 1_500_000
#: Rows of one least set that are compared with it in one task.
CHUNK = 256
#: Sets of one signature whose bitmaps are compared in one task; more are compared block by block.
BLOCK = 4_000
#: How often signatures give only pairs that would join their components, while such pairs link, before they give all
#: pairs across these.
ROUNDS = 3


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each text's begin.

    A-Z count as lower case. A text of fewer than `size` words has its whole sequence as its one shingle; without
    words the set is empty.
    """
    buf, off = C.text_arrays(column)
    begin, end, at = C.words(buf, off)
    word = C.word_hashes(C.LOWER[buf], begin, end)
    n = np.diff(at)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)
    grams = C.mix(np.minimum(n, size).astype(np.uint64)[row] + np.uint64(1))
    stop = at[row + 1]
    for j in range(size):
        on = np.flatnonzero(start + j < stop)
        grams[on] = C.fold(grams[on], word[start[on] + j])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def names(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each whole set, as two numbers."""
    size = np.diff(at).astype(np.uint64)
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix(grams ^ np.uint64(salt)), dtype=np.uint64)))
        out.append(C.mix((sums[at[1:]] - sums[at[:-1]]) ^ C.mix(size + np.uint64(salt))).view(np.int64))
    return tuple(out)


def bitmaps(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The parity bitmap of each set, of two bits or more for each element: a power of two, 64 at least."""
    size = np.diff(at)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(bits)))
    spot = np.repeat(base[:-1], size) + (C.mix(grams ^ np.uint64(0x5EED)) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(spot, minlength=base[-1]) & 1).astype(np.uint8)
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def bands(most: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The last size of each band, and the most elements in which two linked sets up to that size can differ.

    A linked pair's sizes lie in one band or in two neighbours: a band ends where `percent` of its end reaches
    its begin. Sets link when percent/100 * union <= intersection, so they differ in at most
    (100 - percent) / (100 + percent) of the sum of their sizes.
    """
    ends, size = [], 1
    while True:
        ends.append(size * 100 // percent)
        if size > most:
            break
        size = ends[-1] + 1
    ends = np.array(ends, np.int64)
    return ends, (100 - percent) * 2 * ends // (100 + percent)


def signatures(grams: np.ndarray, at: np.ndarray, percent: int = PERCENT, parts: int | None = None, left_out: int = LEFT_OUT) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of each set.

    For a band in which linked sets differ in at most k elements the domain falls into n1 parts, each of some
    smaller ones: in one of the n1 they differ in at most `left_out` elements, so all but so many of its smaller
    parts are equal, and one of the signatures made of all such choices is shared. A set has the signatures of its
    own band and of the next, where it may meet larger sets. A choice of parts that are all empty says nothing; a
    few more first-level parts than needed make up for those, and the rare sets with too many of them also share
    one signature of their band.
    """
    size = np.diff(at)
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends, differ = bands(int(size.max()), percent)
    ends, differ = bands(int(ends[-1]) + 1, percent)  # and the band after the last
    own = np.searchsorted(ends, size)
    usual = parts or (PARTS if percent >= PERCENT else WIDE)
    rows, out = [], []
    for step in (0, 1):
        k = differ[own + step]
        fine = np.array([usual if parts else FINE.get(x, usual) for x in range(int(k.max()) + 1)])[k]
        for n2 in np.unique(fine[size > 0]).tolist():
            some = np.flatnonzero((fine == n2) & (size > 0))
            n = size[some]
            sub = np.concatenate(([0], np.cumsum(n)))
            mine = grams[np.arange(sub[-1]) - np.repeat(sub[:-1], n) + np.repeat(at[:-1][some], n)]
            r, s = _sign(mine, sub, own[some] + step, k[some], n2, left_out, percent)
            rows.append(some[r])
            out.append(s)
    return np.concatenate(rows), np.concatenate(out)


def _sign(grams: np.ndarray, at: np.ndarray, band: np.ndarray, k: np.ndarray, parts: int, left_out: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets that are not empty, for the given bands, with so many second-level parts."""
    size, rows, out = np.diff(at), [], []
    row = np.repeat(np.arange(len(size)), size)
    spread = C.mix(grams ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)
    out_of = np.minimum(k, left_out)  # equal sets only: one signature of the whole set
    need = k // (left_out + 1)
    more = np.minimum(2, k // 10) if percent >= PERCENT else 3 * need // 20 + np.minimum(5, k // 4)
    n1 = np.where(out_of > 0, need + 1 + more, 1)
    cells = n1 * parts
    base = np.concatenate(([0], np.cumsum(cells)))
    part = (spread * cells[row].astype(np.uint64)) >> np.uint64(31)
    cell = base[row] + part.astype(np.int64)
    sums = np.zeros(base[-1], np.uint64)
    np.add.at(sums, cell, C.mix(grams))
    owner = np.repeat(np.arange(len(size)), cells)
    place = np.arange(base[-1]) - base[owner]
    filled = np.bincount(cell, minlength=base[-1]) > 0
    sums, filled = sums.reshape(-1, parts), filled.reshape(-1, parts)
    owner, place = owner[::parts], place[::parts] // parts
    tag = C.mix(band[owner].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
    whole = out_of[owner] == 0
    solid = np.ones(len(owner), bool)
    for number, chosen in enumerate(combinations(range(parts), parts - left_out)):
        some = filled[:, chosen].any(1)
        solid &= some
        s = C.mix(tag + np.uint64(number))
        for c in chosen:
            s = C.fold(s, sums[:, c])
        rows.append(owner[some & ~whole])
        out.append(s[some & ~whole])
    all_of = C.fold(tag, sums.sum(1))
    rows.append(owner[whole])
    out.append(all_of[whole])
    # At most `need` first-level parts differ in more than left_out elements. If more than that have no empty
    # choice, one of those agrees in a choice that says something, for this set and any that it links with.
    bare = (out_of > 0) & (np.bincount(owner[solid], minlength=len(size)) <= need)
    rows.append(np.flatnonzero(bare))
    out.append(C.mix(band[bare].astype(np.uint64) + np.uint64(0xABCD << 40)))
    return np.concatenate(rows), np.concatenate(out)


def most(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """In how many elements linked sets of these sizes may differ."""
    both = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * both


def _numbered(docs: DataFrame, id_col: str, text_col: str, size: int, carry: list[str]) -> DataFrame:
    """_j_row, a number for each row of docs; _j_id, _j_text; the set's name _j_s, _j_t, size _j_n and bitmap _j_bits."""
    source = docs.select(F.monotonically_increasing_id().alias("_j_row"), F.col(id_col).cast("long").alias("_j_id"), F.col(text_col).alias("_j_text"), F.coalesce(F.col(text_col), F.lit("")).alias("_s_text"), *carry)

    def describe(batch):
        grams, at = shingle_sets(batch.column("_s_text"), size)
        s, t = names(grams, at)
        found = [pa.array(s), pa.array(t), pa.array(np.diff(at)), pa.array(bitmaps(grams, at), pa.binary())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_j_row", "_j_id", "_j_text", *carry)], *found], ["_j_row", "_j_id", "_j_text", *carry, "_j_s", "_j_t", "_j_n", "_j_bits"])

    kinds = dict(docs.dtypes)
    carried = "".join(f"`{c}` {kinds[c]}, " for c in carry)
    return C.table(C.map_texts(source, describe, f"_j_row long, _j_id long, _j_text string, {carried}_j_s long, _j_t long, _j_n long, _j_bits binary"))


def _met(rows: DataFrame, total: int, size: int, percent: int) -> DataFrame:
    """(sig, node, rep): the sets that share a signature with others, each by its least row, and the least of them all.

    Signatures are moved packed: 4 bytes and a place in the list of sets of the slice that they come from.
    """
    parts = PARTS if percent >= PERCENT else WIDE
    a_shingle = 3.5 * parts * (100 - percent) / (100 + percent)
    n = int(total * a_shingle) // MET + 1

    def pack(whole):
        for first in range(0, whole.num_rows, 1 << 16):
            batch = whole.slice(first, 1 << 16)
            grams, at = shingle_sets(batch.column("_s_text"), size)
            row, sig = signatures(grams, at, percent)
            name, ids = names(grams, at)[0], np.array(batch.column("_j_row"), np.int64)
            p = (sig >> np.uint64(32)) % np.uint64(n)
            by = np.lexsort((row, p, ids[row] >> 32))
            p, sig, row = p[by], sig[by], row[by]
            high = ids[row] >> 32
            new = np.append(True, (p[1:] != p[:-1]) | (high[1:] != high[:-1])) if len(p) else np.zeros(0, bool)
            cut = np.flatnonzero(new).tolist() + [len(p)]
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                who, at_who = np.unique(row[a:b], return_inverse=True)
                out.append((int(p[a]), int(high[a]), sig[a:b].astype(np.uint32).tobytes(), at_who.astype(np.uint16).tobytes(), ids[who].astype(np.uint32).tobytes(), name[who].tobytes()))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], ["p", "high", "sigs", "at", "who", "names"])

    def shared(p, blobs):
        sig = np.concatenate([np.frombuffer(x[0], np.uint32) for x in blobs])
        place = [np.frombuffer(x[1], np.uint16) for x in blobs]
        by = np.argsort(sig, kind="stable")
        same = sig[by[1:]] == sig[by[:-1]]
        keep = by[np.append(False, same) | np.append(same, False)] if len(by) else by
        node = np.concatenate([np.frombuffer(x[2], np.uint32)[k].astype(np.int64) | x[4] << 32 for x, k in zip(blobs, place, strict=True)])[keep]
        name = np.concatenate([np.frombuffer(x[3], np.int64)[k] for x, k in zip(blobs, place, strict=True)])[keep]
        sig = sig[keep]
        by = np.lexsort((node, name, sig))
        sig, name, node = sig[by], name[by], node[by]
        new = np.append(True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])) if len(sig) else np.zeros(0, bool)
        sig, node = sig[new], node[new]  # copies of a set go by the least of their rows
        begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
        times = np.diff(np.append(begin, len(sig)))
        rep = np.repeat(np.minimum.reduceat(node, begin), times) if len(begin) else node
        on = np.repeat(times > 1, times)
        sig = (np.int64(p) << 32 | sig.astype(np.int64))[on]
        for a in range(0, len(sig), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (sig, node[on], rep[on])], ["sig", "node", "rep"])

    def meet(batches):
        def blobs():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("p", "sigs", "at", "who", "names", "high")), strict=True)

        for p, members in groupby(blobs(), lambda r: r[0]):
            yield from shared(p, [m[1:] for m in members])
        C.tidy()

    packed = C.map_texts(rows.select("_j_row", F.coalesce("_j_text", F.lit("")).alias("_s_text")), pack, "p long, high long, sigs binary, at binary, who binary, names binary")
    return C.table(packed.repartition(n, "p").sortWithinPartitions("p").mapInArrow(meet, "sig long, node long, rep long"))


def _other(column: str):
    """The key under another value: the join then exchanges both sides, and Spark can split a hot key."""
    return F.col(column).bitwiseXOR(F.lit(1))


def _verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) that link. The rows of one u are dealt to tasks by CHUNK; each task has u's text
    once and takes one row after the other."""
    times = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("nc")).select(_other("u").alias("u2"), "nc")
    dealt = C.table(pairs.join(times, _other("u") == F.col("u2")).select("u", "v", F.pmod(F.xxhash64("v"), F.col("nc")).cast("int").alias("c")))
    places = dealt.select("u", "c", F.lit(1).alias("role"), F.col("v").alias("node")).unionByName(dealt.select("u", "c").distinct().select("u", "c", F.lit(0).alias("role"), F.col("u").alias("node")))
    texts = rows.select(_other("_j_row").alias("row2"), F.coalesce("_j_text", F.lit("")).alias("_s_text"))
    wanted = places.hint("merge").join(texts, _other("node") == F.col("row2")).select("u", "c", "role", "node", "_s_text")

    def check(batches):
        held, left = None, None
        for whole in batches:
            for batch in C.slices(whole, "_s_text"):
                grams, at = shingle_sets(batch.column("_s_text"), size)
                us, vs = [], []
                for i, (u, role, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("u", "role", "node")), strict=True)):
                    mine = grams[at[i] : at[i + 1]]
                    if role == 0:
                        held, left = u, mine
                        continue
                    if held != u:
                        raise ValueError("a row without the set that it is compared with")
                    small, large = (mine, left) if len(mine) < len(left) else (left, mine)
                    k = np.searchsorted(large, small)
                    both = int((large[np.minimum(k, len(large) - 1)] == small).sum()) if len(small) else 0
                    if both and 100 * both >= percent * (len(mine) + len(left) - both):
                        us.append(u)
                        vs.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                left = None if left is None else left.copy()  # the slice's arrays may go
        C.tidy()

    C.small_batches(pairs.sparkSession)
    found = C.table(wanted.repartition("u", "c").sortWithinPartitions("u", "c", "role").mapInArrow(check, "u long, v long"))
    C.drop(dealt)
    return found


def _placed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, node, comp): the sets of each signature with their components."""
    of = roots.select(_other("node").alias("node2"), "root")
    return C.table(shared.join(of, _other("node") == F.col("node2"), "left").select("sig", "node", F.coalesce("root", "node").alias("comp")))


def _across(shared: DataFrame, roots: DataFrame, rows: DataFrame, percent: int, joining: bool) -> DataFrame:
    """(u, v, sig): pairs of sets that share a signature, are in different components of `roots` and whose bitmaps leave a
    link possible. All of them, or of each signature (block by block) only `joining` ones."""
    placed = _placed(shared, roots)
    several = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb")).filter("lo < hi")
    open_ = placed.join(several.select(_other("sig").alias("sig2"), "nb"), _other("sig") == F.col("sig2")).select("sig", "node", "comp", "nb")
    bits = rows.select(_other("_j_row").alias("row2"), F.col("_j_n").alias("n"), F.col("_j_bits").alias("bits"))
    open_ = open_.join(bits, _other("node") == F.col("row2")).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    tiles = open_.select("sig", "node", "comp", "n", "bits", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    tiles = tiles.select("sig", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", "comp", "n", "bits")

    def compare(batches):
        def members():
            for x in batches:
                yield from zip(*(x.column(c).to_pylist() for c in ("sig", "i", "j", "b", "node", "comp", "n", "bits")), strict=True)

        for (sig, i, j), group in groupby(members(), lambda r: r[:3]):
            group = list(group)
            for found in possible([g for g in group if g[3] == i], [g for g in group if g[3] == j], i == j, percent, joining):
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array([sig] * found.num_rows, pa.int64())], ["u", "v", "sig"])
        C.tidy()

    found = C.table(tiles.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(compare, "u long, v long, sig long"))
    C.drop(placed)
    return found


def possible(left: list, right: list, same: bool, percent: int, joining: bool = False):
    """Batches of pairs (u < v) across components whose bitmaps leave a link possible. Rows end with node, comp, n, bits.

    With `joining` only as many as join all components that any of the pairs do: a tree over components, found from the
    least on, so signatures with much the same sets give much the same pairs.
    """
    if not left or not right:
        return
    width = min(len(r[-1]) for r in (*left, *right))

    def arrays(rows):
        if joining:
            rows = sorted(rows, key=lambda r: r[-4])
        node, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (-4, -3, -2))
        bits = np.zeros((len(rows), width // 8), np.uint64)
        for k, r in enumerate(rows):  # a wider bitmap is folded: its halves, laid over each other, are the narrower one
            bits[k] = np.bitwise_xor.reduce(np.frombuffer(r[-1], np.uint64).reshape(-1, width // 8), axis=0)
        return node, comp, n, bits

    a, b = arrays(left), arrays(right)
    step = max(1, 2_000_000 // (len(right) * (width // 8)))
    may = np.zeros((len(left), len(right)) if joining else (0, 0), bool)
    for k in range(0, len(left), step):
        node, comp, n, bits = (x[k : k + step] for x in a)
        apart = np.bitwise_count(bits[:, None, :] ^ b[3][None, :, :]).sum(2, dtype=np.int64)
        ok = (apart <= most(n[:, None], b[2][None, :], percent)) & (comp[:, None] != b[1][None, :])
        if joining:
            may[k : k + step] = ok
            continue
        if same:
            ok &= node[:, None] < b[0][None, :]
        x, y = np.nonzero(ok)
        if len(x):
            yield _pairs(node[x], b[0][y])
    if joining and may.any():
        x, y = _tree(may, a[1], b[1])
        yield _pairs(a[0][x], b[0][y])


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def _tree(may: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) in `may` of pairs that join all components (of its rows: left, of its columns: right) that its pairs
    join, one fewer for each group so joined than it has components."""
    comps, of = np.unique(np.concatenate((left, right)), return_inverse=True)
    sides = [(may, of[: len(left)], of[len(left) :]), (may.T, of[len(left) :], of[: len(left)])]
    by = [np.argsort(rows, kind="stable") for _, rows, _ in sides]
    ends = [np.searchsorted(rows[k], np.arange(len(comps) + 1)) for k, (_, rows, _) in zip(by, sides, strict=True)]
    seen, out = np.zeros(len(comps), bool), [[], []]
    for first in range(len(comps)):
        if seen[first]:
            continue
        seen[first], reached = True, [first]
        for c in reached:
            for side, (ok, _, to) in enumerate(sides):
                for x in by[side][ends[side][c] : ends[side][c + 1]].tolist():
                    hits = np.flatnonzero(ok[x] & ~seen[to])
                    if len(hits):
                        new, at = np.unique(to[hits], return_index=True)
                        seen[new] = True
                        reached += new.tolist()
                        out[side].append(np.full(len(new), x))
                        out[1 - side].append(hits[at])
    # Each side's list has, in one order, the row and the column of every pair.
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _linked(shared: DataFrame, links: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that join all sets which links of any kind join, given the first of them: (node, root) of components."""
    roots, tried, joining, turn = components(links), None, True, 1
    while not (found := _across(shared, roots, rows, percent, joining)).isEmpty():
        pairs = found.select("u", "v").distinct()
        pairs = C.table(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"))
        again = _verified(pairs, rows, size, percent)
        grown = not again.isEmpty()
        if grown:
            links = links.unionByName(again)
            roots = components(links)
        if not joining:
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        # A signature without such a pair has none later on: components only grow.
        shared = shared.join(found.select(_other("sig").alias("sig2")).distinct(), _other("sig") == F.col("sig2"), "left_semi")
        joining, turn = grown and turn < ROUNDS, turn + 1
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of docs, numbered (see _numbered, with the columns `carry`), and (row, id, n, lo, best) for each: the size
    of its set, the least id of its component and the number of the component's row that has it (the first of such)."""
    rows = _numbered(docs, id_col, text_col, size, list(carry))
    info = rows.select(F.col("_j_row").alias("row"), F.col("_j_id").alias("id"), F.col("_j_s").alias("s"), F.col("_j_t").alias("t"), F.col("_j_n").alias("n"))
    total = int(info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    shared = _met(rows, total, size, percent)
    stars = shared.groupBy("node").agg(F.min("rep").alias("u")).filter("u < node").select("u", F.col("node").alias("v"))
    links = _verified(stars, rows, size, percent)
    roots = _linked(shared, links, rows, size, percent)
    C.drop(shared)
    best = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = info.filter("n > 0").groupBy("s", "t").agg(F.min("row").alias("node"), F.min(best).alias("best"))
    nodes = C.table(nodes.join(roots.select(_other("node").alias("node2"), "root"), _other("node") == F.col("node2"), "left").select("s", "t", F.coalesce("root", "node").alias("root"), "best"))
    least = nodes.groupBy("root").agg(F.min("best").alias("best")).select(_other("root").alias("root2"), "best")
    nodes = nodes.drop("best").join(least, _other("root") == F.col("root2")).select(_other("s").alias("s2"), F.col("t").alias("t2"), "best")
    out = info.join(nodes, (_other("s") == F.col("s2")) & (F.col("t") == F.col("t2")) & (F.col("n") > 0), "left")
    return rows, out.select("row", "id", "n", F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("lo"), F.coalesce("best.row", "row").alias("best"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: id, n_shingles and component_id, the least id that links lead to, its own included.

    Rows of equal sets are one node, however many. Null and empty texts have the empty set, link with nothing and
    get their own id. Ids are whole numbers; null ids are passed over when the least is taken, so it is null only
    where all are. Repeated rows are copies of each other. Other columns are not read.
    """
    _, found = classes(docs, id_col, text_col, size, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("lo").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of linked rows: that of the least id, a null id counting last, and of several such
    rows one. Rows, not ids, go and stay: a text stays whatever other rows share its id. Rows without words all stay.
    """
    rest = tuple(c for c in docs.columns if c not in (text_col,))
    rows, found = classes(docs.select(text_col, *rest), id_col, text_col, size, percent, rest)
    gone = found.filter("row <> best").select(_other("row").alias("row2"))
    kept = rows.join(gone.hint("merge"), _other("_j_row") == F.col("row2"), "left_anti")
    return kept.withColumnRenamed("_j_text", text_col).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that link at 90 percent of their three-word shingles, by component: doc_id, n_shingles, component_id."""
    return jaccard_components(C.read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w, ' ') AS g FROM w WHERE len(w) BETWEEN 1 AND 2
      UNION SELECT doc_id, array_to_string(w[i:i + 2], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON c.doc_id = e.a WHERE c.root < e.b)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id FROM c LEFT JOIN n ON c.doc_id = n.doc_id GROUP BY ALL
"""
