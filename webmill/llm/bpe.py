"""Byte-level BPE from a public vocabulary file: operators 1 (token counts) and 2 (encoding and decoding).

Texts are split into pre-tokens by the vocabulary's own pattern, and each distinct pre-token of a worker is
worked out once, for whole batches at a time in numpy. Both operators are maps over documents: no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from webmill.llm import common as C

#: Pre-tokens that a worker remembers; beyond it starts anew. It bounds memory and changes no result.
REMEMBERED = 200_000
#: Pre-tokens of more bytes than this go through the scalar form of the same dynamic program.
PADDED = 48
#: Pre-tokens of more bytes than this are counted one by one, each rank going to its own places instead of to all.
LONG = 1_000
#: The pattern of this vocabulary's pre-tokenizer (a fixed value), with white space written out as Unicode has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Ids, merges and special strings of a byte-level BPE vocabulary in which a token's id orders its merge."""

    def __init__(self, path: str):
        data = json.loads(open(path, encoding="utf-8").read())
        self.pattern = regex.compile(PATTERN)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(visible))}
        ids = data["model"]["vocab"]
        size = max([*ids.values(), *(t["id"] for t in data["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.text_of = [str(i) for i in range(size)]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in pairs], np.int64) for k in (0, 1))
        made = np.array([ids["".join(m)] for m in pairs], np.int64)
        if (np.diff(made) <= 0).any() or made[0] <= self.byte_id.max():
            raise ValueError("ids must follow the order of merges")
        self.first_merged = int(made[0])
        self.left, self.right = (np.arange(size, dtype=np.int64) for _ in range(2))
        self.left[made], self.right[made] = left, right
        # Pairs in an open hash table: lookups touch one or two entries.
        self.bits = np.uint64(18)
        self.keys = np.full(1 << 18, -1, np.int64)
        self.made = np.full(1 << 18, size, np.int64)
        todo = np.arange(len(made))
        slot = self._slot(left << 32 | right)
        key = left << 32 | right
        while len(todo):
            free = self.keys[slot[todo]] < 0
            cand = todo[free]
            _, one = np.unique(slot[cand], return_index=True)
            put = cand[one]
            self.keys[slot[put]], self.made[slot[put]] = key[put], made[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            taken = self.keys[slot[todo]] != key[todo]
            slot[todo[taken]] = (slot[todo[taken]] + 1) & (len(self.keys) - 1)
        self.none = size
        self._goto = None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or `none`."""
        key = a << 32 | b
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.made[slot], self.none)
        look = np.flatnonzero((got != key) & (got >= 0))
        while len(look):
            slot[look] = (slot[look] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[look]]
            hit = got == key[look]
            out[look[hit]] = self.made[slot[look[hit]]]
            look = look[~hit & (got >= 0)]
        return out

    # -- operator 1 ------------------------------------------------------------------------------------------

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece when in every round each piece merges its lowest-ranked pair, everywhere at once.

        The pieces lie in one ragged array. A piece without a pair to merge leaves it with its count. Long pieces, which
        have very many ranks, are merged by count_long().
        """
        out = np.zeros(len(pieces), np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(size > LONG).tolist():
            out[i], size[i] = self.count_long(pieces[i]), 0
        who = np.flatnonzero(size)
        symbols = self.byte_id[np.frombuffer(b"".join([pieces[i] for i in who.tolist()]), np.uint8)]
        owner = np.repeat(who, size[who])
        while len(symbols):
            same = owner[1:] == owner[:-1]
            pair = np.full(len(symbols), self.none, np.int64)
            at = np.flatnonzero(same)
            pair[at] = self.merged(symbols[at], symbols[at + 1])
            begin = np.flatnonzero(np.concatenate(([True], ~same)))
            length = np.diff(np.append(begin, len(symbols)))
            least = np.minimum.reduceat(pair, begin)
            out[owner[begin]] = length
            live = np.repeat(least < self.none, length)
            take = live & (pair == np.repeat(least, length))
            run = np.flatnonzero(take[1:] & take[:-1]) + 1
            if len(run):  # a symbol can't be in two merges: of pairs that overlap, every other one counts
                begins = np.concatenate(([True], np.diff(run) > 1))
                first = np.maximum.accumulate(np.where(begins, np.arange(len(run)), 0))
                take[run[(np.arange(len(run)) - first) % 2 == 0]] = False
            symbols = np.where(take, pair, symbols)
            keep = live
            keep[1:] &= ~take[:-1]
            symbols, owner = symbols[keep], owner[keep]
        return out

    def count_long(self, piece: bytes) -> int:
        """Symbols left of one piece, by the same rounds: ranks in their order, each merged at all its places at once.

        Places are kept by rank. A round looks at the places of its rank alone, and afterwards ranks the pairs anew that
        it has touched; a pair with a merged symbol always ranks later than that. So each rank has one round, and all
        rounds together look at a few places for each merge, however long the piece is.
        """
        n = len(piece)
        symbol = self.byte_id[np.frombuffer(piece, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.merged(symbol[:-1], symbol[1:]), self.none)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            """Puts places under their ranks."""
            at = at[rank[at] < self.none]
            at = at[np.argsort(rank[at], kind="stable")]
            cut = [0, *(np.flatnonzero(np.diff(rank[at])) + 1).tolist(), len(at)]
            for r, i, j in zip(rank[at[cut[:-1]]].tolist() if len(at) else (), cut, cut[1:], strict=False):
                if r in places:
                    places[r].append(at[i:j])
                else:
                    places[r] = [at[i:j]]
                    heapq.heappush(ranks, r)

        note(np.arange(n - 1))
        left = n
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]  # others have been merged or touched since
            run = np.flatnonzero(after[at[:-1]] == at[1:]) + 1
            if len(run):  # a symbol can't be in two merges: of pairs that overlap, every other one counts
                begins = np.concatenate(([True], np.diff(run) > 1))
                first = np.maximum.accumulate(np.where(begins, np.arange(len(run)), 0))
                at = np.delete(at, run[(np.arange(len(run)) - first) % 2 == 0])
            if not len(at):
                continue
            gone = after[at]
            symbol[at], rank[gone], after[at] = r, self.none, after[gone]
            left -= len(at)
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            touched = np.unique(np.concatenate((at, before[at][before[at] >= 0])))
            rank[touched] = self.none
            touched = touched[after[touched] < n]
            rank[touched] = self.merged(symbol[touched], symbol[after[touched]])
            note(touched)
        return left

    # -- operator 2 ------------------------------------------------------------------------------------------

    def automaton(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Transitions by byte, each state's longest token that ends there, each token's next shorter one, and lengths."""
        if self._goto is None:
            tokens = [(t, i) for i, t in enumerate(self.bytes_of) if t and i < self.none and self.text_of[i] and i not in self.special.values()]
            nodes: dict[tuple[int, int], int] = {}
            depth, parent, by, token_at = [0], [0], [0], {}
            for t, i in tokens:
                s = 0
                for b in t:
                    k = nodes.get((s, b))
                    if k is None:
                        k = nodes[(s, b)] = len(depth)
                        depth.append(depth[s] + 1)
                        parent.append(s)
                        by.append(b)
                    s = k
                token_at[s] = i
            depth, parent, by = np.array(depth), np.array(parent), np.array(by)
            goto = np.zeros((len(depth), 256), np.int32)
            fail = np.zeros(len(depth), np.int64)
            own = np.full(len(depth), -1, np.int64)
            own[list(token_at)] = list(token_at.values())
            longest = own.copy()
            shorter = np.full(len(self.bytes_of), -1, np.int64)
            # A state's missing transitions are those of its failure state, which is less deep.
            at = np.flatnonzero(depth == 1)
            goto[0, by[at]] = at
            for d in range(1, int(depth.max()) + 1):
                at = np.flatnonzero(depth == d)
                if d > 1:
                    fail[at] = goto[fail[parent[at]], by[at]]
                ends = own[at] >= 0
                shorter[own[at[ends]]] = longest[fail[at[ends]]]
                longest[at[~ends]] = longest[fail[at[~ends]]]
                goto[at] = goto[fail[at]]
                below = np.flatnonzero(depth == d + 1)
                # children of this depth; their parents' rows were just filled
                goto[parent[below], by[below]] = below
            lengths = np.array([len(t) for t in self.bytes_of], np.int64)
            self._goto = goto, longest, shorter, lengths
        return self._goto

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the two tokens' joined bytes gives just these two.

        The tokens are taken apart again at their common border, latest merge first. They are compatible unless
        two symbols that touched there would have merged before one of them merged within its own token; at the
        same rank the left one goes first.
        """
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until = np.full(len(a), self.none, np.int64)
        while len(at):
            bad = self.merged(a, b) < until
            out[at[bad]] = False
            of_left = a > b
            on = ~bad & (np.maximum(a, b) >= self.first_merged)
            at, a, b, of_left = at[on], a[on], b[on], of_left[on]
            until = np.where(of_left, a, b + 1)
            a, b = np.where(of_left, self.right[a], a), np.where(of_left, b, self.left[b])
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: for every prefix the one last token it can have, then back from the end."""
        out: list[list[int]] = [[] for _ in pieces]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for k in np.flatnonzero(size > PADDED):
            out[k] = self._encode_long(pieces[k])
        order = np.flatnonzero((size > 0) & (size <= PADDED))
        order = order[np.argsort(-size[order], kind="stable")]
        if not len(order):
            return out
        goto, longest, shorter, length = self.automaton()
        size = size[order]
        text = np.zeros((len(order), int(size[0])), np.uint8)
        text[np.arange(text.shape[1]) < size[:, None]] = np.frombuffer(b"".join(pieces[k] for k in order), np.uint8)
        last = np.zeros((len(order), text.shape[1] + 1), np.int64)
        state = np.zeros(len(order), np.int64)
        for i in range(1, text.shape[1] + 1):
            n = int(np.searchsorted(-size, -i, "right"))
            state = goto[state[:n], text[:n, i - 1]].astype(np.int64)
            token = longest[state]
            at = np.arange(n)
            while len(at):
                t = token[at]
                start = i - length[t]
                ok = start == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.compatible(last[at[inner], start[inner]], t[inner])
                last[at[ok], i] = t[ok]
                at = at[~ok]
                token[at] = shorter[token[at]]
        # Back-pointers, for all pieces at once.
        at, end = np.arange(len(order)), size.copy()
        who, ids = [], []
        while len(at):
            t = last[at, end]
            who.append(at)
            ids.append(t)
            end = end - length[t]
            on = end > 0
            at, end = at[on], end[on]
        who, ids = np.concatenate(who)[::-1], np.concatenate(ids)[::-1]
        by = np.argsort(who, kind="stable")
        who, ids = who[by], ids[by].tolist()
        cut = np.searchsorted(who, np.arange(len(order) + 1)).tolist()
        for k, i, j in zip(order.tolist(), cut[:-1], cut[1:], strict=True):
            out[k] = ids[i:j]
        return out

    def _encode_long(self, piece: bytes) -> list[int]:
        goto, longest, shorter, length = self.automaton()
        fits: dict[tuple[int, int], bool] = {}
        last, state = [0], 0
        for i, b in enumerate(piece, 1):
            state = int(goto[state, b])
            t = int(longest[state])
            while (start := i - int(length[t])) > 0:
                pair = (last[start], t)
                if pair not in fits:
                    fits[pair] = bool(self.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
                if fits[pair]:
                    break
                t = int(shorter[t])
            last.append(t)
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= int(length[last[end]])
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def split(self, text: str) -> list[str]:
        """Pre-tokens and special strings, in order."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        parts = self.specials.split(text)
        return list(chain.from_iterable([p] if k % 2 else self.pattern.findall(p) for k, p in enumerate(parts)))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_known: dict[tuple[str, str], dict] = {}


def _forget(path: str) -> None:
    """At the end of a task the worker keeps the vocabulary, but neither pre-tokens nor the automaton."""
    _known.clear()
    vocabulary(path)._goto = None
    C.tidy()


def _learn(path: str, what: str, lists: list[list[str]], work) -> dict:
    """What the worker knows of pre-tokens, with those of these texts added."""
    known, v = _known.setdefault((path, what), {}), vocabulary(path)
    new = set(chain.from_iterable(lists)).difference(known)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = set(chain.from_iterable(lists))
    if new:
        new = list(new)
        for i in range(0, len(new), 100_000):
            part = new[i : i + 100_000]
            known.update(zip(part, work([x.encode() for x in part]), strict=True))
        for text, i in v.special.items():
            known[text] = 1 if what == "count" else (i,)
    return known


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and tokens. Rows are independent: repeated rows and null ids give rows of
    their own, an empty table an empty one; other columns are not read.
    """

    def work(batches):
        v = vocabulary(path)
        for whole in batches:
            for batch in C.slices(whole, "t"):
                texts = [x or "" for x in batch.column("t").to_pylist()]
                lists = [v.split(x) for x in texts]
                known = _learn(path, "count", lists, lambda p: v.count(p).tolist())
                n = [sum(map(known.__getitem__, x)) for x in lists]
                size = np.diff(C.text_arrays(batch.column("t"))[1])
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(n, np.int64) > limit)], ["i", "n_bytes", "n_tokens", "over_limit"])
        _forget(path)

    C.small_batches(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]
    got = docs.selectExpr(f"`{id_col}` AS i", f"`{text_col}` AS t").mapInArrow(work, f"i {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return got.withColumnRenamed("i", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row of docs: id, ids (array of token ids), decoded text; or, with digests, their count and SHA-256.

    A null or empty text has no ids and decodes to an empty text. Rows are independent, as in token_counts.
    """

    def work(batches):
        v = vocabulary(path)
        for whole in batches:
            for batch in C.slices(whole, "t"):
                lists = [v.split(x or "") for x in batch.column("t").to_pylist()]
                known = _learn(path, "ids", lists, lambda p: map(tuple, v.encode(p)))
                ids = [list(chain.from_iterable(map(known.__getitem__, x))) for x in lists]
                decoded = [v.decode(x) for x in ids]
                if digests:
                    text = v.text_of.__getitem__
                    cols = [
                        pa.array(list(map(len, ids)), pa.int64()),
                        pa.array([hashlib.sha256(",".join(map(text, x)).encode()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays([batch.column("i"), *cols], ["i", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["i", "ids", "decoded"])
        _forget(path)

    C.small_batches(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.selectExpr(f"`{id_col}` AS i", f"`{text_col}` AS t").mapInArrow(work, f"i {kind}, {schema}").withColumnRenamed("i", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token counts: doc_id, n_bytes, n_tokens, over_limit. A null text is an empty one."""
    return token_counts(C.read(spark, sf_dir, "documents"), vocabulary_path())


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token ids and what they decode to, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(C.read(spark, sf_dir, "documents"), vocabulary_path(), digests=True)
