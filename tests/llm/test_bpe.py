import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

from webmill.llm import bpe

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_strings_are_split_and_merged_as_the_library_does(library):
    v, rnd = bpe.vocabulary(PATH), random.Random(1)
    letters = [chr(c) for c in (*range(40), 0x85, 0xA0, 0x1C, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF, 0xB2, 0xBD, 0x2167, 0x4E00, 0x1F600, 0x661, 0x301, 0xE9)] + list("aaabc 's'll  \n\n12")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500, "=" * 200 + "\n" * 99, "aaa" * 33, "", "<|endoftext|>x <|endoftext|>", "<|endoftext|"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        pieces = v.split(text)
        special = [p in v.special for p in pieces]
        ids = [[v.special[p]] if s else x for p, s, x in zip(pieces, special, v.encode([p.encode() for p in pieces]), strict=True)]
        counts = [1 if s else n for s, n in zip(special, v.count([p.encode() for p in pieces]), strict=True)]
        flat = [i for x in ids for i in x]
        assert flat == want.ids and sum(counts) == len(want.ids)
        assert v.decode(flat) == library.decode(want.ids, skip_special_tokens=False) == text


def test_operators_over_edge_cases(docs, nothing, cases, library):
    want = Counter()
    for i, t, *_ in cases:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len((t or "").encode()), len(ids), len(ids) > 512] += 1
    assert Counter(map(tuple, bpe.token_counts(docs, PATH).collect())) == want
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(docs, PATH).collect())
    assert got == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, *_ in cases)
    assert bpe.token_counts(nothing, PATH).count() == bpe.encode(nothing, PATH, digests=True).count() == 0


def test_long_pieces_are_counted_as_the_library_does(library):
    v, rnd = bpe.vocabulary(PATH), random.Random(2)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (1_001, 5_000, 60_000)]
    words += ["a" * 10_001, "ab" * 4_000 + "a", "é" * 3_000, "=" * 5_000, "".join(rnd.choice("aab") for _ in range(20_000)), "the" * 3_000 + "z", "日本語" * 1_000]
    for w in words:
        assert v.count([b"", w.encode(), b"x"]).tolist() == [0, len(library.encode(w, add_special_tokens=False).ids), 1]
