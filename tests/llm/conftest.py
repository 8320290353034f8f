import random

import pytest

#: Columns whose names operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, c string, id string, v int, n int, key string, size int, row int"


def rows(texts):
    return [(i, t, lang, source, len(t or ""), 1, "c", "id", 2, 3, "key", 4, 5) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def cases():
    """Ids and texts with nulls, empty, very long, equal and nearly equal texts, ties and repeated rows."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["ba", "ne", "ti", "Ro", "é", "ß", "x1", "日本", "🙂"]) for _ in range(rnd.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(300), prose(90)
    near = base.split()
    near[150] = "changed"
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "de", "b"), (3, " ".join(near), "de", "b"),
        (4, None, None, None), (5, "", "en", "b"), (6, " \t\n", "fr", "b"), (7, "one", "en", "a"), (8, "One", "en", None), (9, "two words", "en", "a"),
        (10, prose(80) + "\n" + passage + "  " + prose(60), "en", "a"), (11, prose(20) + " " + passage + " " + prose(200), "es", "c"), (12, passage, "es", "c"),
        (13, "x" * 30_000, "en", "a"), (14, "ab " * 9_000, "en", "a"), (15, prose(6_000), "en", "b"), (16, "l\nl\nm\n\n l\nm", None, "c"),
        (None, prose(120), "en", "a"), (None, base, "en", "b"), (None, None, None, None), (17, "<|endoftext|> a<|endoftext|>", "en", "c"), (18, "\x00\x1f　 x \xa0y", "en", "c"),
    ]
    return out + [(100 + i, prose(rnd.randint(1, 200)), "en", rnd.choice("abc")) for i in range(30)]


@pytest.fixture(scope="session")
def docs(spark, cases):
    return spark.createDataFrame(rows(cases), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def as_docs(spark):
    """A table of documents from rows like those of `cases`."""
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
