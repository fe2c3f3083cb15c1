"""Small inputs that the tests of the operators share."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
EDGE_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rk int, c string, `_rk` string, id int"


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode().translate(FOLD))]


def prose(n, seed, vocab=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocab)}x" for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    long = prose(30_000, 7, 5000)
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, long), (7, long), (None, "a lone text here"),
             (None, None), (8, "same row"), (8, "same row"), (9, "x" * 50_000), (10, "<|endoftext|> 😀 ünï")]
    return [(i, t, None, "s", None, 1, "c", "r", 2) for i, t in texts]


def edge(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
