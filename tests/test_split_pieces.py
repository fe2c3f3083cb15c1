"""Texts are split into pieces over the flat characters of a batch, with the pieces of the SQL patterns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.functions.masks import hash32
from spanweave.operators import vocab as V

ALPHABET = ["a", "B", "Σ", "é", "é", "’", "'", ",", "▁", "‍", "", " ", "  ", "\n", "\x01", "\xa0", "　", "—", "$", "€", "9", "_", "\U0001F600",
            "字", "͸", "-", "\0", "\U0001D400"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = [None, "", " ", "▁", "", "‍foo", " ‍foo,bar", None, ""]
    return odd + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(500)] + ["", None]


@pytest.fixture(scope="module")
def want(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["p"] for r in d.select("i", V.pieces("text").alias("p")).orderBy("i").collect()]


@pytest.mark.parametrize("block", [1, 9, 400, 1 << 20])
def test_pieces_of_texts_in_blocks(spark, monkeypatch, texts, want, block):
    monkeypatch.setattr(V, "SPLIT_BLOCK", block)
    kinds = V.character_kinds(spark)
    for lo in (0, 1, 4):   # slices have an offset
        items, cut, nulls = V.split_pieces(pa.array(texts).slice(lo), kinds)
        items = items.to_pylist()
        assert [None if n else items[a:b] for a, b, n in zip(cut[:-1], cut[1:], nulls.to_pylist())] == want[lo:]


@pytest.mark.parametrize("texts_", [[], [None], ["", ""], [" \n "]])
def test_nothing_to_split(spark, texts_):
    items, cut, nulls = V.split_pieces(pa.array(texts_, pa.string()), V.character_kinds(spark))
    assert len(items) == 0 and cut.tolist() == [0] * (len(texts_) + 1) and nulls.to_pylist() == [t is None for t in texts_]


def test_bytes_that_are_no_characters(spark):
    d = spark.sql("SELECT cast(X'61FF20C328' AS string) AS text")
    want = d.select(V.pieces("text").alias("p")).first()["p"]
    raw = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, 5], np.int32).tobytes()), pa.py_buffer(b"a\xff \xc3("))
    assert V.split_pieces(raw, V.character_kinds(spark))[0].to_pylist() == want


def test_encoding_splits_no_text_by_patterns(spark):
    """The patterns took most of the time of the vocabulary and of encoding; ids are as before."""
    d = spark.createDataFrame([("a, b ab", 1), (None, 2), ("", 3)], "text string, k int")
    vocab = V.build_vocab(d, "text", subwords=["ab"])
    by_pieces = {r["k"]: r["x"] for r in d.select("k", V.piece_ids(vocab)(V.pieces("text")).alias("x")).collect()}
    ids = V.encode_ids(d, "text", vocab, add_eos=False)
    chunks = V.encode(d, "text", vocab, 8)
    for plan in (ids, chunks):
        assert "regexp_extract" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k"]: r["ids"] for r in ids.collect()} == by_pieces
    held = {r["piece"]: r["count"] for r in vocab.where("count > 0").collect()}
    assert held["▁b"] == 1 and held["▁ab"] == 1


def test_hashes_of_places():
    from hashlib import md5
    assert hash32(42, "k", [b"1", b"22"]).tolist() == [int(md5(b"42:k:" + p).hexdigest()[:8], 16) for p in (b"1", b"22")]
