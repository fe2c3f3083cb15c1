"""Vocabulary with byte fallback, spelling and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.constants import PIECE_PATTERN, UNK_ID, WORD_MARK
from spanweave.functions.rank import group_dense_index
from spanweave.operators.vocab import (FIRST_PIECE, N_SPECIAL, byte_piece, build_vocab, decode, encode, encode_ids, encode_labels,
                                       read_subwords, spell)


def texts_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def piece_list(text):
    import regex
    return [(WORD_MARK if m[1] else "") + m[2] for m in regex.finditer(PIECE_PATTERN, " " + text)]


def test_alphabet_larger_than_the_vocabulary(spark):
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 2000)] + list("abcdefgh")
    texts = ["".join(rng.choice(alphabet) for _ in range(40)) + " the cat the dog" for _ in range(200)] + ["😀 ünï"]
    size = 500
    vocab = build_vocab(texts_frame(spark, texts), size=size, subwords=[])
    rows = vocab.collect()
    assert len(rows) == size and sorted(r["id"] for r in rows) == list(range(size))
    held = {r["piece"]: r["id"] for r in rows}
    assert [held[byte_piece(b)] for b in range(256)] == list(range(N_SPECIAL, FIRST_PIECE))
    assert {f"{WORD_MARK}the", f"{WORD_MARK}cat"} <= set(held)
    got = encode_ids(texts_frame(spark, texts), "text", vocab, add_eos=False, size=size).collect()
    text_ids = {p: i for p, i in held.items() if i >= FIRST_PIECE and i < size - 100}
    by_id = {i: p.encode() for p, i in text_ids.items()} | {N_SPECIAL + b: bytes([b]) for b in range(256)}
    for r in got:
        assert UNK_ID not in r["ids"] and all(N_SPECIAL <= i < size - 100 for i in r["ids"])
        assert b"".join(by_id[i] for i in r["ids"]).decode() == "".join(piece_list(r["text"]))
        assert r["ids"] == [i for p in piece_list(r["text"]) for i in spell(p, text_ids)]


def test_least_vocabulary_has_bytes_only(spark):
    df = texts_frame(spark, ["naïve 日本 text"])
    vocab = build_vocab(df, size=359)
    assert vocab.count() == 359
    assert UNK_ID not in encode_ids(df, "text", vocab, add_eos=False, size=359).first()["ids"]
    with pytest.raises(ValueError):
        build_vocab(df, size=358)


def test_frequent_pieces_fill_the_vocabulary_exactly(spark):
    """The histogram of counts leaves no piece out: the same table as a plain sort."""
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.8)) % 5000}" for _ in range(20000)]
    df = texts_frame(spark, [" ".join(words[k:k + 50]) for k in range(0, len(words), 50)])
    from collections import Counter
    counts = Counter(f"{WORD_MARK}{w}" for w in words)
    room = 700 - 100 - FIRST_PIECE
    letters = min(room // 8, len({c for w in counts for c in w}))
    want = sorted(counts, key=lambda p: (-counts[p], p))[:room - letters]
    got = [r["piece"] for r in build_vocab(df, size=700, subwords=[]).where("length(piece) > 1").orderBy("id").collect()]
    assert got[3 + 256:-100] == want


def test_round_trip_of_any_unicode(spark):
    hard = ["日本語 テキスト", "😀👩‍👩‍👧 ok", "naïve café", "a" * 1000, "Ω≈ç√∫˜µ≤≥÷", "tab\tand\nline", "", None, "<0x41> </s> <pad>"]
    vocab = build_vocab(texts_frame(spark, ["plain words only"]))
    df = texts_frame(spark, hard)
    got = {r["doc_id"]: r["back"] for r in decode(encode_ids(df, "text", vocab), "ids", vocab, "back").collect()}
    for k, text in enumerate(hard):
        assert got[k] == (None if text is None else "".join(piece_list(text)).replace(WORD_MARK, " ").strip(" "))


def test_character_cut_between_rows_is_replaced(spark):
    vocab = build_vocab(texts_frame(spark, ["x"]), subwords=[])
    rows = encode(texts_frame(spark, ["日本"]), "text", vocab, 4)
    assert rows.count() >= 2 and decode(rows, "input_ids", vocab, "back").count() == rows.count()


def test_subwords_come_from_the_public_file():
    subwords = read_subwords(n=100)
    assert len(subwords) == len(set(subwords)) == 100 and "a" in subwords
    assert read_subwords(n=3000)[:100] == subwords and any(w.startswith(WORD_MARK) and len(w) > 3 for w in read_subwords(n=3000))


def test_long_labels_are_refused_not_cut(spark):
    vocab = build_vocab(texts_frame(spark, ["x"]), subwords=[])
    df = spark.createDataFrame([("in", "Ω" * 20)], "text string, label string")
    with pytest.raises(Exception, match="does not fit"):
        encode_labels(df, "label", vocab, 16).collect()
    assert len(encode_labels(df, "label", vocab, 64).first()["labels"]) == 64
    assert encode_labels(df, "label", vocab, 16, overflow="chunk").count() == 3


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("g", 1, "c"), ("g", 5, "d")], "grp string, o int, v string")
    got = {r["v"]: r["idx"] for r in group_dense_index(df, ["grp"], ["o"], num_partitions=3).collect()}
    assert got == {"a": 0, "b": 1, "c": 0, "d": 1}


def test_packing_keeps_null_and_repeated_documents(spark):
    from spanweave.plans.catalog import PACK_RAW, pack_documents
    text = " ".join(["word"] * 200)
    rows = [(1, text), (1, text), (None, text), (None, text), (2, None), (3, text)]
    vocab = build_vocab(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), vocab)
    assert got.count() == 5 * 201 // PACK_RAW
    # the last document's end stands in the remainder of the group
    assert got.select(F.explode("input_ids").alias("i")).where("i = 1").count() == 4
