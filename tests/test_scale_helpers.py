"""Helpers whose work grows with the input alone: blocks, sketches, and values that are made once a row."""

import collections
import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.functions.arrays import trim_after_eos_sql
from spanweave.functions.masks import segment_lengths, span_masks
from spanweave.operators import phrases as P, vocab as V
from spanweave.operators.corrupt import corrupt_complement


def _runs(n_items, n_segments, seed, key, tag):
    """E1 by its definition, one row."""
    rank = {i: (int(hashlib.md5(f"{seed}:{key}:{tag}:{i}".encode()).hexdigest()[:8], 16) << 20) + i for i in range(1, n_items)}
    bounds = [0, *sorted(sorted(rank, key=rank.get)[:max(n_segments - 1, 0)]), n_items]
    gaps = [b - a for a, b in zip(bounds, bounds[1:])]
    return gaps + [0] * (n_segments - len(gaps))


@pytest.mark.parametrize("n, k", [(1, 1), (2, 5), (7, 3), (109, 6), (19, 6)])
def test_runs_are_those_of_the_definition(n, k):
    keys = ["1:0", "1:1", "é:2"]
    assert segment_lengths(n, k, 42, keys, "clean").tolist() == [_runs(n, k, 42, key, "clean") for key in keys]


def test_masks_of_short_rows():
    for n in (1, 2, 3):
        assert span_masks(n, ["a", "b"], 0.15, 3.0, 42, True, True).shape == (2, n)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_lookup_in_blocks_gives_the_ids_of_every_row(block, monkeypatch):
    monkeypatch.setattr(V, "LOOKUP_BLOCK", block)
    held = {"ab": 300, "c": 301, "d": 302}
    rows = [[], None, ["ab", "cd"], [], ["x", "c", "c", "dd"], ["ab"], []]
    ids, cut, nulls = V._ids_of(pa.array(rows, pa.list_(pa.string())), held)
    got = [ids.to_pylist()[a:b] for a, b in zip(cut[:-1], cut[1:])]
    assert got == [[i for p in r or [] for i in V.spell(p, held)] for r in rows]
    assert nulls.to_pylist() == [r is None for r in rows]


def test_lookup_holds_a_block_and_no_table_of_a_whole_batch(monkeypatch):
    seen = []
    spelled = V._spelled
    monkeypatch.setattr(V, "_spelled", lambda arr, held: seen.append(len(arr)) or spelled(arr, held))
    V._ids_of(pa.array([["a"] * (V.LOOKUP_BLOCK + 5)] * 2), {"a": 300})
    assert max(seen) <= V.LOOKUP_BLOCK


def test_long_rows_take_linear_time(spark):
    """Both were quadratic in the row: the eos looked up, and the inverted mask made, for every position."""
    n = 20_000
    d = spark.range(4).select(F.col("id").cast("string").alias("k"), F.expr(f"transform(sequence(1, {n}), i -> i + 2)").alias("input_ids"))
    d.select(F.expr(trim_after_eos_sql("slice(input_ids, 1, 10)"))).collect()
    begun = time.time()
    assert d.select(F.expr(f"size({trim_after_eos_sql('input_ids')}) AS n")).distinct().collect()[0]["n"] == n
    with pytest.raises(Exception, match="expected 1 elements"):
        corrupt_complement(d, "k", 1, 1).collect()
    assert time.time() - begun < 40


def test_phrases_are_counted_exactly_when_hashes_share_bits(spark, monkeypatch):
    """With a sketch of 2^16 bits nearly all windows pass; the counts of texts still decide."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, size)) for size in (0, 1, 2, 3, 400, 900, 5)] + [None]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    want = collections.Counter()
    for t in texts:
        w = (t or "").split()
        want.update(" ".join(w[i:i + n]) for n in range(2, 6) for i in range(len(w) - n + 1))
    want = {t: c for t, c in want.items() if c >= 5}
    for bits in (16, P.SKETCH_BITS):
        monkeypatch.setattr(P, "SKETCH_BITS", bits)
        got = {r["phrase"]: r["count"] for r in P.mine_phrases(d, "text").collect()}
        assert got == want


def test_windows_of_a_level_are_shuffled_as_numbers(spark):
    """What is grouped per level is a hash and a count, however long the words are."""
    words = spark.createDataFrame([([1, 2, 3, 1, 2],), ([],)], "h array<bigint>")
    got = words.mapInArrow(P._window_counts(2, None), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).collect()
    assert sorted(r["c"] for r in got) == [1, 1, 2]
