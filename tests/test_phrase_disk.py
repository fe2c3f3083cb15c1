"""Phrases at size: matching moves no rows, mining leaves nothing behind, and the filters never decide."""

import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from spanweave.operators import phrases as P
from spanweave.session import checkpoint_dir
from tests.test_phrases_and_pack import PHRASES, ROWS, brute_force_mask


def _folders(spark) -> set:
    return set(os.listdir(urlparse(checkpoint_dir(spark)).path))


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_neither_stores_nor_shuffles_rows(spark):
    """Also with a phrase table too large to broadcast."""
    held, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _folders(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(ROWS, "k string, tokens array<string>")
        plan = _plan(P.match_phrases(df, "tokens", spark.createDataFrame([(x,) for x in PHRASES], "phrase string")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "Exchange" not in plan and "Join" not in plan
    assert _folders(spark) == before


def test_texts_decide_where_the_filter_passes_everything(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"r{k}", [rng.choice(["▁a", "▁b", "▁c", "d", ",", "</s>"]) for _ in range(n)]) for k, n in enumerate([3, 40, 90, 300])]
    phrases = [" ".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6)] + ["a ,", ""]
    df, ph = spark.createDataFrame(rows, "k string, tokens array<string>"), spark.createDataFrame([(x,) for x in phrases], "phrase string")
    monkeypatch.setattr(P, "_may_be", lambda bits, h: h == h)
    got = {r["k"]: r["m"] for r in P.phrase_mask(df, "tokens", ph, "k", "m").collect()}
    assert got == {k: brute_force_mask(k, toks, set(phrases)) for k, toks in rows}


def test_null_and_empty_rows_have_no_words(spark):
    df = spark.createDataFrame([("a", None), ("b", []), ("c", ["▁new", "▁york"]), (None, ["</s>"])], "k string, tokens array<string>")
    got = {r["k"]: (len(r["words"]), [tuple(m) for m in r["matches"]]) for r in P.match_phrases(
        df, "tokens", spark.createDataFrame([("new york",)], "phrase string")).collect()}
    assert got == {"a": (0, []), "b": (0, []), "c": (2, [(2, 0, "new york")]), None: (0, [])}


def test_mining_leaves_its_result_only(spark):
    """Words and counts are gone when the phrases are there, and nothing is shuffled when they are read."""
    before = _folders(spark)
    d = spark.createDataFrame([("one two three one two three four",)] * 6, "text string")
    mined = P.mine_phrases(d, "text")
    plan = _plan(mined)
    assert "Exchange" not in plan and "Join" not in plan
    assert {f.rsplit("-", 1)[0] for f in _folders(spark) - before} == {"mine-scores"}


def test_scores_are_those_of_the_best_segmentation(spark):
    import itertools
    import math
    from collections import Counter
    texts = ["a b a b c a b c d e a b c d e"] * 5 + ["b c d", "e e e e e e"]
    count, total = Counter(), 0
    for t in texts:
        w = t.split()
        total += len(w)
        count.update(tuple(w[i:i + n]) for n in range(1, 6) for i in range(len(w) - n + 1))
    for r in P.mine_phrases(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        g, log = tuple(r["phrase"].split()), lambda x: math.log(count[x] / total)
        cuts = [c for k in range(1, len(g)) for c in itertools.combinations(range(1, len(g)), k)]
        best = max(sum(log(g[a:b]) for a, b in zip((0, *c), (*c, len(g)))) for c in cuts)
        assert r["count"] == count[g] and r["n"] == len(g) and r["score"] == pytest.approx(log(g) - best), g


def test_words_of_odd_texts(spark):
    cases = {"": [], " ": [], "▁": [""], " ▁ b": ["", "b"], "‍Foo": ["foo"], " ‍foo,Bar": ["foo", ",bar"], "a‍b c": ["ab", "c"],
             "it’s it's": ["it’s", "it", "'s"], "a—b - c": ["a—b", "-", "c"], "x ‍ y‍ z": ["x", "y", "z"], "x ‍y": ["xy"], "€5 \\]^": ["€5", "\\", "]", "^"]}
    d = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r["text"]: r["line"].split(" ")[1:] for r in P.word_lines(d).collect()} == cases


def test_long_runs_of_spaces_take_linear_time(spark):
    import time
    begun = time.time()
    line = P.word_lines(spark.range(1).select(F.concat(F.repeat(F.lit(" "), 300_000), F.lit("x"), F.repeat(F.lit("\t"), 300_000)).alias("text"))).first()["line"]
    assert line == " x" and time.time() - begun < 20


def test_phrase_masks_are_corrupted_row_by_row(spark):
    """The helper that corrupts takes its mask from the helper that matches, with no shuffle between them."""
    from spanweave.operators.corrupt import corrupt
    df = spark.createDataFrame([("a", ["▁new", "▁york", "</s>"], [5, 6, 1]), ("b", ["▁a", "</s>", "<pad>"], [7, 1, 0])],
                               "k string, tokens array<string>, input_ids array<int>")
    m = P.phrase_mask(df.repartition(2), "tokens", spark.createDataFrame([("new york",)], "phrase string"), "k", p=0.9)
    got = {r["k"]: (r["phrase_mask"], r["input_ids"], r["labels"]) for r in corrupt(m, "k", 3, 4, mask_col="phrase_mask").collect()}
    masks = {r["k"]: r["phrase_mask"] for r in m.collect()}
    assert masks == {"a": [1, 1, 0], "b": [1, 0, 0]} and {k: v[0] for k, v in got.items()} == masks
    assert got["a"][1] == [32099, 1, 0] and got["b"][1] == [32099, 1, 0]
    assert got["a"][2][:3] == [32099, 5, 6] and got["b"][2][:2] == [32099, 7]
