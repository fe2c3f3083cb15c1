"""Stemmed ROUGE-L, row metrics, goals of task records, null groups."""

import random

import numpy as np
import pytest

from spanweave.operators import metrics as M, rouge, runlog
from spanweave.operators import tasks as J

# Known results of the algorithm and its extensions.
GOLDEN = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi
sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control
roll roll dying die spied spi died die enjoy enjoy flies fli playing play generalization gener oscillators oscil yellows yellow""".split()


def test_stems():
    assert {w: rouge.stem(w) for w in GOLDEN[::2]} == dict(zip(GOLDEN[::2], GOLDEN[1::2]))


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_subsequences_by_bits():
    rng = random.Random(1)
    sizes = [0, 1, 5, 63, 64, 65, 128, 200, 600]
    pairs = [([rng.randrange(v) for _ in range(rng.choice(sizes))], [rng.randrange(v) for _ in range(rng.choice(sizes))])
             for v in (1, 2, 10, 200) for _ in range(25)]
    cut = [np.append(0, np.cumsum([len(p[s]) for p in pairs])).astype(np.int64) for s in (0, 1)]
    flat = [np.array([t for p in pairs for t in p[s]], np.int64) for s in (0, 1)]
    assert rouge.lcs_lengths(flat[0], cut[0], flat[1], cut[1]).tolist() == [lcs(a, b) for a, b in pairs]


def test_stemmed_rouge_by_hand(spark):
    rows = [("The cats were running", "the cat runs"), ("", "x"), (None, "x"), ("same words", "SAME, words!")]
    df = spark.createDataFrame(rows, "prediction string, reference string")
    # cat, run of 4 and 3 tokens, and the: 3 of 4 and 3 of 3; nothing; nothing; all
    got = rouge.rouge_l(df, stemmed=True).first()
    want = 2 * (3 / 4) * (3 / 3) / (3 / 4 + 3 / 3)
    assert got["n_pairs"] == 4 and got["rouge_l"] == pytest.approx(100 * (want + 0 + 0 + 1) / 4)
    plain = rouge.rouge_l(df).first()["rouge_l"]
    assert plain < got["rouge_l"]


def test_row_metric_and_null_groups(spark):
    from spanweave.plans.surfaces import lead_parts
    M.register_row_metric("lead", lead_parts, lambda right, kept: right / kept)
    try:
        df = spark.createDataFrame([("a", [5, 6, 9], [5, 6, 7]), ("a", [4, 4], [5, 4]), (None, [5, 6], [5, 6])],
                                   "task string, pred array<int>, labels array<int>")
        got = {(r["task"], r["metric"]): r["value"] for r in M.token_metrics(df, ["task"], metric_names=["lead", "accuracy"], align=False).collect()}
        assert got["a", "row_lead"] == pytest.approx(2 / 5) and got["a", "token_accuracy"] == pytest.approx(3 / 5)
        assert got[None, "row_lead"] == 1.0 and got[None, "example_accuracy"] == 1.0
    finally:
        M.ROW_METRICS.pop("lead")


def test_best_step_follows_the_record(spark):
    J.register_task(J.Task("small", 1, goal=J.Goal("loss", "min")))
    try:
        rows = [("sst2", "r", 1, "example_accuracy", .5), ("sst2", "r", 2, "example_accuracy", .7), ("sst2", "r", 3, "example_accuracy", .7),
                ("sst2", "r", 4, "loss", .9), ("small", "q", 1, "loss", .5), ("small", "q", 2, "loss", .1), ("mrpc", "m", 7, "example_f1", .2)]
        df = spark.createDataFrame(rows, "task string, run string, step int, name string, value double")
        got = {r["run"]: (r["metric"], r["best_step"], r["best_value"]) for r in runlog.best_step_by_task(df).collect()}
        assert got == {"r": ("example_accuracy", 2, .7), "q": ("loss", 2, .1), "m": ("example_f1", 7, .2)}
        with pytest.raises(Exception, match="no record"):
            runlog.best_step_by_task(spark.createDataFrame([("none", "r", 1, "loss", .1)], df.schema)).collect()
    finally:
        J.REGISTRY.pop("small")
