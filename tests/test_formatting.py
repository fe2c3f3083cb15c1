"""Formatting quirks that are observable outputs."""

import pytest
from pyspark.sql import functions as F

from spanweave.operators.formatting import format_n_inputs, format_task, score_to_text
from spanweave.operators.tasks import get_task


def test_python_rounding_of_scores(spark):
    df = spark.createDataFrame([(0.15,), (0.25,), (0.35,), (2.0,), (4.95,)], "x double")
    got = [r[0] for r in df.select(score_to_text("x")).collect()]
    assert got == [str(round(v, 1)) for v in (0.15, 0.25, 0.35, 2.0, 4.95)] == ["0.1", "0.2", "0.3", "2.0", "5.0"]


def test_rte_prefix_and_labels(spark):
    df = spark.createDataFrame([("a", "b", 1), ("c", "d", 0)], "sentence1 string, sentence2 string, label int")
    got = [tuple(r) for r in format_task(df, "rte").select("processed_inputs", "processed_outputs").collect()]
    assert got == [("rte: sentence1: a sentence2b", "positive"), ("rte: sentence1: c sentence2d", "negative")]


def test_mnli_prefixes_premise_with_hypothesis(spark):
    df = spark.createDataFrame([("P", "H", 2)], "premise string, hypothesis string, label int")
    r = format_task(df, "mnli").collect()[0]
    assert r["processed_inputs"] == "mnli hypothesis: P premise: H" and r["processed_outputs"] == "contradiction"


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("x", 7)], "sentence string, label int")
    with pytest.raises(Exception):
        format_task(df, "sst2").collect()


def test_n_inputs_none_and_limit(spark):
    df = spark.createDataFrame([("a", None, "1")], "s1 string, s2 string, label string")
    r = format_n_inputs(df, get_task("DCchat"), ["s1", "s2"]).collect()[0]
    assert r["processed_inputs"] == "DCchat: first_sentence: a\tsecond_sentence: None"
    assert r["processed_outputs"] == "Coherent"
    wide = spark.range(1).select(*[F.lit("t").alias(f"c{i}") for i in range(10)], F.lit("0").alias("label"))
    with pytest.raises(ValueError):
        format_n_inputs(wide, get_task("DCchat"), [f"c{i}" for i in range(10)])
