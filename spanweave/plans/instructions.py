"""Instruction tasks derived from ``conversations``.

One task per conversation: the definition is its first turn; positive
examples are consecutive turn pairs (input, reply, explanation = replying
role), negative examples the same pairs reversed; every later turn is an
instance whose input is the previous turn and whose references are the turn
text and the replying role. Task files hold a task as one nested record, which
``instruction_tasks`` makes for the file queries; the others read ``instruction_instances``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanweave.operators.instructions import instances_of_turns
from spanweave.sources.tables import read_table


def instruction_tasks(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations", balance=True).select("conv_id", "turn", "role", "text")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    pairs = ("transform(sequence(1, size(t) - 1), i -> named_struct('input', t[i - 1].text, 'output', t[i].text, "
             "'explanation', t[i].role))")
    return g.select(
        F.concat(F.lit("task"), F.col("conv_id").cast("string")).alias("Task"),
        F.expr("array(t[0].text)").alias("Definition"),
        F.expr(f"IF(size(t) > 1, {pairs}, array())").alias("Positive Examples"),
        F.expr(f"IF(size(t) > 1, transform({pairs}, p -> named_struct('input', p.output, 'output', p.input, "
               f"'explanation', p.explanation)), array())").alias("Negative Examples"),
        F.expr("IF(size(t) > 1, transform(sequence(1, size(t) - 1), i -> named_struct("
               "'id', concat(cast(conv_id as string), '-', cast(t[i].turn as string)), 'input', t[i - 1].text, "
               "'output', array(t[i].text, t[i].role))), array())").alias("Instances"))


def instruction_instances(spark: SparkSession, sf: str, subset: str | None = None) -> DataFrame:
    """The instances of the same tasks, joined from tables."""
    c = read_table(spark, sf, "conversations", balance=True).select("conv_id", "turn", "role", "text")
    return instances_of_turns(c, subset=subset)
