"""Task inputs derived from the shared tables (no downloads; every row derives from data).

one-input  : documents joined with labels, quality -> sst2 label
two-input  : consecutive conversation turns (self-join on turn + 1; skew-free, unlike a
             window per conversation), label from the second turn's role
regression : the same pairs with a score in [0, 5] from the text lengths
n-input    : the turns of a conversation pivoted into columns (DCchat shape)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanweave.functions.rank import uniform_sql
from spanweave.sources.tables import read_table

#: Columns of one dialogue row; longer conversations take several rows (``part``).
TURNS_PER_ROW = 8


def sst2_input(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", balance=True).select("doc_id", "text")
    labels = read_table(spark, sf, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id")
                .select(F.col("doc_id").alias("idx"), F.col("text").alias("sentence"),
                        F.col("quality").alias("label")))


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations", balance=True).select("conv_id", "turn", "role", "text")
    a = c.select("conv_id", "turn", F.col("text").alias("sentence1"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"),
                 F.col("role").alias("role2"))
    return a.join(b, ["conv_id", "turn"])


def rte_input(spark: SparkSession, sf: str) -> DataFrame:
    return turn_pairs(spark, sf).withColumn("label", F.when(F.col("role2") == "assistant", 1).otherwise(0))


def stsb_input(spark: SparkSession, sf: str) -> DataFrame:
    score = F.pmod(F.length("sentence1") + F.length("sentence2"), F.lit(51)).cast("double") / 10
    return turn_pairs(spark, sf).withColumn("label", score)


def dialogue_input(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue_rows(read_table(spark, sf, "conversations", balance=True).select("conv_id", "turn", "text"))


def dialogue_rows(c: DataFrame) -> DataFrame:
    """Turns as columns t0.. of one row for every ``TURNS_PER_ROW`` turns of a conversation."""
    n = TURNS_PER_ROW
    c = c.withColumn("part", F.floor(F.col("turn") / n).cast("int")).withColumn("at", F.col("turn") % n)
    p = c.groupBy("conv_id", "part").pivot("at", list(range(n))).agg(F.max("text"))
    p = p.select("conv_id", "part", *[F.col(str(i)).alias(f"t{i}") for i in range(n)])
    return p.withColumn("label", F.expr(uniform_sql("2", 42, "conv_id")).cast("int"))
