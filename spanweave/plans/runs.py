"""Run log derived from ``events``: run = user, step = per-run order of (ts, event_id),
name = event type, value = value; 'view' rows are training-set evaluations
(prefix 'training'), the rest prefix 'eval'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanweave.functions.rank import group_dense_index
from spanweave.sources.tables import read_table


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events", balance=True).select("event_id", "ts", "user_id", "event_type", "value")
    d = group_dense_index(e, ["user_id"], ["ts", "event_id"], "_i")
    return d.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"),
                    F.when(F.col("event_type") == "view", "training").otherwise("eval").alias("prefix"),
                    (F.col("_i") + 1).alias("step"), F.col("event_type").alias("name"), "value", "event_id", "user_id")
