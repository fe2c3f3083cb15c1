"""Evaluation inputs derived from the shared tables.

predictions : corpus chunk ids as labels; predictions = labels with md5-chosen
              positions altered (a quarter of the rows untouched), shifted right
              behind a pad start token, as a decoder emits them
logits      : each ``embeddings`` vector is one position's class scores, its
              ``label`` the target; 8 consecutive vectors form one example and an
              md5-chosen eighth of the positions is ignored (-100)
text pairs  : consecutive ``benchmark`` items as (prediction, reference)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from spanweave.functions.masks import hash32
from spanweave.functions.rank import uniform_sql
from spanweave.plans.corpus import corpus_chunks
from spanweave.sources.tables import read_table

POSITIONS = 8


@F.arrow_udf(StructType([StructField(name, ArrayType(IntegerType())) for name in ("pred", "labels")]))
def _predicted(ids: pa.Array, keys: pa.Array, clean: pa.Array) -> pa.Array:
    """Predictions and labels of ids: a fifth of the positions (above eos) altered, chosen by md5 of (row key, position), clean rows
    as they are, shifted right behind a pad; and the ids with -100 for pad."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    cut = np.concatenate([[0], np.cumsum(sizes)])
    x = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(len(x)) - np.repeat(cut[:-1], sizes)
    out = x.copy()
    places = [b"%d" % i for i in range(int(sizes.max(initial=0)))]
    for key, still, lo, hi in zip(keys.to_pylist(), clean.to_pylist(), cut[:-1], cut[1:]):
        if not still:
            met = lo + np.flatnonzero(x[lo:hi] > 1)
            met = met[hash32(42, key, [places[i] for i in at[met].tolist()]) % 5 == 0]
            out[met] = 3 + (x[met] * 31 + at[met]) % 97
    # shifted inside each row: no id goes over into the next
    out = np.where(at == 0, 0, np.roll(out, 1))
    lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, pa.int32()), mask=ids.is_null())
             for v in (out, np.where(x == 0, -100, x))]
    return pa.StructArray.from_arrays(lists, fields=[pa.field(n, lists[0].type) for n in ("pred", "labels")])


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    ch = corpus_chunks(spark, sf)
    clean = F.expr(uniform_sql("4", 42, "row_key")) == 0
    d = ch.withColumn("_sw_both", _predicted(F.col("input_ids"), F.col("row_key"), clean))
    return d.select("doc_id", "chunk", "row_key", "_sw_both.pred", "_sw_both.labels")


def logits_examples(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings", balance=True).select("vec_id", "embedding", "label")
    e = e.withColumn("example_key", (F.col("vec_id") / POSITIONS).cast("bigint"))
    e = e.withColumn("label", F.when(F.expr(uniform_sql("8", 42, "vec_id")) == 0, F.lit(-100)).otherwise(F.col("label")))
    g = e.groupBy("example_key").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding", "label"))).alias("rows"))
    return g.select("example_key", F.expr("transform(rows, r -> r.embedding)").alias("logits"),
                    F.expr("transform(rows, r -> r.label)").alias("labels"))


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("reference"))
    return b.join(nxt, "item_id").select(F.col("item_id").alias("example_key"),
                                         F.col("text").alias("prediction"), "reference")
