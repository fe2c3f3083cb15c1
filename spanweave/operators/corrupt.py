"""Span corruption pipelines (E16 gen-1, E17 gen-2). Row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanweave.constants import DEFAULT_SEED, EOS_ID, PAD_ID, VOCAB_SIZE
from spanweave.functions.arrays import (check_length, corrupt_spans, corrupt_token_types_sql, fit_length_sql,
                                        ignore_pads_sql, shift_right_sql)
from spanweave.functions.masks import random_spans_mask


def corrupt(df: DataFrame, key: str, input_length: int, target_length: int,
            ids: str = "input_ids", density: float = 0.5, mean_span: float = 3.0,
            vocab_size: int = VOCAB_SIZE, seed=DEFAULT_SEED, mask_col: str | None = None,
            types: str | None = None) -> DataFrame:
    """Random (or supplied, e.g. phrase) mask -> E9 -> E10 -> E11/E13 -> E14 -> B9 -> E15.

    The mask covers the whole row (pads included) and is then cleared on pad
    and eos. Inputs are padded/cropped to ``input_length`` with pad, labels to
    ``target_length`` with pad then -100. ``attention_mask`` passes through at
    its pre-corruption length, as in the reference. A column of sentence numbers named by
    ``types`` loses the positions that the inputs lose (E12) and is padded alike.
    """
    d = df.withColumn("_sw_n", F.size(ids))
    if mask_col is None:
        d = random_spans_mask(d, "_sw_n", key, "_sw_mask0", density, mean_span, seed, roll=True, float32=True)
        mask_col = "_sw_mask0"
    else:
        # a mask that a generator gives stays a column of its own; nested lambdas inside a helper's arguments are not evaluated
        d = d.select("*", F.explode_outer(F.array(mask_col)).alias("_sw_mask0"))
        mask_col = "_sw_mask0"
    d = d.withColumn("_sw_spans", corrupt_spans(vocab_size)(ids, mask_col))
    d = d.withColumn("_sw_sent", F.col("_sw_spans.sent"))
    d = d.withColumn("_sw_in", F.expr(fit_length_sql("_sw_spans.inputs", input_length, PAD_ID)))
    d = d.withColumn("_sw_lab", F.expr(ignore_pads_sql(fit_length_sql("_sw_spans.targets", target_length, PAD_ID))))
    if types is not None:
        kept = fit_length_sql(corrupt_token_types_sql(types, "_sw_sent"), input_length, PAD_ID)
        d = d.withColumn("_sw_types", F.expr(kept)).withColumn(types, check_length("_sw_types", input_length, types))
    d = (d.withColumn(ids, check_length("_sw_in", input_length, "input_ids"))
          .withColumn("labels", check_length("_sw_lab", target_length, "labels")))
    d = d.withColumn("decoder_input_ids", F.expr(shift_right_sql("labels", str(target_length))))
    return d.drop(*[c for c in d.columns if c.startswith("_sw_")])


def corrupt_complement(df: DataFrame, key: str, input_length: int, target_length: int,
                       ids: str = "input_ids", density: float = 0.15, mean_span: float = 3.0,
                       vocab_size: int = VOCAB_SIZE, seed=DEFAULT_SEED) -> DataFrame:
    """Gen-2 collator on packed rows.

    Mask without rotation (float64 counts); inputs = sentinels of the mask,
    labels = sentinels of the inverted mask; both compacted (negatives
    dropped) and closed by eos; exact-length check, no padding.
    """
    d = df.withColumn("_sw_n", F.size(ids))
    d = random_spans_mask(d, "_sw_n", key, "_sw_mask", density, mean_span, seed, roll=False, float32=False)
    # the inverted mask is a column of its own: inside a lambda it would be made anew for every position
    d = d.withColumn("_sw_other", F.transform("_sw_mask", lambda b: 1 - b))
    for mask, out in (("_sw_mask", "_sw_in"), ("_sw_other", "_sw_lab")):
        kept = corrupt_spans(vocab_size, special=())(ids, mask)["inputs"]
        d = d.withColumn(out, F.concat(kept, F.array(F.lit(EOS_ID))))
    d = (d.withColumn(ids, check_length("_sw_in", input_length, "input_ids"))
          .withColumn("labels", check_length("_sw_lab", target_length, "labels")))
    return d.drop(*[c for c in d.columns if c.startswith("_sw_")])
