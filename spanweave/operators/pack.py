"""Packing and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from spanweave.functions.rank import _dense_index_rows, dense_index
from spanweave.sources.tables import stored


def pack_tokens(df: DataFrame, ids: str, length: int, group: str, order: str,
                out: str = "input_ids") -> DataFrame:
    """Concatenate the ids of each group in ``order`` and cut rows of exactly ``length``.

    The group remainder (< length ids) is dropped, as in the reference.
    Instead of exploding tokens, each document explodes into the chunks it
    overlaps (at most size/length + 2 rows) carrying its slice; the chunks
    are reassembled by ``groupBy(group, chunk)``, which reuses the window's
    partitioning on ``group`` (no second shuffle).
    Result: (group, row, out).
    """
    L = int(length)
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = (df.select(group, order, ids)
           .withColumn("_sw_len", F.size(ids))
           .withColumn("_sw_start", F.coalesce(F.sum("_sw_len").over(w), F.lit(0)).cast("bigint")))
    d = d.filter(F.col("_sw_len") > 0).withColumn("row", F.explode(F.expr(
        f"sequence(cast(_sw_start div {L} as int), cast((_sw_start + _sw_len - 1) div {L} as int))")))
    d = d.withColumn("_sw_piece", F.expr(
        f"slice({ids}, cast(greatest(row * {L} - _sw_start, 0) + 1 as int), "
        f"cast(least((row + 1) * {L}, _sw_start + _sw_len) - greatest(row * {L}, _sw_start) as int))"))
    packed = (d.groupBy(group, "row")
                .agg(F.sort_array(F.collect_list(F.struct(F.col("_sw_start"), F.col("_sw_piece")))).alias("_sw_parts")))
    packed = packed.withColumn(out, F.flatten(F.expr("transform(_sw_parts, p -> p._sw_piece)")))
    return packed.filter(F.size(out) == L).select(group, "row", out)


def pack_corpus(df: DataFrame, ids: str, length: int, order: str, out: str = "input_ids", first: int = 0) -> tuple[DataFrame, DataFrame]:
    """D6 over the whole corpus: all ids in ``order`` (a unique column) as one sequence, cut into rows of ``length``.

    The place of each document is a two-level prefix sum of the lengths alone (``dense_index`` with
    weights), so no group of documents loses a remainder; only the end of the corpus does not fill a row.
    Returns (rows, rest): ``row`` (from ``first``) with its ids, and the ids of the end as one row of the same
    form, or none. The ids are stored once, since both need them; a filter on them before that would be
    pushed below the numbering and make them a second time.
    """
    L = int(length)
    held = stored(df.select(F.col(order).alias("_sw_key"), F.col(ids).alias("_sw_ids")), "pack-ids").where(F.size("_sw_ids") > 0)
    places = _dense_index_rows(held.select("_sw_key", F.size("_sw_ids").alias("_sw_n")), ["_sw_key"], "_sw_start", weight="_sw_n")
    d = held.join(places, "_sw_key")
    d = d.withColumn("row", F.explode(F.expr(f"sequence(_sw_start div {L}, (_sw_start + _sw_n - 1) div {L})")))
    d = d.withColumn("_sw_piece", F.expr(
        f"slice(_sw_ids, cast(greatest(row * {L} - _sw_start, 0) + 1 as int), "
        f"cast(least((row + 1) * {L}, _sw_start + _sw_n) - greatest(row * {L}, _sw_start) as int))"))
    rows = d.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("_sw_start", "_sw_piece"))).alias("_sw_parts"))
    rows = rows.select((F.col("row") + first).alias("row"), F.flatten(F.expr("transform(_sw_parts, p -> p._sw_piece)")).alias(out))
    return rows.where(F.size(out) == L), rows.where(F.size(out) < L)


def assign_batches(df: DataFrame, order_cols: list, batch_size: int, grad_acc: int = 1,
                   out: str = "batch_id") -> DataFrame:
    """Consecutive batches of batch_size // grad_acc rows; the last partial batch is kept."""
    if batch_size % grad_acc:
        raise ValueError("batch size must be divisible by gradient accumulation steps")
    b = batch_size // grad_acc
    d = dense_index(df, order_cols, "_sw_idx")
    return d.withColumn(out, (F.col("_sw_idx") / F.lit(b)).cast("bigint")).withColumnRenamed("_sw_idx", "row_idx")


def pad_to_longest(df: DataFrame, batch: str, cols: dict, multiple: int = 8,
                   out_len: str = "padded_length") -> DataFrame:
    """Pad every array in ``cols`` (name -> pad value) to the longest row of its batch,
    rounded up to ``multiple``. Batches are bounded by the batch size, so the
    window per batch is small."""
    first = next(iter(cols))
    w = Window.partitionBy(batch)
    d = df.withColumn(out_len, (F.ceil(F.max(F.size(first)).over(w) / F.lit(multiple)) * multiple).cast("int"))
    for c, pad in cols.items():
        d = d.withColumn(c, F.expr(f"concat({c}, array_repeat({pad}, {out_len} - size({c})))"))
    return d


def collect_batches(df: DataFrame, batch: str, order: str, cols: list) -> DataFrame:
    """Stack each batch's rows (in ``order``) into 2-D arrays; bounded by the batch size."""
    s = F.sort_array(F.collect_list(F.struct(F.col(order), *[F.col(c) for c in cols])))
    d = df.groupBy(batch).agg(s.alias("_sw_rows"))
    return d.select(batch, F.size("_sw_rows").alias("n_rows"),
                    *[F.expr(f"transform(_sw_rows, r -> r.{c})").alias(c) for c in cols])


def plan_steps(df: DataFrame, split: str, batch_size: int, grad_acc: int = 1,
               epochs: int = 1, workers: int = 1) -> DataFrame:
    """Batches per split and total optimizer steps = (batches // grad_acc) * epochs // workers."""
    c = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
    c = c.withColumn("n_batches", F.expr(f"cast(ceil(n_rows / {batch_size}) as bigint)"))
    return c.withColumn("total_steps", F.expr(f"cast((n_batches div {grad_acc}) * {epochs} div {workers} as bigint)"))

