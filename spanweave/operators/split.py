"""Shuffle, split, mix, slice and per-group caps.

Global order is always a dense index (``dense_index``: range shuffle +
per-partition offsets), never a window without a partition. Per-group caps
use two window levels with a salt, so a group holding a third of all rows is
still spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spanweave.constants import DEFAULT_SEED
from spanweave.functions.rank import dense_index, md5_rank, uniform

SALT_BUCKETS = 64


def shuffle(df: DataFrame, key: str, seed=DEFAULT_SEED, out: str = "shuffle_idx") -> DataFrame:
    """full random order = dense index over (md5 rank, key)."""
    d = df.withColumn("_sw_rank", md5_rank(seed, key))
    return dense_index(d, ["_sw_rank", key], out).drop("_sw_rank")


def reshuffle_epoch(df: DataFrame, key: str, epoch: int, seed=DEFAULT_SEED, out: str = "shuffle_idx") -> DataFrame:
    """a new order per epoch (rank key md5(seed+epoch : key))."""
    return shuffle(df, key, seed=f"{seed}+{epoch}", out=out)


def buffer_shuffle(df: DataFrame, order_cols: list, key: str, buffer: int = 10_000, seed=DEFAULT_SEED,
                   out: str = "shuffle_idx") -> DataFrame:
    """deterministic bounded-locality shuffle: order by (index div buffer, md5 rank).

    A row moves at most ``buffer`` positions, the same locality bound as a
    shuffle buffer of that size. Rows are numbered once; a block holds ``buffer`` of them, so that
    its order is a window of bounded size.
    """
    d = dense_index(df, order_cols, "_sw_idx")
    d = d.withColumn("_sw_block", F.floor(F.col("_sw_idx") / F.lit(buffer))).withColumn("_sw_rank", md5_rank(seed, key))
    order = Window.partitionBy("_sw_block").orderBy("_sw_rank", key, "_sw_idx")
    place = F.col("_sw_block") * buffer + F.row_number().over(order) - 1
    return d.withColumn(out, place.cast("bigint")).drop("_sw_idx", "_sw_block", "_sw_rank")


def buffer_pass(df: DataFrame, index: str, buffer: int, seed=DEFAULT_SEED, out: str = "shuffle_idx") -> DataFrame:
    """F2 as a shuffle buffer of ``buffer`` slots: the first rows fill the slots, every later row goes to a random
    slot and drives out the row that stands there.

    ``index`` is the place of arrival. The row that drives another out is the next one of its slot, so the
    place at which a row leaves is a lead over the slot's rows; ``out`` is null for rows still in the buffer. Slots hold equal
    shares of the rows whatever their content, so no window is hot.
    """
    slot = F.when(F.col(index) < buffer, F.col(index)).otherwise(uniform(buffer, seed, index))
    turn = Window.partitionBy("_sw_slot").orderBy(index)
    return df.withColumn("_sw_slot", slot).withColumn(out, F.lead(index).over(turn) - F.lit(buffer)).drop("_sw_slot")


def buffer_rest(held: DataFrame, index: str, seed=DEFAULT_SEED, out: str = "shuffle_idx") -> DataFrame:
    """The rows that stand in the buffer at the end of the input, in random order after all that left it."""
    ends = held.agg((F.coalesce(F.max(index), F.lit(-1)) + 1 - F.count(F.lit(1))).cast("bigint")).scalar()
    d = held.drop(out).withColumn("_sw_rank", md5_rank(seed, F.lit("rest"), index))
    d = dense_index(d, ["_sw_rank", index], "_sw_place")
    return d.withColumn(out, (F.col("_sw_place") + ends).cast("bigint")).drop("_sw_rank", "_sw_place")


def shuffle_through(df: DataFrame, order_cols: list, buffer: int = 10_000, seed=DEFAULT_SEED,
                    out: str = "shuffle_idx") -> DataFrame:
    """the whole table through a shuffle buffer; a row leaves at most ``buffer`` places early and any number late."""
    d = buffer_pass(dense_index(df, order_cols, "_sw_idx"), "_sw_idx", buffer, seed, out)
    left = d.where(F.col(out).isNotNull())
    return left.unionByName(buffer_rest(d.where(F.col(out).isNull()), "_sw_idx", seed, out)).drop("_sw_idx")


def train_test_split(df: DataFrame, key: str, test_fraction: float = 0.05, seed=DEFAULT_SEED,
                     test_name: str = "validation", train_name: str = "train") -> DataFrame:
    """exact-size seeded split: the first ceil(N * fraction) rows of the md5 order are test."""
    d = shuffle(df, key, seed, "_sw_idx")
    n = df.agg(F.count(F.lit(1))).scalar()
    n_test = F.ceil(n.cast("double") * F.lit(float(test_fraction)))
    return d.withColumn("split", F.when(F.col("_sw_idx") < n_test, F.lit(test_name)).otherwise(F.lit(train_name))).drop("_sw_idx")


def slice_split(df: DataFrame, order_cols: list, percent: float | None = 100, n: int | None = None) -> DataFrame:
    """A3: ``train[:p%]`` if percent is set, else ``train[:n]``, else everything.

    The percentage wins (its default is 100); rows are kept by dense index
    < round(N * p / 100) (half-even).
    """
    if percent:
        total = df.agg(F.count(F.lit(1))).scalar()
        limit = F.bround(total.cast("double") * F.lit(float(percent)) / 100, 0).cast("bigint")
    elif n is not None:
        limit = F.lit(int(n))
    else:
        return df
    return dense_index(df, order_cols, "_sw_idx").filter(F.col("_sw_idx") < limit).drop("_sw_idx")


def take_skip(df: DataFrame, order_cols: list, n: int) -> tuple[DataFrame, DataFrame]:
    """B2: first n rows (train) and the rest (validation)."""
    d = dense_index(df, order_cols, "_sw_idx")
    return d.filter(F.col("_sw_idx") < n).drop("_sw_idx"), d.filter(F.col("_sw_idx") >= n).drop("_sw_idx")


def interleave(dfs: dict, order_cols: dict) -> DataFrame:
    """round-robin over sources until the first one runs out.

    Each source gets a dense index ``src_idx``; (i, source k) is kept while it
    comes before the first position whose source is exhausted: i < m, or
    i = m for sources before the first source of length m (m = shortest).
    Output adds ``source``, ``src_idx`` and ``mix_idx`` = i * sources + k.
    Sources must share a schema (select the common columns first).
    """
    names = list(dfs)
    counts = [dfs[name].agg(F.count(F.lit(1))).scalar() for name in names]
    m = F.least(*counts) if len(counts) > 1 else counts[0]
    first_short = reduce(lambda acc, kc: F.when(acc.isNull() & (kc[1] == m), F.lit(kc[0])).otherwise(acc),
                         list(enumerate(counts)), F.lit(None).cast("int"))
    out = None
    for k, name in enumerate(names):
        d = dense_index(dfs[name], order_cols[name], "src_idx").withColumn("source", F.lit(name))
        keep = (F.col("src_idx") < m) | ((F.col("src_idx") == m) & (F.lit(k) < first_short))
        d = d.filter(keep).withColumn("mix_idx", F.col("src_idx") * len(names) + k)
        out = d if out is None else out.unionByName(d)
    return out


def cap_per_group(df: DataFrame, group: str, order: Column | str, n: int, tie: str,
                  salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """B3/B4 core: keep the first n rows of each group in (order, tie) order, skew-safe.

    Level 1 keeps the first n per (group, salt); level 2 ranks the survivors
    (at most n * salt_buckets per group) per group.
    """
    o = order if isinstance(order, Column) else F.col(order)
    d = df.withColumn("_sw_o", o).withColumn("_sw_salt", F.pmod(F.xxhash64(tie), F.lit(salt_buckets)))
    w1 = Window.partitionBy(group, "_sw_salt").orderBy("_sw_o", tie)
    d = d.withColumn("_sw_r1", F.row_number().over(w1)).filter(F.col("_sw_r1") <= n)
    w2 = Window.partitionBy(group).orderBy("_sw_o", tie)
    d = d.withColumn("rank_in_group", F.row_number().over(w2)).filter(F.col("rank_in_group") <= n)
    return d.drop("_sw_o", "_sw_salt", "_sw_r1")


def cap_per_task(df: DataFrame, task: str, key: str, n: int, seed=DEFAULT_SEED) -> DataFrame:
    """Random cap per task (md5 order)."""
    return cap_per_group(df, task, md5_rank(seed, key), n, key)


def first_n_per_task(df: DataFrame, task: str, pos: str, n: int = 100) -> DataFrame:
    """Positional cap per task."""
    return cap_per_group(df, task, pos, n, pos)


def limit_batches(df: DataFrame, batch_1based: str, steps: int, grad_acc: int = 1) -> DataFrame:
    """Evaluation stops before batch number steps * grad_acc (1-based)."""
    return df.filter(F.col(batch_1based) < steps * grad_acc)


def due_steps(df: DataFrame, step: str, every: int, total_steps: int) -> DataFrame:
    """Rows at which logging / evaluation / checkpointing is due."""
    return df.filter((F.col(step) % every == 0) | (F.col(step) > total_steps))
