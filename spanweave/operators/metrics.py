"""Evaluation.

Token metrics explode kept positions (label not pad/eos) and aggregate with
built-in functions; class-level statistics (MCC, Spearman ranks) aggregate
per token id first, so their size is bounded by the vocabulary, not by the
data. Metrics of whole examples are sums of parts that a batch of them gives (J3).
"""

from __future__ import annotations

import inspect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from spanweave.constants import EOS_ID, IGNORE_ID, PAD_ID
from spanweave.functions.arrays import argmax_sql
from spanweave.operators.split import limit_batches
from spanweave.operators.tasks import REGISTRY
from spanweave.sources.tables import stored

METRICS: dict = {}
ROW_METRICS: dict = {}
BUILT_IN = ("accuracy", "f1", "precision", "recall", "mcc", "pearson", "spearman")
#: So many groups send one row each to every task; of more, each is a small part of the rows.
FEW_GROUPS = 10_000


def register_metric(name: str, fn) -> None:
    """``fn() -> Column``, an aggregate over the confusion cells (columns ``l``, ``p``
    and the cell count ``c``), e.g. ``lambda: F.sum(F.col("c") * (F.col("l") == F.col("p")))``."""
    METRICS[name] = fn


def register_row_metric(name: str, parts, finish) -> None:
    """A metric of whole examples, ``row_<name>``.

    ``parts(labels, preds)`` gets the aligned arrays of a batch of examples (lists of NumPy arrays, pads included) and
    returns one row of numbers per example; Spark sums them per group before and after the shuffle, so no
    group meets in one task; ``finish(*sums) -> Column`` makes the value."""
    ROW_METRICS[name] = (parts, finish)


def _row_parts(parts):
    @F.arrow_udf(ArrayType(DoubleType()))
    def run(labels: pa.Array, preds: pa.Array) -> pa.Array:
        def arrays(col):
            if isinstance(col, pa.ChunkedArray):
                col = col.combine_chunks()
            cut = np.append(0, np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            flat = col.flatten().to_numpy(zero_copy_only=False)
            return [flat[lo:hi] for lo, hi in zip(cut[:-1], cut[1:])]
        got = np.asarray(parts(arrays(labels), arrays(preds)), float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * got.shape[1], pa.int32()), pa.array(got.ravel()))
    return run


def _row_metric(d: DataFrame, group: list, name: str, pred: str, labels: str) -> DataFrame:
    """Sums of a row metric's parts per group, finished into column ``row_<name>``."""
    parts, finish = ROW_METRICS[name]
    sized = inspect.signature(finish).parameters
    got = d.select(*group, _row_parts(parts)(labels, pred).alias("v"))
    sums = got.groupBy(*group).agg(*[F.sum(F.get("v", F.lit(k))).alias(f"_sw_s{k}") for k in range(len(sized))])
    return sums.select(*group, finish(*[F.col(f"_sw_s{k}") for k in range(len(sized))]).cast("double").alias(f"row_{name}"))


def align_predictions(df: DataFrame, pred: str = "pred", labels: str = "labels", group: list | None = None) -> DataFrame:
    """G1: labels -100 -> pad; if the largest first predicted token over the whole set (over
    the group's rows, where ``group`` names columns) is pad, drop the first prediction token and
    append pad.

    The rows are stored once, since the largest first token needs them before they are moved. Few groups
    are broadcast: a shuffle by group would bring all rows to as many tasks as there are groups."""
    df = stored(df, "predictions")
    largest = F.max(F.element_at(pred, 1))
    if group:
        found = stored(df.groupBy(*group).agg(largest.alias("_sw_first")), "first-tokens")
        df = df.join(F.broadcast(found) if found.count() <= FEW_GROUPS else found, group)
        first_max = F.col("_sw_first")
    else:
        first_max = df.agg(largest).scalar()
    shifted = F.concat(F.slice(pred, 2, F.greatest(F.size(pred) - 1, F.lit(0))), F.array(F.lit(PAD_ID)))
    return (df.withColumn(labels, F.transform(labels, lambda x: F.when(x == IGNORE_ID, PAD_ID).otherwise(x)))
              .withColumn(pred, F.when(first_max == PAD_ID, shifted).otherwise(F.col(pred))).drop("_sw_first"))


def confusion_cells(df: DataFrame, group: list, pred: str = "pred", labels: str = "labels") -> DataFrame:
    """One pass over the examples: counts per (group, label, prediction) over kept positions (B6),
    plus two marker cells (l = -1, p = 0/1) counting wrong/right examples (G2).

    The result is bounded by the distinct (label, prediction) pairs, so every
    metric below is computed from this small table and the examples are read once.
    """
    z = F.arrays_zip(F.col(labels).alias("l"), F.col(pred).alias("p"))
    kept = F.filter(z, lambda s: ~s["l"].isin(PAD_ID, EOS_ID))
    marker = F.array(F.struct(F.lit(-1).alias("l"), (F.col(pred) == F.col(labels)).cast("int").alias("p")))
    cells = df.select(*group, F.explode(F.concat(kept, marker)).alias("z"))
    return cells.groupBy(*group, F.col("z.l").alias("l"), F.col("z.p").alias("p")).agg(F.count(F.lit(1)).alias("c"))


def _weighted_corr(x: Column, y: Column, w: Column) -> Column:
    n = F.sum(w)
    sx, sy = F.sum(x * w), F.sum(y * w)
    sxx, syy, sxy = F.sum(x * x * w), F.sum(y * y * w), F.sum(x * y * w)
    den = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.when(den == 0, F.lit(float("nan"))).otherwise((n * sxy - sx * sy) / den)


def _attach_one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two global (ungrouped) aggregates: each side is exactly one row, so a
    broadcast equi-join on a constant key is bounded by construction."""
    return (a.withColumn("_sw_one", F.lit(1))
             .join(F.broadcast(b.withColumn("_sw_one", F.lit(1))), "_sw_one").drop("_sw_one"))


def token_metrics(df: DataFrame, group: list | None = None, pred: str = "pred", labels: str = "labels",
                  metric_names: list | None = None, align: bool = True) -> DataFrame:
    """``token_<m>`` and ``example_<m>`` in long form (group..., metric, value).

    Without ``metric_names``, all built-in and registered metrics.

    G3/G4 micro scores, G5 MCC x 100, G6 Pearson and G7 Spearman (average
    ranks) all derive from the confusion cells; G8 example scores from the
    marker cells (accuracy-like = share correct, MCC 0, correlations NaN).
    """
    shown = list(group or [])
    names = list(metric_names) if metric_names is not None else [*BUILT_IN, *METRICS, *ROW_METRICS]
    unknown = [m for m in names if m not in BUILT_IN and m not in METRICS and m not in ROW_METRICS]
    if unknown:
        raise KeyError(f"unknown metrics {unknown}")
    custom = {m: METRICS[m] for m in names if m in METRICS}
    by_row = [m for m in names if m in ROW_METRICS]
    # groups meet by one key that is never null, so that a null group is a group like any other
    group = ["_sw_key"] if shown else []
    if shown:
        df = df.withColumn("_sw_key", F.to_json(F.struct(*shown)))
    df = df.select(*dict.fromkeys([*group, *shown, pred, labels]))
    if align:
        d = align_predictions(df, pred, labels, group)
    else:
        d = stored(df, "predictions") if by_row else df
    # filters on the grouping key would be pushed below the aggregation and make
    # every branch recount the examples; the cell table is small (distinct
    # label/prediction pairs), so it is kept once and all branches read it
    cells = confusion_cells(d, group + shown, pred, labels).persist()
    tok = cells.filter(F.col("l") >= 0)
    ex = (cells.filter(F.col("l") == -1).groupBy(*group)
               .agg((F.sum(F.when(F.col("p") == 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("ex_acc")))
    c = F.col("c").cast("double")
    base = tok.groupBy(*group).agg(
        F.sum(F.when(F.col("l") == F.col("p"), c).otherwise(0.0)).alias("tp"),
        F.sum(F.when(F.col("l") != F.col("p"), c).otherwise(0.0)).alias("fp"),
        F.sum(c).alias("n"),
        _weighted_corr(F.col("l").cast("double"), F.col("p").cast("double"), c).alias("pearson"))
    tk = tok.groupBy(*group, F.col("l").alias("k")).agg(F.sum(c).alias("t_k"))
    pk = tok.groupBy(*group, F.col("p").alias("k")).agg(F.sum(c).alias("p_k"))
    kk = tk.join(pk, group + ["k"], "full").na.fill(0.0, ["t_k", "p_k"])
    mc = kk.groupBy(*group).agg(F.sum(F.col("t_k") * F.col("p_k")).alias("tp_sum"),
                                F.sum(F.col("t_k") ** 2).alias("t2"), F.sum(F.col("p_k") ** 2).alias("p2"))
    # average ranks per distinct value from the marginals (ties share the mean rank)
    wl = Window.partitionBy(*group).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rl = tk.withColumn("r_l", F.coalesce(F.sum("t_k").over(wl), F.lit(0.0)) + (F.col("t_k") + 1) / 2.0) \
           .select(*group, F.col("k").alias("l"), "r_l")
    rp = pk.withColumn("r_p", F.coalesce(F.sum("p_k").over(wl), F.lit(0.0)) + (F.col("p_k") + 1) / 2.0) \
           .select(*group, F.col("k").alias("p"), "r_p")
    sp = (tok.join(rl, group + ["l"]).join(rp, group + ["p"]).groupBy(*group)
             .agg(_weighted_corr(F.col("r_l"), F.col("r_p"), c).alias("spearman")))
    j = lambda a, b: a.join(b, group) if group else _attach_one_row(a, b)
    out = j(j(j(base, mc), sp), ex)
    den = F.sqrt((F.col("n") ** 2 - F.col("p2")) * (F.col("n") ** 2 - F.col("t2")))
    out = (out.withColumn("accuracy", F.col("tp") / F.col("n"))
              .withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
              .withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fp")))
              .withColumn("f1", F.col("tp") / (F.col("tp") + F.col("fp")))
              .withColumn("mcc", F.when(den == 0, F.lit(0.0))
                          .otherwise((F.col("tp") * F.col("n") - F.col("tp_sum")) / den * 100)))
    for name, fn in custom.items():
        out = j(out, tok.groupBy(*group).agg(fn().alias(f"custom_{name}")))
    for name in by_row:
        out = j(out, _row_metric(d, group, name, pred, labels))
    if shown:
        out = j(out, cells.groupBy("_sw_key").agg(F.first(F.struct(*shown)).alias("_sw_shown"))).select("*", "_sw_shown.*")
    rows = []
    for m in [m for m in names if m in BUILT_IN]:
        tokv = F.col(m).cast("double")
        if m in ("pearson", "spearman"):
            exv = F.lit(float("nan"))
        elif m == "mcc":
            exv = F.lit(0.0)
        else:
            exv = F.col("ex_acc")
        rows += [F.struct(F.lit(f"token_{m}").alias("metric"), F.coalesce(tokv, F.lit(float("nan"))).alias("value")),
                 F.struct(F.lit(f"example_{m}").alias("metric"), exv.alias("value"))]
    for name in custom:
        rows.append(F.struct(F.lit(f"token_{name}").alias("metric"), F.col(f"custom_{name}").cast("double").alias("value")))
    for name in by_row:
        rows.append(F.struct(F.lit(f"row_{name}").alias("metric"), F.col(f"row_{name}").alias("value")))
    return out.select(*shown, F.explode(F.array(*rows)).alias("m")).select(*shown, "m.metric", "m.value")


def metrics_by_task(df: DataFrame, task: str = "task", pred: str = "pred", labels: str = "labels") -> DataFrame:
    """G9 by task: each task's predictions are aligned and scored on their own, and get the metrics
    that the task's record lists (J1), registered ones (J3) included. A task without a record raises."""
    listed = {name: list(cfg.scores) for name, cfg in REGISTRY.items()}
    names = sorted({m for ms in listed.values() for m in ms})
    pairs = [x for name, ms in listed.items() for x in (F.lit(name), F.array(*[F.lit(m) for m in ms]))]
    wanted = F.coalesce(F.element_at(F.create_map(*pairs), F.col(task)), F.raise_error(
        F.concat(F.lit("no record of task "), F.coalesce(F.col(task), F.lit("null")))).cast("array<string>"))
    found = token_metrics(df, [task], pred, labels, metric_names=names)
    return found.where(F.array_contains(wanted, F.regexp_replace("metric", "^(token|example|row)_", "")))


def argmax_tokens(df: DataFrame, logits: str = "logits", out: str = "pred") -> DataFrame:
    """First maximum over the vocabulary at every position."""
    return df.withColumn(out, F.expr(argmax_sql(logits)))


def padded_token_accuracy(pred: str = "pred", labels: str = "labels") -> Column:
    """Correct / all positions (ignored positions count as wrong)."""
    return F.expr(f"aggregate(zip_with({pred}, {labels}, (p, l) -> IF(p = l, 1, 0)), 0, (a, x) -> a + x) "
                  f"/ size({labels})")


def masked_nll_parts(logits: str = "logits", labels: str = "labels") -> tuple[Column, Column]:
    """G12 pieces per example: (sum of -log softmax at the label, number of non-ignored positions).

    The maximum of a position is bound as a lambda variable, once, so the cost is linear in classes."""
    loss = "ln(aggregate(v, CAST(0 AS DOUBLE), (a, x) -> a + exp(x - m))) + m - v[l]"
    per_pos = (f"zip_with({logits}, {labels}, (v, l) -> IF(l = {IGNORE_ID}, CAST(NULL AS DOUBLE), "
               f"transform(array(array_max(v)), m -> {loss})[0]))")
    total = F.expr(f"aggregate(filter({per_pos}, x -> x IS NOT NULL), CAST(0 AS DOUBLE), (a, x) -> a + x)")
    count = F.expr(f"size(filter({labels}, l -> l != {IGNORE_ID}))")
    return total, count


def evaluate_batches(df: DataFrame, batch_1based: str, steps: int, grad_acc: int = 1,
                     logits: str = "logits", labels: str = "labels") -> DataFrame:
    """Per batch mean NLL (G12) and padded accuracy (G11); batches stop before
    steps*grad_acc (B5); the result is the mean of batch means."""
    d = limit_batches(df, batch_1based, steps, grad_acc)
    d = argmax_tokens(d, logits, "_sw_pred")
    total, count = masked_nll_parts(logits, labels)
    d = d.select(batch_1based, total.alias("nll_sum"), count.alias("nll_n"),
                 F.expr(f"aggregate(zip_with(_sw_pred, {labels}, (p, l) -> IF(p = l, 1, 0)), 0, (a, x) -> a + x)")
                  .alias("correct"), F.size(labels).alias("positions"))
    b = d.groupBy(batch_1based).agg((F.sum("nll_sum") / F.sum("nll_n")).alias("loss"),
                                    (F.sum("correct") / F.sum("positions")).alias("accuracy"))
    return b.agg(F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"),
                 F.count(F.lit(1)).alias("n_batches"))


def trim_duplicates(df: DataFrame, key: str) -> DataFrame:
    """The last distributed batch repeats rows; keep one row per example key."""
    return df.dropDuplicates([key])
