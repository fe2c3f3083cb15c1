"""Run-log analytics (H1-H7) over a long table (run, prefix, step, name, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from spanweave.functions.rank import group_dense_index, running_scan
from spanweave.operators.tasks import REGISTRY


def report_intervals(df: DataFrame, every: int, step: str = "step") -> DataFrame:
    """H2: reports at steps every, 2*every, ...; interval k covers steps ((k-1)*every, k*every]."""
    return df.withColumn("interval", F.ceil(F.col(step) / F.lit(every)).cast("bigint"))


def average_stats(df: DataFrame, weight: float = 1.0, keys=("run", "prefix", "interval"),
                  name: str = "name", value: str = "value", step: str = "step") -> DataFrame:
    """H1: per report and statistic, sum v*w^(n-i+1) / sum w^(n-i+1) (w = 1: the mean).

    The i-th of n updates gets weight w^(n-i+1): r = n-i+1 is the reverse
    rank inside one report, a group bounded by the report interval.
    """
    g = list(keys) + [name]
    w = Window.partitionBy(*g).orderBy(F.desc(step))
    d = df.withColumn("_sw_r", F.row_number().over(w))
    d = d.withColumn("_sw_w", F.pow(F.lit(float(weight)), F.col("_sw_r")))
    return d.groupBy(*g).agg((F.sum(F.col(value) * F.col("_sw_w")) / F.sum("_sw_w")).alias("average"),
                             F.count(F.lit(1)).alias("n_updates"))


def best_step(df: DataFrame, metric: str, greater_is_better: bool = True, run: str = "run",
              name: str = "name", value: str = "value", step: str = "step") -> DataFrame:
    """H3: best checkpoint per run by one metric and direction; ties -> earliest step."""
    d = df.filter(F.col(name) == metric)
    key = F.col(value) if greater_is_better else -F.col(value)
    best = d.groupBy(run).agg(F.max_by(F.struct(F.col(step), F.col(value)),
                                       F.struct(key.alias("k"), (-F.col(step)).alias("s"))).alias("b"))
    return best.select(run, F.lit(metric).alias("metric"), F.col("b").getField(step).alias("best_step"),
                       F.col("b").getField(value).alias("best_value"))


def best_step_by_task(df: DataFrame, task: str = "task", run: str = "run", name: str = "name",
                      value: str = "value", step: str = "step") -> DataFrame:
    """H3 by task record (J1): each run's best checkpoint by its task's goal. A task without a record raises."""
    goals = [x for t in REGISTRY.values() for x in (F.lit(t.name), F.struct(F.lit(t.goal.metric).alias("metric"),
                                                                            F.lit(t.goal.direction == "max").alias("up")))]
    missing = F.raise_error(F.concat(F.lit("no record of task "), F.coalesce(F.col(task), F.lit("null"))))
    goal = F.coalesce(F.element_at(F.create_map(*goals), F.col(task)), missing.cast("struct<metric:string,up:boolean>"))
    d = df.withColumn("_sw_goal", goal).where(F.col(name) == F.col("_sw_goal.metric"))
    key = F.when(F.col("_sw_goal.up"), F.col(value)).otherwise(-F.col(value))
    best = d.groupBy(task, run).agg(F.first("_sw_goal.metric").alias("metric"), F.max_by(
        F.struct(F.col(step), F.col(value)), F.struct(key.alias("k"), (-F.col(step)).alias("s"))).alias("b"))
    return best.select(task, run, "metric", F.col("b").getField(step).alias("best_step"), F.col("b").getField(value).alias("best_value"))


def early_stop(df: DataFrame, metric: str, patience: int, threshold: float = 0.0,
               greater_is_better: bool = True, run: str = "run", name: str = "name",
               value: str = "value", step: str = "step") -> DataFrame:
    """H4: step at which early stopping ends training (NULL: never).

    The best so far is updated on any strict improvement, so it is the
    running max (min) of earlier evaluations; an evaluation improves when it
    beats that by more than ``threshold``. Training stops at the first
    evaluation that is ``patience`` evaluations past the last improvement.
    The evaluation number, the best so far and the last improvement are two-level
    scans over range partitions, so that one run of any length is spread over many tasks. Evaluations at
    the same step count in the order of their values.
    """
    sign = 1.0 if greater_is_better else -1.0
    d = df.filter(F.col(name) == metric).select(run, step, (F.col(value) * sign).alias("_sw_value"))
    order = [step, "_sw_value"]
    d = group_dense_index(d, [run], order, "_sw_k")
    order = ["_sw_k"]
    best = running_scan(d, [run], order, F.col("_sw_value"), F.max, "_sw_best", upto=False)
    v = F.col("_sw_value")
    improved = F.col("_sw_best").isNull() | ((v > F.col("_sw_best")) & (F.abs(v - F.col("_sw_best")) > threshold))
    last = running_scan(best, [run], order, F.when(improved, F.col("_sw_k")).otherwise(F.lit(-1)), F.max, "_sw_last")
    stop = F.when(F.col("_sw_k") - F.col("_sw_last") >= patience, F.col(step).cast("bigint"))
    return last.groupBy(run).agg(F.min(stop).alias("stopped_at_step"), F.count(F.lit(1)).cast("int").alias("n_evals"))


def keep_last(df: DataFrame, n: int, run: str = "run", step: str = "step") -> DataFrame:
    """H6: only the last n checkpoints of each run (salted two-level cap: skew-safe)."""
    from spanweave.operators.split import cap_per_group
    return cap_per_group(df, run, -F.col(step), n, step).drop("rank_in_group")


def rank_sweep(df: DataFrame, task: str = "task", run: str = "run", metric: str = "metric",
               params=("lr_bin", "scheduler"), goal: str = "maximize") -> DataFrame:
    """H5: per task and parameter cell: runs, mean metric, best run (by the sweep goal; ties -> larger run id)."""
    key = F.col(metric) if goal == "maximize" else -F.col(metric)
    g = [task, *params]
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("n_runs"), F.avg(metric).alias("mean_metric"),
                              F.max_by(F.col(run), F.struct(key.alias("k"), F.col(run).alias("r"))).alias("best_run"))


def train_eval_gap(df: DataFrame, epoch: str = "epoch", every_epochs: int = 2, run: str = "run",
                   prefix: str = "prefix", value: str = "value") -> DataFrame:
    """H7: on every second epoch the training set is also evaluated (prefix 'training');
    pivot the two prefixes and report the gap."""
    d = df.filter(F.col(epoch) % every_epochs == 0)
    p = d.groupBy(run, epoch).pivot(prefix, ["training", "eval"]).agg(F.avg(value))
    return p.withColumn("gap", F.col("eval") - F.col("training"))
