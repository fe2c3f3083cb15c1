"""Text-to-text formatting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from spanweave.operators.tasks import N_INPUT_COLUMN_NAMES, Task, get_task
from spanweave.operators.vocab import encode, encode_labels


def _map_lit(labels: dict) -> Column:
    keys = list(labels)
    return F.create_map(*[x for k in keys for x in (F.lit(k), F.lit(labels[k]))])


def label_to_text(label: str | Column, labels: dict, task: str = "") -> Column:
    """C4: dictionary lookup; a missing key is an error (Spark returns NULL, so check)."""
    c = label if isinstance(label, Column) else F.col(label)
    key_is_str = all(isinstance(k, str) for k in labels)
    key = c.cast("string") if key_is_str else c
    hit = F.try_element_at(_map_lit(labels), key)
    return F.coalesce(hit, F.raise_error(F.concat(F.lit(f"unknown label for {task}: "), c.cast("string"))))


@F.arrow_udf(StringType())
def _py_round1(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else str(round(v, 1)) for v in x.to_pylist()], pa.string())


def score_to_text(label: str | Column, exact: bool = True) -> Column:
    """Regression label text, ``str(round(x, 1))``.

    Python rounds the binary value (0.15 -> 0.1, 0.35 -> 0.3); ``bround``
    rounds the decimal text (0.15 -> 0.2). ``exact=True`` keeps Python's
    result with a tiny Arrow helper; ``exact=False`` is the JVM approximation.
    """
    c = label if isinstance(label, Column) else F.col(label)
    if exact:
        return _py_round1(c.cast("double"))
    return F.bround(c.cast("double"), 1).cast("string")


def format_one_input(df: DataFrame, cfg: Task, text: str | None = None, label: str = "label") -> DataFrame:
    """``prefix || text`` (no added space); label looked up."""
    text = text or cfg.columns[0]
    return (df.withColumn("processed_inputs", F.concat(F.lit(cfg.lead[0]), F.col(text)))
              .withColumn("processed_outputs", label_to_text(label, cfg.labels, cfg.name)))


def format_two_inputs(df: DataFrame, cfg: Task, text_1: str | None = None, text_2: str | None = None,
                      label: str = "label", exact_scores: bool = True) -> DataFrame:
    """``(p1 || t1) || ' ' || (p2 || t2)``; regression labels via C5."""
    t1 = text_1 or cfg.columns[0]
    t2 = text_2 or cfg.columns[1]
    out = (score_to_text(label, exact_scores) if cfg.labels is None
           else label_to_text(label, cfg.labels, cfg.name))
    return (df.withColumn("processed_inputs", F.concat(F.lit(cfg.lead[0]), F.col(t1), F.lit(" "),
                                                       F.lit(cfg.lead[1]), F.col(t2)))
              .withColumn("processed_outputs", out))


def format_n_inputs(df: DataFrame, cfg: Task, text_columns: list[str], label: str = "label") -> DataFrame:
    """Every text column in order becomes ``first_sentence: ...`` etc., TAB-joined,
    prefixed ``task: ``; more than nine columns fails; a null text reads ``None``."""
    if len(text_columns) > len(N_INPUT_COLUMN_NAMES):
        raise ValueError(f"{len(text_columns)} text columns; at most nine are supported")
    parts = [F.concat(F.lit(f"{N_INPUT_COLUMN_NAMES[i]}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
             for i, c in enumerate(text_columns)]
    return (df.withColumn("processed_inputs", F.concat(F.lit(f"{cfg.name}: "), F.concat_ws("\t", *parts)))
              .withColumn("processed_outputs", label_to_text(F.col(label).cast("string"), cfg.labels, cfg.name)))


def format_task(df: DataFrame, task: str, text_columns: list[str] | None = None, label: str = "label",
                **kw) -> DataFrame:
    """Dispatch by the registry (unknown task names raise)."""
    cfg = get_task(task)
    if cfg.inputs == 1:
        return format_one_input(df, cfg, (text_columns or [None])[0], label)
    if cfg.inputs == 2:
        cols = text_columns or [None, None]
        return format_two_inputs(df, cfg, cols[0], cols[1], label, **kw)
    if cfg.inputs is None:
        cols = text_columns or [c for c in df.columns if c != label]
        return format_n_inputs(df, cfg, cols, label)
    raise ValueError(f"task {task!r} has an unsupported shape")


def format_all(formatted: dict[str, DataFrame], keys: list[str] | None = None) -> DataFrame:
    """C7 (extension): multi-task mix = union of formatted tasks with a ``task`` column."""
    out = None
    for name, d in formatted.items():
        cols = (keys or []) + ["processed_inputs", "processed_outputs"]
        part = d.select(F.lit(name).alias("task"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def encode_task(df: DataFrame, task: str, vocab: DataFrame, max_len: int, label_len: int, overflow: str = "chunk",
                **kw) -> DataFrame:
    """A task's rows formatted by its record (C6), inputs encoded (D2; whole texts, in chunks, unless
    ``overflow`` says otherwise) and outputs encoded as labels (D3). Regression scores are encoded as text."""
    d = encode(format_task(df, task, **kw), "processed_inputs", vocab, max_len, overflow=overflow)
    return encode_labels(d, "processed_outputs", vocab, label_len)
