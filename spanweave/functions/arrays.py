"""Array expressions of the corruption and evaluation pipelines.

Each ``*_sql`` builder returns Spark SQL text over column names, and the
matching plain function wraps it as a Column. Heavy arrays are referenced at
least twice or computed inside an ``aggregate`` finish lambda, so Catalyst's
project collapsing never re-evaluates them once per array element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from spanweave.constants import EOS_ID, IGNORE_ID, PAD_ID, VOCAB_SIZE


def corrupt_spans(vocab_size: int = VOCAB_SIZE, special: tuple = (PAD_ID, EOS_ID)):
    """Column function (ids, mask) -> struct (inputs, targets, sent): E9, E10, E11 and E13 without padding.

    Positions that hold one of ``special`` are unmasked; ``sent`` has the sentinel (``vocab_size`` - ordinal) at a span's
    start, -1 inside it and 0 elsewhere; ``inputs`` and ``targets`` are those of ``corrupt_inputs_sql`` and
    ``corrupt_targets_sql``. All rows of a batch are one flat array, so the work is linear in the ids."""
    lists = pa.list_(pa.int32())

    @F.arrow_udf("struct<inputs:array<int>,targets:array<int>,sent:array<int>>")
    def spans(ids: pa.Array, mask: pa.Array) -> pa.Array:
        nulls = pc.or_(ids.is_null(), mask.is_null())
        ids, mask = (pc.if_else(nulls, pa.scalar(None, a.type), a) for a in (ids, mask))
        sizes, other = (pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False) for a in (ids, mask))
        if (sizes != other).any():
            raise ValueError("a mask has another length than its ids")
        x, m = (pc.list_flatten(a).to_numpy(zero_copy_only=False) for a in (ids, mask))
        cut = np.concatenate([[0], np.cumsum(sizes)])
        first = np.zeros(len(x) + 1, bool)
        first[cut[:-1]] = True
        first = first[:-1]
        noisy = (m == 1) & ~np.isin(x, special)
        start = noisy & (first | ~np.roll(noisy, 1))
        nth = np.concatenate([[0], np.cumsum(start)])
        sent = np.where(start, vocab_size - (nth[1:] - np.repeat(nth[cut[:-1]], sizes)), np.where(noisy, -1, 0))
        put = np.where(sent != 0, sent, x)
        goal = np.where(~first & np.roll(sent != 0, 1), np.roll(x, 1), sent)

        def kept(values, keep):
            ends = np.concatenate([[0], np.cumsum(keep)])[cut]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[keep], pa.int32()), mask=nulls)
        parts = [kept(put, put != -1), kept(goal, goal != 0), kept(sent, np.ones(len(sent), bool))]
        return pa.StructArray.from_arrays(parts, fields=[pa.field(n, lists) for n in ("inputs", "targets", "sent")])

    return spans


def fit_length_sql(arr: str, n: int, pad: int = PAD_ID) -> str:
    """Pad right with ``pad`` to n, or crop to n."""
    return f"slice(concat({arr}, array_repeat({pad}, {int(n)})), 1, {int(n)})"


def fit_length(arr: str, n: int, pad: int = PAD_ID) -> Column:
    return F.expr(fit_length_sql(arr, n, pad))


def unmask_special_sql(mask: str, ids: str, special=(PAD_ID, EOS_ID)) -> str:
    """Positions holding pad or eos are never masked."""
    s = ", ".join(str(x) for x in special)
    return f"zip_with({mask}, {ids}, (b, x) -> IF(x IN ({s}), 0, b))"


def unmask_special(mask: str, ids: str) -> Column:
    return F.expr(unmask_special_sql(mask, ids))


def sentinel_ids_sql(mask: str, vocab_size: int = VOCAB_SIZE) -> str:
    """Span start -> vocab_size - ordinal, continuation -> -1, else 0.

    One fold collects span starts (short list), its finish lambda maps every
    position once; position 0 starts a span when masked (no wrap-around).
    """
    return (
        f"aggregate({mask}, named_struct('prev', 0, 'pos', 0, 'starts', cast(array() as array<int>)), "
        f"(acc, b) -> named_struct('prev', b, 'pos', acc.pos + 1, 'starts', "
        f"IF(b = 1 AND acc.prev = 0, concat(acc.starts, array(acc.pos)), acc.starts)), "
        f"acc -> transform({mask}, (b, p) -> CASE WHEN b = 1 AND (CASE WHEN p = 0 THEN 0 ELSE {mask}[p - 1] END) = 0 "
        f"THEN {int(vocab_size)} - cast(array_position(acc.starts, p) as int) "
        f"WHEN b = 1 THEN -1 ELSE 0 END))"
    )


def sentinel_ids(mask: str, vocab_size: int = VOCAB_SIZE) -> Column:
    return F.expr(sentinel_ids_sql(mask, vocab_size))


def corrupt_inputs_sql(ids: str, sent: str) -> str:
    """E11 without padding: span -> its sentinel, continuations deleted."""
    return f"filter(zip_with({ids}, {sent}, (x, s) -> IF(s != 0, s, x)), y -> y != -1)"


def corrupt_targets_sql(ids: str, sent: str) -> str:
    """E13 without padding: position j = ids[j-1] if sent[j-1] != 0 else sent[j]; zeros dropped.

    Sentinel, span tokens, sentinel, ...; no eos and no closing sentinel, and a
    span touching the last position loses its last token.
    """
    return (f"filter(transform({sent}, (s, j) -> CASE WHEN j > 0 AND {sent}[j - 1] != 0 "
            f"THEN {ids}[j - 1] ELSE s END), y -> y != 0)")


def corrupt_token_types_sql(types: str, sent: str) -> str:
    """The same compaction applied to sentence numbers (deleted -> 0 at the end)."""
    return (f"transform(filter(zip_with({types}, {sent}, (t, s) -> named_struct('t', t, 's', s)), "
            f"z -> z.s != -1), z -> z.t)")


def shift_right_sql(labels: str, n: str, start: int = PAD_ID, pad: int = PAD_ID) -> str:
    """Prepend the start id, drop the last, ignore ids -> pad."""
    return (f"transform(concat(array({start}), slice({labels}, 1, greatest({n} - 1, 0))), "
            f"y -> IF(y = {IGNORE_ID}, {pad}, y))")


def ignore_pads_sql(arr: str) -> str:
    """pad -> -100 (labels ignored by the loss)."""
    return f"transform({arr}, y -> IF(y = {PAD_ID}, {IGNORE_ID}, y))"


def check_length(col: str, n: int, what: str | None = None) -> Column:
    """Fail the task with expected/actual length if an array has the wrong size."""
    what = what or col
    return F.when(F.size(col) != F.lit(int(n)),
                  F.raise_error(F.concat(F.lit(f"array {what}: expected {int(n)} elements, found "),
                                         F.size(col).cast("string")))
            ).otherwise(F.col(col))


def trim_after_eos_sql(ids: str) -> str:
    """Last position forced to eos; everything after the first eos -> pad."""
    forced = f"concat(slice({ids}, 1, greatest(size({ids}) - 1, 0)), array({EOS_ID}))"
    # the first eos is looked for once, not for every position; the forced one is always found
    end = f"cast(array_position(a, {EOS_ID}) as int)"
    return (f"aggregate(array(0), {forced}, (a, x) -> a, "
            f"a -> concat(slice(a, 1, {end}), array_repeat({PAD_ID}, size(a) - {end})))")


def argmax_sql(rows: str) -> str:
    """First maximum over the vocabulary, per position."""
    return f"transform({rows}, v -> cast(array_position(v, array_max(v)) as int) - 1)"


def render(col: str, sep: str = " ") -> Column:
    """Integer array -> text, for representation-free comparison and sinks."""
    return F.array_join(F.col(col).cast("array<string>"), sep).alias(col)
