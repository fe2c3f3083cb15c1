"""Registered queries of readers, task records, collators and other user-facing surfaces.

Files that a reader needs are derived from the given tables first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from spanweave.functions.arrays import render
from spanweave.functions.masks import plan_lengths_df
from spanweave.functions.rank import uniform_sql
from spanweave.operators import instructions as IN
from spanweave.operators import metrics as M
from spanweave.operators import tasks as J
from spanweave.operators.corrupt import corrupt
from spanweave.operators.formatting import encode_task
from spanweave.operators.udf import collate, map_batches
from spanweave.plans import catalog as C, evaluation as EV, oracle as O, tasks as T
from spanweave.plans.corpus import corpus_chunks, corpus_vocab
from spanweave.plans.instructions import instruction_instances, instruction_tasks
from spanweave.sources.tables import drop_columns, read_corpora, read_table, read_task
from spanweave.streaming.streams import scratch_path

query = C.query


# --- A1, A2, A5, B1, B7 readers --------------------------------------------------
@query("read_corpora", sql="""
SELECT 'documents' AS corpus, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_letters, 'doc_id text' AS columns FROM documents
UNION ALL SELECT 'turns', count(*), CAST(sum(length(text)) AS BIGINT), 'conv_id turn text' FROM conversations""")
def read_corpora_q(spark, sf):
    """A1 and B1: two corpora by path, the first named after its file; columns dropped by name."""
    base = sf.rstrip("/")
    corpora = read_corpora(spark, f"{base}/documents.parquet,{base}/conversations.parquet", ",turns")
    unused = {"documents": ["lang", "source", "n_chars"], "turns": "role"}
    parts = [d.agg(F.lit(name).alias("corpus"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_letters"),
                   F.lit(" ".join(d.columns)).alias("columns"))
             for name, d in ((name, drop_columns(d, unused[name])) for name, d in corpora.items())]
    return parts[0].unionByName(parts[1])


@query("read_task_splits", sql=f"""
SELECT 'sst2' AS task, CASE {O.uniform('10', 'd.doc_id')} WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split,
       d.doc_id AS idx, d.text AS sentence, l.quality AS label
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def read_task_splits(spark, sf):
    """The splits of the selected tasks, from files laid out as base/benchmark/task/split."""
    base = scratch_path(spark, "tasks")
    rows = T.sst2_input(spark, sf)
    part = F.expr(uniform_sql("10", 42, "idx"))
    for split, which in (("validation", part == 0), ("test", part == 1), ("train", part > 1)):
        rows.where(which).write.parquet(f"{base}/glue/sst2/{split}")
    chosen = J.select_tasks(J.registry_df(spark), include=["sst2", "rte", "mnli"], exclude=["rte", "mnli"])
    found = None
    for record in chosen.select("family", "task").collect():   # bounded by the registry
        for split, d in read_task(spark, base, record["family"], record["task"]).items():
            d = d.select(F.lit(record["task"]).alias("task"), F.lit(split).alias("split"), "idx", "sentence", "label")
            found = d if found is None else found.unionByName(d)
    return found


@query("instruction_files", sql="""
WITH p AS (SELECT conv_id, turn, role, text, row_number() OVER w - 1 AS k, lag(text) OVER w AS input,
                  first_value(text) OVER w AS definition
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, definition, input, text || '|' || role AS outputs
FROM p WHERE k BETWEEN 1 AND 100""")
def instruction_files(spark, sf):
    """A5: instruction tasks written as JSON lines, with a file of their names, and read back."""
    base = scratch_path(spark, "instructions")
    tasks = instruction_tasks(spark, sf)
    tasks.write.json(f"{base}/tasks")
    tasks.select("Task").write.text(f"{base}/names")
    d = IN.read_instruction_tasks(spark, f"{base}/names", f"{base}/tasks", subset="test", one_per_file=False,
                                  max_examples=IN.MAX_EXAMPLES)
    return d.select("id", F.col("Definition")[0].alias("definition"), F.col("Instance.input").alias("input"),
                    F.array_join("Instance.output", "|").alias("outputs"))


# --- D5 two inputs and regression ------------------------------------------------
@query("encode_task_pair", sql=C.encode_task_sql(C.ORACLE["format_rte"], ["conv_id", "turn"]))
def encode_task_pair(spark, sf):
    return _encoded_pairs(T.rte_input(spark, sf), "rte", corpus_vocab(spark, sf))


@query("encode_task_score", sql=C.encode_task_sql(C.ORACLE["format_stsb"], ["conv_id", "turn"]))
def encode_task_score(spark, sf):
    return _encoded_pairs(T.stsb_input(spark, sf), "stsb", corpus_vocab(spark, sf))


def _encoded_pairs(rows, task, vocab):
    e = encode_task(rows, task, vocab, C.TASK_LEN, C.LABEL_LEN)
    return e.select("conv_id", "turn", F.col("chunk").cast("int").alias("chunk"), render("input_ids"),
                    render("attention_mask"), render("labels"))


# --- D7, E12 ----------------------------------------------------------------------
@query("plan_lengths", sql="""
WITH g AS (SELECT doc_id, CAST(16 + n_chars % 497 AS INTEGER) AS input_length,
                  [0.15, 0.5, 0.9][CAST(doc_id % 3 AS INTEGER) + 1]::DOUBLE AS density,
                  [3.0, 20.0][CAST(doc_id % 2 AS INTEGER) + 1]::DOUBLE AS mean_span FROM documents),
n AS (SELECT *, unnest(range(input_length, input_length * 16 + 64)) AS raw FROM g),
s AS (SELECT *, raw - round_even((raw) * density, 0) + round_even(round_even(raw * density, 0) / mean_span, 0) + 1 AS size,
             (raw + 1) - round_even((raw + 1) * density, 0) + round_even(round_even((raw + 1) * density, 0) / mean_span, 0) + 1
             AS next FROM n),
f AS (SELECT doc_id, input_length, density, mean_span, min(raw) AS raw FROM s WHERE next > input_length
      GROUP BY doc_id, input_length, density, mean_span),
t AS (SELECT *, round_even(raw * density, 0) + round_even(round_even(raw * density, 0) / mean_span, 0) + 1 AS target FROM f)
SELECT doc_id, (raw - CASE WHEN density = 0.5 AND target > input_length THEN 1 ELSE 0 END)::INTEGER AS raw_length,
       (target - CASE WHEN density = 0.5 AND target > input_length THEN 1 ELSE 0 END)::INTEGER AS target_length FROM t""")
def plan_lengths_q(spark, sf):
    """One plan for each document's length, over three densities and two span lengths."""
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    grid = docs.select("doc_id", (16 + F.col("n_chars") % 497).cast("int").alias("input_length"),
                       F.array(F.lit(0.15), F.lit(0.5), F.lit(0.9))[(F.col("doc_id") % 3).cast("int")].alias("density"),
                       F.array(F.lit(3.0), F.lit(20.0))[(F.col("doc_id") % 2).cast("int")].alias("mean_span"))
    return plan_lengths_df(grid, "input_length", "density", "mean_span").select("doc_id", "raw_length", "target_length")


_KEPT_TYPES = ("list_transform(list_filter(list_transform(sent, lambda s, i: {'s': s, 't': (i - 1) // 16 + 1}), "
               "lambda z: z.s != -1), lambda z: z.t)")


@query("corrupt_types", sql=O.corpus_ctes() + "," + O.random_mask_ctes(
    "chunks", "len(input_ids)", "row_key", 0.15, 3.0, True, True) + f""",
cl AS (SELECT *, list_transform(mask, lambda b, i: CASE WHEN input_ids[i] IN (0, 1) THEN 0 ELSE b END) AS cmask FROM m6),
se AS (SELECT *, {O.sentinel('cmask')} AS sent FROM cl)
SELECT doc_id, chunk, {O.render(O.fit(_KEPT_TYPES, 128))} AS token_types FROM se""")
def corrupt_types(spark, sf):
    """Sentence numbers (here sixteen tokens a sentence) that follow the corrupted inputs."""
    ch = corpus_chunks(spark, sf).withColumn("token_types", F.transform(
        "input_ids", lambda x, i: F.floor(i / 16).cast("int") + 1))
    out = corrupt(ch, "row_key", input_length=128, target_length=32, density=0.15, types="token_types")
    return out.select("doc_id", "chunk", render("token_types"))


# --- G9, J1, J3 metrics by task ----------------------------------------------------
def _task_rows(task: str, where: str, names: tuple) -> str:
    listed = ", ".join(f"'{kind}_{m}'" for m in names for kind in ("token", "example"))
    return f"SELECT '{task}' AS task, metric, value FROM ({C.metric_sql(where)}) WHERE metric IN ({listed})"


def lead_parts(labels: list[np.ndarray], preds: list[np.ndarray]) -> np.ndarray:
    """Per example: right tokens before the first wrong one, and kept tokens. No table of (label, prediction)
    pairs gives it, since it depends on places."""
    out = np.zeros((len(labels), 2))
    for r, (want, got) in enumerate(zip(labels, preds)):
        kept = (want != 0) & (want != 1)
        wrong = np.flatnonzero((want != got)[kept])
        out[r] = (wrong[0] if len(wrong) else kept.sum(), kept.sum())
    return out


def _lead_sql(where: str) -> str:
    return (O.corpus_ctes() + O.predictions_cte() + f""",
moved AS (SELECT row_key, pred[2 : len(pred)] || [0] AS pred, labels FROM preds WHERE {where}),
each AS (SELECT row_key, unnest(labels) AS l, unnest(pred) AS p, unnest(generate_series(1, len(labels))) AS i FROM moved),
kept AS (SELECT *, max((l <> p)::INTEGER) OVER (PARTITION BY row_key ORDER BY i ROWS UNBOUNDED PRECEDING) AS past
         FROM each WHERE l NOT IN (0, 1, -100))
SELECT 'spans' AS task, 'row_lead' AS metric, round(sum(1 - past)::DOUBLE / count(*), 6) AS value FROM kept""")


def _hits_sql(where: str) -> str:
    return (O.corpus_ctes() + O.predictions_cte() + f""",
moved AS (SELECT pred[2 : len(pred)] || [0] AS pred, labels FROM preds WHERE {where}),
each AS (SELECT unnest(labels) AS l, unnest(pred) AS p FROM moved)
SELECT 'spans' AS task, 'token_hits' AS metric, count(*)::DOUBLE AS value FROM each WHERE l = p AND l NOT IN (0, 1, -100)""")


@query("task_metrics", sql=" UNION ALL ".join([
    _task_rows("cola", "doc_id % 2 = 0", ("accuracy", "f1", "precision", "recall", "mcc")),
    _task_rows("spans", "doc_id % 2 = 1", ("accuracy", "spearman")),
    f"SELECT * FROM ({_hits_sql('doc_id % 2 = 1')})", f"SELECT * FROM ({_lead_sql('doc_id % 2 = 1')})"]))
def task_metrics(spark, sf):
    """G9 by task, with a task added by register_task (J1) that lists metrics added by register_metric
    and register_row_metric (J3)."""
    M.register_metric("hits", lambda: F.sum(F.when(F.col("l") == F.col("p"), F.col("c")).otherwise(0)))
    M.register_row_metric("lead", lead_parts, lambda right, kept: right / kept)
    J.register_task(J.Task("spans", 1, ("spans: ",), scores=("accuracy", "spearman", "hits", "lead")))
    try:
        p = EV.predictions(spark, sf).withColumn("task", F.when(F.col("doc_id") % 2 == 0, "cola").otherwise("spans"))
        return M.metrics_by_task(p).select("task", "metric", F.round("value", 6).alias("value"))
    finally:
        M.METRICS.pop("hits")
        M.ROW_METRICS.pop("lead")
        J.REGISTRY.pop("spans")


# --- J2 batched map, J4 collators ---------------------------------------------------
def _lengths(batch: pa.RecordBatch) -> pa.RecordBatch:
    text = batch.column(1)
    return pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_length(text).cast(pa.int64()),
                                       pc.binary_length(text).cast(pa.int64())], names=["doc_id", "n_letters", "n_bytes"])


@query("map_documents", sql="""
SELECT doc_id, length(text) AS n_letters, strlen(text) AS n_bytes FROM documents""")
def map_documents(spark, sf):
    """A function over Arrow batches of two columns."""
    return map_batches(read_table(spark, sf, "documents"), _lengths, "doc_id bigint, n_letters bigint, n_bytes bigint",
                       columns=["doc_id", "text"])


@query("collate_span", sql=C.ORACLE["corrupt_random"])
def collate_span(spark, sf):
    """J4 in span mode."""
    out = collate(corpus_chunks(spark, sf), "span", key="row_key", input_length=128, target_length=32, density=0.15)
    return out.select("doc_id", "chunk", render("input_ids"), render("labels"), render("decoder_input_ids"),
                      render("attention_mask"))


TARGET_LEN = 32


def _collated_sql() -> str:
    n, m = C.INSTR_MAX, TARGET_LEN
    prompts = C.ORACLE["instruction_prompts"]
    return (O.vocab_ctes() + f""",
src AS ({prompts})""" + O.text_ids_ctes("si", "src", ["id"], "source", eos=False)
            + O.text_ids_ctes("so", "src", ["id"], "target", eos=False) + f""",
cut AS (SELECT a.id, a.ids[1 : {n - 1}] || [1] AS i, b.ids[1 : {m - 1}] || [1] AS o
        FROM si_ids a JOIN so_ids b ON b.id = a.id)
SELECT id, {O.render(O.fit('i', n))} AS input_ids, {O.render(O.fit('list_transform(i, lambda x: 1)', n))} AS attention_mask,
       {O.render(f"list_transform({O.fit('o', m)}, lambda y: CASE WHEN y = 0 THEN -100 ELSE y END)")} AS labels FROM cut""")


@query("collate_instruction", sql=_collated_sql())
def collate_instruction(spark, sf):
    """J4 in instruction mode, cut to its lengths as the reference's collator does."""
    e = instruction_instances(spark, sf, subset="test")
    e = IN.with_fixed_encoding(e, add_task_name=True, add_task_definition=True, num_pos_examples=2,
                               num_neg_examples=2, add_explanation=True)
    out = collate(e, "instruction", vocab=corpus_vocab(spark, sf), max_source_length=C.INSTR_MAX,
                  max_target_length=TARGET_LEN, overflow="truncate")
    return out.select("id", render("input_ids"), render("attention_mask"), render("labels"))


# The lengths of the reference's configuration of instruction tasks (ft.yaml).
SOURCE_MAX, TARGET_MAX = 1024, 128


def _whole_collated_sql() -> str:
    n, m = SOURCE_MAX, TARGET_MAX
    base, pos, neg = C.instruction_ctes("true AS name_f, true AS def_f, 2 AS npos, 2 AS nneg, true AS expl_f")

    def fitting(counts: str, used: str) -> str:
        return f"len(list_filter(range(1, len({counts}) + 1), lambda j: {used} + list_sum(({counts})[1 : j]) <= {n}))"

    def seg(ids: str, c: str, body: int) -> str:
        return f"{ids}[{c} * {body} + 1 : {c} * {body} + {body}] || [1]"
    return (O.vocab_ctes() + f""",
cand AS ({base}
SELECT id, task || '. ' || d AS head, {pos} AS pos, {neg} AS neg, ti,
       output[{O.uniform('len(output)', 'id', "'ref'")} + 1] AS target FROM b),
part AS (SELECT id, unnest([head || ti] || pos || neg) AS part, unnest(generate_series(0, len(pos) + len(neg))) AS k FROM cand)"""
            + O.text_ids_ctes("pt", "part", ["id", "k"], "part", eos=False) + f""",
sizes AS (SELECT id, list(len(ids) ORDER BY k) AS n FROM pt_ids GROUP BY id),
cp AS (SELECT c.*, s.n[1] + 1 AS used, s.n[2 : 1 + len(pos)] AS np, s.n[2 + len(pos) : len(s.n)] AS nn
       FROM cand c JOIN sizes s ON s.id = c.id),
kp AS (SELECT *, {fitting('np', 'used')} AS k FROM cp),
kn AS (SELECT *, used + coalesce(list_sum(np[1 : k]), 0) AS more FROM kp),
src AS (SELECT id, head || array_to_string(pos[1 : k], '') || array_to_string(neg[1 : {fitting('nn', 'more')}], '') || ti
               AS source, target FROM kn)""" + O.text_ids_ctes("si", "src", ["id"], "source", eos=False)
            + O.text_ids_ctes("so", "src", ["id"], "target", eos=False) + f""",
sc AS (SELECT id, c::INTEGER AS source_chunk, {seg('ids', 'c', n - 1)} AS i
       FROM si_ids, unnest(range(0, greatest(ceil(len(ids) / {n - 1})::INTEGER, 1))) AS r(c)),
tc AS (SELECT id, c::INTEGER AS target_chunk, {seg('ids', 'c', m - 1)} AS o
       FROM so_ids, unnest(range(0, greatest(ceil(len(ids) / {m - 1})::INTEGER, 1))) AS r(c))
SELECT sc.id, source_chunk, target_chunk, {O.render(O.fit('i', n))} AS input_ids,
       {O.render(O.fit('list_transform(i, lambda x: 1)', n))} AS attention_mask,
       {O.render(f"list_transform({O.fit('o', m)}, lambda y: CASE WHEN y = 0 THEN -100 ELSE y END)")} AS labels
FROM sc JOIN tc ON tc.id = sc.id""")


@query("collate_instruction_whole", sql=_whole_collated_sql())
def collate_instruction_whole(spark, sf):
    """J4 in instruction mode at the reference's lengths: whole prompts and references, in chunk rows.

    Instances carry the two examples of each kind that the encoding asks for, not the task's whole lists."""
    e = instruction_instances(spark, sf, subset="test")
    e = IN.with_fixed_encoding(e, add_task_name=True, add_task_definition=True, num_pos_examples=2,
                               num_neg_examples=2, add_explanation=True)
    out = collate(e, "instruction", vocab=corpus_vocab(spark, sf), max_source_length=SOURCE_MAX,
                  max_target_length=TARGET_MAX)
    return out.select("id", F.col("source_chunk").cast("int").alias("source_chunk"),
                      F.col("target_chunk").cast("int").alias("target_chunk"),
                      render("input_ids"), render("attention_mask"), render("labels"))
