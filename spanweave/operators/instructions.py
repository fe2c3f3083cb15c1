"""Instruction tasks (A5, B3/B4 caps, C8-C12, J5).

Prompts are assembled per row with string functions; the example budget
(C9) counts tokens as pieces + eos of each candidate prompt, or with a
vocabulary as the ids that the whole prompt is encoded to; examples are
added while the prompt fits and the first failure stops the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from spanweave.constants import ASCII_PUNCTUATION, DEFAULT_SEED, SPARK_PIECE_PATTERN
from spanweave.functions.rank import group_dense_index, uniform_sql
from spanweave.operators.split import cap_per_task, first_n_per_task

EXAMPLE_T = ArrayType(StructType([StructField("input", StringType()), StructField("output", StringType()),
                                  StructField("explanation", StringType())]))
TASK_SCHEMA = StructType([
    StructField("Task", StringType()), StructField("Contributors", StringType()),
    StructField("Source", ArrayType(StringType())), StructField("URL", ArrayType(StringType())),
    StructField("Categories", ArrayType(StringType())), StructField("Reasoning", ArrayType(StringType())),
    StructField("Definition", ArrayType(StringType())), StructField("Input_language", ArrayType(StringType())),
    StructField("Output_language", ArrayType(StringType())),
    StructField("Instruction_language", ArrayType(StringType())), StructField("Domains", ArrayType(StringType())),
    StructField("Positive Examples", EXAMPLE_T), StructField("Negative Examples", EXAMPLE_T),
    StructField("Instances", ArrayType(StructType([StructField("id", StringType()), StructField("input", StringType()),
                                                    StructField("output", ArrayType(StringType()))]))),
    StructField("Instance License", ArrayType(StringType())),
])

# The five encodings the reference samples from when tk_instruct is set
# (add_task_name, add_task_definition, num_pos_examples, num_neg_examples, add_explanation).
ENCODINGS = [
    (False, True, 0, 0, False),   # instruction only
    (False, False, 2, 0, False),  # examples only
    (False, True, 2, 0, False),   # instruction + positive examples
    (False, True, 2, 2, False),   # instruction + positive + negative examples
    (False, True, 2, 0, True),    # instruction + positive examples with explanations
]
#: examples of a kind that any of the encodings asks for
MAX_EXAMPLES = max(max(positive, negative) for _, _, positive, negative, _ in ENCODINGS)


def read_instruction_tasks(spark: SparkSession, split_file: str, task_dir: str, subset: str | None = None,
                           max_per_task: int | None = None, seed=DEFAULT_SEED, one_per_file: bool = True,
                           max_examples: int | None = None) -> DataFrame:
    """A5: task names (one per line) joined with task JSON files; one row per instance; 'test' keeps
    the first 100 instances per task, ``max_per_task`` a seeded random cap.

    A file holds one task and is named after it, or, with ``one_per_file=False``, one task per line
    with its name in the field ``Task``. ``Definition`` may be a text or a list of texts.
    """
    names = spark.read.text(split_file).select(F.trim("value").alias("task_name")).filter("task_name != ''").distinct()
    fields = [StructField(f.name, StringType()) if f.name == "Definition" else f for f in TASK_SCHEMA.fields]
    tasks = spark.read.schema(StructType(fields)).option("multiLine", one_per_file).json(task_dir)
    # a list read as text keeps its JSON form
    listed = F.when(F.col("Definition").startswith("["), F.from_json("Definition", ArrayType(StringType())))
    tasks = tasks.withColumn("Definition", F.coalesce(listed, F.array("Definition")))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1) if one_per_file else F.col("Task")
    tasks = tasks.withColumn("task_name", name).join(names, "task_name")
    return explode_instances(tasks, subset=subset, max_per_task=max_per_task, seed=seed, max_examples=max_examples)


def explode_instances(tasks: DataFrame, subset: str | None = None, max_per_task: int | None = None,
                      seed=DEFAULT_SEED, task_col: str = "Task", max_examples: int | None = None) -> DataFrame:
    """J5 + B3/B4: one row per instance (``posexplode``); ``id`` = instance id. With ``max_examples`` an instance
    carries that many examples of each kind (``MAX_EXAMPLES`` is what the encodings ask for), without it the task's
    whole lists, which is quadratic where tasks hold many."""
    for kind in ("Positive Examples", "Negative Examples") if max_examples is not None else ():
        tasks = tasks.withColumn(kind, F.slice(F.col(f"`{kind}`"), 1, max_examples))
    keep = [c for c in tasks.columns if c not in ("Instances", "Instruction Source")]
    d = tasks.select(*keep, F.posexplode("Instances").alias("instance_pos", "Instance"))
    return limit_instances(d.withColumn("id", F.col("Instance.id")), subset, max_per_task, seed, task_col)


def limit_instances(d: DataFrame, subset: str | None = None, max_per_task: int | None = None, seed=DEFAULT_SEED,
                    task_col: str = "Task") -> DataFrame:
    """B3/B4: 'test' keeps the first 100 instances of a task, ``max_per_task`` a seeded random cap."""
    if subset == "test":
        d = first_n_per_task(d, task_col, "instance_pos", 100).drop("rank_in_group")
    if max_per_task is not None and max_per_task >= 0:
        d = cap_per_task(d, task_col, "id", max_per_task, seed).drop("rank_in_group")
    return d


def instances_of_turns(turns: DataFrame, subset: str | None = None, max_per_task: int | None = None, seed=DEFAULT_SEED,
                       max_examples: int = MAX_EXAMPLES, conv: str = "conv_id", order: tuple = ("turn", "role", "text"),
                       role: str = "role", text: str = "text") -> DataFrame:
    """Instances of the tasks that conversations make, by joins of tables; no record holds a conversation.

    Turns are numbered inside their conversation over all tasks of the cluster (``group_dense_index``) and joined with the turn
    before; a conversation's definition (its first turn) and its first ``max_examples`` pairs are one bounded row, joined back
    on the conversation. So the work is linear in the turns, and a conversation of any length is spread; a null
    conversation is one like any other. Rows are those of ``explode_instances`` over the nested tasks.
    """
    d = group_dense_index(turns.select(*dict.fromkeys([conv, *order, role, text])), [conv], list(order), "_sw_i")
    before = d.select(F.col(conv).alias("_sw_c"), (F.col("_sw_i") + 1).alias("_sw_j"), F.col(text).alias("_sw_input"))
    pairs = d.join(before, F.col(conv).eqNullSafe(F.col("_sw_c")) & (F.col("_sw_i") == F.col("_sw_j")))
    pairs = pairs.select(conv, "_sw_i", order[0], "_sw_input", F.col(text).alias("_sw_output"), F.col(role).alias("_sw_role"))

    def example(given: str, answer: str):
        return lambda p: F.struct(p[given].alias("input"), p[answer].alias("output"), p["_sw_role"].alias("explanation"))

    first = pairs.where(F.col("_sw_i") <= max_examples).groupBy(conv).agg(F.array_sort(F.collect_list(
        F.struct("_sw_i", "_sw_input", "_sw_output", "_sw_role"))).alias("_sw_first"))
    first = first.select(F.col(conv).alias("_sw_c"), F.transform("_sw_first", example("_sw_input", "_sw_output")).alias("Positive Examples"),
                         F.transform("_sw_first", example("_sw_output", "_sw_input")).alias("Negative Examples"))
    stated = d.where("_sw_i = 0").select(F.col(conv).alias("_sw_t"), F.array(text).alias("Definition"))
    tasks = stated.join(first, F.col("_sw_t").eqNullSafe(F.col("_sw_c"))).drop("_sw_c")
    key = F.col(conv).cast("string")
    rows = pairs.join(tasks, F.col(conv).eqNullSafe(F.col("_sw_t"))).select(
        F.concat(F.lit("task"), key).alias("Task"), "Definition", "Positive Examples", "Negative Examples",
        (F.col("_sw_i") - 1).cast("int").alias("instance_pos"),
        F.struct(F.concat(key, F.lit("-"), F.col(order[0]).cast("string")).alias("id"), F.col("_sw_input").alias("input"),
                 F.array("_sw_output", "_sw_role").alias("output")).alias("Instance"))
    return limit_instances(rows.withColumn("id", F.col("Instance.id")), subset, max_per_task, seed)


def choose_encoding(df: DataFrame, seed=DEFAULT_SEED, key: str = "id") -> DataFrame:
    """One of the five encodings per row, by md5 uniform."""
    lit = "array(" + ", ".join(
        f"named_struct('add_task_name', {str(a).lower()}, 'add_task_definition', {str(b).lower()}, "
        f"'num_pos_examples', {c}, 'num_neg_examples', {d}, 'add_explanation', {str(e).lower()})"
        for a, b, c, d, e in ENCODINGS) + ")"
    return df.withColumn("encoding", F.expr(f"element_at({lit}, cast({uniform_sql('5', seed, key)} as int) + 1)"))


def with_fixed_encoding(df: DataFrame, add_task_name=False, add_task_definition=True, num_pos_examples=2,
                        num_neg_examples=0, add_explanation=False) -> DataFrame:
    return df.withColumn("encoding", F.struct(F.lit(add_task_name).alias("add_task_name"),
                                              F.lit(add_task_definition).alias("add_task_definition"),
                                              F.lit(num_pos_examples).alias("num_pos_examples"),
                                              F.lit(num_neg_examples).alias("num_neg_examples"),
                                              F.lit(add_explanation).alias("add_explanation")))


def _sql_lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


PUNCT = _sql_lit(ASCII_PUNCTUATION)
STRIP = r"'^[\\s\\p{Z}]+|[\\s\\p{Z}]+$'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '')"


def _dot(x: str) -> str:
    """Append '.' unless the text already ends with ASCII punctuation. The text is bound as a lambda variable, once:
    nested calls that name it three times would make it three times each."""
    return f"transform(array({x}), v -> concat(v, IF(instr({PUNCT}, substr(v, -1, 1)) > 0 AND length(v) > 0, '', '.')))[0]"


def token_count_sql(text: str) -> str:
    """Tokens of a text under the engine's tokenizer: pieces + eos."""
    return f"(size(regexp_extract_all({text}, {_sql_lit(SPARK_PIECE_PATTERN)}, 2)) + 1)"


def _example_sql(kind: str, e: str, k: str, expl: str) -> str:
    head = _dot(f"concat(' {kind} Example ', cast({k} as string), ' -\\nInput: ', {_strip(e + '.input')})")
    body = _dot(f"concat({head}, '\\n', ' Output: ', {_strip(e + '.output')})")
    reason = f"concat({body}, '\\n', ' Explanation: ', {_strip(e + '.explanation')})"
    with_expl = f"IF({expl} AND {e}.explanation IS NOT NULL, concat({_dot(reason)}, '\\n'), concat({body}, '\\n'))"
    return f"concat({with_expl}, '\\n')"


def _fitting_sql(counts: str, used: str, limit: int) -> str:
    """Struct (used, n, stop): how many leading entries of ``counts`` fit into the limit after ``used``."""
    return (f"aggregate({counts}, named_struct('used', {used}, 'n', 0, 'stop', false), (s, c) -> "
            f"IF(s.stop OR s.used + c > {int(limit)}, named_struct('used', s.used, 'n', s.n, 'stop', true), "
            f"named_struct('used', s.used + c, 'n', s.n + 1, 'stop', false)))")


def _spelled_examples(d: DataFrame, strs: dict, max_source_length: int, vocab: DataFrame) -> DataFrame:
    """Accepted examples by the ids of the whole prompt, task name and eos included.

    Parts of a prompt meet at separators, so that their ids add up to those of the prompt."""
    from spanweave.operators.vocab import piece_counts, pieces
    d = d.withColumn("_sw_pos", F.expr(strs["Positive"])).withColumn("_sw_neg", F.expr(strs["Negative"]))
    parts = F.concat(F.array(F.concat("_sw_name", "_sw_def", "_sw_ti")), "_sw_pos", "_sw_neg")
    d = d.withColumn("_sw_n", piece_counts(vocab)(F.transform(parts, pieces)))
    for col, counts, used in (("_sw_fp", "slice(_sw_n, 2, size(_sw_pos))", "_sw_n[0] + 1"),
                              ("_sw_fn", "slice(_sw_n, size(_sw_pos) + 2, size(_sw_neg))", "_sw_fp.used")):
        d = d.withColumn(col, F.expr(_fitting_sql(counts, used, max_source_length)))
    d = d.withColumn("_sw_pos", F.expr("slice(_sw_pos, 1, _sw_fp.n)")).withColumn("_sw_neg", F.expr("slice(_sw_neg, 1, _sw_fn.n)"))
    return d.drop("_sw_n", "_sw_fp", "_sw_fn")


def render_instruction(df: DataFrame, max_source_length: int = 1024, out: str = "source",
                       vocab: DataFrame | None = None) -> DataFrame:
    """C8 + C9: prompt = [task name + '. '] + [definition] + positives + negatives + task input.

    Each example is added while the prompt built so far (definition, the
    accepted examples joined by a space, the candidate, the task input) has at
    most ``max_source_length`` tokens; the first failure stops that list.
    With ``vocab`` tokens are the ids of the whole prompt, spelled pieces and
    the task name included, so that examples go before the task input is cut;
    without it they are pieces, and the task name is not counted.
    """
    ti = _dot(f"concat('Now complete the following example -\\nInput: ', {_strip('Instance.input')})")
    ti = f"concat({ti}, '\\nOutput: ')"
    stated = f"concat('Definition: ', {_strip('`Definition`[0]')})"
    definition = f"IF(encoding.add_task_definition, concat({_dot(stated)}, '\\n\\n'), '')"
    d = df.withColumn("_sw_ti", F.expr(ti)).withColumn("_sw_def", F.expr(definition))
    d = d.withColumn("_sw_name", F.expr("IF(encoding.add_task_name, concat(Task, '. '), '')"))
    candidates = {kind: (f"transform(slice(coalesce({col}, array()), 1, {n}), (e, i) -> "
                         f"{_example_sql(kind, 'e', 'i + 1', 'encoding.add_explanation')})")
                  for kind, col, n in (("Positive", "`Positive Examples`", "encoding.num_pos_examples"),
                                       ("Negative", "`Negative Examples`", "encoding.num_neg_examples"))}
    if vocab is not None:
        d = _spelled_examples(d, candidates, max_source_length, vocab)
    for kind, strs in candidates.items() if vocab is None else ():
        prior = "array_join(_sw_pos, ' ')" if kind == "Negative" else "''"
        so_far = f"concat(_sw_def, {prior}, array_join(s.acc, ' '), c, _sw_ti)"
        fold = (f"aggregate({strs}, named_struct('acc', cast(array() as array<string>), 'stop', false), "
                f"(s, c) -> IF(s.stop, s, IF({token_count_sql(so_far)} "
                f"<= {int(max_source_length)}, named_struct('acc', concat(s.acc, array(c)), 'stop', false), "
                f"named_struct('acc', s.acc, 'stop', true))), s -> s.acc)")
        d = d.withColumn("_sw_pos" if kind == "Positive" else "_sw_neg", F.expr(fold))
    d = d.withColumn(out, F.expr("concat(_sw_name, _sw_def, array_join(_sw_pos, ''), array_join(_sw_neg, ''), _sw_ti)"))
    return d.drop("_sw_ti", "_sw_def", "_sw_name", "_sw_pos", "_sw_neg")


def choose_reference(df: DataFrame, seed=DEFAULT_SEED, key: str = "id", out: str = "target") -> DataFrame:
    """C11: one of the instance's reference outputs by md5 uniform; NULL when it has none."""
    n = "size(Instance.output)"
    pick = f"IF({n} > 0, element_at(Instance.output, cast({uniform_sql(n, seed, key, "'ref'")} as int) + 1), NULL)"
    return df.withColumn(out, F.expr(pick))


def source_tokens(text: str | Column) -> Column:
    """Pieces of a prompt (the units counted and truncated)."""
    from spanweave.operators.vocab import pieces
    return pieces(text)


def truncate_source(df: DataFrame, vocab: DataFrame, max_source_length: int = 1024, col: str = "source",
                    out: str = "source_text") -> DataFrame:
    """A prompt over the limit becomes the decoding of its first max tokens (specials skipped)."""
    from spanweave.operators.vocab import decode, piece_ids
    lookup = piece_ids(vocab)
    d = df.withColumn("_sw_ids", F.concat(lookup(source_tokens(col)), F.array(F.lit(1))))
    d = d.withColumn("_sw_cut", F.slice("_sw_ids", 1, max_source_length))
    d = decode(d, "_sw_cut", vocab, "_sw_dec")
    return (d.withColumn(out, F.when(F.size("_sw_ids") <= max_source_length, F.col(col)).otherwise(F.col("_sw_dec")))
             .drop("_sw_ids", "_sw_cut", "_sw_dec"))
