"""Token-type compaction (E12), metric registry (J3), batch map (J2), B9 length check."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.functions.arrays import check_length, corrupt_token_types_sql, fit_length_sql
from spanweave.operators import metrics as M
from spanweave.operators.udf import map_batches


def test_token_types_follow_input_compaction(spark):
    # sentinels of mask 0 1 1 0 0 -> continuation at position 2 is deleted
    df = spark.createDataFrame([([1, 1, 2, 2, 0], [0, 32099, -1, 0, 0])], "t array<int>, s array<int>")
    got = df.select(F.expr(fit_length_sql(corrupt_token_types_sql("t", "s"), 5)).alias("x")).collect()[0]["x"]
    assert got == [1, 1, 2, 0, 0]


def test_registered_metric(spark):
    M.register_metric("hits", lambda: F.sum(F.when(F.col("l") == F.col("p"), F.col("c")).otherwise(0)))
    try:
        df = spark.createDataFrame([([0, 5, 6, 7], [5, 6, 9, 1])], "pred array<int>, labels array<int>")
        out = {r["metric"]: r["value"] for r in M.token_metrics(df).collect()}
        # aligned prediction = 5 6 7 0 against labels 5 6 9 1: kept positions 5 6 9
        assert out["token_hits"] == 2.0
        assert out["token_accuracy"] == pytest.approx(2 / 3)
        assert out["example_accuracy"] == 0.0
    finally:
        M.METRICS.pop("hits", None)


def test_map_batches(spark):
    df = spark.range(10).select(F.col("id").cast("int").alias("x"))

    def double(b):
        return pa.RecordBatch.from_arrays([pa.compute.multiply(b.column(0), 2).cast(pa.int32())], names=["y"])

    assert sorted(r["y"] for r in map_batches(df, double, "y int").collect()) == [2 * i for i in range(10)]


def test_check_length_raises(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert df.select(check_length("a", 3)).collect()[0][0] == [1, 2, 3]
    with pytest.raises(Exception):
        df.select(check_length("a", 4)).collect()


def test_unknown_pieces_are_spelled(spark):
    from spanweave.operators.vocab import build_vocab, encode
    corpus = spark.createDataFrame([(1, "aa bb aa"), (2, "abc, aa")], "k int, text string")
    # 3 special ids, 256 bytes, 5 given subwords (marker, a, b, c and the comma), the most frequent longer piece, 100 sentinels
    vocab = build_vocab(corpus, "text", size=365, subwords=["\u2581", "a", "b", "c", ","])
    pieces = {r["piece"] for r in vocab.collect()}
    assert {"a", "b", "c", ",", "\u2581", "\u2581aa"} <= pieces and "\u2581abc" not in pieces
    ids = encode(corpus, "text", vocab, 16, size=365)
    assert all(2 not in r["input_ids"] for r in ids.collect())


def test_masked_loss_is_linear_in_classes(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from spanweave.operators.metrics import masked_nll_parts
    n = 32_100
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(3, n)).astype(float)
    df = spark.createDataFrame([(logits.tolist(), [5, -100, 7])], "logits array<array<double>>, labels array<int>")
    total, count = masked_nll_parts()
    got = df.select(total.alias("t"), count.alias("c")).first()
    want = sum(np.log(np.exp(logits[i]).sum()) - logits[i][label] for i, label in ((0, 5), (2, 7)))
    assert got["c"] == 2 and abs(got["t"] - want) < 1e-6


def test_dialogue_of_twelve_turns_keeps_them_all(spark):
    from spanweave.plans.tasks import dialogue_rows
    turns = spark.createDataFrame([(1, k, f"t{k}") for k in range(12)], "conv_id int, turn int, text string")
    rows = dialogue_rows(turns).orderBy("part").collect()
    assert [r["part"] for r in rows] == [0, 1]
    assert [r[f"t{k}"] for r in rows for k in range(8)] == [f"t{k}" for k in range(12)] + [None] * 4


def test_stream_take_over_several_batches(spark, tmp_path):
    from spanweave.streaming.streams import stream_take
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):   # the second run finds nothing new and adds nothing
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(src)
        stream_take(spark, stream, 25, "id", out)
        assert spark.read.parquet(out).count() == 25


def test_stream_stats_over_several_batches_and_a_restart(spark, tmp_path):
    from spanweave.operators.runlog import average_stats, report_intervals
    from spanweave.streaming.streams import read_stats, stream_stats
    src, out = str(tmp_path / "log"), str(tmp_path / "stats")
    schema = "run string, prefix string, step bigint, name string, value double"
    rows = [("r", "training", k, "loss", float(k * k % 7)) for k in range(1, 26)]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        stream_stats(spark, stream, 10, out, weight=0.9)

    for lo in (0, 8, 16):   # intervals of ten steps grow over batches
        spark.createDataFrame(rows[lo:lo + 8], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame(rows[24:], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    want = average_stats(report_intervals(spark.createDataFrame(rows, schema), 10), weight=0.9)
    want = {r["interval"]: (round(r["average"], 9), r["n_updates"]) for r in want.collect()}
    got = {r["interval"]: (round(r["average"], 9), r["n_updates"]) for r in read_stats(spark, out).collect()}
    assert got == want and len(got) == 3
    changed = spark.read.parquet(out).groupBy("batch_id").count().collect()
    assert max(r["count"] for r in changed) <= 2   # a batch writes what it changed, not the whole table


def test_read_stats_before_any_batch(spark, tmp_path):
    from spanweave.streaming.streams import read_stats
    assert read_stats(spark, str(tmp_path / "none")).count() == 0


def test_stream_pack_over_several_files_equals_batch_groups(spark, tmp_path):
    from spanweave.functions.masks import plan_lengths
    from spanweave.operators.pack import pack_tokens
    from spanweave.operators.vocab import build_vocab, encode_ids
    from spanweave.streaming.streams import GROUPS_PER_BATCH, stream_pack_corrupt
    docs = [(k, " ".join(f"w{(k * j) % 5}" for j in range(12))) for k in range(24)]
    vocab = build_vocab(spark.createDataFrame(docs, "doc_id bigint, text string"), "text")
    src, out = str(tmp_path / "docs"), str(tmp_path / "packed")
    raw, target = plan_lengths(16, 0.15)
    seen = []
    for lo in range(0, 24, 12):   # a second call goes on with the new file only
        part = spark.createDataFrame(docs[lo:lo + 12], "doc_id bigint, text string")
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(src)
        stream_pack_corrupt(spark, stream, vocab, out, raw, 16, target, group_docs=4)
        ids = encode_ids(part, "text", vocab).withColumn(
            "pack_group", F.floor((F.col("doc_id") - lo) / 4).cast("bigint") + F.lit(lo // 12 * GROUPS_PER_BATCH))
        seen += [(r["pack_group"], r["row"]) for r in pack_tokens(ids, "ids", raw, "pack_group", "doc_id").collect()]
    got = [(r["pack_group"], r["row"]) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(seen) and len({g for g, _ in got}) == 6


def test_metrics_by_task_align_each_task_and_need_a_record(spark):
    rows = [("cola", [0, 5, 6], [5, 6, 9]), ("sst2", [5, 6, 7], [5, 6, 8])]
    df = spark.createDataFrame(rows, "task string, pred array<int>, labels array<int>")
    got = {(r["task"], r["metric"]): r["value"] for r in M.metrics_by_task(df).collect()}
    # cola starts with pad and moves to 5 6 0; sst2 does not and stays; only cola lists mcc
    assert got["cola", "token_accuracy"] == got["sst2", "token_accuracy"] == pytest.approx(2 / 3)
    assert ("cola", "token_mcc") in got and ("sst2", "token_mcc") not in got and ("sst2", "token_pearson") not in got
    with pytest.raises(Exception, match="no record of task other"):
        M.metrics_by_task(df.withColumn("task", F.lit("other"))).collect()
    with pytest.raises(KeyError):
        M.token_metrics(df, metric_names=["nothing"])


def test_instruction_files_take_texts_and_lists_as_definition(spark, tmp_path):
    import json
    from spanweave.operators.instructions import read_instruction_tasks
    for name, definition in (("a", "Say it."), ("b", ["Say [it]."]), ("c", "[not a list"), ("d", ["unused"])):
        task = {"Task": name, "Definition": definition, "Instances": [
            {"id": f"{name}-{k}", "input": "x", "output": ["y"]} for k in range(120)]}
        (tmp_path / f"{name}.json").write_text(json.dumps(task, indent=1))
    names = tmp_path / "names.txt"
    names.write_text("a\nb\n\nc\nc\n")
    d = read_instruction_tasks(spark, str(names), str(tmp_path / "*.json"), subset="test")
    got = d.groupBy("task_name", F.col("Definition")[0].alias("d")).count().collect()
    assert {(r["task_name"], r["d"], r["count"]) for r in got} == {("a", "Say it.", 100), ("b", "Say [it].", 100),
                                                                    ("c", "[not a list", 100)}
    few = read_instruction_tasks(spark, str(names), str(tmp_path / "*.json"), max_per_task=7)
    assert few.count() == 21


def test_collated_instructions_keep_task_input_and_whole_target(spark):
    from spanweave.operators.instructions import TASK_SCHEMA, explode_instances, with_fixed_encoding
    from spanweave.operators.udf import collate
    from spanweave.operators.vocab import build_vocab, encode_ids
    vocab = build_vocab(spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz ABCDEFGINOP .:- 0123456789")], "k int, text string"), "text",
                        subwords=[])
    # every word is spelled, so ids are several times the pieces
    reply = " ".join(f"reply{k}" for k in range(40))
    example = {"input": "some words " * 8, "output": "other words " * 8, "explanation": "why"}
    task = {"Task": "task1", "Definition": ["Say it"], "Positive Examples": [example] * 2, "Negative Examples": [example] * 2,
            "Instances": [{"id": "a", "input": "the question", "output": [reply]}]}
    tasks = spark.createDataFrame([task], TASK_SCHEMA)
    e = with_fixed_encoding(explode_instances(tasks), True, True, 2, 2, True)
    rows = collate(e, "instruction", vocab=vocab, max_source_length=512, max_target_length=64).collect()

    def ids(text):
        return encode_ids(spark.createDataFrame([(text,)], "t string"), "t", vocab, add_eos=False).first()["ids"]
    assert {r["source_chunk"] for r in rows} == {0} and len(rows) > 3
    source = [x for x in rows[0]["input_ids"] if x][:-1]
    assert source == ids(rows[0]["source"]) and rows[0]["source"].endswith("Input: the question.\nOutput: ")
    assert "Positive Example 1" in rows[0]["source"] and "Positive Example 2" not in rows[0]["source"]
    rows.sort(key=lambda r: r["target_chunk"])
    assert [x for r in rows for x in r["labels"] if x not in (1, -100)] == ids(reply)
    tight = collate(e, "instruction", vocab=vocab, max_source_length=20, max_target_length=64).collect()
    parts = {r["source_chunk"]: [x for x in r["input_ids"] if x > 1] for r in tight}
    assert "Example 1" not in tight[0]["source"] and [x for k in sorted(parts) for x in parts[k]] == ids(tight[0]["source"])


def test_all_batches_are_evaluated(spark):
    from spanweave.plans import catalog as C
    from tests.conftest import SF_SMALL
    n = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").selectExpr("count(distinct vec_id div 32)").first()[0]
    assert n > 9 and C.QUERIES["eval_all_batches"](spark, SF_SMALL).first()["n_batches"] == n


def test_instances_joined_from_turns_equal_those_of_nested_tasks(spark, tmp_path):
    from spanweave.operators.instructions import MAX_EXAMPLES, explode_instances, instances_of_turns
    from spanweave.plans.instructions import instruction_tasks
    rows = [(c, t, "user" if t % 2 else "bot", None if (c or 0) == 3 and t == 4 else f"{c} says {t}")
            for c in (1, 2, 3, None) for t in range(0, 2 + 3 * (c or 4), 2)]
    rows += [(7, 0, "bot", "alone"), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 2, "bot", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    nested = explode_instances(instruction_tasks(spark, str(tmp_path)), max_examples=MAX_EXAMPLES)
    joined = instances_of_turns(turns)
    key = lambda r: repr(r)
    names = ["Task", "Definition", "Positive Examples", "Negative Examples", "instance_pos", "Instance", "id"]
    want, got = (sorted(map(key, x.select(*[f"`{n}`" for n in names]).collect())) for x in (nested, joined))
    assert got == want and len(got) > 15
    assert instances_of_turns(turns.limit(0)).count() == 0


def test_instances_of_a_very_long_conversation(spark):
    from pyspark.sql import functions as F
    from spanweave.operators.instructions import instances_of_turns
    n = 100_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                  F.concat(F.lit("turn "), "id", F.repeat(F.lit(" word"), 20)).alias("text"))
    d = instances_of_turns(turns)
    shape = d.agg(F.count(F.lit(1)), F.max(F.size("Positive Examples")), F.countDistinct("id"), F.max("instance_pos"),
                  F.sum((F.split("`Instance`.`input`", " ")[1].cast("int") == F.col("instance_pos")).cast("int"))).first()
    assert tuple(shape) == (n - 1, 2, n - 1, n - 2, n - 1)
