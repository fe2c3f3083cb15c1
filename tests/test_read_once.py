"""Steps that need their rows twice make them once, and no step gathers all rows by a few keys."""

import pytest
from pyspark.sql import functions as F

from spanweave.operators import instructions as IN, metrics as M, pack as P, vocab as V
from spanweave.operators.udf import collate
from spanweave.plans import catalog as C
from spanweave.streaming import streams as ST


def counted(df, name):
    """``df`` with column ``name`` passed through a helper, and the number of rows that it saw."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    @F.arrow_udf("array<int>")
    def same(col):
        seen.add(len(col))
        return col
    return df.withColumn(name, same(name)), seen


def predictions(spark, n):
    rows = [(k, 0, f"{k}:0", "ab"[k % 2], [0, 5 + k % 3, 7], [5, 7, -100]) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, chunk int, row_key string, task string, pred array<int>, labels array<int>")


@pytest.mark.parametrize("group", [None, ["task"]])
def test_aligned_predictions_are_made_once(spark, group):
    df, seen = counted(predictions(spark, 40), "pred")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = M.align_predictions(df, group=group)
        got = {r["doc_id"]: (list(r["pred"]), list(r["labels"])) for r in d.collect()}
        assert seen.value == 40
        assert got == {k: ([5 + k % 3, 7, 0], [5, 7, 0]) for k in range(40)}
        # two groups: a shuffle by group would leave all rows to two tasks
        assert "hashpartitioning(task" not in d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_task_metrics_read_predictions_once(spark):
    from spanweave.plans.surfaces import lead_parts
    M.register_row_metric("lead", lead_parts, lambda right, kept: right / kept)
    try:
        df, seen = counted(predictions(spark, 40), "pred")
        got = {(r["task"], r["metric"]): r["value"] for r in M.token_metrics(df, ["task"], metric_names=["lead", "accuracy"]).collect()}
        assert seen.value == 40 and len(got) == 6
        right = sum(k % 3 == 0 for k in range(0, 40, 2))
        assert got["a", "token_accuracy"] == pytest.approx((20 + right) / 40)
        assert got["a", "row_lead"] == pytest.approx(2 * right / 40)
    finally:
        M.ROW_METRICS.pop("lead")


def test_repeated_predictions_are_trimmed_from_stored_ones(spark, monkeypatch):
    df, seen = counted(predictions(spark, 50).drop("task"), "pred")
    monkeypatch.setattr(C.EV, "predictions", lambda spark, sf: df)
    got = C.dedup_predictions(spark, "unused").collect()
    assert seen.value == 50 and sorted(r["doc_id"] for r in got) == list(range(50))


def test_packed_ids_are_made_once(spark):
    docs = spark.createDataFrame([(k, [10 + k] * (k % 4)) for k in range(30)], "doc_idx bigint, ids array<int>")
    df, seen = counted(docs, "ids")
    rows, rest = P.pack_corpus(df, "ids", 8, "doc_idx")
    flat = [10 + k for k in range(30) for _ in range(k % 4)]
    assert [list(r["input_ids"]) for r in rows.orderBy("row").collect()] == [flat[i:i + 8] for i in range(0, len(flat) - 7, 8)]
    assert list(rest.first()["input_ids"]) == flat[len(flat) // 8 * 8:]
    assert seen.value == 30


def test_stream_encodes_a_batch_once(spark, tmp_path, monkeypatch):
    from spanweave.functions.masks import plan_lengths
    raw, target = plan_lengths(16, 0.15, 3.0)
    rows = [(k, "alpha beta gamma delta epsilon " * 3) for k in range(20)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(src)
    vocab = V.build_vocab(spark.read.parquet(src), "text", subwords=[])
    seen = []

    def encode_ids(df, text_col, vocab, out="ids"):
        d, n = counted(V.encode_ids(df, text_col, vocab, out), out)
        seen.append(n)
        return d
    monkeypatch.setattr(ST, "encode_ids", encode_ids)
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(src)
    out = ST.stream_pack_corrupt(spark, stream, vocab, str(tmp_path / "out"), raw, 16, target, group_docs=8)
    assert spark.read.parquet(out).count() > 0
    assert [n.value for n in seen] == [20]


def test_prompt_parts_stand_once_in_a_branch():
    made = IN._example_sql("Positive", "e", "1", "true")
    # one for each branch of the explanation
    assert made.count("e.input") == made.count("e.output") == 2


def test_dot_is_appended_once(spark):
    df = spark.createDataFrame([("a",), ("b.",), ("",), (None,), ("c ",), ("d。",)], "x string")
    got = [r[0] for r in df.select(F.expr(IN._dot("x"))).collect()]
    assert got == ["a.", "b.", ".", None, "c .", "d。."]


def test_instructions_are_collated_by_many_tasks(spark):
    turns = spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], f"turn {t} of {c}") for c in range(6) for t in range(5)],
                                  "conv_id bigint, turn int, role string, text string")
    vocab = V.build_vocab(turns, "text", subwords=[])
    e = IN.with_fixed_encoding(IN.instances_of_turns(turns, subset="test"), num_pos_examples=2)
    out = collate(e, "instruction", vocab=vocab, max_source_length=64, max_target_length=16)
    assert out.count() >= 24
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_decoded_ids_at_the_edges(spark):
    vocab = V.build_vocab(spark.createDataFrame([("ab cd ab",)], "text string"), "text", subwords=[])
    ids = {r["piece"]: r["id"] for r in vocab.collect()}
    word, mark = ids["▁ab"], [3 + b for b in "é".encode()]
    rows = [(0, None), (1, []), (2, [word, -100, 0, 1, 2, 32099, None, 31_000]), (3, mark + [word]), (4, [mark[0], word])]
    d = V.decode(spark.createDataFrame(rows, "k int, ids array<int>"), "ids", vocab, "text")
    assert {r["k"]: r["text"] for r in d.collect()} == {0: None, 1: "", 2: "ab", 3: "é ab", 4: "� ab"}
