"""Two-level scans, packing without group loss, artifacts with several writers, bounded shuffles."""

import random
import threading

from pyspark.sql import functions as F

from spanweave.functions.rank import running_scan
from spanweave.operators.pack import pack_corpus
from spanweave.operators.runlog import early_stop
from spanweave.operators.split import buffer_shuffle, shuffle_through
from spanweave.sources.tables import cached, expire_cache
from spanweave.streaming import streams as ST


def stopped_by_hand(values, patience, threshold):
    best, bad = None, 0
    for step, v in enumerate(values):
        if best is None or (v > best and abs(v - best) > threshold):
            bad = 0
        else:
            bad += 1
        best = v if best is None else max(best, v)
        if bad >= patience:
            return step
    return None


def test_early_stop_matches_a_loop(spark):
    rng = random.Random(2)
    runs = {f"r{k}": [rng.choice([0.0, 1.0, 2.0, k + rng.random()]) for _ in range(rng.choice([1, 3, 40, 200]))] for k in range(20)}
    runs[None] = [3.0, 2.0, 1.0, 0.0]
    rows = [(run, s, "acc", v) for run, vs in runs.items() for s, v in enumerate(vs)]
    got = {r["run"]: (r["stopped_at_step"], r["n_evals"]) for r in early_stop(
        spark.createDataFrame(rows, "run string, step bigint, name string, value double"), "acc", 3, 0.5).collect()}
    assert got == {run: (stopped_by_hand(vs, 3, 0.5), len(vs)) for run, vs in runs.items()}


def test_one_run_of_a_million_steps(spark):
    """No window holds the run: every partition of the scan has a share of it."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("one").alias("run"), F.col("id").alias("step"), F.lit("acc").alias("name"),
                               F.when(F.col("id") <= 900_000, F.col("id").cast("double")).otherwise(0.0).alias("value"))
    assert early_stop(df, "acc", 5).first()["stopped_at_step"] == 900_005
    scan = running_scan(df.select("run", "step", "value"), ["run"], ["step"], F.col("value"), F.max, "best", num_partitions=8)
    assert scan.where(F.col("best") != F.least(F.col("step"), F.lit(900_000))).count() == 0
    plan = scan._jdf.queryExecution().toString()
    assert "windowspecdefinition(_sw_pid" in plan and "windowspecdefinition(run#" not in plan.split("_sw_part")[0]


def test_pack_corpus_loses_the_last_remainder_only(spark):
    rng = random.Random(5)
    docs = [(k, [rng.randrange(100) for _ in range(rng.choice([0, 1, 3, 9, 50, 400]))]) for k in range(60)]
    rows, rest = pack_corpus(spark.createDataFrame(docs, "d bigint, ids array<int>").repartition(5), "ids", 16, "d")
    flat = [x for _, ids in docs for x in ids]
    got = rows.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(len(flat) // 16))
    assert [x for r in got for x in r["input_ids"]] == flat[:len(flat) // 16 * 16]
    assert [x for r in rest.collect() for x in r["input_ids"]] == flat[len(flat) // 16 * 16:]
    empty = spark.createDataFrame([], "d bigint, ids array<int>")
    assert [d.count() for d in pack_corpus(empty, "ids", 16, "d")] == [0, 0]


def test_stream_carries_ids_between_batches(spark, tmp_path):
    from spanweave.operators.vocab import build_vocab, encode_ids
    docs = [(k, " ".join(f"w{(k * j) % 7}" for j in range(k % 11)) if k % 5 else None) for k in range(40)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for k in range(0, 40, 8):
        part = spark.createDataFrame([(d, t, "x", "s", 1) for d, t in docs[k:k + 8]], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    vocab = build_vocab(spark.createDataFrame(docs, "doc_id bigint, text string"))
    out = str(tmp_path / "out")

    def run():
        stream = ST.stream_corpus(spark, str(tmp_path / "in"), max_files_per_trigger=1)
        ST.stream_pack_whole(spark, stream, vocab, out, 16)
        return [r["input_ids"] for r in spark.read.schema("row bigint, input_ids array<int>").parquet(out).orderBy("row").collect()]
    got = run()
    assert len(ST.batch_folders(spark, out)) == 5
    ids = encode_ids(spark.createDataFrame([d for d in docs if d[1] is not None], "doc_id bigint, text string"), "text", vocab)
    flat = [x for r in ids.orderBy("doc_id").collect() for x in r["ids"]]
    want = [flat[k:k + 16] for k in range(0, len(flat) // 16 * 16, 16)]
    assert got == want and run() == want


def test_two_writers_of_one_artifact(spark, tmp_path):
    built, start = [], threading.Barrier(2)

    def build(mark):
        def make():
            start.wait(60)
            built.append(mark)
            return spark.range(100).withColumn("by", F.lit(mark))
        return make
    got = {}
    threads = [threading.Thread(target=lambda m=m: got.update({m: cached(spark, {"a": 1}, build(m), root=str(tmp_path)).collect()}))
               for m in ("x", "y")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(built) == ["x", "y"] and all(len(rows) == 100 and len({r["by"] for r in rows}) == 1 for rows in got.values())
    first = cached(spark, {"a": 1}, lambda: 1 / 0, root=str(tmp_path)).collect()
    assert first == cached(spark, {"a": 1}, lambda: 1 / 0, root=str(tmp_path)).collect()
    assert expire_cache(spark, 3600, root=str(tmp_path)) == 0
    assert expire_cache(spark, -60, root=str(tmp_path)) == 2
    assert cached(spark, {"a": 1}, lambda: spark.range(3), root=str(tmp_path)).count() == 3


def test_buffer_shuffle_is_a_bounded_permutation(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    got = buffer_shuffle(df, ["k"], "k", buffer=64).collect()
    assert sorted(r["shuffle_idx"] for r in got) == list(range(1000))
    assert all(r["shuffle_idx"] // 64 == r["k"] // 64 for r in got) and any(r["shuffle_idx"] != r["k"] for r in got)


def through_by_hand(n, buffer, slot_of):
    """Indexes in the order in which a shuffle buffer gives them out, without the rest; and the rest."""
    slots, left = {}, []
    for i in range(n):
        slot = i if i < buffer else slot_of[i]
        if i >= buffer:
            left.append(slots[slot])
        slots[slot] = i
    return left, set(slots.values())


def test_shuffle_buffer_matches_a_loop(spark):
    from spanweave.functions.rank import uniform
    for n, buffer in ((0, 8), (5, 8), (9, 8), (500, 32)):
        slot_of = {r["id"]: r["s"] for r in spark.range(n).select("id", uniform(buffer, 42, "id").alias("s")).collect()}
        left, rest = through_by_hand(n, buffer, slot_of)
        df = spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("slot"))
        got = sorted((r["shuffle_idx"], r["k"]) for r in shuffle_through(df, ["k"], buffer).collect())
        assert [i for i, _ in got] == list(range(n))
        assert [k for _, k in got][:len(left)] == left and {k for _, k in got[len(left):]} == rest
        assert all(i >= k - buffer for i, k in got)


def test_stream_shuffle_crosses_batches_and_restarts(spark, tmp_path):
    rows = [(k if k % 7 else None, f"t{k % 3}") for k in range(300)]
    df = spark.createDataFrame([(p, *r) for p, r in enumerate(rows)], "pos bigint, k bigint, t string")
    want = {(r["shuffle_idx"], r["pos"], r["k"], r["t"]) for r in shuffle_through(df, ["pos"], 40).collect()}

    def run(name, cuts):
        src, out = str(tmp_path / f"{name}-in"), str(tmp_path / name)
        for lo, hi in zip([0, *cuts], [*cuts, 300]):
            df.where((F.col("pos") >= lo) & (F.col("pos") < hi)).coalesce(1).write.mode("append").parquet(src)
            ST.stream_shuffle(spark, spark.readStream.schema(df.schema).parquet(src), ["pos"], out, 40)
        return out
    for name, cuts in (("a", [10, 55, 200]), ("b", [299])):
        out = run(name, cuts)
        got = ST.read_shuffled(spark, out, df.schema)
        assert got.columns == ["pos", "k", "t", "shuffle_idx"]
        assert {tuple(r[c] for c in ("shuffle_idx", "pos", "k", "t")) for r in got.collect()} == want
        part = {r["shuffle_idx"] for r in ST.read_shuffled(spark, out, df.schema, ended=False).collect()}
        assert part == set(range(260))
    # rows of an earlier batch leave after rows of a later one
    place = {pos: i for i, pos, _, _ in want}
    assert max(place[p] for p in range(55, 200)) > min(place[p] for p in range(200, 300))
    assert ST.read_shuffled(spark, str(tmp_path / "none"), df.schema).count() == 0
