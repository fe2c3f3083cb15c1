"""Streaming pipelines.

Sources are file streams with declared schemas (never inferred). A sink keeps its
checkpoint next to its output folder: a query started again with the same folder goes
on where it stopped, and a batch that runs twice replaces its own rows. ``trigger(availableNow=True)`` drains what is
there and stops, which is also how the tests drive them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from spanweave.constants import DEFAULT_SEED
from spanweave.functions.rank import dense_index
from spanweave.operators.corrupt import corrupt, corrupt_complement
from spanweave.operators.pack import pack_corpus, pack_tokens
from spanweave.operators.runlog import report_intervals
from spanweave.operators.split import buffer_pass, buffer_rest, buffer_shuffle
from spanweave.operators.vocab import encode, encode_ids
from spanweave.sources.tables import scratch_path, stored  # noqa: F401  (folders of stream sinks)

DOCUMENT_SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                              StructField("lang", StringType()), StructField("source", StringType()),
                              StructField("n_chars", LongType())])


#: Numbers of pack groups that a micro-batch has to itself.
GROUPS_PER_BATCH = 1 << 32


def batch_folder(out: str, batch_id: int) -> str:
    """Where a micro-batch writes: a folder of its own, so that a retried batch replaces its rows."""
    return f"{out}/batch_id={batch_id}"


def batch_folders(spark: SparkSession, out: str) -> list[str]:
    """Folders of the micro-batches written so far."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/batch_id=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def count_input_files(spark: SparkSession, pattern: str) -> int:
    """Number of files matching a glob (the shard count of a file stream)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    statuses = path.getFileSystem(conf).globStatus(path)
    return 0 if statuses is None else len(statuses)


def stream_corpus(spark: SparkSession, pattern: str, schema: StructType = DOCUMENT_SCHEMA,
                  drop=(), expected_shards: int | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A4: lazy file stream with a declared schema; drops columns; checks the shard count."""
    if expected_shards is not None:
        n = count_input_files(spark, pattern)
        if n != expected_shards:
            raise ValueError(f"expected {expected_shards} input shards, found {n}")
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.parquet(pattern)
    missing = [c for c in drop if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return df.drop(*drop)


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def stream_encode_corrupt(spark: SparkSession, stream: DataFrame, vocab: DataFrame, out: str,
                          max_len: int = 128, input_length: int = 128, target_length: int = 32,
                          density: float = 0.15) -> str:
    """Stream -> whole-text encoding -> span corruption -> parquet features.

    Stateless and row-local; seeded by (doc_id, chunk), so the output equals
    the batch pipeline on the same files regardless of micro-batch sizes.
    """
    enc = encode(stream.select("doc_id", "text"), "text", vocab, max_len, overflow="chunk")
    enc = (enc.withColumn("chunk", F.col("chunk").cast("int"))
              .withColumn("row_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string"))))
    feats = corrupt(enc.drop("text"), "row_key", input_length, target_length, density=density)
    q = (feats.select("doc_id", "chunk", "input_ids", "labels", "decoder_input_ids", "attention_mask")
              .writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start())
    _run(q)
    return out


def stream_pack_corrupt(spark: SparkSession, stream: DataFrame, vocab: DataFrame, out: str,
                        raw_length: int, input_length: int, target_length: int, density: float = 0.15,
                        buffer: int = 10_000, group_docs: int = 64) -> str:
    """Per micro-batch: pack in groups of ``group_docs`` documents (remainder dropped, as the
    reference's map batches) -> buffer shuffle (F2) -> complement corruption (E17).

    Groups are numbered ``batch_id * GROUPS_PER_BATCH`` upwards, so they spread over the cluster and
    the rows of a batch do not depend on how it is partitioned."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        docs = dense_index(batch.select("doc_id", "text"), ["doc_id"], "_sw_doc")
        group = F.floor(F.col("_sw_doc") / group_docs) + F.lit(batch_id * GROUPS_PER_BATCH)
        ids = encode_ids(docs.withColumn("pack_group", group.cast("bigint")), "text", vocab)
        # the shuffle numbers the rows and then reads them again
        packed = stored(pack_tokens(ids, "ids", raw_length, "pack_group", "_sw_doc"), "packed")
        packed = packed.withColumn("row_key", F.concat_ws(":", F.col("pack_group").cast("string"),
                                                          F.col("row").cast("string")))
        shuffled = buffer_shuffle(packed, ["pack_group", "row"], "row_key", buffer=buffer)
        feats = corrupt_complement(shuffled, "row_key", input_length, target_length, density=density)
        feats.select("pack_group", "row", "shuffle_idx", "input_ids", "labels").write.mode("overwrite").parquet(
            batch_folder(out, batch_id))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", out + "-checkpoint")
               .trigger(availableNow=True).start())
    _run(q)
    return out


def stream_pack_whole(spark: SparkSession, stream: DataFrame, vocab: DataFrame, out: str, raw_length: int) -> str:
    """I2 without loss: every micro-batch goes on with the ids that the batch before it left over.

    A batch packs the carried ids and its own documents (in ``doc_id`` order) as one sequence; full rows are numbered on from
    the batch before, and the ids that do not fill a row (fewer than ``raw_length``) are written beside
    them for the next one. What a batch reads is what an earlier batch wrote, so a batch that runs again
    writes the same rows. Only the end of the whole stream does not fill a row; it stays in ``<out>-carry``."""
    carry = out + "-carry"
    schema = "row bigint, input_ids array<int>"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        earlier = [p for p in batch_folders(spark, carry) if int(p.rpartition("=")[2]) < batch_id]
        last = max(earlier, key=lambda p: int(p.rpartition("=")[2]), default=None)
        left = spark.read.schema(schema).parquet(last) if last else spark.createDataFrame([], schema)
        held = left.first()
        first = held["row"] if held else 0
        docs = dense_index(batch.select("doc_id", "text").where("text is not null"), ["doc_id"], "_sw_doc")
        ids = encode_ids(docs, "text", vocab).select("_sw_doc", "ids")
        ids = ids.unionByName(left.select(F.lit(-1).cast("bigint").alias("_sw_doc"), F.col("input_ids").alias("ids")))
        rows, rest = pack_corpus(ids, "ids", raw_length, "_sw_doc", first=first)
        folder = batch_folder(out, batch_id)
        rows.write.mode("overwrite").parquet(folder)
        done = spark.read.schema(schema).parquet(folder).agg(F.coalesce(F.max("row") + 1, F.lit(first))).first()[0]
        nothing = spark.createDataFrame([(done, [])], schema)
        rest = rest.unionByName(nothing).agg(F.max("row").alias("row"), F.flatten(F.collect_list("input_ids")).alias("input_ids"))
        rest.write.mode("overwrite").parquet(batch_folder(carry, batch_id))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", out + "-checkpoint")
               .trigger(availableNow=True).start())
    _run(q)
    return out


def _buffered(spark: SparkSession, schema: StructType, *folders: str) -> DataFrame:
    """Rows of written micro-batches of ``stream_shuffle``; ``_sw_held`` tells those that stayed in the buffer."""
    written = StructType([*schema.fields, StructField("_sw_idx", LongType()), StructField("shuffle_idx", LongType()),
                          StructField("_sw_held", BooleanType())])
    parts = [spark.read.schema(written).option("basePath", f).parquet(f) for f in folders]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], written)


def stream_shuffle(spark: SparkSession, stream: DataFrame, order_cols: list, out: str, buffer: int = 10_000,
                   seed=DEFAULT_SEED) -> str:
    """F2 on a stream: a shuffle buffer that lives on from micro-batch to micro-batch.

    A batch's rows (in ``order_cols`` order) arrive after those of the batches before it, meet the rows that the last batch
    left in the buffer (at most ``buffer``), and drive them out. Its folder holds the rows that left, with their
    place, and beside them the buffer as it stands then, both in one write. What a batch reads
    is what an earlier one wrote, so a batch that runs again, and a stream that is started again, goes on in
    the same order. The order depends on the order of arrival alone, not on where batches end.
    ``read_shuffled`` gives the rows."""
    schema = stream.schema

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        earlier = [p for p in batch_folders(spark, out) if int(p.rpartition("=")[2]) < batch_id]
        last = max(earlier, key=lambda p: int(p.rpartition("=")[2]), default=None)
        held = _buffered(spark, schema, *([last] if last else [])).where("_sw_held").drop("shuffle_idx", "_sw_held")
        # the row that arrived last is always in the buffer
        first = held.agg(F.coalesce(F.max("_sw_idx") + 1, F.lit(0))).first()[0]
        rows = dense_index(batch, order_cols, "_sw_idx").withColumn("_sw_idx", F.col("_sw_idx") + first)
        passed = buffer_pass(held.unionByName(rows), "_sw_idx", buffer, seed)
        (passed.withColumn("_sw_held", F.col("shuffle_idx").isNull())
               .write.mode("overwrite").partitionBy("_sw_held").parquet(batch_folder(out, batch_id)))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", out + "-checkpoint")
               .trigger(availableNow=True).start())
    _run(q)
    return out


def read_shuffled(spark: SparkSession, out: str, schema: StructType, ended: bool = True, seed=DEFAULT_SEED) -> DataFrame:
    """Rows of ``stream_shuffle`` with their place ``shuffle_idx``: all that left the buffer, and, if the stream has
    ``ended``, the rows that still stand in it behind them."""
    folders = sorted(batch_folders(spark, out), key=lambda p: int(p.rpartition("=")[2]))
    left = _buffered(spark, schema, *folders).where("not _sw_held")
    if ended:
        held = _buffered(spark, schema, *folders[-1:]).where("_sw_held")
        left = left.unionByName(buffer_rest(held, "_sw_idx", seed))
    return left.drop("_sw_idx", "_sw_held")


def stream_take(spark: SparkSession, stream: DataFrame, n: int, order: str, out: str) -> str:
    """Keep the first n rows of the stream (in ``order`` inside each micro-batch), then
    write nothing more. What earlier batches wrote is counted from their folders (parquet
    footers), so a batch that runs again counts and writes the same rows again."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        earlier = [p for p in batch_folders(spark, out) if int(p.rpartition("=")[2]) < batch_id]
        left = n - (spark.read.parquet(*earlier).count() if earlier else 0)
        if left > 0:
            batch.orderBy(order).limit(left).write.mode("overwrite").parquet(batch_folder(out, batch_id))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", out + "-checkpoint")
               .trigger(availableNow=True).start())
    _run(q)
    return out


STATS_KEYS = ["run", "prefix", "interval", "name"]


def stream_stats(spark: SparkSession, stream: DataFrame, every: int, out: str, weight: float | None = None) -> str:
    """I4: running mean of every statistic per (run, prefix, report interval).

    With ``weight`` the mean is weighted as in H1: the latest update by ``weight``, the one before by
    its square, and so on; an interval's updates are kept in the state for it, ``every`` steps at most.
    Update mode: a trigger writes only the keys it changed, into a folder of its own; ``read_stats``
    gives the latest row of every key.
    """
    average = F.avg("value")
    if weight is not None:
        latest_first = F.reverse(F.sort_array(F.collect_list(F.struct("step", "value"))))
        total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        share = lambda i: F.pow(F.lit(float(weight)), i + 1)
        average = (total(F.transform(latest_first, lambda u, i: u["value"] * share(i)))
                   / total(F.transform(latest_first, lambda u, i: share(i))))
    agg = report_intervals(stream, every).groupBy(*STATS_KEYS).agg(
        average.alias("average"), F.count(F.lit(1)).alias("n_updates"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    q = (agg.writeStream.outputMode("update").foreachBatch(per_batch)
            .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start())
    _run(q)
    return out


def read_stats(spark: SparkSession, out: str) -> DataFrame:
    """The current table of ``stream_stats``: of every key, what the last batch that changed it wrote."""
    schema = "run string, prefix string, interval bigint, name string, average double, n_updates bigint"
    if not batch_folders(spark, out):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", batch_id bigint").parquet(out)
    last = rows.groupBy(*STATS_KEYS).agg(F.max_by(F.struct("average", "n_updates"), "batch_id").alias("last"))
    return last.select(*STATS_KEYS, "last.average", "last.n_updates")
