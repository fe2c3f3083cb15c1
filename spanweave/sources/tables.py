"""Readers for the shared parquet tables and generic corpus sources."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def balanced(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over the cluster when it arrives in too few partitions.

    The test files hold one row group each, so a fresh read is one task; large
    inputs already arrive split by ``spark.sql.files.maxPartitionBytes`` and
    pass through untouched (no extra shuffle).
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, balance: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balanced(df) if balance else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, deleted when the application ends."""
    from spanweave.session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: later steps read files that every executor
    can reach, the optimizer knows their size, and nothing stays in memory. The files of the shuffles that made it are removed."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Without it, Spark keeps the shuffle files of a query that has ended until the driver happens to collect its garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run inside remove the files of their own shuffles when they end."""
    before = spark.conf.get(REMOVE_SHUFFLES)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def released(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote, when no later step reads them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, jpath = _file_system(df.sparkSession, folder)
            fs.delete(jpath, True)


def read_corpora(spark: SparkSession, paths: str | list, names: str | list | None = None,
                 fmt: str = "parquet", text_col: str = "text") -> dict[str, DataFrame]:
    """A1: comma-separated paths and names (equal counts), each loaded separately.

    An empty name means "no configuration name" and the path's stem is used.
    Mixing is done by ``interleave`` (F4).
    """
    ps = [p for p in (paths.split(",") if isinstance(paths, str) else paths)]
    ns = names.split(",") if isinstance(names, str) else (names or [""] * len(ps))
    if len(ps) != len(ns):
        raise ValueError(f"{len(ps)} corpus paths but {len(ns)} names")
    out = {}
    for p, n in zip(ps, ns):
        key = n or p.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
        out[key] = spark.read.format(fmt).load(p)
    return out


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """One phrase per line, as a set (duplicates vanish; '' never matches)."""
    return spark.read.text(path).select(F.col("value").alias("phrase")).distinct()


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """B1: drop by name; unlike ``DataFrame.drop`` an unknown name is an error."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return df.drop(*cols)


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Only input_ids, attention_mask and labels reach the consumer."""
    cols = [c for c in ("input_ids", "attention_mask", "labels") if c in df.columns]
    df.select(*cols).write.mode(mode).parquet(path)


def write_predictions(df: DataFrame, path: str, partition_by=("task", "split"), mode: str = "overwrite") -> None:
    """Predictions next to input and target text, partitioned by task and split."""
    missing = [c for c in ("input", "prediction", "reference") if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    parts = [c for c in partition_by if c in df.columns]
    w = df.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)


def read_task(spark: SparkSession, base: str, benchmark: str, task: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """A2: every split of one task, laid out as ``base/benchmark/task/<split>``.

    ``mnli`` has matched/mismatched validation and test splits; other tasks
    one of each. Returns split name -> DataFrame.
    """
    if task == "mnli":
        splits = ["train", "validation_matched", "validation_mismatched", "test_matched", "test_mismatched"]
    else:
        splits = ["train", "validation", "test"]
    return {s: spark.read.format(fmt).load(f"{base.rstrip('/')}/{benchmark}/{task}/{s}") for s in splits}


def _file_system(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _versions(spark: SparkSession, pattern: str) -> list[tuple[int, str]]:
    """(time, folder) of the complete versions that match, the first finished one first."""
    fs, path = _file_system(spark, f"{pattern}/_SUCCESS")
    return sorted((f.getModificationTime(), f.getPath().getParent().toString()) for f in fs.globStatus(path) or [])


def cached(spark: SparkSession, config: dict, build, root: str | None = None) -> DataFrame:
    """Load a materialised result if present, else build, write and load it.

    The key is a hash of the whole configuration (paths, tokenizer, slice,
    lengths), so a changed setting never hits a stale entry. Entries live in
    the shared checkpoint folder unless ``root`` names another shared path. Every writer
    has a folder of its own below the key, and ``_SUCCESS`` marks it complete: writers at the same
    time never touch each other's files, and all later readers take the version that was finished first.
    ``expire_cache`` removes entries by age.
    """
    import hashlib
    import json

    from spanweave.session import checkpoint_dir
    key = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:24]
    folder = f"{(root or checkpoint_dir(spark)).rstrip('/')}/cache-{key}"
    found = _versions(spark, f"{folder}/*")
    if not found:
        built = build()
        with shuffles_removed(spark):
            built.write.parquet(f"{folder}/{uuid.uuid4().hex}")
        found = _versions(spark, f"{folder}/*")
    return spark.read.parquet(found[0][1])


def expire_cache(spark: SparkSession, older_than_seconds: float, root: str | None = None) -> int:
    """Delete the versions of cached results that were finished before that long ago; their number."""
    import time

    from spanweave.session import checkpoint_dir
    limit = (time.time() - older_than_seconds) * 1000
    old = [p for t, p in _versions(spark, f"{(root or checkpoint_dir(spark)).rstrip('/')}/cache-*/*") if t < limit]
    for path in old:
        fs, jpath = _file_system(spark, path)
        fs.delete(jpath, True)
    return len(old)


def input_fingerprint(spark: SparkSession, pattern: str) -> list:
    """(path, size, modification time) of every file under a path or glob, for cache keys."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    out = []
    for st in fs.globStatus(path) or []:
        if st.isDirectory():
            it = fs.listFiles(st.getPath(), True)
            while it.hasNext():
                f = it.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        else:
            out.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return sorted(out)
