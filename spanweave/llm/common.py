"""Helpers the operators share: stored tables, vectorised word hashing, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanweave.session import checkpoint_dir

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every byte to its lower-case form (A-Z only).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[int, np.ndarray] = {}
WORDS_AT_ONCE = 50_000


# ---------------------------------------------------------------- tables

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new folder below the shared checkpoint folder and read it back.

    Later steps then depend on files every executor can read, not on a lineage that a lost
    executor would have to rerun. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def unsigned_mod(col: Column, n: int) -> Column:
    return F.pmod(col, F.lit(n))


def id_crc(id_col: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


# ---------------------------------------------------------------- words and hashes

def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer on 64-bit integers."""
    x = x.astype(_U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    x ^= x >> _U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers derived from a seed."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE_VALUE = constants(256, 77)[LOWER]
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 19)
        steps = np.full(size, base, _U)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=_U)
    return have[:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, offsets of the rows) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE):
    """(starts, ends, word offsets per row): maximal runs of bytes that ``apart`` does not hold."""
    inside = ~apart[data]
    first = np.empty(len(data) + 1, bool)
    first[0], first[-1] = True, True
    np.logical_not(inside[:-1], out=first[1:-1]) if len(data) else None
    first[offsets] = True
    starts = np.flatnonzero(inside & first[:-1])
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = True
        np.logical_not(inside[1:], out=last[:-1])
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        last[edge - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, A-Z lower-cased: differences of a running polynomial."""
    out = np.empty(len(starts), _U)
    for lo in range(0, len(starts), WORDS_AT_ONCE):
        s, e = starts[lo:lo + WORDS_AT_ONCE], ends[lo:lo + WORDS_AT_ONCE]
        base = s[0]
        n = int(e[-1] - base)
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE_VALUE[data[base:base + n]] * _powers(_BASE, n), out=total[1:])
        h = (total[e - base] - total[s - base]) * _powers(_INVERSE, n)[s - base]
        out[lo:lo + len(s)] = mix(h + (e - s).astype(_U))
    return out


_STEP = constants(8, 5)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int = 5):
    """(distinct shingle hashes, offsets per row), sorted within each row.

    A shingle is ``width`` consecutive words; a row with fewer words has its whole sequence as
    its only one; a row without words has none.
    """
    n = np.diff(offsets)
    parts, sizes = [], np.zeros(len(n) + 1, np.int64)
    step = constants(width, 5)
    roll = np.zeros(max(0, len(words) - width + 1), _U)
    for k in range(width):
        roll += words[k:k + len(roll)] * step[k]
    roll = mix(roll)
    for r, (lo, count) in enumerate(zip(offsets[:-1].tolist(), n.tolist())):
        if count >= width:
            got = np.unique(roll[lo:lo + count - width + 1])
        elif count:
            got = mix((words[lo:lo + count] * step[:count]).sum(dtype=_U, keepdims=True) + _U(count))
        else:
            continue
        parts.append(got)
        sizes[r + 1] = len(got)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.cumsum(sizes)


def slices(batches, nbytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``nbytes`` at most (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        rows = max(1, int(n * nbytes / max(1, batch.nbytes)))
        for lo in range(0, n, rows):
            yield batch.slice(lo, rows)


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the edges with the smallest node it can reach.

    Alternates two star rewritings until the edges no longer change: each node's larger
    neighbours go to its smallest neighbour, then its smaller ones do. Minima are taken with
    partial aggregation and joined back, so a node with very many neighbours is no single task,
    and nothing is gathered in one place. Every round is a stored table.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = stored(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _edge_state(now)
    while True:
        each = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = each.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (each.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .where("u <> v").distinct())
        # every edge (u, v) now has v < u: v is a smaller neighbour of u
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                      .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                      .select("e.*").where("u <> v").distinct())
        now = stored(small, "edges")
        after = _edge_state(now)
        if after == state:
            break
        state = after
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def _edge_state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                    F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
