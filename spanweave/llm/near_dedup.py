"""Operator 3: MinHash near-duplicate detection with tensored banding.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Documents with
equal sets form a class; only classes are compared.

Tensored banding: instead of many independent bands, a document has two small collections of
``m`` hashes, each of three minhashes; a table key combines one hash of either collection, so
``m * m`` tables cost ``2 * 3 * m`` minhashes, about the square root of what separate bands need.
``m`` follows from the similarity s: the chance that a pair at s shares no table,
``2 * (1 - s**3)**m`` at most, stays below ``LOSS``.

From keys to links, every step linear in rows:

1. hashes of a collection that only one class has are dropped (they cannot make a shared key);
2. in each bucket, classes meet the class with the most neighbours, never each other, and a
   comparison of the signatures drops pairs that are far from similar;
3. what hangs together through such pairs is a cluster: all similar pairs lie inside one. Whole
   texts are read again for its members only, and *every* pair inside is compared on full sets.
   Large clusters are cut by set size (similar sets have similar sizes) and into blocks of
   bounded members and shingles, one task for each two blocks; a task returns a spanning forest
   of its links, never its pairs;
4. connected components of the links.

Defined cases: null or wordless texts have an empty set, link with nothing and keep their own
id; fewer than five words make one shingle; equal rows share a class; null ids are allowed and
are never the smallest id of a group that has another. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanweave.llm.common import (components, constants, find_words, fresh, hash_words, mix, shingles, slices,
                                  stored, text_bytes)

ROWS = 3             #: minhashes in one hash of a collection
LOSS = 1e-6          #: chance to miss a pair exactly at the similarity
SLACK = 0.3          #: signature estimates this far below the similarity still join a cluster
BLOCK_DOCS = 512    #: members of a block
BLOCK_SHINGLES = 1 << 20
_U = np.uint64


def collection_size(similarity: float) -> int:
    return max(2, math.ceil(math.log(LOSS / 2) / math.log(1 - similarity ** ROWS)))


def row_key(df: DataFrame, id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def sketches(docs: DataFrame, id_col: str, text_col: str, m: int) -> DataFrame:
    """One row per document: its set's size and fingerprint, 2*m collection hashes, signature."""
    factors = constants(2 * m * ROWS, 901)
    join = constants(ROWS, 31)
    place = constants(2 * m, 333)

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(2))
            starts, ends, per_row = find_words(data, offsets)
            hashes, at = shingles(hash_words(data, starts, ends), per_row)
            n = np.diff(at)
            full = np.flatnonzero(n)
            sums = np.zeros(len(n), _U)
            keys = np.zeros((len(n), 2 * m), _U)
            sig = np.zeros((len(n), 2 * m * ROWS), np.uint16)
            if len(full):
                lo = at[full]
                sums[full] = mix(np.add.reduceat(mix(hashes ^ _U(0x5851F42D4C957F2D)), lo) + n[full].astype(_U))
                for j in range(2 * m * ROWS):
                    low = np.minimum.reduceat(hashes * factors[j], lo)
                    sig[full, j] = (mix(low) >> _U(48)).astype(np.uint16)
                    keys[full, j // ROWS] += low * join[j % ROWS]
                keys[full] = mix(keys[full] + place)
            flat = pa.array(keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n.astype(np.int64)),
                pa.array(sums.view(np.int64), mask=n == 0),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * m)), flat),
                pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(
                    (np.arange(len(n) + 1, dtype=np.int32) * (sig.shape[1] * 2)).tobytes()),
                    pa.py_buffer(sig.tobytes())]),
            ], names=["rk", "id", "n_shingles", "c", "hashes", "sig"])

    src = docs.select(row_key(docs, id_col, text_col).alias("rk"), F.col(id_col).alias("id"),
                      F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"rk bigint, id {id_type}, n_shingles bigint, c bigint, hashes array<bigint>, sig binary")


def _close(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs whose signatures agree in ``least`` places or more."""
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                    for k in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)],
                                             names=["a", "b"])
    return pairs.mapInArrow(run, "a bigint, b bigint")


def _forest(sets: list[np.ndarray], names: list[int], num: int, den: int):
    """Edges of a spanning forest of all links among the given full sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n <= 16:
        link = np.zeros((n, n), bool)
        for i in range(n):
            for j in range(i):
                small, large = sorted((size[i], size[j]))
                if den * small >= num * large:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    link[i, j] = link[j, i] = den * both >= num * (size[i] + size[j] - both)
    else:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(n), size)
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[inverse] > 1
        number = np.cumsum(count > 1) - 1
        col, row = number[inverse[shared]], row[shared]
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        both = np.zeros((n, n), np.float32)
        wide = 4096
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
            i, j = np.searchsorted(col, (lo, lo + wide))
            part = np.zeros((n, wide), np.float32)
            part[row[i:j], col[i:j] - lo] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        link = den * both >= num * (size[:, None] + size[None, :] - both)
    left = np.ones(n, bool)
    for root in range(n):
        if left[root]:
            left[root] = False
            stack = [root]
            while stack:
                i = stack.pop()
                found = np.flatnonzero(link[i] & left)
                left[found] = False
                for j in found.tolist():
                    stack.append(j)
                    yield names[i], names[j]


def _links(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links of each group of the sorted (grp, c, text) rows, as spanning forests."""
    def links_of(names, texts):
        data, offsets = text_bytes(pa.array(texts, pa.large_string()))
        starts, ends, per_row = find_words(data, offsets)
        hashes, at = shingles(hash_words(data, starts, ends), per_row)
        return _forest([hashes[at[k]:at[k + 1]] for k in range(len(names))], names, num, den)

    def run(batches):
        now, names, texts, found = None, [], [], []
        for batch in batches:
            for grp, c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                    batch.column(2).to_pylist()):
                if grp != now:
                    if len(names) > 1:
                        found += links_of(names, texts)
                    now, names, texts = grp, [], []
                if not names or names[-1] != c:  # sorted: copies of a class stand together
                    names.append(c)
                    texts.append(text)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
                found = []
        if len(names) > 1:
            found += links_of(names, texts)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
    return blocks.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: ``rk`` (hash of id and text), ``id``, ``n_shingles``, ``c`` (class;
    null for the empty set), ``comp`` (its component's class), ``component_id`` (smallest id)."""
    m = collection_size(num / den)
    rows = stored(sketches(docs, id_col, text_col, m), "sketches")
    classes = stored(rows.where("c is not null").groupBy("c").agg(
        F.min("id").alias("id"), F.min("rk").alias("rk"), F.first("n_shingles").alias("n"),
        F.first("hashes").alias("hashes"), F.first("sig").alias("sig")), "classes")

    each = classes.select("c", F.posexplode("hashes").alias("i", "h"))
    known = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = stored(each.join(known, "h").groupBy("c").agg(
        F.collect_list(F.when(F.col("i") < m, F.col("h"))).alias("left"),
        F.collect_list(F.when(F.col("i") >= m, F.col("h"))).alias("right"),
        F.sum("n").alias("score")).where("size(left) > 0 and size(right) > 0"), "hits")
    keys = hits.select("c", "score", F.explode("left").alias("h"), "right").select(
        "c", "score", "h", F.explode("right").alias("g")).select("c", "score", F.xxhash64("h", "g").alias("key"))
    best = (keys.groupBy("key").agg(F.max(F.struct("score", "c")).alias("top"), F.count(F.lit(1)).alias("n"))
                .where("n > 1").select("key", F.col("top.c").alias("b")))
    pairs = keys.join(best, "key").where("c <> b").select(F.col("c").alias("a"), "b").distinct()
    sig = classes.select("c", "sig")
    pairs = (pairs.join(sig.withColumnRenamed("c", "a"), "a")
                  .join(sig.select(F.col("c").alias("b"), F.col("sig").alias("sig_b")), "b")
                  .select("a", "b", "sig", "sig_b"))
    close = _close(pairs, math.ceil((num / den - SLACK) * 2 * m * ROWS))
    cluster = components(close)

    members = cluster.join(classes.select("c", "rk", "n"), cluster["node"] == classes["c"]).select(
        "component", "c", "rk", "n")
    total = members.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("sum"))
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("sum") <= BLOCK_SHINGLES)
    step = F.floor(F.log("n") / F.lit(-math.log(num / den))).cast("int")
    members = stored(members.join(total, "component").withColumn(
        "g", F.explode(F.when(small, F.array(F.lit(-1))).otherwise(F.array(step, step + 1)))).drop("docs", "sum"),
        "members")
    parts = members.groupBy("component", "g").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    own = F.pmod(F.hash("c", F.lit("block")), F.col("parts"))
    placed = members.join(parts, ["component", "g"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.xxhash64("component", "g", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "c", "rk")
    texts = docs.select(row_key(docs, id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    # the member list grows with the corpus: never broadcast it, hash it partition by partition
    blocks = texts.join(placed.hint("shuffle_hash"), "rk").select("grp", "c", "text")
    blocks = blocks.repartition(F.col("grp")).sortWithinPartitions("grp", "c")
    linked = components(_links(blocks, num, den))

    comp = classes.select("c", "id").join(linked.withColumnRenamed("node", "c"), "c", "left").select(
        "c", "id", F.coalesce("component", "c").alias("comp"))
    least = comp.groupBy("comp").agg(F.min("id").alias("component_id"))
    comp = comp.join(least, "comp").select("c", "comp", "component_id")
    return rows.select("rk", "id", "n_shingles", "c").join(comp, "c", "left").withColumn(
        "component_id", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id (equal ids: the smallest
    row hash). Rows equal in id and text are one document. Documents without words all stay."""
    found = near_duplicates(docs, id_col, text_col, num, den)
    least = found.where("c is not null").groupBy("comp").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rk")).alias("top"))
    keep = least.select(F.col("top.rk").alias("rk")).unionByName(found.where("c is null").select("rk")).distinct()
    rk = fresh(docs, "_rk")
    return (docs.withColumn(rk, row_key(docs, id_col, text_col)).join(keep.withColumnRenamed("rk", rk), rk, "left_semi")
                .dropDuplicates([rk]).drop(rk))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
