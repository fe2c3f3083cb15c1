"""Operator 11: ranked lexical search over norm buckets of impact vectors.

Every document is a sparse vector of integer impacts, one per distinct term; an item is the vector
of its terms' counts, and a score is their inner product. Only terms of the items matter, so the
stored vectors hold just those, and a document's length is that of this part.

Index: one pass finds each document's item terms with their counts and its number of terms; corpus
counts come from that stored table. The vectors are dealt over tasks by falling length
(range partitions, equal lengths split by a hash) and cut into buckets of at most ``BUCKET`` rows or
``ENTRIES`` entries.

Search of a bucket for an item, with ``theta`` the k-th best score the task knows:
1. the bucket, and the rows at its short end, go where |item| * |row| < theta (Cauchy-Schwarz);
2. the item's ``FOCUS`` coordinates with the largest possible share are summed over the bucket's
   postings; a row stays if that sum and the least of two bounds on its other coordinates
   (Cauchy-Schwarz on what is left of both, and the sum of the bucket's column maxima) reach theta;
3. survivors are scored exactly in 64-bit integers over all coordinates.
Bounds are floats with a relative slack, so no row that can tie is lost. A first search over a
sample by hash (``SAMPLE`` documents, more or less) gives every item a theta to start with; it only
steers, since the k-th best of some rows is never above that of all. Each task gives at most k rows
an item; the last ranking keeps k an item before its shuffle.

Items come in blocks of at most ``TERMS`` distinct terms (a single longer item is a block), so what
is sent to tasks is bounded whatever the size of the benchmark.

Defined cases: a null text has no terms; documents and items without terms, and documents without
a term of the item, do not appear; a repeated document row is a document of its own; rows of items with equal
id and text are one item, those with equal id and different texts are ranked each on its own; null
ids stand after others of the same score; extra columns are ignored; an empty table gives no
rows. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanweave.llm.common import find_words, hash_words, slices, stored, table, text_bytes
from spanweave.llm.licences import APART

K = 20
BUCKET = 4096
ENTRIES = 1 << 20
FOCUS = 8
SAMPLE = 16384
TERMS = 1 << 18
SLACK = 1e-9
#: Bits of a row's number that a task counts itself; its partition's number stands above them.
LOCAL_BITS = 36
LAST = np.iinfo(np.int64).max


def term_hashes(col: pa.Array):
    """(terms per row, row of each term, hash of each term)."""
    data, offsets = text_bytes(col)
    starts, ends, at = find_words(data, offsets, APART)
    n = np.diff(at)
    return n, np.repeat(np.arange(len(n)), n), hash_words(data, starts, ends)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, qid, terms, counts``: distinct items with their term hashes and counts."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << LOCAL_BITS
        for batch in slices(batches):
            _, row, h = term_hashes(batch.column(1))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            got = [np.unique(h[lo:hi].view(np.int64), return_counts=True) for lo, hi in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(number, number + batch.num_rows)),
                 pa.array([t for t, _ in got], pa.list_(pa.int64())), pa.array([c for _, c in got], pa.list_(pa.int64()))],
                names=["item", "qid", "terms", "counts"])
            number += batch.num_rows

    src = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    kind = src.schema["item"].dataType.simpleString()
    return stored(src.mapInArrow(run, f"item {kind}, qid bigint, terms array<bigint>, counts array<bigint>")
                     .where("size(terms) > 0"), "items")


def item_blocks(items: DataFrame) -> list[tuple[int, list[int]]]:
    """(number of hash buckets, those that make a block): each block holds ``TERMS`` terms at most, or one item."""
    buckets = 1
    while True:
        held = (items.groupBy(F.pmod(F.xxhash64("qid"), F.lit(buckets)).alias("bucket"))
                     .agg(F.sum(F.size("terms")).alias("terms"), F.count(F.lit(1)).alias("items")))
        if not held.where(f"terms > {TERMS} and items > 1").limit(1).count():
            break
        buckets *= 2
    blocks, room = [], 0
    for r in held.orderBy("bucket").toLocalIterator():
        if r["terms"] > room:
            blocks.append([])
            room = TERMS
        blocks[-1].append(r["bucket"])
        room -= r["terms"]
    return [(buckets, b) for b in blocks]


class Items:
    """A block of items: vocabulary (sorted hashes) and each item's coordinates and counts."""

    def __init__(self, rows):
        self.qid = np.array([r["qid"] for r in rows], np.int64)
        every = [np.array(r["terms"], np.int64) for r in rows]
        self.vocab = np.unique(np.concatenate(every).view(np.uint64)) if every else np.zeros(0, np.uint64)
        self.at = [np.searchsorted(self.vocab, t.view(np.uint64)) for t in every]
        self.count = [np.array(r["counts"], np.int64) for r in rows]
        self.norm = [float(np.sqrt((c.astype(float) ** 2).sum())) for c in self.count]


def vectors(docs: DataFrame, vocab: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``row, doc, n, at, tf`` per document: number of its terms, the item terms among them and their counts."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << LOCAL_BITS
        size = len(vocab)
        for batch in slices(batches):
            n, row, h = term_hashes(batch.column(1))
            place = np.searchsorted(vocab, h)
            place[place == size] = 0
            hit = vocab[place] == h
            key, tf = np.unique(row[hit] * size + place[hit], return_counts=True)
            cut = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + batch.num_rows)), batch.column(0), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(cut, pa.array(key % size, pa.int32())),
                 pa.ListArray.from_arrays(cut, pa.array(tf, pa.int32()))], names=["row", "doc", "n", "at", "tf"])
            number += batch.num_rows

    src = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    return stored(src.mapInArrow(run, "row bigint, doc bigint, n bigint, at array<int>, tf array<int>"), "impacts")


class Weights:
    """Integer term weights and the impact of a term in a document."""

    def __init__(self, docs: int, terms: int, df: np.ndarray):
        self.docs, self.terms = docs, terms
        self.w = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)

    def impacts(self, n: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Impacts of entries; ``n`` is the number of terms of each entry's document."""
        m = 75 + (25 * n * self.docs) // max(1, self.terms)
        return self.w[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def entries(batch: pa.RecordBatch, first: int = 2):
    """(entries per row, terms per document of each entry, coordinates, counts) of columns n, at, tf."""
    n, at, tf = (batch.column(first + k) for k in range(3))
    size = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return (size, np.repeat(n.to_numpy(zero_copy_only=False), size), at.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            tf.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


class Best:
    """The k best (score, document) of each item that a task has seen."""

    def __init__(self, items: Items, theta: np.ndarray, k: int):
        self.theta, self.k = theta.copy(), k
        self.score = [np.zeros(0, np.int64)] * len(items.qid)
        self.doc = [np.zeros(0, np.int64)] * len(items.qid)

    def add(self, q: int, score: np.ndarray, doc: np.ndarray):
        score, doc = np.concatenate([self.score[q], score]), np.concatenate([self.doc[q], doc])
        top = np.lexsort((doc, -score))[:self.k]
        self.score[q], self.doc[q] = score[top], doc[top]
        if len(top) == self.k:
            self.theta[q] = max(self.theta[q], score[top[-1]])


def search_bucket(items: Items, best: Best, doc: np.ndarray, size: np.ndarray, at: np.ndarray, impact: np.ndarray):
    """Add a bucket's rows, longest first, to the best of every item."""
    n = len(doc)
    ends = np.cumsum(size)
    starts = ends - size
    square = np.bincount(np.repeat(np.arange(n), size), weights=impact.astype(float) ** 2, minlength=n)
    norm = np.sqrt(square)
    down = np.maximum.accumulate(norm[::-1])[::-1]
    order = np.argsort(at, kind="stable")
    post_row, post_impact, post_at = np.repeat(np.arange(n), size)[order], impact[order].astype(float), at[order]
    heads = np.flatnonzero(np.diff(post_at, prepend=-1))
    held = post_at[heads]
    tails = np.append(heads[1:], len(post_at))
    most = np.maximum.reduceat(post_impact, heads) if len(heads) else np.zeros(0)
    dense = np.zeros(len(items.vocab), np.int64)
    for q in range(len(items.qid)):
        theta = float(best.theta[q]) * (1 - SLACK)
        # rows are in order of falling length: those from ``live`` on are too short
        live = int(np.searchsorted(-down, -theta / items.norm[q], side="right")) if theta > 0 else n
        if live == 0:
            continue
        place = np.searchsorted(held, items.at[q])
        place[place == len(held)] = 0
        there = held[place] == items.at[q] if len(held) else np.zeros(len(place), bool)
        place, count = place[there], items.count[q][there]
        if not len(place):
            continue
        share = count * most[place]
        by = np.argsort(-share, kind="stable")
        focus, rest = by[:FOCUS], by[FOCUS:]
        span = [slice(heads[place[f]], tails[place[f]]) for f in focus]
        rows = np.concatenate([post_row[s] for s in span])
        got = np.concatenate([post_impact[s] for s in span])
        part = np.bincount(rows, weights=got * np.repeat(count[focus], [s.stop - s.start for s in span]), minlength=n)[:live]
        if len(rest):
            used = np.bincount(rows, weights=got ** 2, minlength=n)[:live]
            left = np.sqrt(np.maximum(square[:live] * (1 + SLACK) - used, 0)) * np.sqrt((count[rest].astype(float) ** 2).sum())
            part += np.minimum(left, share[rest].sum())
        keep = np.flatnonzero((part * (1 + SLACK) >= theta) & (part > 0))
        if not len(keep):
            continue
        dense[items.at[q]] = items.count[q]
        each = size[keep]
        cut = np.cumsum(each) - each
        which = np.repeat(starts[keep] - cut, each) + np.arange(each.sum())
        score = np.add.reduceat(impact[which] * dense[at[which]], cut)
        dense[items.at[q]] = 0
        good = (score > 0) & (score >= best.theta[q])
        best.add(q, score[good], doc[keep[good]])


def search(rows: DataFrame, items: Items, weights: Weights, theta: np.ndarray, k: int) -> DataFrame:
    """``qid, doc, score``: the k best rows of each item in every partition; rows come longest first."""
    def run(batches):
        best, held, count, amount = Best(items, theta, k), [], 0, 0

        def bucket():
            search_bucket(items, best, *(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                size, n, at, tf = entries(part)
                doc = part.column(1).fill_null(LAST).to_numpy(zero_copy_only=False)
                held.append((doc, size, at, weights.impacts(n, at, tf)))
                count, amount = count + len(doc), amount + len(at)
                if count >= BUCKET or amount >= ENTRIES:
                    bucket()
                    held, count, amount = [], 0, 0
        if held:
            bucket()
        size = [len(s) for s in best.score]
        if sum(size):
            doc = pa.array(np.concatenate(best.doc))
            doc = pa.compute.if_else(pa.compute.equal(doc, LAST), pa.scalar(None, pa.int64()), doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items.qid, size)), doc, pa.array(np.concatenate(best.score))],
                                             names=["qid", "doc", "score"])

    return rows.select("row", "doc", "n", "at", "tf").mapInArrow(run, "qid bigint, doc bigint, score bigint")


def _search_block(docs: DataFrame, items: Items, id_col: str, text_col: str, k: int) -> DataFrame:
    rows = vectors(docs, items.vocab, id_col, text_col)
    shape = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"),
                     F.count_if(F.size("at") > 0).alias("rows")).first()
    count = rows.select(F.explode("at").alias("at")).groupBy("at").count().collect()  # one row per item term at most
    df = np.zeros(len(items.vocab), np.int64)
    df[[r["at"] for r in count]] = [r["count"] for r in count]
    weights = Weights(shape["docs"], shape["terms"], df)

    def lengths(batches):
        for batch in batches:
            size, n, at, tf = entries(batch)
            square = weights.impacts(n, at, tf).astype(float) ** 2
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), weights=square, minlength=len(size)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], names=[*batch.schema.names, "norm"])

    found = rows.where("size(at) > 0")
    long = found.mapInArrow(lengths, "row bigint, doc bigint, n bigint, at array<int>, tf array<int>, norm double")
    tie = F.xxhash64("row")
    theta = np.zeros(len(items.qid), np.int64)
    part = max(1, shape["rows"] // SAMPLE)
    if part > 1:
        sample = search(long.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(part)) == 0)
                            .repartition(8, "row").sortWithinPartitions(F.desc("norm"), tie), items, weights, theta, k)
        order = Window.partitionBy("qid").orderBy(F.desc("score"))
        last = sample.withColumn("r", F.row_number().over(order)).where(f"r = {k}").collect()  # one row per item at most
        place = {q: i for i, q in enumerate(items.qid.tolist())}
        theta[[place[r["qid"]] for r in last]] = [r["score"] for r in last]
    spread = long.repartitionByRange(max(1, -(-shape["rows"] // BUCKET)), F.desc("norm"), tie)
    return search(spread.sortWithinPartitions(F.desc("norm"), tie), items, weights, theta, k)


def ranked_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item with a score above 0."""
    items = item_terms(queries, item_col, item_text_col)
    found = None
    for buckets, block in item_blocks(items):
        mine = items.where(F.pmod(F.xxhash64("qid"), F.lit(buckets)).isin(block)).orderBy("qid").collect()
        one = stored(_search_block(docs, Items(mine), id_col, text_col, k), "ranked")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "qid bigint, doc bigint, score bigint")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(items.select("qid", "item"), "qid").select(
        F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sizes AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM doc_terms WHERE len(terms) > 0
), items AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), item_terms AS (
  SELECT q, item_id, term, count(*) AS qf FROM (SELECT q, item_id, unnest(terms) AS term FROM items) GROUP BY ALL
), tfs AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc_terms)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, sizes GROUP BY term
), impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact
  FROM tfs JOIN weights USING (term), sizes
), scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(qf * impact) AS BIGINT) AS score
  FROM item_terms JOIN impacts USING (term) GROUP BY q, item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
