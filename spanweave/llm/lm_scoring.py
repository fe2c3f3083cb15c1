"""Operator 8: language-model scores by context-tree weighting over bytes.

Model: the next byte of the lower-cased text is eight binary decisions; each has a context tree
over the ``DEPTH`` bytes before it. A node's Krichevsky-Trofimov estimate of its counts and the
product of its children's weighted probabilities are mixed half and half, from the deepest contexts
up to the root, so every depth has the weight that its coding of the training text earns. A text is
its bytes and one end symbol (a byte that UTF-8 does not have); its score is the sum of log10
probabilities, and its code length per byte follows from it. On a path, a context never seen in
training ends the tree: the next shorter one decides.

The tree grows with the corpus and is never held in one place:

1. documents are put into chunks of about ``CHUNK_BYTES``; a chunk's distinct codes (context and
   next byte) are counted, then summed over all chunks by code;
2. the codes that share their last two context bytes form a group, at most 256 * 256 contexts of 256
   bytes whatever the corpus; a group weights its part of the tree by itself, and only one number
   for each decision goes on to the 256 one-byte contexts, and from there to the root;
3. the weights go down again: a group gets those of its one-byte context (a table of 256 rows) and
   gives one probability for each code of the corpus, in training or not;
4. codes meet the chunks that hold them in a shuffled join, and a chunk is scored with its own codes.

Base scores need the count of every token. The ``FREQUENT`` most frequent tokens' counts (a bounded
table) are looked up in the tasks; all other tokens of a document meet their counts in a shuffled
join on the token's 64-bit hash.

Defined cases: null text is empty (its end alone), a null id counts as the empty text in the
held-out rule, repeated rows are scored alike, an empty training set gives uniform bytes and
base counts of 0; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanweave.llm.common import LOWER, find_words, hash_words, id_crc, slices, stored, text_bytes

FREQUENT = 1 << 19
DEPTH = 4                       #: bytes of context
CHUNK_BYTES = 16 << 20          #: text of a chunk (a longer document is a chunk by itself)
END = 255                       #: the end symbol as a byte, also what stands before a text
END_TOKEN = -0x0E5D0E5D0E5D0E5D  #: the end's key among the token hashes
COUNTS_HELD = 1 << 21            #: counts a task holds before it merges them, or passes them on


# ---------------------------------------------------------------- counting

def chunked(docs: DataFrame, may_learn: Column, id_col: str, text_col: str) -> DataFrame:
    """``row, chunk, id, text, held_out``: documents numbered and put into chunks, in the order of their partition."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        row, chunk, size = part << 36, part << 24, 0
        for batch in slices(batches):
            n = batch.num_rows
            if size and size + batch.nbytes > CHUNK_BYTES:
                chunk, size = chunk + 1, 0
            size += batch.nbytes
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), pa.array(np.full(n, chunk)), *batch.columns],
                                             names=["row", "chunk", "id", "text", "held_out"])
            row += n

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~may_learn).alias("held_out"))
    return src.mapInArrow(run, f"row bigint, chunk bigint, id {src.schema['id'].dataType.simpleString()}, text string, "
                               "held_out boolean")


def byte_codes(data: np.ndarray, offsets: np.ndarray):
    """(codes, offsets per row): every byte and the end of each row, below the ``DEPTH`` bytes before it."""
    n = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(n + DEPTH + 1)])      # symbols before, one after each row
    x = np.full(at[-1], END, np.int64)
    if len(data):
        x[np.arange(len(data)) + np.repeat(at[:-1] + DEPTH - offsets[:-1], n)] = LOWER[data]
    codes = x[DEPTH:].copy()
    keep = np.ones(len(codes), bool)
    for k in range(1, DEPTH + 1):
        codes |= x[DEPTH - k:len(x) - k] << (8 * k)
        keep[at[1:-1] - k] = False                            # what reaches over two rows
    return codes[keep], np.concatenate([[0], np.cumsum(n + 1)])


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """(kind, chunk, key, n): a chunk's codes (kind 0, n from its training documents, 0 where only
    others have the code), and the training documents' token hashes (kind 1, chunk null)."""
    def batch_of(chunk, keys, n):
        whose = pa.nulls(len(keys), pa.int64()) if chunk is None else pa.array(np.full(len(keys), chunk, np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), int(chunk is None), np.int32)), whose, pa.array(keys.astype(np.int64)),
             pa.array(n.astype(np.int64))], names=["kind", "chunk", "key", "n"])

    def merged(parts):
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def run(batches):
        held: dict = {None: []}     # parts of the tokens (None) and of the chunk that is being read
        size: dict = {None: 0}

        def hold(owner, keys, n):
            held[owner].append((keys, n))
            size[owner] += len(keys)
            if size[owner] > COUNTS_HELD:
                held[owner] = [merged(held[owner])]
                size[owner] = len(held[owner][0][0])
                if size[owner] > COUNTS_HELD // 2:
                    yield batch_of(owner, *held[owner][0])
                    held[owner], size[owner] = [], 0

        def rest(owner):
            if held[owner]:
                yield batch_of(owner, *merged(held[owner]))

        now = None
        for batch in slices(batches):
            chunk = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if chunk[lo] != now:
                    if now is not None:
                        yield from rest(now)
                        del held[now], size[now]
                    now = int(chunk[lo])
                    held[now], size[now] = [], 0
                data, offsets = text_bytes(batch.column(1).slice(lo, hi - lo))
                learn = ~batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                codes, at = byte_codes(data, offsets)
                own = np.repeat(learn, np.diff(at))
                yield from hold(now, *np.unique(codes[own], return_counts=True))
                others = np.unique(codes[~own])
                yield from hold(now, others, np.zeros(len(others), np.int64))
                starts, ends, words = find_words(data, offsets)
                own = np.repeat(learn, np.diff(words))
                keys, n = np.unique(hash_words(data, starts, ends).view(np.int64)[own], return_counts=True)
                if learn.any():
                    yield from hold(None, np.append(keys, END_TOKEN), np.append(n, learn.sum()))
        for owner in held:
            yield from rest(owner)

    return chunks.select("chunk", "text", "held_out").mapInArrow(run, "kind int, chunk bigint, key bigint, n bigint")


# ---------------------------------------------------------------- weighting

def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 (Stirling's series after shifting by eight)."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    out = np.zeros(np.shape(zeros))
    some = zeros + ones > 0
    z, o = zeros[some], ones[some]
    out[some] = _lgamma(z + 0.5) + _lgamma(o + 0.5) - _lgamma(z + o + 1.0) - math.log(math.pi)
    return out


def decision_counts(next_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of next bytes (..., 256) to zeros and ones of the 255 decisions, heap order (..., 256)."""
    total = np.zeros((*next_counts.shape[:-1], 512))
    total[..., 256:] = next_counts
    for first in (128, 64, 32, 16, 8, 4, 2, 1):
        total[..., first:2 * first] = total[..., 2 * first:4 * first:2] + total[..., 2 * first + 1:4 * first:2]
    return total[..., 0::2].copy(), total[..., 1::2].copy()


def log_mix(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, children) - math.log(2)


def one_down(settled, left, ended, zeros, ones, log_ratio):
    """Chances of a one, one level further down a path.

    A chance is ``settled + left * (what the deeper levels say)``, and ``ended`` where they have not
    seen the decision. ``log_ratio``: the node's own estimate against its children's.
    """
    seen = zeros + ones > 0
    own = (ones + 0.5) / (zeros + ones + 1.0)
    weight = 1 / (1 + np.exp(-np.clip(log_ratio, -700, 700)))
    return (np.where(seen, settled + left * weight * own, ended), np.where(seen, left * (1 - weight), 0.0),
            np.where(seen, settled + left * own, ended))


def _blocks(key: np.ndarray, n: np.ndarray):
    """A group's codes by their third-last context byte: (places of the codes, the row of each, next-byte
    counts of the contexts as rows); 256 rows at most."""
    third = (key >> 24) & 255
    order = np.argsort(third, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(third[order])) + 1):
        before, row = np.unique(key[at] >> 32, return_inverse=True)
        table = np.zeros((len(before), 256))
        table[row, key[at] & 255] = n[at]
        yield at, row, table


def _weigh(key: np.ndarray, n: np.ndarray):
    """(zeros, ones, log of the own estimate, log of the children's) of a group's two-byte context."""
    zeros, ones, below = np.zeros(256), np.zeros(256), np.zeros(256)
    for _, _, table in _blocks(key, n):
        z, o = decision_counts(table)
        below += log_mix(log_kt(z.sum(axis=0), o.sum(axis=0)), log_kt(z, o).sum(axis=0))
        zeros += z.sum(axis=0)
        ones += o.sum(axis=0)
    return zeros, ones, log_kt(zeros, ones), below


def code_logs(key: np.ndarray, n: np.ndarray, above: tuple) -> np.ndarray:
    """log10 probability of every code of a group; ``above``: its path as ``one_down`` left it."""
    zeros, ones, own, below = _weigh(key, n)
    path = one_down(*above, zeros, ones, own - below)
    out = np.zeros(len(key))
    for at, row, table in _blocks(key, n):
        z, o = decision_counts(table)
        whole = z.sum(axis=0), o.sum(axis=0)
        deeper = one_down(*path, *whole, log_kt(*whole) - log_kt(z, o).sum(axis=0))
        _, _, chance = one_down(*deeper, z, o, np.zeros(1))    # the deepest contexts decide by themselves
        byte, node = key[at] & 255, np.ones(len(at), np.int64)
        for bit in range(7, -1, -1):
            one = (byte >> bit) & 1
            p = chance[row, node]
            out[at] += np.log10(np.where(one == 1, p, 1 - p))
            node = node * 2 + one
    return out


def train(codes: DataFrame) -> DataFrame:
    """(key, log): the log10 probability of every code, from the codes' training counts (key, n)."""
    grouped = codes.withColumn("last_two", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))

    def up(group: pa.Table) -> pa.Table:
        key, n = group.column("key").to_numpy(), group.column("n").to_numpy()
        zeros, ones, own, below = _weigh(key, n)
        return pa.table({"last": [int(key[0] >> 8) & 255], "zeros": [zeros], "ones": [ones], "logw": [log_mix(own, below)]})

    arrays = "zeros array<double>, ones array<double>, logw array<double>"
    two = grouped.groupBy("last_two").applyInArrow(up, f"last bigint, {arrays}")

    def join(group: pa.Table) -> pa.Table:
        zeros, ones, below = (np.array(group.column(c).to_pylist()).sum(axis=0) for c in ("zeros", "ones", "logw"))
        return pa.table({"last": group.column("last").slice(0, 1), "zeros": [zeros], "ones": [ones], "logw": [below]})

    level = two.groupBy("last").applyInArrow(join, f"last bigint, {arrays}").collect()   # 256 rows at most
    of = {r["last"]: [np.array(r[c]) for c in ("zeros", "ones", "logw")] for r in level}
    none = np.zeros(256)
    zeros, ones = (sum((t[k] for t in of.values()), none) for k in (0, 1))
    below = sum((log_mix(log_kt(z, o), deep) for z, o, deep in of.values()), none)
    root = one_down(none, np.ones(256), np.full(256, 0.5), zeros, ones, log_kt(zeros, ones) - below)
    paths = {last: one_down(*root, z, o, log_kt(z, o) - deep) for last, (z, o, deep) in of.items()}

    def down(group: pa.Table) -> pa.Table:
        key, n = group.column("key").to_numpy(), group.column("n").to_numpy()
        return pa.table({"key": key, "log": code_logs(key, n, paths[int(key[0] >> 8) & 255])})

    return grouped.groupBy("last_two").applyInArrow(down, "key bigint, log double")


def text_scores(keys: np.ndarray, logs: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each row, its end included; ``keys`` are sorted and hold every code of the rows."""
    codes, at = byte_codes(data, offsets)
    return np.add.reduceat(logs[np.searchsorted(keys, codes)], at[:-1])


# ---------------------------------------------------------------- the operator

def score_texts(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    spark = docs.sparkSession
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType
    chunks = stored(chunked(docs, may_learn, id_col, text_col), "chunks")
    counts = stored(corpus_counts(chunks), "counts")
    tokens = stored(counts.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "tokens")
    total = tokens.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, distinct = total["n"] or 0, total["v"]
    asked = counts.where("kind = 0").select("chunk", "key", "n")
    codes = stored(asked.groupBy("key").agg(F.sum("n").alias("n")), "codes")
    # both sides grow with the corpus
    answers = asked.select("chunk", "key").distinct().join(train(codes).hint("merge"), "key")

    # the cut: the smallest count that keeps no more than FREQUENT tokens above it
    above, cut = 0, None
    levels = (tokens.groupBy(F.greatest(F.lit(1), F.least(F.col("n"), F.lit(10_000))).alias("n"))
                    .agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("n")).collect())   # 10,000 rows at most
    for r in levels:
        if above + r["v"] > FREQUENT:
            break
        above, cut = above + r["v"], r["n"]
    if cut is None:
        known = np.zeros((2, 0), np.int64)
    else:
        got = tokens.where(F.col("n") >= cut).toArrow()
        known = np.stack([got.column("key").to_numpy(), got.column("n").to_numpy()])
        known = known[:, np.argsort(known[0])]
    shared = spark.sparkContext.broadcast(known)
    from pyspark.sql.pandas.types import to_arrow_type
    id_arrow = to_arrow_type(id_type)
    arrow = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("times", pa.int64()), ("id", id_arrow),
                       ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                       ("log_sum", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def rows_of(batch, keys, logs):
        """The documents of a batch, then their tokens that are not in the shared table."""
        known_keys, n_of = shared.value
        n = batch.num_rows
        data, offsets = text_bytes(batch.column("text"))
        scores = text_scores(keys, logs, data, offsets)
        starts, ends, at = find_words(data, offsets)
        words = np.insert(hash_words(data, starts, ends).view(np.int64), at[1:], END_TOKEN)
        n_words = np.diff(at) + 1
        doc = np.repeat(np.arange(n), n_words)
        uniq, inverse = np.unique(words, return_inverse=True)
        place = np.minimum(np.searchsorted(known_keys, uniq), max(0, len(known_keys) - 1))
        have = known_keys[place] == uniq if len(known_keys) else np.zeros(len(uniq), bool)
        count = np.where(have, n_of[place], 0) if len(known_keys) else np.zeros(len(uniq), np.int64)
        log_sum = np.bincount(doc, weights=np.log10(count + 1.0)[inverse], minlength=n)
        n_known = np.bincount(doc, weights=have[inverse], minlength=n).astype(np.int64)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), none, none, batch.column("id"), batch.column("held_out"), pa.array(n_words),
             pa.array(n_known), pa.array(log_sum), pa.array(scores), pa.array(np.diff(offsets))], schema=arrow)
        if cut == 1:      # the table held every training token
            return
        rare = ~have[inverse]
        pair, times = np.unique(doc[rare] * len(uniq) + inverse[rare], return_counts=True)
        k = len(pair)
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch.column("row").to_numpy()[pair // max(1, len(uniq))]), pa.array(uniq[pair % max(1, len(uniq))]),
             pa.array(times), pa.nulls(k, id_arrow), *(pa.nulls(k, t) for t in arrow.types[4:])], schema=arrow)

    def score_chunk(texts: pa.Table, found: pa.Table) -> pa.Table:
        keys, logs = found.column("key").to_numpy(), found.column("log").to_numpy()
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        return pa.Table.from_batches([out for batch in slices(texts.to_batches()) for out in rows_of(batch, keys, logs)],
                                     schema=arrow)

    each = stored(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score_chunk, f"row bigint, key bigint, times bigint, id {id_type.simpleString()}, held_out boolean, "
                     "n_tokens bigint, n_known bigint, log_sum double, score double, n_bytes bigint"), "scores")
    rare = (each.where("key is not null").select("row", "key", "times").join(tokens, "key")
                .groupBy("row").agg(F.sum("times").alias("more_known"),
                                    F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more_sum")))
    base = each.where("key is null").join(rare, "row", "left")
    norm = math.log10(n_train + 1 * (distinct + 1))
    return base.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("more_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score", (-F.col("score") / F.lit(math.log10(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), id_crc("doc_id") % 7 != 2)
