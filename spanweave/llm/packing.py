"""Operator 2: pack tokenized documents into sequences of at most ``cap`` tokens.

Only documents longer than a sequence are cut, into pieces of ``cap`` tokens of which the first
may be shorter; pieces of exactly ``cap`` tokens are a sequence each. The others are dealt at
random into groups of about ``GROUP`` pieces, whatever their ids, and each group is packed on
its own: a best-fit start, then a local search over the bins that are not full. It takes the
bin with the smallest gap and closes it as far as one exchange can: a document moved from
another bin, one swapped for a shorter one, or two of one bin swapped for one. Donors are never
fuller than the taker, so each exchange increases the sum of squared fills, and bins at the low
end lose their documents until they are empty. Rounds repeat until no exchange is left. A group
wastes less than a bin or so, so thousands of pieces a group cost some hundredths of a per cent.

Tokens: byte-level BPE. The rank file is the same vocabulary as the tokenizer's JSON and several
times faster; texts with runs that its merge loop is slow on go through the JSON tokenizer, and
tests hold the two equal.

Defined cases: null text is the empty text (the end id alone), null and repeated ids are carried
through (each row is a document), an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanweave.llm.common import slices, stored

CAP = 1024
END_ID = 2
GROUP = 8192
END_OF_TEXT = "<|endoftext|>"
_SLOW = re.compile(r"\S{1000}|\s{1000}")


def byte_bpe(json_path: str, rank_path: str, pattern: str):
    """Function text -> token ids of the byte-level BPE (no special tokens added)."""
    import tiktoken
    from tokenizers import Tokenizer
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path)

    def encode(text: str) -> list[int]:
        if END_OF_TEXT in text or _SLOW.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)
    return encode


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, cap: int, end_id: int,
                     with_ids: bool, json_path: str | None, rank_path: str | None) -> DataFrame:
    """One row per piece, with a number (``slot``) of its own and, if asked for, its token ids."""
    def run(batches):
        import public_tokenizers as public
        from pyspark import TaskContext
        encode = byte_bpe(json_path or public.path("byte_bpe_50k.json"),
                          rank_path or public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
        slot = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            rows, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "slot", "ids")}
            for r, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                at, stop = 0, len(ids) % cap or cap
                for piece in range(-(-len(ids) // cap)):
                    part = ids[at:stop]
                    rows.append(r)
                    for k, v in zip(out, (piece, at, len(part), zlib.crc32(part.tobytes()), slot, part)):
                        out[k].append(v)
                    at, stop, slot = stop, stop + cap, slot + 1
            ids = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32())]
            cols = [*ids, *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32", "slot"))]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in out["ids"]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32", "slot", *["ids"] * with_ids]
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint,"
                               f" ids_crc32 bigint, slot bigint" + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], cap: int) -> list[list[int]]:
    """Longest first, each to the fullest bin that takes it."""
    bins, room, rooms = [], [[] for _ in range(cap + 1)], 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = rooms >> lengths[k]
        if fits:
            gap = lengths[k] + (fits & -fits).bit_length() - 1
            b = room[gap].pop()
            if not room[gap]:
                rooms &= ~(1 << gap)
            bins[b].append(k)
        else:
            gap, b = cap, len(bins)
            bins.append([k])
        room[gap - lengths[k]].append(b)
        rooms |= 1 << (gap - lengths[k])
    return bins


class Donors:
    """Underfull bins by the lengths, and the sums of two lengths, that they can give."""

    def __init__(self):
        self.one, self.two, self.mask_one, self.mask_two = {}, {}, 0, 0

    def _sums(self, held):
        kinds = sorted(held)
        one = set(kinds)
        two = {}
        for i, x in enumerate(kinds):
            for y in kinds[i:]:
                if x != y or len(held[x]) > 1:
                    two[x + y] = (x, y)
        return one, two

    def add(self, b, held):
        one, two = self._sums(held)
        for x in one:
            self.one.setdefault(x, {})[b] = None
            self.mask_one |= 1 << x
        for x, parts in two.items():
            self.two.setdefault(x, {})[b] = parts
            self.mask_two |= 1 << x

    def remove(self, b, held):
        one, two = self._sums(held)
        for x in one:
            del self.one[x][b]
            if not self.one[x]:
                self.mask_one &= ~(1 << x)
        for x in two:
            del self.two[x][b]
            if not self.two[x]:
                self.mask_two &= ~(1 << x)


def _most(mask: int, limit: int) -> int:
    """The largest set bit up to ``limit``, or 0."""
    return (mask & ((1 << (limit + 1)) - 1)).bit_length() - 1 if mask else 0


def local_search(bins: list[list[int]], lengths: list[int], cap: int) -> list[list[int]]:
    """Exchanges between underfull bins until none raises the sum of squared fills."""
    fill = [sum(lengths[k] for k in b) for b in bins]
    held: list[dict[int, list[int]]] = []
    for b in bins:
        kinds: dict[int, list[int]] = {}
        for k in b:
            kinds.setdefault(lengths[k], []).append(k)
        held.append(kinds)

    def take(b, length):
        k = held[b][length].pop()
        if not held[b][length]:
            del held[b][length]
        fill[b] -= length
        return k

    def put(b, k):
        held[b].setdefault(lengths[k], []).append(k)
        fill[b] += lengths[k]

    changed = True
    while changed:
        changed = False
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < cap), key=lambda b: -fill[b])
        donors = Donors()
        for b in under:
            donors.add(b, held[b])
        for b in under:
            if not fill[b]:
                continue
            donors.remove(b, held[b])
            while gap := cap - fill[b]:
                best = (_most(donors.mask_one, gap), 0, 1)
                for a in held[b]:
                    for mask, count in ((donors.mask_one, 1), (donors.mask_two, 2)):
                        got = _most(mask, a + gap)
                        if got - a > best[0]:
                            best = (got - a, a, count)
                gain, a, count = best
                if gain <= 0:
                    break
                donor, parts = next(iter((donors.one if count == 1 else donors.two)[a + gain].items()))
                donors.remove(donor, held[donor])
                moved = [take(donor, x) for x in (parts if count == 2 else (a + gain,))]
                if a:
                    put(donor, take(b, a))
                for k in moved:
                    put(b, k)
                if fill[donor]:
                    donors.add(donor, held[donor])
                changed = True
    return [[k for ks in kinds.values() for k in ks] for kinds in held if kinds]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP, end_id: int = END_ID,
         with_ids: bool = False, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, [ids,] sequence_id, offset``."""
    pieces = stored(tokenized_pieces(docs, id_col, text_col, cap, end_id, with_ids, json_path, rank_path), "pieces")
    whole = pieces.where(F.col("length") == cap).withColumn("sequence_id", F.col("slot") * 2).withColumn(
        "offset", F.lit(0).cast("bigint"))
    part = pieces.where(F.col("length") < cap)
    groups = max(1, -(-part.count() // GROUP))
    part = part.withColumn("grp", F.pmod(F.xxhash64("slot"), F.lit(groups)))

    def run(batch: pa.Table) -> pa.Table:
        lengths = batch.column("length").to_pylist()
        bins = local_search(best_fit(lengths, cap), lengths, cap)
        first = batch.column("grp")[0].as_py() << 24
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for b, held in enumerate(bins):
            at = 0
            for k in held:
                sequence[k], offset[k], at = (first + b) * 2 + 1, at, at + lengths[k]
        return batch.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
            "offset", pa.array(offset, pa.int64()))

    packed = part.groupBy("grp").applyInArrow(run, whole.schema)
    return whole.unionByName(packed).drop("slot").withColumnRenamed("id", id_col)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    return pack(table(spark, sf_dir, "documents"))
