"""Operator 13: align the tokens of two tokenizers over the same text.

Both tokenizers cut the same bytes (a space and the text) into consecutive tokens. Tokens of both are
one list of byte intervals, sorted by start; the running maximum of their ends shows where a group
breaks: at a start that reaches it. Within a group every token of A is linked with every
token of B. A pair of ids counts once a document that holds it linked, over the whole corpus.

One pass tokenizes, aligns and cuts the documents into chunks of about ``CHUNK`` bytes of text (or one longer
document). A chunk lists its distinct id pairs once, with the number of its documents that hold
each; its documents refer to that list by position. Only these lists are shuffled for counting,
joined with the corpus counts and brought back to their chunk, so that a frequent pair is one row a
chunk. The best count of an id of A is a table of at most as many rows as A has ids, and is broadcast.

Groups too large to be written out pair by pair (above ``SPELLED`` pairs) go through
their distinct ids: a pair's links are the product of the two ids' occurrences.

Defined cases: a null or empty text, or one that either tokenizer changes, has no tokens (zeros and an empty
digest); null and repeated ids are carried along, each row being a document; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanweave.llm.common import slices, stored, table

CHUNK = 8 << 20
AT_ONCE = 1 << 20
SPELLED = 4096
#: Runs that the rank file's merge loop is slow on; the JSON tokenizer takes them.
_RUNS = re.compile(r"\S{1000}|\s{1000}")
NAMES = ("n_a", "n_b", "n_groups", "n_links")


class Pair:
    """Both tokenizers: ids of texts, and the bytes, lengths and digits of every id."""

    def __init__(self, json_path: str | None = None, rank_path: str | None = None, piece_path: str | None = None):
        import public_tokenizers as public
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        with open(rank_path or public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("a", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(json_path or public.path("byte_bpe_50k.json"))
        self.slow.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path or public.path("piece_bpe_32k.model"))
        a = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            a[rank] = word
        b = [self._piece_bytes(self.piece.id_to_piece(k)) for k in range(self.piece.get_piece_size())]
        self.words = (a, b)
        self.lengths = tuple(np.array([len(w) for w in x], np.int64) for x in self.words)
        self.size = max(len(a), len(b))
        self.spelled = [sep + str(k).encode() for sep in (b";", b",", b"|") for k in range(self.size)]

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> tuple[list, list]:
        """Ids of both for every text; none where a tokenizer does not give the text's bytes back."""
        out = ([], [])
        for text, b in zip(texts, self.piece.encode([t or "" for t in texts], num_threads=1)):
            a = []
            if text:
                whole = " " + text
                a = self.slow.encode(whole, add_special_tokens=False).ids if _RUNS.search(whole) else self.fast.encode_ordinary(whole)
                raw = whole.encode()
                if b"".join(map(self.words[0].__getitem__, a)) != raw or b"".join(map(self.words[1].__getitem__, b)) != raw:
                    a, b = [], []
            else:
                b = []
            out[0].append(a)
            out[1].append(b)
        return out


class Aligned:
    """Groups of a few documents. Tokens are in order of group, A before B, and place.

    Byte offsets run on over the documents, so a document's end is a break like any other."""

    def __init__(self, pair: Pair, ids_a: list[list[int]], ids_b: list[list[int]]):
        docs = len(ids_a)
        self.tokens = [np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b)]
        ids = [np.fromiter((k for x in every for k in x), np.int64, n.sum()) for every, n in zip((ids_a, ids_b), self.tokens)]
        lengths = [pair.lengths[s][ids[s]] for s in (0, 1)]
        end = np.concatenate([np.cumsum(x) for x in lengths])
        start = end - np.concatenate(lengths)
        side = np.repeat([0, 1], [len(x) for x in ids])
        doc = np.concatenate([np.repeat(np.arange(docs), n) for n in self.tokens])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        opens = np.ones(len(order), bool)
        opens[1:] = start[order][1:] >= reach[:-1]
        group = np.cumsum(opens) - 1
        by = np.argsort(group * 2 + side[order], kind="stable")
        order, self.group = order[by], group[by]
        self.ids, self.side, self.doc = np.concatenate(ids)[order], side[order], doc[order]
        self.start, self.end = start[order], end[order]
        heads = np.flatnonzero(np.diff(self.group, prepend=-1))
        self.head, self.group_doc = heads, self.doc[heads]
        self.n = [np.bincount(self.group[self.side == s], minlength=len(heads)).astype(np.int64) for s in (0, 1)]
        self.docs = docs
        self.groups = np.bincount(self.group_doc, minlength=docs)
        self.links = np.zeros(docs, np.int64)
        np.add.at(self.links, self.group_doc, self.n[0] * self.n[1])

    def pairs(self):
        """(document, pair, links): the distinct linked id pairs of every document, sorted."""
        na, nb = self.n
        small = np.flatnonzero(na * nb <= SPELLED)
        many = (na * nb)[small]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        g = np.repeat(small, many)
        keys = [self._key(self.group_doc[g], self.ids[self.head[g] + at // nb[g]], self.ids[self.head[g] + na[g] + at % nb[g]])]
        links = [np.ones(len(g), np.int64)]
        for g in np.flatnonzero(na * nb > SPELLED).tolist():
            a, held_a = np.unique(self.ids[self.head[g]:self.head[g] + na[g]], return_counts=True)
            b, held_b = np.unique(self.ids[self.head[g] + na[g]:self.head[g] + na[g] + nb[g]], return_counts=True)
            keys.append(self._key(self.group_doc[g], np.repeat(a, len(b)), np.tile(b, len(a))))
            links.append(np.repeat(held_a, len(b)) * np.tile(held_b, len(a)))
        key, links = np.concatenate(keys), np.concatenate(links)
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(links[order], heads) if len(heads) else links
        return key[heads] >> 32, key[heads] & 0xFFFFFFFF, total

    @staticmethod
    def _key(doc, a, b):
        return np.asarray(doc, np.int64) << 32 | a << 16 | b

    def digests(self, pair: Pair) -> list[str]:
        """SHA-256 of each document's groups as text; an empty text without tokens."""
        after = np.diff(self.side, prepend=0) > 0
        sep = np.where(np.diff(self.group, prepend=-1) > 0, 0, np.where(after, 2, 1))
        spelled = (sep * pair.size + self.ids).tolist()
        cut = np.searchsorted(self.doc, np.arange(self.docs + 1)).tolist()
        get = pair.spelled.__getitem__
        return [hashlib.sha256(b"".join(map(get, spelled[lo:hi]))[1:]).hexdigest() if hi > lo else ""
                for lo, hi in zip(cut[:-1], cut[1:])]

    def structs(self) -> pa.Array:
        """Per document the groups as structs: bytes start and stop (of space and text), ids of A and of B."""
        sides = []
        for s in (0, 1):
            cut = np.concatenate([[0], np.cumsum(self.n[s])])
            sides.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(self.ids[self.side == s], pa.int32())))
        start = self.start[self.head]
        stop = np.maximum.reduceat(self.end, self.head) if len(self.head) else start
        first = np.zeros(self.docs, np.int64)
        rows = np.searchsorted(self.group_doc, np.arange(self.docs + 1))
        some = rows[1:] > rows[:-1]
        first[some] = start[rows[:-1][some]]
        base = first[self.group_doc]
        parts = pa.StructArray.from_arrays([pa.array(start - base), pa.array(stop - base), *sides], ["start", "stop", "a", "b"])
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), parts)


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return src, src.schema["doc"].dataType.simpleString()


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **paths) -> DataFrame:
    """``id, groups`` per document: the groups' bytes and their ids of A and B, in order. No shuffle."""
    src, kind = _source(docs, id_col, text_col)

    def run(batches):
        pair = Pair(**paths)
        for batch in slices(batches, AT_ONCE):
            found = Aligned(pair, *pair.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found.structs()], names=["id", "groups"])

    return src.mapInArrow(run, f"id {kind}, groups array<struct<start:bigint,stop:bigint,a:array<int>,b:array<int>>>"
                          ).withColumnRenamed("id", id_col)


def chunks(docs: DataFrame, id_col: str, text_col: str, **paths) -> DataFrame:
    """Rows of documents (counts, digest, places of their pairs in the chunk's list, links of each) and, with a
    null digest, of chunks (the list of pairs, documents that hold each)."""
    src, kind = _source(docs, id_col, text_col)
    counts = ", ".join(f"{n} bigint" for n in NAMES)
    schema = f"chunk bigint, doc {kind}, {counts}, digest string, place array<int>, links array<int>, pairs array<bigint>, held array<int>"

    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        pair = Pair(**paths)
        held, amount = [], 0

        def chunk():
            every = np.concatenate([x["pair"] for x in held])
            known, place = np.unique(every, return_inverse=True)
            at = 0
            for x in held:
                n = len(x["pair"])
                lists = [pa.ListArray.from_arrays(pa.array(x["cut"], pa.int32()), pa.array(v, pa.int32()))
                         for v in (place[at:at + n], x["links"])]
                at += n
                rows = len(x["digest"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, number)), x["doc"], *(pa.array(v, pa.int64()) for v in x["counts"]),
                     pa.array(x["digest"], pa.string()), *lists, pa.nulls(rows, pa.list_(pa.int64())),
                     pa.nulls(rows, pa.list_(pa.int32()))], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.nulls(1, held[0]["doc"].type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                 *[pa.nulls(1, pa.list_(pa.int32()))] * 2, pa.array([known], pa.list_(pa.int64())),
                 pa.array([np.bincount(place, minlength=len(known))], pa.list_(pa.int32()))], names=names)

        names = ["chunk", "doc", *NAMES, "digest", "place", "links", "pairs", "held"]
        for batch in slices(batches, AT_ONCE):
            found = Aligned(pair, *pair.encode(batch.column(1).to_pylist()))
            doc, ids, links = found.pairs()
            held.append({"doc": batch.column(0), "counts": (*found.tokens, found.groups, found.links), "digest": found.digests(pair),
                         "pair": ids, "links": links, "cut": np.searchsorted(doc, np.arange(found.docs + 1))})
            amount += batch.column(1).nbytes
            if amount >= CHUNK:
                yield from chunk()
                held, amount, number = [], 0, number + 1
        if held:
            yield from chunk()

    return stored(src.mapInArrow(run, schema), "aligned")


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **paths) -> DataFrame:
    """Per document: tokens of A and B, groups, links, links whose pair is a best one of its A id, the sum of
    the links' counts, and the digest of the groups."""
    rows = chunks(docs, id_col, text_col, **paths)
    lists = rows.where("digest is null").select(F.col("chunk").alias("part"), F.inline(F.arrays_zip("pairs", "held")))
    count = stored(lists.groupBy("pairs").agg(F.sum("held").alias("count")), "pair-counts")
    a = F.shiftright("pairs", 16)
    top = count.groupBy(a.alias("a")).agg(F.max("count").alias("top"))  # at most one row per id of A
    known = count.withColumn("a", a).join(F.broadcast(top), "a").select("pairs", "count", (F.col("count") == F.col("top")).alias("best"))
    back = lists.select("part", "pairs").join(known, "pairs")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pairs"].to_numpy())
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        place, links = (left[c].combine_chunks() for c in ("place", "links"))
        size = place.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        place, links = place.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)
        sums = []
        for value in (best, count):
            total = np.zeros(len(size), np.int64)
            np.add.at(total, row, links * value[place])
            sums.append(pa.array(total))
        return pa.Table.from_arrays([left["doc"], *(left[n] for n in NAMES), *sums, left["digest"]],
                                    names=["doc", *NAMES, "n_best", "count_sum", "digest"])

    kind = rows.schema["doc"].dataType.simpleString()
    counts = ", ".join(f"{n} bigint" for n in (*NAMES, "n_best", "count_sum"))
    mine = rows.where("digest is not null").select("chunk", "doc", *NAMES, "digest", "place", "links")
    return mine.groupBy("chunk").cogroup(back.groupBy("part")).applyInArrow(score, f"doc {kind}, {counts}, digest string").select(
        F.col("doc").alias(id_col), *NAMES, "n_best", "count_sum", F.col("digest").alias("groups_sha256"))


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return link_statistics(table(spark, sf_dir, "documents"))
