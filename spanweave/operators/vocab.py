"""Vocabulary, encoding and decoding.

A piece is a run of word characters or one punctuation/symbol character,
prefixed with the word-start marker when separators precede it (as a
sentencepiece model writes it). The vocabulary holds the 256 bytes, the subwords
of a public rank file, the corpus's frequent characters and then its most frequent
longer pieces. A piece that is not in it is spelled: from the left, the longest
entry that stands there, and a character that has none as its UTF-8 bytes. So
every Unicode text has ids, whatever the size of the alphabet, and none is 2.
Ids: 0 pad, 1 eos, 2 unk (unused by encoding), 3..258 bytes, then subwords in rank
order, characters and pieces by (count desc, text), then the sentinels at the top.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spanweave.constants import (EOS_ID, EOS_TOKEN, IGNORE_ID, N_SENTINELS, PAD_ID, PAD_TOKEN, SPARK_PIECE_PATTERN,
                                 UNK_ID, UNK_TOKEN, VOCAB_SIZE, WORD_MARK)
from spanweave.functions.arrays import fit_length_sql, ignore_pads_sql
from spanweave.sources.tables import stored

N_SPECIAL = 3
#: Id of the first entry that is text; the 256 bytes stand before it.
FIRST_PIECE = N_SPECIAL + 256
#: Longest entry, in characters, that spelling looks for.
SPELL_LEN = 16
#: Subwords of the public rank file that a vocabulary takes by default.
N_SUBWORDS = 2000
#: Characters get at most this part of the ids that are left for text.
CHARACTER_PART = 8
#: Counts are told apart to 1/16 of a power of two when the least count of a vocabulary is looked for.
COUNT_STEPS = 16
#: Pieces that are looked up at a time.
LOOKUP_BLOCK = 1 << 18
#: Spelled pieces that a task remembers from one block to the next.
MEMO_SIZE = 1 << 17
#: Longer ones are not remembered.
MEMO_LEN = 64


def byte_piece(b: int) -> str:
    return f"<0x{b:02X}>"


def read_subwords(path: str | None = None, n: int = N_SUBWORDS) -> list[str]:
    """The first n entries of a public rank file (base64 text and rank a line) that are whole characters.

    A space stands for the word-start marker. ``path`` defaults to the installed byte-level file; without one
    there are no subwords."""
    if path is None:
        try:
            import public_tokenizers
        except ModuleNotFoundError:
            return []
        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out: dict[str, None] = {}
    with open(path, "rb") as f:
        for line in f:
            if len(out) == n:
                break
            try:
                word = base64.b64decode(line.split()[0]).decode().replace(" ", WORD_MARK)
            except UnicodeDecodeError:
                continue
            if word.isprintable():
                out[word] = None
    return list(out)


def pieces(text: str | Column) -> Column:
    """Text -> array of pieces (JVM regex, two capture groups, zipped)."""
    t = F.concat(F.lit(" "), text if isinstance(text, Column) else F.col(text))
    ws = F.regexp_extract_all(t, F.lit(SPARK_PIECE_PATTERN), F.lit(1))
    core = F.regexp_extract_all(t, F.lit(SPARK_PIECE_PATTERN), F.lit(2))
    return F.zip_with(ws, core, lambda w, c: F.when(w == F.lit(""), c).otherwise(F.concat(F.lit(WORD_MARK), c)))


#: Kinds of characters: in no piece, a separator, part of a run, a piece of its own.
NO_PIECE, SEPARATOR, RUN, SINGLE = range(4)
#: Bytes of text that are split into pieces at a time, at least.
SPLIT_BLOCK = 1 << 20
_kinds: list[np.ndarray] = []


def character_kinds(spark) -> np.ndarray:
    """Kind of every code point, as the JVM's patterns tell them apart: 1 MB, made once."""
    if not _kinds:
        points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        kinds = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((RUN, r"[^\p{Z}\p{C}\p{P}\p{S}]"), (SINGLE, r"[\p{P}\p{S}]"), (SEPARATOR, r"[\p{Z}\p{Cc}]")):
            met = spark._jvm.java.util.regex.Pattern.compile(pattern).matcher(text).replaceAll("\0")
            kinds[points[np.frombuffer(met.encode("utf-32-le"), "<u4") == 0]] = kind
        _kinds.append(kinds)
    return _kinds[0]


def _sizes_utf8(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)


def split_pieces(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(pieces, row ends with a 0 before them, mask of null rows) of an array of texts: what ``pieces`` makes, by the kinds
    of characters, in blocks that end before a space or a text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    nulls, texts = texts.is_null(), pc.fill_null(texts, "").cast(pa.large_string())
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:   # bytes that are no characters, as the JVM reads them
        texts = pa.array([t.decode("utf-8", "replace") for t in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = memoryview(data)[ends[0]:ends[-1]] if data is not None else memoryview(b"")
    ends = ends - ends[0]
    starts = ends[:-1][np.diff(ends) > 0]   # of texts that are not empty
    found, cut, total, lo = [], [np.zeros(1, np.int64)], 0, 0
    while lo < len(data):
        hi = _block_end(data, starts, lo)
        points = np.frombuffer(str(data[lo:hi], "utf-8").encode("utf-32-le"), "<u4")
        here, rows = starts[np.searchsorted(starts, lo):np.searchsorted(starts, hi)] - lo, ends[np.searchsorted(ends, lo, "right"):np.searchsorted(ends, hi, "right")] - lo
        if len(points) < hi - lo:
            at = np.append(0, np.cumsum(_sizes_utf8(points)))
            here, rows = np.searchsorted(at, here), np.searchsorted(at, rows)
        kind = kinds[points]
        before = np.empty_like(kind)
        before[:1], before[1:] = SEPARATOR, kind[:-1]
        before[here] = SEPARATOR
        opens = (kind == SINGLE) | ((kind == RUN) & (before != RUN))
        marked = opens & (before == SEPARATOR)
        kept = kind >= RUN
        # a kept character stands behind all kept ones before it and their markers
        at = np.cumsum(kept.astype(np.int32) + marked) - 1
        out = np.empty(at[-1] + 1 if len(at) else 0, "<u4")
        out[at[kept]] = points[kept]
        out[at[marked] - 1] = ord(WORD_MARK)
        first = np.flatnonzero(opens)
        begins = (at[first] - marked[first]).astype(np.int64)
        flat = out.tobytes().decode("utf-32-le").encode()
        if len(flat) > len(out):
            begins = np.append(0, np.cumsum(_sizes_utf8(out)))[begins]
        offsets = np.append(begins, len(flat)).astype(np.int32)
        found.append(pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)))
        cut.append(total + np.searchsorted(first, rows))
        total, lo = total + len(first), hi
    cut = np.concatenate(cut)
    cut = np.concatenate([np.zeros(len(texts) + 1 - len(cut), np.int64), cut])   # empty texts before the first piece
    return pa.concat_arrays(found) if found else pa.array([], pa.string()), cut, nulls


def _block_end(data: memoryview, starts: np.ndarray, lo: int) -> int:
    """First place from ``SPLIT_BLOCK`` bytes on where a text begins or a space stands."""
    if lo + SPLIT_BLOCK >= len(data):
        return len(data)
    here = starts[np.searchsorted(starts, lo + SPLIT_BLOCK):][:1]
    stop = int(here[0]) if len(here) else len(data)
    for at in range(lo + SPLIT_BLOCK, stop, SPLIT_BLOCK):
        space = bytes(data[at:min(at + SPLIT_BLOCK, stop)]).find(b" ")
        if space >= 0:
            return at + space
    return stop


def sentinel_token(k: int) -> str:
    """Name of sentinel k (0-based): id = vocabulary size - 1 - k."""
    return f"<extra_id_{k}>"


def build_vocab(df: DataFrame, text_col: str = "text", size: int = VOCAB_SIZE,
                n_sentinels: int = N_SENTINELS, subwords: list[str] | None = None) -> DataFrame:
    """(piece, id, count) for specials, bytes, subwords, characters, the most frequent pieces, sentinels.

    Counting is a map-side-combined ``groupBy`` (hot pieces never reach one task
    unaggregated). A histogram of counts (some hundred rows) gives the least count
    that can still be in the vocabulary, so that only about ``size`` pieces, not so many
    of every partition, meet in the top-k that numbers them.
    """
    k = size - n_sentinels - FIRST_PIECE
    if k < 0:
        raise ValueError(f"a vocabulary needs {n_sentinels + FIRST_PIECE} ids for specials, bytes and sentinels")
    spark = df.sparkSession
    subwords = (read_subwords() if subwords is None else subwords)[:k]
    sub = spark.createDataFrame([(w, r) for r, w in enumerate(subwords)], "piece string, rank int")
    kinds = spark.sparkContext.broadcast(character_kinds(spark))

    def counted(batches):
        for batch in batches:
            coded = split_pieces(batch.column(0), kinds.value)[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], names=["piece", "n"])

    met = df.select(F.col(text_col).cast("string")).mapInArrow(counted, "piece string, n bigint")
    counts = stored(met.groupBy("piece").agg(F.sum("n").cast("bigint").alias("count")), "piece-counts")
    chars = (counts.select(F.explode(F.split("piece", "")).alias("piece"), "count")
                   .groupBy("piece").agg(F.sum("count").alias("count")).where("piece <> ''"))
    new = counts.where(F.length("piece") > 1).join(F.broadcast(sub), "piece", "left_anti")
    order = (F.desc("count"), F.asc("piece"))
    # tables bounded by ``size``
    known = counts.join(F.broadcast(sub), "piece").select("piece", "count").toPandas()
    held = dict(zip(known["piece"], known["count"]))
    most = (k - len(subwords)) // CHARACTER_PART
    letters = (chars.join(F.broadcast(sub), "piece", "left_anti").orderBy(*order).limit(most)).toPandas()
    room = k - len(subwords) - len(letters)
    step = F.floor(F.log2("count") * COUNT_STEPS)
    least, above = 0, 0
    for r in new.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        least, above = r["step"], above + r["n"]
        if above >= room:
            break
    longer = new.where(step >= least).orderBy(*order).limit(room).toPandas()
    import pandas as pd
    rows = [(PAD_TOKEN, PAD_ID, 0), (EOS_TOKEN, EOS_ID, 0), (UNK_TOKEN, UNK_ID, 0)]
    rows += [(byte_piece(b), N_SPECIAL + b, 0) for b in range(256)]
    text = [(w, held.get(w, 0)) for w in subwords] + [*letters.itertuples(index=False)] + [*longer.itertuples(index=False)]
    rows += [(w, FIRST_PIECE + i, n) for i, (w, n) in enumerate(text)]
    rows += [(sentinel_token(j), size - 1 - j, 0) for j in range(n_sentinels)]
    pdf = pd.DataFrame(rows, columns=["piece", "id", "count"]).astype({"id": "int32", "count": "int64"})
    return spark.createDataFrame(pdf, "piece string, id int, count bigint")


def _vocab_pieces(vocab: DataFrame, size: int, n_sentinels: int) -> list[str]:
    """Text entries ordered by id (ids 259..), collected once; bounded by ``size``."""
    pdf = (vocab.filter((F.col("id") >= FIRST_PIECE) & (F.col("id") < size - n_sentinels))
                .orderBy("id").select("piece", "id").toPandas())
    if len(pdf) > size:
        raise ValueError("vocabulary larger than its declared size")
    if (pdf["id"].to_numpy() != range(FIRST_PIECE, FIRST_PIECE + len(pdf))).any():
        raise ValueError(f"vocabulary ids must be dense from {FIRST_PIECE}")
    return pdf["piece"].tolist()


def spell(piece: str, held: dict[str, int]) -> list[int]:
    """Ids of a piece: its own, or those of the longest entries from the left, bytes where none stands."""
    if piece in held:
        return [held[piece]]
    out, at, n = [], 0, len(piece)
    while at < n:
        for stop in range(min(n, at + SPELL_LEN), at, -1):
            found = held.get(piece[at:stop])
            if found is not None:
                out.append(found)
                at = stop
                break
        else:
            out += [N_SPECIAL + b for b in piece[at].encode()]
            at += 1
    return out


class Entries(dict):
    """Ids of the text entries, and beside them those of the pieces that a task has spelled so far."""

    def __init__(self, found):
        super().__init__(found)
        self.spelled: dict[str, list[int]] = {}

    def ids(self, piece: str) -> list[int]:
        out = self.spelled.get(piece)
        if out is None:
            out = spell(piece, self)
            if len(piece) <= MEMO_LEN:
                if len(self.spelled) >= MEMO_SIZE:
                    self.spelled.clear()
                self.spelled[piece] = out
        return out


def _spelled(arr: pa.Array, held: dict[str, int]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """(ids of each distinct piece, their numbers, which distinct piece stands where) of a flat array of pieces."""
    coded = arr.dictionary_encode()
    held = held if isinstance(held, Entries) else Entries(held)
    ids = [held.ids(p or "") for p in coded.dictionary.to_pylist()]
    return ids, np.array([len(x) for x in ids], np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(arr: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(items, row ends with a 0 before them, mask of null rows) of a list array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(arr), np.concatenate([[0], np.cumsum(sizes)]), arr.is_null()


def _held(vocab: DataFrame, size: int, n_sentinels: int):
    """Function that gives the text entries' ids on a worker, built once a task from a broadcast list."""
    bc = vocab.sparkSession.sparkContext.broadcast(_vocab_pieces(vocab, size, n_sentinels))
    built: list[Entries] = []

    def get() -> Entries:
        if not built:
            built.append(Entries((p, FIRST_PIECE + i) for i, p in enumerate(bc.value)))
        return built[0]
    return get


def _sent_kinds(vocab: DataFrame):
    return vocab.sparkSession.sparkContext.broadcast(character_kinds(vocab.sparkSession))


def _ids_of(arr: pa.Array, held: dict[str, int], kinds: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(ids, row ends with a 0 before them, mask of null rows) of a list array of pieces, or of an array of texts.

    Pieces are looked up in blocks, so that the tables of a batch of any size stay small beside its ids."""
    items, cut, nulls = _flat(arr) if pa.types.is_list(arr.type) else split_pieces(arr, kinds)
    parts, ends, total = [], [np.zeros(1, np.int64)], 0
    for lo in range(0, len(items), LOOKUP_BLOCK):
        ids, sizes, which = _spelled(items.slice(lo, LOOKUP_BLOCK), held)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        every = np.fromiter(chain.from_iterable(ids), np.int32, starts[-1])
        here = np.concatenate([[0], np.cumsum(sizes[which])])
        parts.append(every[np.repeat(starts[which] - here[:-1], sizes[which]) + np.arange(here[-1])])
        # the ends of rows that lie in this block
        rows = cut[np.searchsorted(cut, lo, "right"):np.searchsorted(cut, lo + len(which), "right")]
        ends.append(total + here[rows - lo])
        total += here[-1]
    ends = np.concatenate(ends)
    ends = np.concatenate([np.zeros(len(cut) - len(ends), np.int64), ends])   # empty rows before the first piece
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)), ends, nulls


def chunk_ids(vocab: DataFrame, body: int, size: int = VOCAB_SIZE, n_sentinels: int = N_SENTINELS):
    """Column function: texts (or array<string> pieces) -> array<array<int>>, their ids in consecutive runs of ``body``.

    A text without pieces has one empty run, a null text one null run."""
    get, kinds = _held(vocab, size, n_sentinels), _sent_kinds(vocab)

    @F.arrow_udf("array<array<int>>")
    def _chunks(arr: pa.Array) -> pa.Array:
        ids, cut, nulls = _ids_of(arr, get(), kinds.value)
        runs = np.maximum(-(-np.diff(cut) // body), 1)
        outer = np.concatenate([[0], np.cumsum(runs)])
        nth = np.arange(outer[-1]) - np.repeat(outer[:-1], runs)
        stops = np.minimum(np.repeat(cut[:-1], runs) + (nth + 1) * body, np.repeat(cut[1:], runs))
        null_runs = np.repeat(nulls.to_numpy(zero_copy_only=False), runs)
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), ids, mask=pa.array(null_runs))
        return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)

    return _chunks


def piece_ids(vocab: DataFrame, size: int = VOCAB_SIZE, n_sentinels: int = N_SENTINELS):
    """Column function: texts (or array<string> pieces) -> array<int> ids.

    Each batch spells its distinct pieces only, against a dictionary that a task
    builds once from the broadcast entries: the vocabulary is bounded by ``size``
    (32,100 by default, checked), and the lookup keeps the per-document
    layout, so no token-level explode/regroup shuffle is needed.
    """
    get, kinds = _held(vocab, size, n_sentinels), _sent_kinds(vocab)

    @F.arrow_udf("array<int>")
    def _lookup(arr: pa.Array) -> pa.Array:
        ids, cut, nulls = _ids_of(arr, get(), kinds.value)
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), ids, mask=nulls)

    return _lookup


def piece_counts(vocab: DataFrame, size: int = VOCAB_SIZE, n_sentinels: int = N_SENTINELS):
    """Column function: array<array<string>> lists of pieces -> array<int>, the number of ids that
    ``piece_ids`` gives for each list."""
    get = _held(vocab, size, n_sentinels)

    @F.arrow_udf("array<int>")
    def _count(arr: pa.Array) -> pa.Array:
        lists, outer, nulls = _flat(arr)
        items, inner, _ = _flat(lists)
        _, sizes, which = _spelled(items, get())
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        counts = np.diff(ends[inner]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.array(counts), mask=nulls)

    return _count


def encode(df: DataFrame, text_col: str, vocab: DataFrame, max_len: int,
           overflow: str = "chunk", out: str = "input_ids",
           mask_out: str = "attention_mask", size: int = VOCAB_SIZE) -> DataFrame:
    """Ids + attention mask, eos last, padded to ``max_len``.

    ``overflow="truncate"`` is the reference behaviour (first max_len-1 pieces
    + eos). ``overflow="chunk"`` keeps the whole text: one row per run of
    max_len-1 pieces (column ``chunk``), each closed by eos and padded.
    ``overflow="refuse"`` fails on a longer text. All are narrow (no shuffle).
    """
    body = max_len - 1
    if overflow == "chunk":
        # the helper gives the runs, so that no row of a chunk carries the ids of its whole text; every text has a
        # run, and "outer" keeps the optimizer from filtering by (and so computing) the runs a second time
        d = df.withColumn("_sw_runs", chunk_ids(vocab, body, size)(F.col(text_col).cast("string")))
        d = d.select(*[c for c in df.columns if c != "chunk"], F.posexplode_outer("_sw_runs").alias("chunk", "_sw_ids"))
        seg = "_sw_ids"
    elif overflow in ("truncate", "refuse"):
        d = df.withColumn("_sw_ids", piece_ids(vocab, size)(F.col(text_col).cast("string")))
        seg = f"slice(_sw_ids, 1, {body})"
        if overflow == "refuse":
            seg = (f"IF(size(_sw_ids) > {body}, raise_error(concat('text of ', size(_sw_ids) + 1, "
                   f"' ids does not fit into {max_len}')), _sw_ids)")
    else:
        raise ValueError("overflow must be 'truncate', 'chunk' or 'refuse'")
    d = d.withColumn("_sw_seg", F.expr(f"concat({seg}, array({EOS_ID}))"))
    d = (d.withColumn(out, F.expr(fit_length_sql("_sw_seg", max_len, PAD_ID)))
          .withColumn(mask_out, F.expr(f"{fit_length_sql('array_repeat(1, size(_sw_seg))', max_len, 0)}")))
    return d.drop("_sw_ids", "_sw_seg")


def encode_ids(df: DataFrame, text_col: str, vocab: DataFrame, out: str = "ids",
               add_eos: bool = True, size: int = VOCAB_SIZE) -> DataFrame:
    """Ids without padding or mask (the packing path, D6), eos appended."""
    lookup = piece_ids(vocab, size)
    ids = lookup(F.col(text_col).cast("string"))
    if add_eos:
        ids = F.concat(ids, F.array(F.lit(EOS_ID)))
    return df.withColumn(out, ids)


def encode_labels(df: DataFrame, text_col: str, vocab: DataFrame, max_len: int,
                  out: str = "labels", overflow: str = "refuse") -> DataFrame:
    """D3: as D2, then pad -> -100. A label that does not fit is an error unless ``overflow`` allows a cut or rows."""
    d = encode(df, text_col, vocab, max_len, overflow=overflow, out="_sw_lab", mask_out="_sw_labmask")
    return d.withColumn(out, F.expr(ignore_pads_sql("_sw_lab"))).drop("_sw_lab", "_sw_labmask")


def encode_sentences(df: DataFrame, list_col: str, vocab: DataFrame, max_len: int,
                     overflow: str = "chunk") -> DataFrame:
    """A list of sentences per row; each sentence encoded alone (rows out != rows in).

    Long sentences become several rows (column ``chunk``), or are cut with ``overflow="truncate"``."""
    d = df.select("*", F.posexplode(list_col).alias("sentence_idx", "_sw_sentence"))
    return encode(d, "_sw_sentence", vocab, max_len, overflow=overflow).drop("_sw_sentence")


def vocab_array(vocab: DataFrame) -> Column:
    """The vocabulary as one array indexed by id (a scalar subquery, evaluated once)."""
    return vocab.agg(F.sort_array(F.collect_list(F.struct("id", "piece"))).alias("v")).scalar()


def decode(df: DataFrame, ids_col: str, vocab: DataFrame, out: str = "text",
           skip_special: bool = True) -> DataFrame:
    """-100 -> pad, ids -> pieces, specials skipped, marker -> space, stripped."""
    d = df.withColumn("_sw_raw", _joined_bytes(vocab, skip_special)(F.col(ids_col).cast("array<int>")))
    # bytes are characters only together with those beside them; ends of characters cut off are U+FFFD
    return d.withColumn(out, F.expr(f"trim(replace(make_valid_utf8(cast(_sw_raw as string)), '{WORD_MARK}', ' '))")).drop("_sw_raw")


def _joined_bytes(vocab: DataFrame, skip_special: bool):
    """Column function: array<int> ids -> the UTF-8 bytes of their entries in a row (-100 is pad, an id without an entry nothing).

    The entries are bounded by the vocabulary's size; all ids of a batch are looked up at once."""
    entries = vocab.orderBy("id", "piece").select("id", "piece").toPandas()
    bc = vocab.sparkSession.sparkContext.broadcast(list(zip(entries["id"].tolist(), entries["piece"].tolist())))
    built: list[pa.Array] = []

    def spelled(i: int, piece: str) -> bytes:
        if skip_special and (i >= VOCAB_SIZE - N_SENTINELS or i < N_SPECIAL):
            return b""
        return bytes([int(piece[3:5], 16)]) if N_SPECIAL <= i < FIRST_PIECE else piece.encode()

    @F.arrow_udf("binary")
    def _join(arr: pa.Array) -> pa.Array:
        if not built:
            # an empty entry at the end stands for ids without one
            built.append(pa.array([spelled(i, p) for i, p in bc.value] + [b""], pa.binary()))
        items, cut, nulls = _flat(arr)
        none = len(built[0]) - 1
        at = pc.fill_null(items, none).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.where(at == IGNORE_ID, PAD_ID, at)
        at = np.where((at < 0) | (at > none), none, at)
        lists = pa.LargeListArray.from_arrays(pa.array(cut, pa.int64()), built[0].cast(pa.large_binary()).take(pa.array(at)))
        joined = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
        return pc.if_else(nulls, pa.scalar(None, pa.large_binary()), joined).cast(pa.binary())

    return _join


def id_to_piece(df: DataFrame, ids_col: str, vocab: DataFrame, out: str = "tokens") -> DataFrame:
    """ids -> piece strings, specials kept (input of phrase masking, E8)."""
    d = df.withColumn("_sw_v", vocab_array(vocab))
    return d.withColumn(out, F.expr(
        f"transform({ids_col}, i -> coalesce(try_element_at(_sw_v, i + 1).piece, '{UNK_TOKEN}'))")).drop("_sw_v")
