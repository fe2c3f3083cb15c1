"""Phrase-aware masking (E4-E8) and phrase mining (X1, extension).

Masking and matching are row-local: a filter of bits finds the windows that may be phrases, and the few texts that
pass it without being one are looked for first, once for each distinct text. Mining counts level by level and prunes
by sketches; every level's tables are stored and their shuffles removed before the next one begins.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from spanweave.constants import ASCII_PUNCTUATION, DEFAULT_SEED, EOS_TOKEN, PAD_TOKEN, WORD_MARK
from spanweave.functions.rank import md5_sql
from spanweave.operators.vocab import _flat
from spanweave.sources.tables import released, stored

WORDS_T = ArrayType(StructType([StructField(c, IntegerType()) for c in ("first", "ntok", "part")]))
MATCHES_T = ArrayType(StructType([StructField("n", IntegerType()), StructField("s", IntegerType()), StructField("text", StringType())]))
#: Bits of one long of a position set.
BITS = 64


def _let(value: str, var: str, body: str) -> str:
    """Bind ``value`` once per row and use it in ``body`` (an identity fold)."""
    return f"aggregate(array(0), {value}, (_a, _x) -> _a, {var} -> {body})"


#: Most words of a phrase.
LONGEST = 5


def _text_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


class RowWords:
    """The words (E4) of a batch of token lists, one after another; ``texts`` are the tokens' texts, without marker, lowercased."""

    def __init__(self, tokens: pa.Array, texts: pa.Array):
        items, cut, _ = _flat(tokens)
        coded = items.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        known = coded.dictionary.to_pylist()
        sep = np.array([t in (EOS_TOKEN, PAD_TOKEN) for t in known], bool)[code]
        opens = np.array([t.startswith(WORD_MARK) or t in ASCII_PUNCTUATION for t in known], bool)[code]
        row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        after = np.ones(len(code), bool)   # first in its row, or behind a separator
        after[1:] = sep[:-1] | (row[1:] != row[:-1])
        start = ~sep & (after | opens)
        at = np.flatnonzero(start)
        bounds = np.append(np.flatnonzero(start | sep), len(code))
        ends = np.minimum(bounds[np.searchsorted(bounds, at, "right")], cut[row[at] + 1])
        seps = np.append(0, np.cumsum(sep))
        #: row, first token, number of tokens and number of separators before each word
        self.row = row[at]
        self.first, self.ntok, self.part = at - cut[self.row], ends - at, seps[at] - seps[cut[self.row]]
        #: equal for words of one part of one row
        self.group = seps[at] + self.row
        #: words of row i are those from cut[i] on
        self.cut = np.searchsorted(self.row, np.arange(len(cut)))
        kept = pc.list_flatten(texts).filter(pa.array(~sep))
        offsets = np.append(0, np.cumsum(self.ntok))
        coded = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kept), "").dictionary_encode()
        #: distinct word texts, and which of them stands where
        self.known, self.which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)

    def met(self, bits: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first words, hashes) of the windows of 2 .. ``LONGEST`` words of one part that pass the filter, longest first."""
        words = _text_hashes(self.known)[self.which] if len(self.known) else np.zeros(0, np.uint64)
        out, h = [], words
        for n in range(2, LONGEST + 1):
            h = _rolled(h, words, n)
            s = np.flatnonzero(self.group[:len(h)] == self.group[n - 1:])
            s = s[_may_be(bits, h[s])]
            out.insert(0, (n, s, h[s]))
        return out

    def texts(self, n: int, s: np.ndarray) -> pa.Array:
        """Texts of the windows of n words from the words ``s``."""
        return pc.binary_join_element_wise(*[self.known.take(pa.array(self.which[s + k])) for k in range(n)], " ")


#: Places that a phrase sets in a filter, and bits that it has there at least; a filter has 2^30 (128 MB) at most.
FILTER_PLACES, FILTER_BITS, MOST_FILTER_BITS = 6, 32, 30


def _places(h: np.ndarray, k: int, size: int) -> np.ndarray:
    """The k-th place of each hash among ``size`` (a power of two)."""
    x = (h + np.uint64(k * 0x9E3779B97F4A7C15 % 2 ** 64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(size - 1)).astype(np.int64)


def _may_be(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have all their places in the filter: all that were put in, and few others."""
    left = np.arange(len(h))
    for k in range(FILTER_PLACES):
        at = _places(h[left], k, len(bits) * 8)
        left = left[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(h), bool)
    out[left] = True
    return out


def _line_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the texts of 2 .. ``LONGEST`` words, by their number of words."""
    lists = pc.split_pattern(texts, " ")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    each = _text_hashes(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    starts, h, out = np.append(0, np.cumsum(sizes))[:-1], each, []
    for n in range(2, LONGEST + 1):
        h = _rolled(h, each, n)
        out.append(h[starts[sizes == n]])
    return out


def _phrase_filter(known: DataFrame, column: str, count: int):
    """Broadcast filter of the phrases of 2 .. ``LONGEST`` words; its size follows their number, up to 2^30 bits."""
    size = 1 << min(max((count * FILTER_BITS - 1).bit_length(), 16), MOST_FILTER_BITS)

    def run(batches):
        for batch in batches:
            for h in _line_hashes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_places(h, k, size) for k in range(FILTER_PLACES)]))], names=["bit"])

    bit = F.col("bit") + 1   # buckets of the bitmap functions begin at 1
    rows = (known.select(column).mapInArrow(run, "bit bigint").groupBy((F.bitmap_bucket_number(bit) - 1).alias("block"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")))
    return _broadcast_bits(rows, size)


def _broadcast_bits(rows: DataFrame, size: int):
    """Broadcast set of ``size`` bits from rows (block, bits) of ``SKETCH_ROW`` bits each."""
    rows = stored(rows, "bits")
    held = np.zeros(size // 8, np.uint8)
    for r in rows.toLocalIterator():   # 2^30 bits at most
        lo = r["block"] * (SKETCH_ROW // 8)
        held[lo:lo + SKETCH_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    released(rows)
    return rows.sparkSession.sparkContext.broadcast(held)


def _candidates(bits):
    """Texts of the windows of a batch that pass the filter, each once."""
    def run(batches):
        for batch in batches:
            words = RowWords(batch.column(0), batch.column(1))
            for n, s, _ in words.met(bits.value):
                for lo in range(0, len(s), TEXT_BLOCK):
                    yield pa.RecordBatch.from_arrays([words.texts(n, s[lo:lo + TEXT_BLOCK]).unique()], names=["text"])
    return run


def _matches(bits, strangers):
    """Column function: words and matches of token lists; ``strangers`` (hashes, texts) pass the filter and are no phrases."""
    @F.arrow_udf(StructType([StructField("words", WORDS_T), StructField("matches", MATCHES_T)]))
    def run(tokens: pa.Array, texts: pa.Array) -> pa.Array:
        words = RowWords(tokens, texts)
        hashes, odd = strangers.value
        found = []
        for n, s, h in words.met(bits.value):
            text = words.texts(n, s)
            good = np.ones(len(s), bool)
            for i in np.flatnonzero(np.isin(h, hashes)):
                good[i] = text[i].as_py() not in odd
            found.append((np.full(int(good.sum()), n), s[good], text.filter(pa.array(good))))
        s = np.concatenate([f[1] for f in found])
        order = np.argsort(words.row[s], kind="stable")
        n, s, text = np.concatenate([f[0] for f in found])[order], s[order], pa.concat_arrays([f[2] for f in found]).take(pa.array(order))
        ends = np.searchsorted(words.row[s], np.arange(len(words.cut)))
        columns = [(words.cut, [words.first, words.ntok, words.part], WORDS_T), (ends, [n, s - words.cut[words.row[s]], text], MATCHES_T)]
        lists = []
        for cut, values, kind in columns:
            values = [v if isinstance(v, pa.Array) else pa.array(v, pa.int32()) for v in values]
            items = pa.StructArray.from_arrays(values, names=kind.elementType.names)
            lists.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items))
        return pa.StructArray.from_arrays(lists, names=["words", "matches"])

    return run


def match_phrases(df: DataFrame, tokens: str, phrases: DataFrame, out: str = "matches") -> DataFrame:
    """E4 + E5: words of ``tokens`` (column ``words``) and matched windows ``out`` (array of (n, s, text)).

    A filter of the phrases' bits, some bits for each of them, is sent to the tasks. The distinct texts of the windows that
    pass it meet the phrases in an equi-join that the optimizer broadcasts or shuffles; what is left are the few texts that
    pass and are no phrases. With those sent as well, every row decides on its windows by their texts: no row
    is stored or shuffled, and there is one plan for any number of phrases.
    """
    d = df.withColumn("_sw_texts", F.expr(f"transform({tokens}, t -> lower(trim(BOTH '{WORD_MARK}' FROM t)))"))
    known = stored(phrases.select(F.col("phrase").alias("text")).where("text <> ''"), "phrase-set")
    bits = _phrase_filter(known, "text", known.count())
    passed = d.select(tokens, "_sw_texts").mapInArrow(_candidates(bits), "text string").distinct()
    odd = stored(passed.join(known, "text", "left_anti"), "phrase-strangers")
    texts = [r["text"] for r in odd.toLocalIterator()]
    hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *_line_hashes(pa.array(texts, pa.string()))]))
    strangers = df.sparkSession.sparkContext.broadcast((hashes, set(texts)))
    released(known, odd)
    d = d.withColumn("_sw_met", _matches(bits, strangers)(F.col(tokens), F.col("_sw_texts")))
    return d.withColumn("words", F.col("_sw_met.words")).withColumn(out, F.col("_sw_met.matches")).drop("_sw_texts", "_sw_met")


def _no_bits(size: str) -> str:
    """An empty set of positions 0 .. size - 1."""
    return f"array_repeat(0L, cast({size} div {BITS} as int) + 1)"


def _has_bit(bits: str, at: str) -> str:
    return f"(({bits}[cast({at} div {BITS} as int)] & shiftleft(1L, cast({at} % {BITS} as int))) != 0L)"


def _with_bits(bits: str, at: str, n: str = "1") -> str:
    """The set with positions ``at`` .. ``at`` + n - 1 (n below ``BITS``); they touch two longs at most."""
    ones = f"(shiftleft(1L, cast({n} as int)) - 1L)"
    return (f"transform({bits}, (x, k) -> CASE WHEN k = {at} div {BITS} THEN x | shiftleft({ones}, cast({at} % {BITS} as int)) "
            f"WHEN k = ({at} + {n} - 1) div {BITS} THEN x | shiftrightunsigned({ones}, cast({BITS} - {at} % {BITS} as int)) ELSE x END)")


def resolve_overlaps_sql(matches: str, size: str, seed, key: str) -> str:
    """Longest first, md5 order within a length; skip a window touching a covered word.

    The fold keeps two sets of word positions, covered words and first words. An earlier window is
    at least as long, so that it meets a later one only where it covers its first or its last word.
    Result: struct (covered, first) of the two sets."""
    order = (f"sort_array(transform({matches}, m -> named_struct('k', -m.n, 'r', "
             f"{md5_sql(seed, key, chr(39) + 'merge' + chr(39), 'm.n', 'm.s')}, 's', m.s, 'n', m.n)))")
    return (f"aggregate({order}, named_struct('covered', {_no_bits(size)}, 'first', {_no_bits(size)}), "
            f"(acc, m) -> IF({_has_bit('acc.covered', 'm.s')} OR {_has_bit('acc.covered', '(m.s + m.n - 1)')}, acc, "
            f"named_struct('covered', {_with_bits('acc.covered', 'm.s', 'm.n')}, 'first', {_with_bits('acc.first', 'm.s')})))")


def _spans_to_mask_sql(spans: str, n: str) -> str:
    """0/1 array of length n from disjoint (first, ntok) spans sorted by first: one run
    of zeros and one run of ones per span, then trailing zeros (linear in n)."""
    gap = f"c.first - IF(j = 0, 0, {spans}[j - 1].first + {spans}[j - 1].ntok)"
    end = f"IF(size({spans}) = 0, 0, element_at({spans}, -1).first + element_at({spans}, -1).ntok)"
    return (f"concat(flatten(transform({spans}, (c, j) -> concat(array_repeat(0, {gap}), array_repeat(1, c.ntok)))), "
            f"array_repeat(0, {n} - {end}))")


def phrase_mask(df: DataFrame, tokens: str, phrases: DataFrame, key: str, out: str = "phrase_mask",
                p: float = 0.5, max_predictions: int = 512, seed=DEFAULT_SEED) -> DataFrame:
    """0/1 mask over ``tokens`` masking whole words and phrases.

    Budget = min(max, max(1, round(len * p))) with len counting pads;
    candidates (resolved phrases, then remaining single words) are ordered by
    token count desc with md5 ties, and taken while they fit the budget. What is chosen is a set of
    positions in 64-bit words, so that the work grows with the length, not with its square.
    """
    d = match_phrases(df, tokens, phrases, "_sw_matches")
    d = d.withColumn("_sw_chosen", F.expr(resolve_overlaps_sql("_sw_matches", "size(words)", seed, key)))
    # a phrase or a lone word begins at each word that is a first one or is not covered, and ends before the next one
    begins = (f"filter(IF(size(words) > 0, sequence(0, size(words) - 1), cast(array() as array<int>)), "
              f"w -> {_has_bit('_sw_chosen.first', 'w')} OR NOT {_has_bit('_sw_chosen.covered', 'w')})")
    cands = (f"transform(BG, (w, j) -> named_struct('first', words[w].first, 'ntok', "
             f"words[coalesce(try_element_at(BG, j + 2), size(words)) - 1].first + "
             f"words[coalesce(try_element_at(BG, j + 2), size(words)) - 1].ntok - words[w].first))")
    ranked = (f"sort_array(transform({cands}, c -> named_struct('k', -c.ntok, 'r', "
              f"{md5_sql(seed, key, chr(39) + 'cand' + chr(39), 'c.first')}, 'first', c.first, 'ntok', c.ntok)))")
    d = d.withColumn("_sw_cands", F.expr(_let(begins, "BG", ranked)))
    budget = f"least({int(max_predictions)}, greatest(1, cast(rint(size({tokens}) * {float(p)!r}) as int)))"
    fold = (f"aggregate(_sw_cands, named_struct('used', 0, 'first', {_no_bits(f'size({tokens})')}), "
            f"(acc, c) -> IF(acc.used + c.ntok <= {budget}, named_struct('used', acc.used + c.ntok, "
            f"'first', {_with_bits('acc.first', 'c.first')}), acc), acc -> acc.first)")
    taken = (f"array_sort(transform(filter(_sw_cands, c -> {_has_bit('TK', 'c.first')}), "
             f"c -> named_struct('first', c.first, 'ntok', c.ntok)))")
    d = d.withColumn(out, F.expr(_let(fold, "TK", _let(taken, "S", _spans_to_mask_sql("S", f"size({tokens})")))))
    return d.drop("_sw_matches", "_sw_chosen", "_sw_cands", "words")


def compositions(n: int) -> list[list[tuple[int, int]]]:
    """All splits of n words into >= 2 contiguous segments, as (start, length)."""
    out = []
    for cuts in range(1, n):
        for pos in itertools.combinations(range(1, n), cuts):
            b = (0,) + pos + (n,)
            out.append([(b[i], b[i + 1] - b[i]) for i in range(len(b) - 1)])
    return out


#: Stands between the pieces of a word while its pieces are lowercased; a character that no piece has.
JOINT = "\ue000"


def word_lines(df: DataFrame, text_col: str = "text", out: str = "line") -> DataFrame:
    """Lowercased whole words of raw text (E4 on its pieces; raw text has no separators) as one line, a space before each word.

    A word begins where separators stand before a piece, and at ASCII punctuation and the marker's own character. A piece
    without separators before it goes on with the word, also where a character that belongs to no piece stands between."""
    piece, space = r"[^\p{Z}\p{C}]", r"[\p{Z}\p{Cc}]"
    opens = "[" + "".join("\\" + c for c in ASCII_PUNCTUATION) + WORD_MARK + "]"
    line = F.concat(F.lit(" "), F.col(text_col))
    # separators count only directly before a piece
    line = F.regexp_replace(line, F.lit(rf"(?<!{space}){space}++(?!{piece})|[\p{{C}}&&[^\p{{Cc}}]]++"), F.lit(JOINT))
    line = F.regexp_replace(line, F.lit(rf"{space}++|(?<!{space})(?={opens})"), F.lit(" "))
    line = F.regexp_replace(line, F.lit(r"([\p{P}\p{S}])"), F.lit(f"{JOINT}$1{JOINT}"))
    line = F.replace(F.replace(F.lower(line), F.lit(JOINT), F.lit("")), F.lit(WORD_MARK), F.lit(""))
    return df.withColumn("_sw_line", line).withColumn(out, F.expr(
        "IF(_sw_line = '' OR startswith(_sw_line, ' '), _sw_line, concat(' ', _sw_line))")).drop("_sw_line")


def _worded(batches):
    """Batches (word_texts, h) of the words of lines and their hashes."""
    for batch in batches:
        lists = pc.split_pattern(batch.column(0), " ")
        cut = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        kept = np.ones(cut[-1], bool)
        kept[cut[:-1]] = False   # what stands before the first space
        words = lists.flatten().filter(pa.array(kept)).dictionary_encode()
        h = _text_hashes(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
        offsets = pa.array(cut - np.arange(len(cut)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, v) for v in (words, pa.array(h.view(np.int64)))],
                                         names=["word_texts", "h"])


#: Bits of a sketch of hashes: 2^27, 16 MB, whatever the corpus.
SKETCH_BITS = 27
#: Bits of one row of a sketch, as ``bitmap_construct_agg`` makes it.
SKETCH_ROW = 1 << 15


def _row_bits(size: int) -> int:
    """Leading bits of a hash that number the rows of a sketch of ``size`` bits."""
    return (size // SKETCH_ROW).bit_length() - 1


def _sketched(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit: in the row of their first bits, by the last of the 32 bits behind those."""
    k, x = _row_bits(len(held) * 8), hashes.view(np.uint64)
    bit = ((x >> np.uint64(64 - k)) * np.uint64(SKETCH_ROW) + ((x >> np.uint64(32 - k)) & np.uint64(SKETCH_ROW - 1))).astype(np.int64)
    return (held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _sketch(lines: DataFrame, n: int, below, min_count: int):
    """Broadcast sketch of the hashes of windows of n words that are met ``min_count`` times at least."""
    size = 1 << SKETCH_BITS
    k = _row_bits(size)

    def packed(batches):
        for batch in _window_counts(n, below)(_worded(batches)):
            h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()   # sorted
            block, rest = (h >> np.uint64(64 - k)).astype(np.int64), ((h >> np.uint64(32 - k)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])[:len(block)])
            step = np.diff(rest, prepend=np.zeros(1, np.uint32))
            step[starts] = rest[starts]
            both = np.stack([step, np.minimum(c, 0xFFFFFFFF).astype(np.uint32)], axis=1).astype("<u4").view(np.uint8)
            # the first bytes of all numbers, then the second ones: most are 0, and compressed away
            parts = [both[lo:hi].T.tobytes() for lo, hi in zip(starts, np.append(starts[1:], len(block)))]
            yield pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

    def frequent(table):
        rests, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for part in table.column("part"):
            both = np.ascontiguousarray(np.frombuffer(part.as_buffer(), np.uint8).reshape(8, -1).T).view("<u4")
            rests.append(np.cumsum(both[:, 0], dtype=np.uint32))
            counts.append(both[:, 1])
        rest, which = np.unique(np.concatenate(rests), return_inverse=True)
        often = rest[np.bincount(which, np.concatenate(counts), len(rest)) >= min_count] & np.uint32(SKETCH_ROW - 1)
        bits = np.zeros(SKETCH_ROW, np.uint8)
        bits[often] = 1
        bits = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    met = lines.mapInArrow(packed, "block int, part binary")
    return _broadcast_bits(met.groupBy("block").applyInArrow(frequent, "block int, bits binary"), size)


def _rolled(h: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of windows of n words from those ``h`` of the windows of n - 1 words."""
    m = max(len(words) - n + 1, 0)
    out = (h[:m] ^ (h[:m] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + words[n - 1:]
    return out ^ (out >> np.uint64(29))


def _word_hashes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of a batch, the document each is in)."""
    lists = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)


def _passed(words: np.ndarray, doc: np.ndarray, n: int, held: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 .. n words: (hashes, whether the window lies in one document and its parts have their bits)."""
    out = [(words, np.ones(len(words), bool))]
    for k in range(2, n + 1):
        h = _rolled(out[-1][0], words, k)
        m = len(h)
        ok = out[-1][1][:m] & out[-1][1][1:m + 1] & (doc[:m] == doc[k - 1:])
        if k - 2 < len(held):
            ok[ok] = _sketched(held[k - 2], h[ok])
        out.append((h, ok))
    return out


def _window_counts(n: int, below):
    """Counts (h, c) of the hashes of windows of n words, of a batch of documents, whose two parts pass ``below``."""
    def run(batches):
        for batch in batches:
            words, doc = _word_hashes(batch, "h")
            h = words
            for k in range(2, n + 1):
                part, h = h, _rolled(h, words, k)
            ok = doc[:len(h)] == doc[n - 1:]
            if below is not None:
                has = _sketched(below.value, part)
                ok &= has[:len(h)] & has[1:len(h) + 1]
            found, c = np.unique(h[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])
    return run


def _window_texts(n: int, sketches: list):
    """Counts (n, text, c) of the words (n = 1) of a batch of lines, or of its windows of n words that pass the sketches. With
    the words, the number of all of them, as a row with n = 0 and no text."""
    def run(batches):
        for batch in _worded(batches):
            words, doc = _word_hashes(batch, "h")
            coded = batch.column(batch.schema.get_field_index("word_texts")).flatten()
            texts, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            if n == 1:
                yield _text_counts(0, pa.array([""]), np.array([len(words)]))
                yield _text_counts(1, texts, np.bincount(which, minlength=len(texts)))
                continue
            at = np.flatnonzero(_passed(words, doc, n, [s.value for s in sketches])[-1][1])
            for lo in range(0, len(at), TEXT_BLOCK):
                some = at[lo:lo + TEXT_BLOCK]
                same = which[some].astype(np.int64)   # equal numbers for equal words, one more at a time
                for k in range(1, n):
                    _, where, same, c = np.unique(same * len(texts) + which[some + k], True, True, True)
                parts = [texts.take(pa.array(which[some[where] + k])) for k in range(n)]
                yield _text_counts(n, pc.binary_join_element_wise(*parts, " "), c)
    return run


#: Windows whose texts are made at a time.
TEXT_BLOCK = 1 << 18


def _text_counts(n: int, texts: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), n, np.int32)), texts, pa.array(counts.astype(np.int64))],
                                      names=["n", "text", "c"])


def _at(a: int, l: int, n: int) -> int:
    """Place of the span of l words from word a among all spans of n words: the shorter first, then from the left."""
    return sum(n - k + 1 for k in range(1, l)) + a


def _scored(level: DataFrame, below: DataFrame, n: int, total: int) -> DataFrame:
    """(text, count, cs, score) of windows of n words; ``cs`` are the counts of all spans of a window.

    A window has the spans of its first n - 1 words and those of its last n - 1 words, which the level below knows."""
    level = level.select("text", "count", F.expr(f"substring_index(text, ' ', {n - 1})").alias("head"),
                         F.expr("substring(text, instr(text, ' ') + 1)").alias("rest"))
    d = (level.join(below.select(F.col("text").alias("head"), F.col("cs").alias("_sw_head")), "head")
              .join(below.select(F.col("text").alias("rest"), F.col("cs").alias("_sw_rest")), "rest"))
    spans = [f"_sw_head[{_at(a, l, n - 1)}]" if a + l < n else f"_sw_rest[{_at(a - 1, l, n - 1)}]" for l in range(1, n) for a in range(n - l + 1)]
    d = d.withColumn("cs", F.expr(f"array({', '.join(spans)}, count)"))
    d = d.withColumn("_sw_logs", F.expr("transform(cs, c -> ln(cast(c as double)))"))
    # sum over a segmentation of log p(segment), segment by segment
    logs, words = [], f"ln(cast({total} as double))"
    for c in compositions(n):
        log = "0D"
        for a, l in c:
            log = f"({log} + _sw_logs[{_at(a, l, n)}] - {words})"
        logs.append(log)
    score = f"(ln(cast(count as double)) - {words}) - array_max(array({', '.join(logs)}))"
    return d.select("text", "count", "cs", F.expr(score).alias("score"))


def mine_phrases(df: DataFrame, text_col: str = "text", max_n: int = 5, min_count: int = 5,
                 min_score: float | None = None) -> DataFrame:
    """X1 (extension): n-gram phrases (2..max_n words) scored by PMI.

    score = log p(g) - max over segmentations of sum log p(segment), with
    p(x) = count(x) / number of words (Levine et al., PMI-Masking, 2021).
    Counting is a map-side-combined groupBy; scoring joins each candidate's first and last words with the level below. Every
    level's table is stored, so that the shuffles of one step are gone before the next one begins.
    """
    lines = stored(word_lines(df.where(F.col(text_col).isNotNull()).select(text_col), text_col).select("line"), "mine-words")
    # every occurrence of an n-gram contains its two (n-1)-grams, so one that is frequent has
    # frequent ones: longer windows are counted only where both bits are among those of the level below. Windows are
    # counted as hashes, and a bit may be shared, so that what passes is more than the frequent ones and never
    # less; the texts of what passed are counted last, and decide.
    sketches = []
    for n in range(2, max_n + 1):
        sketches.append(_sketch(lines, n, sketches[-1] if sketches else None, min_count))
    below, single, total, out = None, None, 0, []
    for n in range(1, max_n + 1):
        grams = lines.mapInArrow(_window_texts(n, sketches[:n - 1]), "n int, text string, c bigint")
        counts = grams.groupBy("n", "text").agg(F.sum("c").cast("bigint").alias("count"))
        level = stored(counts.where((F.col("count") >= min_count) | (F.col("n") == 0)), "mine-level")
        # sub-span counts are >= the candidate's count >= min_count: only frequent n-grams are needed
        if n == 1:
            total = max((level.where("n = 0").agg(F.max("count")).first()[0] or 0), 1)
            below, single = level.where("n = 1").select("text", F.array("count").alias("cs")), level
            continue
        below = stored(_scored(level, below, n, total), "mine-scores")
        released(level)
        out.append(below.select(F.col("text").alias("phrase"), F.lit(n).alias("n"), "count", "score"))
    released(lines, single)
    for s in sketches:
        s.unpersist()
    out = functools.reduce(DataFrame.unionByName, out)
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    return out
