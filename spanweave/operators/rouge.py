"""ROUGE-L (G13): tokens, Porter stems over distinct words, and subsequence lengths by bits.

Stems follow the Porter algorithm with the extensions of the common Python toolkit (short words,
``ied`` and ``ies`` endings, ``fulli`` and ``logi``, a few irregular words); tokens of up to three characters
are not stemmed, as the common ROUGE scorer does. A batch stems each distinct token once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Longest reference, in tokens, whose bits are kept beside those of the other pairs of a batch.
SIDE_BY_SIDE = 512

# Measures as patterns: a leading y counts as a consonant and is written Y; any other y is a vowel
# after a consonant and a consonant after a vowel.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
POSITIVE = f"^({_C})?{_V}{_C}"
EXACTLY_ONE = f"^({_C})?{_V}{_C}({_V})?$"
ABOVE_ONE = f"^({_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^({_C})?[aeiouy]"
#: Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant.
SHORT_END = "[^aeiou][aeiouy][^aeiouwxy]$|^[aeiouy][^aeiou]$"

# The algorithm's endings, in its order, and the extensions' irregular words.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
             "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
             "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
SECOND = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
          ("logi", "log"))
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _first(word: str, rules, test: str) -> str:
    """The first rule whose ending the word has, if what stands before it passes; else the word."""
    for end, put in rules:
        if word.endswith(end):
            head = word[:len(word) - len(end)]
            # before logi the l counts towards the measure
            return head + put if re.search(test, head + "l" if end == "logi" else head) else word
    return word


def _past(word: str) -> str:
    """Step 1b: ied, eed, ed and ing."""
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if re.search(POSITIVE, word[:-3]) else word
    for end in ("ed", "ing"):
        head = word[:-len(end)]
        if word.endswith(end) and re.search(HAS_VOWEL, head):
            if head.endswith(("at", "bl", "iz")):
                return head + "e"
            if re.search(r"([^aeiou])\1$", head) and not re.search("[aeiou]yy$|^[yY]y$", head):
                return head if head[-1] in "lsz" else head[:-1]
            return head + "e" if re.search(EXACTLY_ONE, head) and re.search(SHORT_END, head) else head
    return word


def _second(word: str) -> str:
    while word.endswith("alli") and re.search(POSITIVE, word[:-4]):
        word = word[:-2]
    return _first(word, SECOND, POSITIVE)


def _fourth(word: str) -> str:
    for end in FOURTH:
        if word.endswith(end):
            head = word[:-len(end)]
            return head if re.search(ABOVE_ONE, head) and (end != "ion" or head[-1:] in ("s", "t")) else word
    return word


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    first, word = word[0], ("Y" + word[1:] if word[0] == "y" else word)
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _first(word, PLURALS, "")
    word = _past(word)
    if re.search("[^aeiouy]y$|[aeiouy]yy$", word) and len(word) > 2:
        word = word[:-1] + "i"
    word = _fourth(_first(_second(word), THIRD, POSITIVE))
    if word.endswith("e"):
        head = word[:-1]
        if re.search(ABOVE_ONE, head) or re.search(EXACTLY_ONE, head) and not re.search(SHORT_END, head):
            word = head
    if word.endswith("ll") and re.search(ABOVE_ONE, word[:-1]):
        word = word[:-1]
    return first + word[1:] if first == "y" else word


def rouge_tokens(text: str | Column) -> Column:
    """ROUGE tokenisation: lowercase, non-[a-z0-9] -> space, split on whitespace."""
    c = text if isinstance(text, Column) else F.col(text)
    t = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def _parts(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(flat items, row ends with a 0 before them); a null row is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(arr), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


@F.arrow_udf(ArrayType(StringType()))
def stems(tokens: pa.Array) -> pa.Array:
    """Stems of token lists; tokens of up to three characters stay."""
    items, cut = _parts(tokens)
    coded = items.dictionary_encode()
    stemmed = pa.array([stem(w) if len(w) > 3 else w for w in coded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), stemmed.take(coded.indices), mask=tokens.is_null())


def _lcs_long(x: np.ndarray, y: np.ndarray) -> int:
    """One pair with a long side: the bits of y as one integer."""
    at: dict[int, int] = {}
    for k, t in enumerate(y.tolist()):
        at[t] = at.get(t, 0) | 1 << k
    full = (1 << len(y)) - 1
    row = full
    for t in x.tolist():
        match = at.get(t)
        if match:
            both = row & match
            row = (row + both) | (row - both)
    return len(y) - (row & full).bit_count()


def lcs_lengths(x: np.ndarray, x_cut: np.ndarray, y: np.ndarray, y_cut: np.ndarray) -> np.ndarray:
    """Longest common subsequence of every pair of rows of token numbers.

    A row of the table is a bit set over the second text (bit 0: the length grows there). All pairs of a batch advance one token
    of their first texts at a time; sums carry from word to word of 64 bits."""
    nx, ny = np.diff(x_cut), np.diff(y_cut)
    out = np.zeros(len(nx), np.int64)
    for r in np.flatnonzero((ny > SIDE_BY_SIDE) & (nx > 0)).tolist():
        out[r] = _lcs_long(x[x_cut[r]:x_cut[r + 1]], y[y_cut[r]:y_cut[r + 1]])
    some = np.flatnonzero((ny <= SIDE_BY_SIDE) & (nx > 0) & (ny > 0))
    if not len(some):
        return out
    some = some[np.argsort(-nx[some], kind="stable")]
    nx, ny = nx[some], ny[some]
    words = int(-(-ny.max() // 64))
    kinds = int(max(x.max(initial=0), y.max(initial=0))) + 1
    # bit sets of the places of each (pair, token) of the second texts
    row = np.repeat(np.arange(len(some)), ny)
    place = np.arange(ny.sum()) - np.repeat(np.cumsum(ny) - ny, ny)
    token = y[np.repeat(y_cut[:-1][some], ny) + place]
    keys, which = np.unique(row * kinds + token, return_inverse=True)
    masks = np.zeros((len(keys) + 1, words), np.uint64)
    np.bitwise_or.at(masks, (which, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    state = np.full((len(some), words), np.uint64(0xFFFFFFFFFFFFFFFF))
    live = np.searchsorted(-nx, -np.arange(1, nx[0] + 1), side="right")
    for t in range(int(nx[0])):
        k = live[t]
        key = np.arange(k) * kinds + x[x_cut[:-1][some[:k]] + t]
        at = np.searchsorted(keys, key)
        at[(at == len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != key)] = len(keys)
        now, match = state[:k], masks[at]
        both = now & match
        total = np.empty_like(now)
        carry = np.zeros(k, np.uint64)
        for w in range(words):
            part = now[:, w] + both[:, w]
            over = part < now[:, w]
            total[:, w] = part + carry
            carry = (over | (total[:, w] < part)).astype(np.uint64)
        state[:k] = total | (now & ~match)
    # bits beyond a text's end do not count
    end = np.clip(ny[:, None] - 64 * np.arange(words), 0, 64)
    inside = np.where(end >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(end, 63).astype(np.uint64)) - np.uint64(1))
    out[some] = ny - np.bitwise_count(state & inside).sum(axis=1)
    return out


@F.arrow_udf(IntegerType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Longest common subsequence length of two token lists per row."""
    (x, x_cut), (y, y_cut) = _parts(a), _parts(b)
    coded = pa.concat_arrays([x.cast(pa.string()), y.cast(pa.string())]).dictionary_encode().indices.to_numpy().astype(np.int64)
    return pa.array(lcs_lengths(coded[:len(x)], x_cut, coded[len(x):], y_cut).astype(np.int32))


def rouge_l(df: DataFrame, prediction: str = "prediction", reference: str = "reference",
            group: list | None = None, stemmed: bool = False) -> DataFrame:
    """Mean ROUGE-L F-measure x 100, over plain or stemmed tokens."""
    group = list(group or [])
    kind = (lambda c: stems(rouge_tokens(c))) if stemmed else rouge_tokens
    d = (df.withColumn("_sw_pt", kind(prediction)).withColumn("_sw_rt", kind(reference))
           .withColumn("_sw_lcs", lcs_length("_sw_pt", "_sw_rt")))
    p = F.col("_sw_lcs") / F.size("_sw_pt")
    r = F.col("_sw_lcs") / F.size("_sw_rt")
    f = F.when((F.size("_sw_pt") == 0) | (F.size("_sw_rt") == 0) | (F.col("_sw_lcs") == 0), F.lit(0.0)) \
         .otherwise(2 * p * r / (p + r))
    d = d.withColumn("rouge_l", f)
    return d.groupBy(*group).agg((F.avg("rouge_l") * 100).alias("rouge_l"), F.count(F.lit(1)).alias("n_pairs"))
