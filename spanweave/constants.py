"""Engine constants.

Fixed values that must equal the reference's for the results to agree
(special ids, sentinel layout, word-start marker):
    pad id 0, end-of-sequence id 1, unknown id 2, ignore label -100,
    vocabulary size 32100 with 100 sentinel ids at the top
    (sentinel k = vocabulary size - k, so 32099, 32098, ...),
    span continuation marker -1, word-start marker U+2581,
    pad token "<pad>", end token "</s>", unknown token "<unk>".
"""

PAD_ID = 0
EOS_ID = 1
UNK_ID = 2
IGNORE_ID = -100
VOCAB_SIZE = 32100
N_SENTINELS = 100
CONTINUATION_ID = -1
WORD_MARK = "▁"
PAD_TOKEN = "<pad>"
EOS_TOKEN = "</s>"
UNK_TOKEN = "<unk>"
SPECIAL_TOKENS = (PAD_TOKEN, EOS_TOKEN, UNK_TOKEN)

DEFAULT_SEED = 42

# Pieces: optional run of separators (group 1), then either a run of word
# characters or one punctuation/symbol character (group 2). The same pattern
# runs unchanged in Java regex (Spark) and RE2 (DuckDB oracle).
PIECE_PATTERN = r"([\p{Z}\p{Cc}]*)([^\p{Z}\p{C}\p{P}\p{S}]+|[\p{P}\p{S}])"
# The same pattern with possessive quantifiers for Java regex: the separator
# class and the word/punctuation classes are disjoint, so backtracking can never
# produce a different match; possessive matching only skips the futile retries.
SPARK_PIECE_PATTERN = r"([\p{Z}\p{Cc}]*+)([^\p{Z}\p{C}\p{P}\p{S}]++|[\p{P}\p{S}])"

# ASCII punctuation as the reference's word grouping tests it (a token that is
# a substring of this text opens a new word).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
