"""Phrase masking against a brute-force statement of the rules, and packing properties."""

import hashlib

from pyspark.sql import functions as F

from spanweave.constants import ASCII_PUNCTUATION
from spanweave.operators.pack import pack_tokens
from spanweave.operators.phrases import match_phrases, phrase_mask

SEPS = ("</s>", "<pad>")


def md5(*parts):
    return hashlib.md5(":".join(["42", *map(str, parts)]).encode()).hexdigest()


def brute_force_mask(key, tokens, phrases, p=0.5, max_pred=512):
    words, part, prev_sep = [], 0, True
    for i, t in enumerate(tokens):
        if t in SEPS:
            part += 1
            prev_sep = True
            continue
        if prev_sep or t.startswith("▁") or t in ASCII_PUNCTUATION:
            words.append([i, 1, part, t.strip("▁").lower()])
        else:
            words[-1][1] += 1
            words[-1][3] += t.strip("▁").lower()
        prev_sep = False
    matches = []
    for n in (5, 4, 3, 2):
        for s in range(len(words) - n + 1):
            if words[s][2] == words[s + n - 1][2] and " ".join(w[3] for w in words[s:s + n]) in phrases:
                matches.append((n, s))
    chosen = []
    for n, s in sorted(matches, key=lambda m: (-m[0], md5(key, "merge", m[0], m[1]))):
        if not any(a < s + n and s < a + b for a, b in chosen):
            chosen.append((s, n))
    covered = {w for s, n in chosen for w in range(s, s + n)}
    cands = [(words[s][0], words[s + n - 1][0] + words[s + n - 1][1] - words[s][0]) for s, n in chosen]
    cands += [(w[0], w[1]) for j, w in enumerate(words) if j not in covered]
    cands.sort(key=lambda c: (-c[1], md5(key, "cand", c[0])))
    budget = min(max_pred, max(1, round(len(tokens) * p)))
    used, mask = 0, [0] * len(tokens)
    for first, ntok in cands:
        if used + ntok <= budget:
            used += ntok
            for i in range(first, first + ntok):
                mask[i] = 1
    return mask


ROWS = [
    ("r1", ["▁the", "▁new", "▁york", "▁times", "▁said", ",", "▁hello", "▁world", "</s>", "<pad>", "<pad>"]),
    ("r2", ["▁new", "</s>", "york", "▁times", "▁a", "b", "c", "▁new", "▁york", "</s>"]),
    ("r3", ["▁hello", "▁world", "▁hello", "▁world", "▁the", "▁new", "▁york", "▁times", "."]),
    ("r4", []),
    ("r5", ["</s>", "<pad>"]),
]
PHRASES = ["new york", "new york times", "hello world", "the new", "york times said", ""]


def test_phrase_mask_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, "k string, tokens array<string>")
    ph = spark.createDataFrame([(x,) for x in PHRASES], "phrase string")
    for p in (0.0, 0.3, 0.5, 1.0):
        got = {r["k"]: r["m"] for r in phrase_mask(df, "tokens", ph, "k", "m", p=p).collect()}
        for k, toks in ROWS:
            assert got[k] == brute_force_mask(k, toks, set(PHRASES), p=p), (k, p)


def test_phrase_only_text_fully_masked_at_p1(spark):
    toks = ["▁new", "▁york", "▁hello", "▁world"]
    df = spark.createDataFrame([("a", toks)], "k string, tokens array<string>")
    ph = spark.createDataFrame([("new york",), ("hello world",)], "phrase string")
    assert phrase_mask(df, "tokens", ph, "k", "m", p=1.0).collect()[0]["m"] == [1, 1, 1, 1]


def test_pack_exact_rows_and_remainder(spark):
    docs = [(0, i, list(range(i * 100, i * 100 + ln))) for i, ln in enumerate([5, 12, 1, 30, 7])]
    df = spark.createDataFrame(docs, "g long, d long, ids array<int>")
    out = pack_tokens(df, "ids", 8, "g", "d").orderBy("row").collect()
    flat = [x for _, _, ids in docs for x in ids]
    assert all(len(r["input_ids"]) == 8 for r in out)
    assert [x for r in out for x in r["input_ids"]] == flat[: len(flat) // 8 * 8]


def test_shuffled_membership(spark):
    """A phrase table too large to broadcast is joined by a shuffle; same masks."""
    df = spark.createDataFrame(ROWS, "k string, tokens array<string>")
    ph = spark.createDataFrame([(x,) for x in PHRASES], "phrase string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["k"]: r["m"] for r in phrase_mask(df, "tokens", ph, "k", "m", p=0.5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    for k, toks in ROWS:
        assert got[k] == brute_force_mask(k, toks, set(PHRASES), p=0.5), k


def test_repeated_keys_keep_their_own_matches(spark):
    rows = [("a", ["▁new", "▁york"]), ("a", ["▁other", "▁words"]), (None, ["▁hello", "▁world"])]
    ph = spark.createDataFrame([("new york",), ("hello world",)], "phrase string")
    got = match_phrases(spark.createDataFrame(rows, "k string, tokens array<string>"), "tokens", ph).collect()
    assert sorted([m["text"] for m in r["matches"]] for r in got) == [[], ["hello world"], ["new york"]]


def test_masks_of_long_rows(spark):
    """Several 64-bit words of positions, windows across their borders, against the brute force."""
    import random
    rng = random.Random(4)
    rows = [(f"r{k}", [rng.choice(["▁a", "▁b", "▁c", "d", ","]) for _ in range(n)]) for k, n in enumerate([63, 64, 65, 130, 512])]
    phrases = [" ".join(rng.choice("abc") for _ in range(n)) for n in (2, 2, 3, 4, 5, 5)]
    ph = spark.createDataFrame([(x,) for x in phrases], "phrase string")
    got = {r["k"]: r["m"] for r in phrase_mask(spark.createDataFrame(rows, "k string, tokens array<string>"), "tokens", ph, "k", "m").collect()}
    for k, toks in rows:
        assert got[k] == brute_force_mask(k, toks, set(phrases), p=0.5), k
