"""Near-dedup, packing, language ID, licences and language-model scores against brute force."""

import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.llm import language_id, licences, lm_scoring, near_dedup, packing
from tests.llm.data import edge, empty, prose, words

SMALL = "/root/testdata/sf0.001"


def test_near_dedup_matches_all_pairs(spark):
    rng = random.Random(1)
    texts = []
    for base in range(12):
        text = prose(80 + 40 * base, base).split()
        for copy in range(8):
            t = list(text)
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(9)}"
            texts.append(" ".join(t))
    texts += [texts[0], texts[0].upper(), "a b c", "A B  C", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_near_dedup_edge_rows(spark):
    df = edge(spark)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == 13
    by = {r["id"]: r["component_id"] for r in got if r["id"] is not None}
    assert by[4] == by[5] == 4 and by[6] == by[7] == 6 and by[1] == 1 and by[2] == 2
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 9, 10]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_packing_round_trip(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs, with_ids=True).collect()
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = r
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in docs.collect():
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 2]
        got = [pieces[r["doc_id"]][k] for k in range(len(pieces[r["doc_id"]]))]
        assert [i for p in got for i in p["ids"]] == ids
        assert [p["start"] for p in got] == np.cumsum([0, *(p["length"] for p in got)])[:-1].tolist()
        assert all(p["length"] == 1024 for p in got[1:]) and (len(ids) > 1024 or len(got) == 1)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in got)
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= 1024
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 1024) + 2


@pytest.mark.parametrize("lengths", [[700] * 50, [513, 511] * 40, [1023, 1], [1] * 3000, [600, 300, 200, 124, 400, 424, 600]])
def test_local_search_keeps_documents_and_never_adds_bins(lengths):
    start = packing.best_fit(lengths, 1024)
    done = packing.local_search([list(b) for b in start], lengths, 1024)
    assert sorted(k for b in done for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 1024 for b in done) and len(done) <= len(start)


def test_local_search_empties_a_bad_start():
    lengths = [300, 300, 424, 600, 124, 300, 512, 512]
    done = packing.local_search([[k] for k in range(len(lengths))], lengths, 1024)
    assert len(done) == 3


def test_tokenizers_agree_on_odd_texts():
    import public_tokenizers as public
    from tokenizers import Tokenizer
    encode = packing.byte_bpe(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for text in ["", " ", "  \n\n x ", "don't I'LL", "é é ß", "日本語 текст ۱۲۳ ½", "  a​b", "😀😀👨‍👩‍👧", "a" * 5000,
                 "x<|endoftext|>y", "\x00\x01\x7f", "１２３ａｂｃ", "𝒳𝒴 𐍈", "line\r\nend\t\ttab   "]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids, text


def test_packing_edge_rows(spark):
    rows = packing.pack(edge(spark)).collect()
    assert sum(1 for r in rows if r["piece"] == 0) == 13
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(empty(spark)).count() == 0


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    got = language_id.identify(docs, learn).where(~learn)
    right = got.where("lang = lang_pred").count()
    assert right >= 0.97 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_id_edge_rows(spark):
    labelled = spark.createDataFrame([(k, t, lang) for k in range(40) for t, lang in
                                      ((f"der die und nicht {k}", "de"), (f"the of and with {k}", "en"))],
                                     "doc_id bigint, text string, lang string")
    df = edge(spark).unionByName(labelled, allowMissingColumns=True)
    got = language_id.identify(df, F.lit(True)).where("source = 's'")
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[6][0] in ("de", "en") and got.count() == 13
    assert set(df.columns) <= set(got.columns)
    unlabelled = language_id.identify(edge(spark), F.lit(True))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert language_id.identify(empty(spark), F.lit(True)).count() == 0


def test_pair_tables_equal_the_network():
    model = language_id.ByteConv(["a", "b"])
    x = np.stack([language_id.windows_of(prose(60, k)) for k in range(3)])
    pooled, _ = model.pooled(x)
    want = language_id.softmax(pooled @ model.out + model.out_bias)
    data = x.ravel()
    got = language_id.document_probabilities(model, model.pair_tables(), data, np.arange(4) * language_id.WINDOW)
    assert np.allclose(got, want, atol=0.05)


def test_licence_base_and_templates(spark):
    texts = ["", None, "Released under the MIT License.", "cc-by CC BY 4.0; cc\nby", "gnu general public licence",
             "x " * 50 + "Permission is hereby granted, FREE of charge, to any person obtaining a copy of this software and "
             "associated documentation files", "apache license apache license", "mit licenseé", "mit lizenz ohne license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    by = {r["doc_id"]: r for r in licences.scan_licences(df).collect()}
    assert [by[k]["n_base"] for k in range(9)] == [0, 0, 1, 3, 0, 0, 2, 0, 0]
    assert (by[3]["first_word"], by[3]["last_word"], by[3]["base_labels"]) == (0, 6, "cc-by")
    assert by[5]["labels"] == "mit" and by[5]["base_labels"] == "" and by[2]["labels"] == "mit"
    assert by[0]["n_words"] == 0 and by[1]["first_word"] is None and by[8]["labels"] == ""
    assert all(0 <= r["score"] <= 1 for r in by.values())
    assert licences.scan_licences(edge(spark)).count() == 13 and licences.scan_licences(empty(spark)).count() == 0


def licence_by_hand(index, words):
    """(labels, best share) of one file: every template at every place of its first phrase, word by word."""
    number = {w: k for k, w in enumerate(index.words)}
    at = [number.get(w, -1) for w in words]
    labels, best = set(), 0.0

    def stands(ids, low, high):
        return any(at[p:p + len(ids)] == ids for p in range(max(low, 0), high + 1))
    for t in index.templates:
        for p in range(len(at)):
            if not stands(t.phrases[0][1], p, p):
                continue
            move = [p + q - t.origin for q in range(len(t.words))]
            if all(stands(ids, move[q] - t.slack[q], move[q] + t.slack[q]) for q, ids in t.phrases[1:]):
                share = sum(t.weight[q] for q, w in enumerate(t.words)
                            if stands([w], move[q] - t.slack[q], move[q] + t.slack[q])) / t.weight.sum()
                if share >= licences.LEAST - 1e-12:
                    labels.add(t.label)
                    best = max(best, share)
    return labels, best


def test_licence_texts_against_brute_force(spark):
    rng = random.Random(11)
    texts, planted = [], []
    for label, phrases, text in licences.LICENCES:
        words = text.split()
        for drop in (0.0, 0.1, 0.45):
            kept = [w for w in words if rng.random() >= drop]
            for _ in range(rng.choice([0, 2])):
                kept.insert(rng.randrange(len(kept)), "Inserted")
            texts.append(prose(30, len(texts)) + " " + " ".join(kept) + "\n" + prose(20, len(texts) + 1))
            whole = f" {' '.join(re.findall('[0-9a-z]+', ' '.join(kept).lower()))} "
            # an inserted word may have split a mandatory phrase, and then the text does not count
            planted.append(label if drop == 0.0 and all(f" {p} " in whole for p in phrases) else None)
    texts += ["gnu general public license " * 40, "mit license", "permission is hereby granted free of charge " * 30,
              texts[0] + texts[30], "license software the and of " * 50, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    index = licences.Index(*licences.document_frequencies(df))
    got = {r["doc_id"]: r for r in licences.scan_licences(df).collect()}
    seen = 0
    for k, text in enumerate(texts):
        words = re.findall(r"[0-9a-z]+", (text or "").lower())
        labels, best = licence_by_hand(index, words)
        base = {x for p, x in licences.BASE.items() if f" {p} " in f" {' '.join(words)} "}
        assert set(got[k]["labels"].split(",")) - {""} == labels | base
        assert got[k]["score"] == pytest.approx(max([best, *(index.base_score[x] for x in base)], default=0.0))
        if k < len(planted) and planted[k]:
            assert planted[k] in labels
        seen += bool(labels)
    assert len(list(filter(None, planted))) >= 10 and seen > 20 and 0 < got[len(planted) + 1]["score"] < 1


def test_licence_base_columns_against_sql(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licences.BASE.items())
    want = duckdb.sql(f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'),
                                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
                   FROM read_parquet('{SMALL}/documents.parquet')),
        p(phrase, label) AS (VALUES {phrases}),
        f AS (SELECT doc_id, label, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + len(phrase) - 1] = phrase)) AS i
              FROM w, p WHERE list_contains(ws, phrase[1]))
        SELECT w.doc_id, len(any_value(ws)), count(i), min(i) - 1, max(i) - 1,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '')
        FROM w LEFT JOIN f ON f.doc_id = w.doc_id GROUP BY w.doc_id""").fetchall()
    got = licences.op5_licence_scan(spark, SMALL).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[2] for r in want)


def test_licence_places_of_a_hostile_text(spark):
    """A phrase of a long template 20,000 times over, and its words in no order: all places are verified in seconds."""
    text = "hereby granted free of charge copies or substantial portions of the software " * 20_000
    df = spark.createDataFrame([(1, text), (2, "software the of and notice " * 100_000)], "doc_id bigint, text string")
    index = licences.Index(*licences.document_frequencies(df))
    batch = pa.array([text, "software the of and notice " * 100_000])
    start = time.process_time()
    columns = licences._scan(index, *licences._known(*licences.text_bytes(batch), index.hashes, index.order))
    assert time.process_time() - start < 15 and columns[0].to_pylist() == [240_000, 500_000]


@pytest.mark.parametrize("frequent", [1 << 19, 20])
def test_lm_base_score_and_probabilities(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in docs.collect()}
    tokens = {r["doc_id"]: [*words(r["text"]), None] for r in docs.collect()}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    for r in lm_scoring.score_texts(docs, learn).collect():
        ws = tokens[r["doc_id"]]
        want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[r["doc_id"]], len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want) and 0 < r["bits_per_byte"] < 5


def test_lm_is_a_distribution_and_equals_direct_weighting(spark):
    """Next-byte probabilities of every context sum to one, and a small corpus agrees with weighting written out."""
    depth = lm_scoring.DEPTH
    texts, other = ["abab", "abba", "the cat, the bat", "that cab"], "the tab bb"
    df = spark.createDataFrame(list(enumerate([*texts, other])), "doc_id bigint, text string")

    def places(text):
        row = [255] * depth + list(text.encode()) + [255]
        return [(tuple(row[k - depth:k]), row[k]) for k in range(depth, len(row))]
    seen = [p for t in texts for p in places(t)]
    every = {c for t in [*texts, other] for c, _ in places(t)}
    codes = spark.createDataFrame([(int.from_bytes(bytes([*c, x]), "big"), seen.count((c, x))) for c in every
                                   for x in range(256)], "key bigint, n bigint")
    sums = Counter()
    for r in lm_scoring.train(codes).collect():
        sums[r["key"] >> 8] += 10 ** r["log"]
    assert len(sums) == len(every) and all(abs(v - 1) < 1e-9 for v in sums.values())

    def counts(context, prefix, bits):
        at = [x for c, x in seen if x >> (8 - bits) == prefix and c[depth - len(context):] == context]
        ones = sum(x >> (7 - bits) & 1 for x in at)
        return len(at) - ones, ones

    def kt(z, o):
        return math.lgamma(z + .5) + math.lgamma(o + .5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def children(context, prefix, bits):
        longer = {c[depth - len(context) - 1:] for c, _ in seen if c[depth - len(context):] == context}
        return sum(weighted(c, prefix, bits) for c in longer)

    def weighted(context, prefix, bits):
        own = kt(*counts(context, prefix, bits))
        if len(context) == depth:
            return own
        return np.logaddexp(own, children(context, prefix, bits)) - math.log(2)

    def chance(whole, length, prefix, bits):
        context = whole[depth - length:]
        z, o = counts(context, prefix, bits)
        own = (o + .5) / (z + o + 1)
        if length == depth or not sum(counts(whole[depth - length - 1:], prefix, bits)):
            return own
        weight = 1 / (1 + math.exp(children(context, prefix, bits) - kt(z, o)))
        return weight * own + (1 - weight) * chance(whole, length + 1, prefix, bits)

    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(df, F.col("doc_id") < len(texts)).collect()}
    for i, text in enumerate([*texts, other]):
        want = 0.0
        for whole, x in places(text):
            for bits in range(8):
                p = chance(whole, 0, x >> (8 - bits), bits)
                want += math.log10(p if x >> (7 - bits) & 1 else 1 - p)
        assert abs(got[i] - want) < 1e-6, (i, got[i], want)


def test_lm_chunks_do_not_change_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    learn = F.col("doc_id") % 3 != 0
    whole = {r["doc_id"]: r for r in lm_scoring.score_texts(docs, learn).collect()}
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm_scoring, "COUNTS_HELD", 5_000)
    for r in lm_scoring.score_texts(docs.repartition(5), learn).collect():
        assert r["n_known"] == whole[r["doc_id"]]["n_known"] and abs(r["score"] - whole[r["doc_id"]]["score"]) < 1e-6


def test_lm_edge_rows(spark):
    got = lm_scoring.score_texts(edge(spark), F.coalesce(F.col("doc_id"), F.lit(0)) != 3).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 13 and by[1]["n_tokens"] == 1 and by[1]["base_score"] == by[2]["base_score"]
    assert lm_scoring.score_texts(empty(spark), F.lit(True)).count() == 0
