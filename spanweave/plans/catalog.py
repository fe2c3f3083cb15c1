"""Registered queries: each pairs a Spark plan with its DuckDB oracle SQL.

Every query reads the shared tables in full. Integer arrays are rendered as
space-separated text in the result so the comparison does not depend on how
either engine hands lists to Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanweave.functions.arrays import render
from spanweave.functions.masks import random_spans_mask
from spanweave.operators.corrupt import corrupt
from spanweave.constants import PIECE_PATTERN, UNK_ID, WORD_MARK
from spanweave.plans import oracle as O
from spanweave.plans.corpus import VOCAB_VERSION, corpus_chunks, corpus_phrases, corpus_vocab, documents
from spanweave.sources.tables import input_fingerprint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- D1 vocabulary ---------------------------------------------------------
@query("vocab_build", sql=O.corpus_ctes() + """
SELECT piece, id, count FROM vocab
UNION ALL SELECT '<0x' || upper(printf('%02x', b)) || '>', (3 + b)::INTEGER, 0 FROM range(256) t(b)
UNION ALL SELECT '<pad>', 0, 0 UNION ALL SELECT '</s>', 1, 0 UNION ALL SELECT '<unk>', 2, 0
UNION ALL SELECT '<extra_id_' || CAST(j AS VARCHAR) || '>', (32099 - j)::INTEGER, 0 FROM range(100) t(j)""")
def vocab_build(spark, sf):
    return corpus_vocab(spark, sf, fresh=True)


# --- D2 encoding (whole texts, chunked) ------------------------------------
@query("encode_chunks", sql=O.corpus_ctes() + f"""
SELECT doc_id, chunk, {O.render('input_ids')} AS input_ids, {O.render('attention_mask')} AS attention_mask
FROM chunks""")
def encode_chunks(spark, sf):
    ch = corpus_chunks(spark, sf)
    return ch.select("doc_id", "chunk", render("input_ids"), render("attention_mask"))


@query("unk_share", sql=O.corpus_ctes() + """
SELECT count(*) AS n_rows, CAST(sum(len(list_filter(ids, lambda x: x = 2))) AS BIGINT) AS n_unknown FROM doc_ids""")
def unk_share(spark, sf):
    """Ids that stand for no piece, over the whole corpus: none, since bytes spell every character."""
    ids = encode_ids(documents(spark, sf), "text", corpus_vocab(spark, sf), add_eos=False)
    unknown = F.size(F.filter("ids", lambda i: i == UNK_ID)).cast("bigint")
    return ids.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(unknown).alias("n_unknown"))


@query("round_trip", sql="WITH " + O.PIECES_CTE + f"""
SELECT doc_id, trim(replace(array_to_string(pieces, ''), '{WORD_MARK}', ' ')) AS text FROM pc WHERE pieces IS NOT NULL""")
def round_trip(spark, sf):
    """Every text to ids and back, whole; separators come back as one space."""
    vocab = corpus_vocab(spark, sf)
    ids = encode_ids(documents(spark, sf).where("text is not null"), "text", vocab).drop("text")
    return decode(ids, "ids", vocab, "text").select("doc_id", "text")


# --- E1/E2 random span mask ------------------------------------------------
@query("span_mask", sql=O.corpus_ctes() + "," + O.random_mask_ctes(
    "chunks", "len(input_ids)", "row_key", 0.15, 3.0, True, True) + f"""
SELECT doc_id, chunk, {O.render('mask')} AS noise_mask FROM m6""")
def span_mask(spark, sf):
    ch = corpus_chunks(spark, sf).withColumn("_n", F.size("input_ids"))
    m = random_spans_mask(ch, "_n", "row_key", "noise_mask", density=0.15, mean_span=3.0)
    return m.select("doc_id", "chunk", render("noise_mask"))


def _corrupt_sql(density: float, input_length: int, target_length: int) -> str:
    inputs, labels, dec = O.corrupt_select("input_ids", "cmask", input_length, target_length)
    return (O.corpus_ctes() + "," + O.random_mask_ctes("chunks", "len(input_ids)", "row_key", density, 3.0, True, True)
            + f""",
cl AS (SELECT *, list_transform(mask, lambda b, i: CASE WHEN input_ids[i] IN (0, 1) THEN 0 ELSE b END) AS cmask FROM m6),
se AS (SELECT *, {O.sentinel('cmask')} AS sent FROM cl),
c1 AS (SELECT doc_id, chunk, attention_mask, {inputs} AS inp, {labels} AS labels FROM se),
c2 AS (SELECT *, {dec} AS dec FROM c1)
SELECT doc_id, chunk, {O.render('inp')} AS input_ids, {O.render('labels')} AS labels,
       {O.render('dec')} AS decoder_input_ids, {O.render('attention_mask')} AS attention_mask FROM c2""")


# --- E9-E16 gen-1 corruption ------------------------------------------------
@query("corrupt_random", sql=_corrupt_sql(0.15, 128, 32))
def corrupt_random(spark, sf):
    ch = corpus_chunks(spark, sf)
    out = corrupt(ch, "row_key", input_length=128, target_length=32, density=0.15)
    return out.select("doc_id", "chunk", render("input_ids"), render("labels"),
                      render("decoder_input_ids"), render("attention_mask"))


# --- D6 packing, E3/E17 complement corruption --------------------------------
from spanweave.functions.masks import plan_lengths  # noqa: E402
from spanweave.functions.rank import dense_index, uniform_sql  # noqa: E402
from spanweave.operators.corrupt import corrupt_complement  # noqa: E402
from spanweave.operators.pack import (assign_batches, collect_batches, pack_corpus, pack_tokens,  # noqa: E402
                                      pad_to_longest)
from spanweave.operators.vocab import encode_ids  # noqa: E402
from spanweave.plans.corpus import documents  # noqa: E402
from spanweave.sources.tables import read_table  # noqa: E402

PACK_INPUT = 128
PACK_DENSITY = 0.15
PACK_GROUP_DOCS = 64
PACK_RAW, PACK_TARGET = plan_lengths(PACK_INPUT, PACK_DENSITY, 3.0)


def packed_rows(spark, sf):
    return pack_documents(documents(spark, sf), corpus_vocab(spark, sf))


def pack_documents(docs: DataFrame, vocab: DataFrame, group_docs: int = PACK_GROUP_DOCS) -> DataFrame:
    """Documents in ``doc_id`` order in groups of ``group_docs``, packed group by group. The texts are numbered,
    not the ids made of them, so repeated and null doc_ids are documents like any other; null texts hold nothing."""
    numbered = dense_index(docs.select("doc_id", "text"), ["doc_id"], "doc_idx")
    ids = encode_ids(numbered.where("text is not null"), "text", vocab)
    group = (F.col("doc_idx") / group_docs).cast("bigint")
    return pack_tokens(ids.withColumn("pack_group", group), "ids", PACK_RAW, "pack_group", "doc_idx")


_PACK_SQL = (O.vocab_ctes() + O.text_ids_ctes("docs", "documents", ["doc_id"])
             + O.pack_ctes(PACK_RAW, PACK_GROUP_DOCS))


@query("pack_rows", sql=_PACK_SQL + f"""
SELECT pack_group, row, {O.render('input_ids')} AS input_ids FROM packed""")
def pack_rows(spark, sf):
    return packed_rows(spark, sf).select("pack_group", "row", render("input_ids"))


_WHOLE_SQL = (O.vocab_ctes() + O.text_ids_ctes("docs", "documents", ["doc_id"]) + f""",
lens AS (SELECT doc_id, ids, len(ids) AS n, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
         FROM docs_ids),
cuts AS (SELECT st, r AS row, ids[greatest(r * {PACK_RAW} - st, 0) + 1 : least((r + 1) * {PACK_RAW}, st + n) - st] AS piece
         FROM lens, unnest(range(st // {PACK_RAW}, (st + n - 1) // {PACK_RAW} + 1)) t(r)),
whole AS (SELECT row, flatten(list(piece ORDER BY st)) AS input_ids FROM cuts GROUP BY row)""")


def packed_corpus(spark, sf):
    docs = dense_index(documents(spark, sf).where("text is not null"), ["doc_id"], "doc_idx")
    return pack_corpus(encode_ids(docs, "text", corpus_vocab(spark, sf)).select("doc_idx", "ids"), "ids", PACK_RAW, "doc_idx")


@query("pack_whole", sql=_WHOLE_SQL + f"""
SELECT row, {O.render('input_ids')} AS input_ids FROM whole WHERE len(input_ids) = {PACK_RAW}""")
def pack_whole(spark, sf):
    """D6 over the whole corpus as one sequence."""
    return packed_corpus(spark, sf)[0].select("row", render("input_ids"))


@query("pack_whole_account", sql=_WHOLE_SQL + f"""
SELECT sum(n)::BIGINT AS n_ids, (sum(n) // {PACK_RAW})::BIGINT AS n_rows, (sum(n) % {PACK_RAW})::BIGINT AS n_left FROM lens""")
def pack_whole_account(spark, sf):
    """Ids in and rows out of ``pack_whole``: nothing is lost but the end that does not fill a row."""
    rows, rest = packed_corpus(spark, sf)
    every = rows.unionByName(rest).select(F.size("input_ids").cast("bigint").alias("n"))
    full = F.when(F.col("n") == PACK_RAW, 1).otherwise(0)
    return every.agg(F.sum("n").alias("n_ids"), F.sum(full).alias("n_rows"), F.sum(F.col("n") * (1 - full)).alias("n_left"))


def _complement_sql() -> str:
    keep = ("list_filter(list_transform(input_ids, lambda x, i: CASE WHEN {s}[i] != 0 THEN {s}[i] ELSE x END), "
            "lambda y: y >= 0) || [1]")
    return (_PACK_SQL + f""",
pkk AS (SELECT *, CAST(pack_group AS VARCHAR) || ':' || CAST(row AS VARCHAR) AS row_key FROM packed)"""
            + "," + O.random_mask_ctes("pkk", "len(input_ids)", "row_key", PACK_DENSITY, 3.0, False, False)
            + f""",
se AS (SELECT *, {O.sentinel('mask')} AS s_in,
              {O.sentinel('list_transform(mask, lambda b: 1 - b)')} AS s_lab FROM m6)
SELECT pack_group, row, {O.render(keep.format(s='s_in'))} AS input_ids,
       {O.render(keep.format(s='s_lab'))} AS labels FROM se""")


@query("corrupt_packed", sql=_complement_sql())
def corrupt_packed(spark, sf):
    p = packed_rows(spark, sf).withColumn(
        "row_key", F.concat_ws(":", F.col("pack_group").cast("string"), F.col("row").cast("string")))
    out = corrupt_complement(p, "row_key", PACK_INPUT, PACK_TARGET, density=PACK_DENSITY)
    return out.select("pack_group", "row", render("input_ids"), render("labels"))


# --- D8/D10/D11 batching over conversation turns ------------------------------
BATCH = 32


def turn_batches(spark, sf):
    conv = read_table(spark, sf, "conversations", balance=True).select("conv_id", "turn", "text")
    ids = encode_ids(conv, "text", corpus_vocab(spark, sf))
    return assign_batches(ids, ["conv_id", "turn"], BATCH)


_BATCH_SQL = (O.vocab_ctes() + O.text_ids_ctes("cv", "conversations", ["conv_id", "turn"]) + f""",
cb AS (SELECT conv_id, turn, ids, ((row_number() OVER (ORDER BY conv_id, turn) - 1) // {BATCH})::BIGINT AS batch_id
       FROM cv_ids)""")


@query("batch_pad", sql=_BATCH_SQL + f""",
cp AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 8) * 8)::INTEGER AS padded_length FROM cb)
SELECT conv_id, turn, batch_id, padded_length, {O.render('list_resize(ids, padded_length, 0)')} AS input_ids,
       {O.render('list_resize(list_transform(ids, lambda x: 1), padded_length, 0)')} AS attention_mask FROM cp""")
def batch_pad(spark, sf):
    b = turn_batches(spark, sf).withColumn("attention_mask", F.expr("array_repeat(1, size(ids))"))
    p = pad_to_longest(b.withColumnRenamed("ids", "input_ids"), "batch_id", {"input_ids": 0, "attention_mask": 0})
    return p.select("conv_id", "turn", "batch_id", "padded_length", render("input_ids"), render("attention_mask"))


@query("batch_collect", sql=_BATCH_SQL + """
SELECT batch_id, count(*) AS n_rows,
       array_to_string(list(array_to_string(ids, ' ') ORDER BY conv_id, turn), ';') AS input_ids
FROM cb GROUP BY batch_id""")
def batch_collect(spark, sf):
    c = collect_batches(turn_batches(spark, sf), "batch_id", "row_idx", ["ids"])
    return c.select("batch_id", F.col("n_rows").cast("bigint").alias("n_rows"),
                    F.expr("array_join(transform(ids, r -> array_join(r, ' ')), ';')").alias("input_ids"))


# --- X1 phrase mining, E4-E8 phrase masking -----------------------------------
from spanweave.operators.phrases import match_phrases, mine_phrases, phrase_mask  # noqa: E402
from spanweave.operators.vocab import id_to_piece  # noqa: E402

MINE_MIN_COUNT = 5
PHRASE_MIN_SCORE = 1.0


@query("phrase_mine", sql=O.vocab_ctes() + O.mine_ctes(MINE_MIN_COUNT) + """
SELECT phrase, n, count, round(score, 6) AS score FROM mined""")
def phrase_mine(spark, sf):
    m = mine_phrases(documents(spark, sf), "text", max_n=5, min_count=MINE_MIN_COUNT)
    return m.withColumn("score", F.round("score", 6))


def chunk_tokens(spark, sf):
    vocab = corpus_vocab(spark, sf)
    ch = corpus_chunks(spark, sf, vocab=vocab)
    phrases = corpus_phrases(spark, sf, MINE_MIN_COUNT, PHRASE_MIN_SCORE)
    return id_to_piece(ch, "input_ids", vocab, "tokens"), phrases


_PHRASE_BASE = (O.corpus_ctes() + O.mine_ctes(MINE_MIN_COUNT) + f""",
mined_set AS (SELECT phrase FROM mined WHERE score >= {PHRASE_MIN_SCORE})""" + O.tokens_cte("chunks")
                + O.words_ctes("cw", "tk_rows", ["doc_id", "chunk"]))


@query("phrase_match", sql=_PHRASE_BASE + O.ngrams_cte("cg", "cw", ["doc_id", "chunk"], (5, 4, 3, 2)) + """,
cm AS (SELECT * FROM cg WHERE text IN (SELECT phrase FROM mined_set))
SELECT r.doc_id, r.chunk, count(m.s) AS n_matches,
       coalesce(string_agg(CAST(m.n AS VARCHAR) || ':' || CAST(m.s AS VARCHAR) || ':' || m.text, '|'
                           ORDER BY m.n DESC, m.s), '') AS matches
FROM tk_rows r LEFT JOIN cm m ON m.doc_id = r.doc_id AND m.chunk = r.chunk
GROUP BY r.doc_id, r.chunk""")
def phrase_match(spark, sf):
    tok, phrases = chunk_tokens(spark, sf)
    m = match_phrases(tok, "tokens", phrases, "matches")
    return m.select("doc_id", "chunk", F.size("matches").cast("bigint").alias("n_matches"), F.expr(
        "array_join(transform(sort_array(transform(matches, m -> named_struct('k', -m.n, 's', m.s, 't', m.text))), "
        "x -> concat(cast(-x.k as string), ':', cast(x.s as string), ':', x.t)), '|')").alias("matches"))


@query("phrase_mask", sql=_PHRASE_BASE + O.phrase_mask_ctes() + f"""
SELECT doc_id, chunk, {O.render('mask')} AS phrase_mask FROM pmask""")
def phrase_mask_q(spark, sf):
    tok, phrases = chunk_tokens(spark, sf)
    m = phrase_mask(tok, "tokens", phrases, "row_key", "phrase_mask")
    return m.select("doc_id", "chunk", render("phrase_mask"))


def _corrupt_phrase_sql(input_length: int, target_length: int) -> str:
    inputs, labels, dec = O.corrupt_select("input_ids", "cmask", input_length, target_length)
    return (_PHRASE_BASE + O.phrase_mask_ctes() + f""",
cl AS (SELECT *, list_transform(mask, lambda b, i: CASE WHEN input_ids[i] IN (0, 1) THEN 0 ELSE b END) AS cmask FROM pmask),
se AS (SELECT *, {O.sentinel('cmask')} AS sent FROM cl),
c1 AS (SELECT doc_id, chunk, attention_mask, {inputs} AS inp, {labels} AS labels FROM se),
c2 AS (SELECT *, {dec} AS dec FROM c1)
SELECT doc_id, chunk, {O.render('inp')} AS input_ids, {O.render('labels')} AS labels,
       {O.render('dec')} AS decoder_input_ids, {O.render('attention_mask')} AS attention_mask FROM c2""")


#: Half of the 128 tokens at most are masked, each with a sentinel at most, then a last sentinel and the end.
PHRASE_TARGET = 130


@query("corrupt_phrase", sql=_corrupt_phrase_sql(128, 130))
def corrupt_phrase(spark, sf):
    tok, phrases = chunk_tokens(spark, sf)
    m = phrase_mask(tok, "tokens", phrases, "row_key", "phrase_mask")
    out = corrupt(m, "row_key", input_length=128, target_length=PHRASE_TARGET, mask_col="phrase_mask")
    return out.select("doc_id", "chunk", render("input_ids"), render("labels"),
                      render("decoder_input_ids"), render("attention_mask"))


# --- C1-C7 formatting, D3/D5 task encoding -----------------------------------
from spanweave.operators.formatting import encode_task as task_encoding, format_all, format_task  # noqa: E402
from spanweave.plans import tasks as T  # noqa: E402

_TAB = "chr(9)"


def _fmt_sst2(spark, sf):
    return format_task(T.sst2_input(spark, sf), "sst2")


@query("format_sst2", sql="""
SELECT d.doc_id AS idx, 'sst2: sentence: ' || d.text AS processed_inputs,
       CASE l.quality WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN -1 THEN 'other' END AS processed_outputs
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def format_sst2(spark, sf):
    return _fmt_sst2(spark, sf).select("idx", "processed_inputs", "processed_outputs")


_PAIRS_SQL = """FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""


def _fmt_rte(spark, sf):
    return format_task(T.rte_input(spark, sf), "rte")


@query("format_rte", sql=f"""
SELECT a.conv_id, a.turn, 'rte: sentence1: ' || a.text || ' ' || 'sentence2' || b.text AS processed_inputs,
       CASE WHEN b.role = 'assistant' THEN 'positive' ELSE 'negative' END AS processed_outputs {_PAIRS_SQL}""")
def format_rte(spark, sf):
    return _fmt_rte(spark, sf).select("conv_id", "turn", "processed_inputs", "processed_outputs")


@query("format_stsb", sql=f"""
SELECT a.conv_id, a.turn, 'stsb sentence1: ' || a.text || ' ' || 'sentence2: ' || b.text AS processed_inputs,
       CAST(round(CAST((length(a.text) + length(b.text)) % 51 AS DOUBLE) / 10, 1) AS VARCHAR) AS processed_outputs
{_PAIRS_SQL}""")
def format_stsb(spark, sf):
    f = format_task(T.stsb_input(spark, sf), "stsb")
    return f.select("conv_id", "turn", "processed_inputs", "processed_outputs")


_ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"]


def _dialogue_sql() -> str:
    cols = ", ".join(f"max(text) FILTER (WHERE turn % 8 = {i}) AS t{i}" for i in range(8))
    parts = ", ".join(f"'{_ORDINALS[i]}_sentence: ' || coalesce(t{i}, 'None')" for i in range(8))
    return f"""
WITH p AS (SELECT conv_id, (turn // 8)::INTEGER AS part, {cols} FROM conversations GROUP BY conv_id, part)
SELECT conv_id, part, 'DCchat: ' || concat_ws({_TAB}, {parts}) AS processed_inputs,
       CASE {O.uniform('2', 'conv_id')} WHEN 0 THEN 'Incoherent' WHEN 1 THEN 'Coherent' END AS processed_outputs
FROM p"""


def _fmt_dialogue(spark, sf):
    d = T.dialogue_input(spark, sf)
    return format_task(d, "DCchat", text_columns=[f"t{i}" for i in range(T.TURNS_PER_ROW)])


@query("format_dialogue", sql=_dialogue_sql())
def format_dialogue(spark, sf):
    return _fmt_dialogue(spark, sf).select("conv_id", "part", "processed_inputs", "processed_outputs")


@query("format_mix", sql=f"""
SELECT 'sst2' AS task, processed_inputs, processed_outputs FROM (
  SELECT 'sst2: sentence: ' || d.text AS processed_inputs,
         CASE l.quality WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN -1 THEN 'other' END AS processed_outputs
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
UNION ALL
SELECT 'rte', 'rte: sentence1: ' || a.text || ' ' || 'sentence2' || b.text,
       CASE WHEN b.role = 'assistant' THEN 'positive' ELSE 'negative' END {_PAIRS_SQL}
UNION ALL
SELECT 'DCchat', processed_inputs, processed_outputs FROM ({_dialogue_sql()})""")
def format_mix(spark, sf):
    return format_all({"sst2": _fmt_sst2(spark, sf), "rte": _fmt_rte(spark, sf),
                       "DCchat": _fmt_dialogue(spark, sf)})


TASK_LEN = 128
LABEL_LEN = 16


def encode_task_sql(formatted: str, keys: list[str]) -> str:
    """Oracle of task encoding; ``formatted`` yields keys, processed_inputs, processed_outputs."""
    k, same = ", ".join(keys), " AND ".join(f"o.{c} = s.{c}" for c in keys)
    return (O.vocab_ctes() + f""",
fmt AS ({formatted})""" + O.text_ids_ctes("fin", "fmt", keys, "processed_inputs", eos=False)
            + O.text_ids_ctes("fout", "fmt", keys, "processed_outputs", eos=False) + f""",
seg AS (SELECT {k}, c::INTEGER AS chunk, ids[c * {TASK_LEN - 1} + 1 : c * {TASK_LEN - 1} + {TASK_LEN - 1}] || [1] AS seg
        FROM fin_ids, unnest(range(0, greatest(ceil(len(ids) / {TASK_LEN - 1})::INTEGER, 1))) AS r(c))
SELECT {", ".join("s." + c for c in keys)}, s.chunk, {O.render(O.fit('s.seg', TASK_LEN))} AS input_ids,
       {O.render(O.fit('list_transform(s.seg, lambda x: 1)', TASK_LEN))} AS attention_mask,
       {O.render(f"list_transform({O.fit(f'o.ids[1:{LABEL_LEN - 1}] || [1]', LABEL_LEN)}, lambda y: CASE WHEN y = 0 THEN -100 ELSE y END)")} AS labels
FROM seg s JOIN fout_ids o ON {same}""")


@query("encode_task", sql=encode_task_sql("""
SELECT d.doc_id, 'sst2: sentence: ' || d.text AS processed_inputs,
       CASE l.quality WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN -1 THEN 'other' END AS processed_outputs
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""", ["doc_id"]))
def encode_task(spark, sf):
    """Format + encode inputs (whole text, chunked) + encode labels (D3)."""
    rows = T.sst2_input(spark, sf).withColumnRenamed("idx", "doc_id")
    e = task_encoding(rows, "sst2", corpus_vocab(spark, sf), TASK_LEN, LABEL_LEN)
    return e.select("doc_id", F.col("chunk").cast("int").alias("chunk"), render("input_ids"),
                    render("attention_mask"), render("labels"))


# --- F1-F5 shuffle/split/mix, A3/B2-B4 slicing and caps, D12 step plan -------
from spanweave.operators import split as S  # noqa: E402
from spanweave.operators.pack import plan_steps  # noqa: E402


def _docs_ids(spark, sf):
    return read_table(spark, sf, "documents", balance=True).select("doc_id")


@query("shuffle_order", sql=f"""
SELECT doc_id, (row_number() OVER (ORDER BY {O.md5('doc_id')}, doc_id) - 1)::BIGINT AS shuffle_idx FROM documents""")
def shuffle_order(spark, sf):
    return S.shuffle(_docs_ids(spark, sf), "doc_id")


@query("epoch_order", sql="""
SELECT doc_id, (row_number() OVER (ORDER BY md5(concat_ws(':', '42+2', CAST(doc_id AS VARCHAR))), doc_id) - 1)::BIGINT
       AS shuffle_idx FROM documents""")
def epoch_order(spark, sf):
    return S.reshuffle_epoch(_docs_ids(spark, sf), "doc_id", epoch=2)


@query("buffer_order", sql=f"""
WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS block FROM documents)
SELECT doc_id, (row_number() OVER (ORDER BY block, {O.md5('doc_id')}, doc_id) - 1)::BIGINT AS shuffle_idx FROM b""")
def buffer_order(spark, sf):
    return S.buffer_shuffle(_docs_ids(spark, sf), ["doc_id"], "doc_id", buffer=100)


SHUFFLE_SLOTS = 100
_THROUGH_SQL = f"""
WITH d AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
s AS (SELECT *, CASE WHEN i < {SHUFFLE_SLOTS} THEN i ELSE {O.uniform(str(SHUFFLE_SLOTS), 'i')} END AS slot FROM d),
l AS (SELECT *, lead(i) OVER (PARTITION BY slot ORDER BY i) AS next FROM s)
SELECT doc_id, n::BIGINT AS n_text, (CASE WHEN next IS NOT NULL THEN next - {SHUFFLE_SLOTS}
    ELSE count(next) OVER () + row_number() OVER (PARTITION BY next IS NULL ORDER BY {O.md5("'rest'", 'i')}, i) - 1 END)::BIGINT
    AS shuffle_idx FROM l"""


@query("shuffle_through", sql=_THROUGH_SQL)
def shuffle_through(spark, sf):
    """F2 with the slots of a shuffle buffer, whole documents."""
    d = S.shuffle_through(documents(spark, sf).select("doc_id", "text"), ["doc_id"], buffer=SHUFFLE_SLOTS)
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_text"), "shuffle_idx")


_SPLIT_SQL = f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {O.md5('doc_id')}, doc_id) - 1 AS i,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN i < ceil(n * 0.05) THEN 'validation' ELSE 'train' END AS split FROM r"""


@query("split_docs", sql=_SPLIT_SQL)
def split_docs(spark, sf):
    return S.train_test_split(_docs_ids(spark, sf), "doc_id", 0.05)


@query("plan_split_steps", sql=f"""
WITH s AS ({_SPLIT_SQL})
SELECT split, count(*) AS n_rows, CAST(ceil(count(*) / 32) AS BIGINT) AS n_batches,
       CAST((CAST(ceil(count(*) / 32) AS BIGINT) // 2) * 3 // 1 AS BIGINT) AS total_steps
FROM s GROUP BY split""")
def plan_split_steps(spark, sf):
    return plan_steps(S.train_test_split(_docs_ids(spark, sf), "doc_id", 0.05), "split", 32, grad_acc=2, epochs=3)


@query("interleave_text", sql="""
WITH d AS (SELECT 'documents' AS source, 0 AS k, row_number() OVER (ORDER BY doc_id) - 1 AS src_idx, text FROM documents),
c AS (SELECT 'conversations' AS source, 1 AS k, row_number() OVER (ORDER BY conv_id, turn) - 1 AS src_idx, text
      FROM conversations),
a AS (SELECT * FROM d UNION ALL SELECT * FROM c),
m AS (SELECT least((SELECT count(*) FROM documents), (SELECT count(*) FROM conversations)) AS m,
             CASE WHEN (SELECT count(*) FROM documents) <= (SELECT count(*) FROM conversations) THEN 0 ELSE 1 END AS first_short)
SELECT source, src_idx::BIGINT AS src_idx, (src_idx * 2 + k)::BIGINT AS mix_idx, text
FROM a, m WHERE src_idx < m.m OR (src_idx = m.m AND k < m.first_short)""")
def interleave_text(spark, sf):
    docs = read_table(spark, sf, "documents", balance=True).select("doc_id", "text")
    conv = read_table(spark, sf, "conversations", balance=True).select("conv_id", "turn", "text")
    d = S.interleave({"documents": docs.select("doc_id", F.lit(0).cast("bigint").alias("turn"), "text"),
                      "conversations": conv.select(F.col("conv_id").alias("doc_id"), "turn", "text")},
                     {"documents": ["doc_id", "turn"], "conversations": ["doc_id", "turn"]})
    return d.select("source", "src_idx", F.col("mix_idx").cast("bigint").alias("mix_idx"), "text")


@query("slice_docs", sql="""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
WHERE i < round_even(n * 10 / 100.0, 0)""")
def slice_docs(spark, sf):
    return S.slice_split(_docs_ids(spark, sf), ["doc_id"], percent=10)


@query("take_skip", sql="""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < 100 THEN 'train' ELSE 'validation' END AS part
FROM documents""")
def take_skip(spark, sf):
    tr, va = S.take_skip(_docs_ids(spark, sf), ["doc_id"], 100)
    return tr.withColumn("part", F.lit("train")).unionByName(va.withColumn("part", F.lit("validation")))


def _turns(spark, sf):
    c = read_table(spark, sf, "conversations", balance=True).select("conv_id", "turn", "role")
    return c.withColumn("turn_key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


@query("cap_roles", sql=f"""
SELECT conv_id, turn, role, rank_in_group FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY
         {O.md5("CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)")},
         CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR))::INTEGER AS rank_in_group
  FROM conversations) WHERE rank_in_group <= 50""")
def cap_roles(spark, sf):
    return S.cap_per_task(_turns(spark, sf), "role", "turn_key", 50).select("conv_id", "turn", "role", "rank_in_group")


@query("first_roles", sql="""
SELECT conv_id, turn, role, rank_in_group FROM (
  SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY role ORDER BY conv_id * 100 + turn))::INTEGER AS rank_in_group
  FROM conversations) WHERE rank_in_group <= 100""")
def first_roles(spark, sf):
    t = _turns(spark, sf).withColumn("pos", F.col("conv_id") * 100 + F.col("turn"))
    return S.first_n_per_task(t, "role", "pos", 100).select("conv_id", "turn", "role", "rank_in_group")


# --- G1-G16 evaluation, D9 decode ----------------------------------------------
from spanweave.functions.arrays import trim_after_eos_sql  # noqa: E402
from spanweave.operators import metrics as M  # noqa: E402
from spanweave.operators.vocab import decode  # noqa: E402
from spanweave.plans import evaluation as EV  # noqa: E402

def metric_sql(where: str = "true") -> str:
    """All metrics over the predictions that ``where`` selects."""
    return O.corpus_ctes() + O.predictions_cte() + f""",
fm AS (SELECT max(pred[1]) AS m FROM preds WHERE {where}),""" + _METRIC_PARTS.replace("FROM preds p, fm", f"FROM preds p, fm WHERE {where}") + _METRIC_ROWS


_METRIC_PARTS = """
al AS (SELECT p.doc_id, p.chunk,
              CASE WHEN fm.m = 0 THEN p.pred[2 : len(p.pred)] || [0] ELSE p.pred END AS pred,
              list_transform(p.labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END) AS labels
       FROM preds p, fm),
ex AS (SELECT avg(CASE WHEN pred = labels THEN 1.0 ELSE 0.0 END) AS ex_acc FROM al),
pos0 AS (SELECT unnest(labels) AS l, unnest(pred) AS p FROM al),
pos AS (SELECT * FROM pos0 WHERE l NOT IN (0, 1)),
base AS (SELECT sum(CASE WHEN l = p THEN 1.0 ELSE 0.0 END) AS tp, sum(CASE WHEN l != p THEN 1.0 ELSE 0.0 END) AS fp,
                count(*) AS n, corr(l::DOUBLE, p::DOUBLE) AS pearson FROM pos),
tk AS (SELECT l AS k, count(*)::DOUBLE AS t_k FROM pos GROUP BY l),
pk AS (SELECT p AS k, count(*)::DOUBLE AS p_k FROM pos GROUP BY p),
kk AS (SELECT coalesce(tk.k, pk.k) AS k, coalesce(t_k, 0) AS t_k, coalesce(p_k, 0) AS p_k FROM tk FULL JOIN pk ON tk.k = pk.k),
mc AS (SELECT sum(t_k * p_k) AS tp_sum, sum(t_k * t_k) AS t2, sum(p_k * p_k) AS p2 FROM kk),
mcc AS (SELECT CASE WHEN sqrt((b.n::DOUBLE * b.n - mc.p2) * (b.n::DOUBLE * b.n - mc.t2)) = 0 THEN 0.0
                    ELSE (b.tp * b.n - mc.tp_sum) / sqrt((b.n::DOUBLE * b.n - mc.p2) * (b.n::DOUBLE * b.n - mc.t2)) * 100 END AS mcc
        FROM base b, mc),
rl AS (SELECT l, coalesce(sum(count(*)) OVER (ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + (count(*) + 1) / 2.0 AS r_l FROM pos GROUP BY l),
rp AS (SELECT p, coalesce(sum(count(*)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + (count(*) + 1) / 2.0 AS r_p FROM pos GROUP BY p),
sp AS (SELECT corr(rl.r_l, rp.r_p) AS spearman FROM pos JOIN rl USING (l) JOIN rp USING (p)),
v AS (SELECT b.tp AS hits, b.tp / b.n AS accuracy, b.tp / (b.tp + b.fp) AS f1, b.pearson, mcc.mcc, sp.spearman, ex.ex_acc
      FROM base b, mcc, sp, ex)"""
_METRIC_ROWS = """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'token_accuracy' AS metric, accuracy AS value FROM v UNION ALL SELECT 'example_accuracy', ex_acc FROM v
  UNION ALL SELECT 'token_f1', f1 FROM v UNION ALL SELECT 'example_f1', ex_acc FROM v
  UNION ALL SELECT 'token_precision', f1 FROM v UNION ALL SELECT 'example_precision', ex_acc FROM v
  UNION ALL SELECT 'token_recall', f1 FROM v UNION ALL SELECT 'example_recall', ex_acc FROM v
  UNION ALL SELECT 'token_mcc', mcc FROM v UNION ALL SELECT 'example_mcc', 0.0 FROM v
  UNION ALL SELECT 'token_pearson', pearson FROM v UNION ALL SELECT 'example_pearson', 'nan'::DOUBLE FROM v
  UNION ALL SELECT 'token_spearman', spearman FROM v UNION ALL SELECT 'example_spearman', 'nan'::DOUBLE FROM v)"""


@query("token_metrics", sql=metric_sql())
def token_metrics_q(spark, sf):
    m = M.token_metrics(EV.predictions(spark, sf))
    return m.select("metric", F.round("value", 6).alias("value"))


@query("trim_after_eos", sql=O.corpus_ctes() + O.predictions_cte() + f""",
t AS (SELECT doc_id, chunk, pred[1 : len(pred) - 1] || [1] AS f FROM preds)
SELECT doc_id, chunk, {O.render("list_transform(f, lambda x, i: CASE WHEN i > list_position(f, 1) THEN 0 ELSE x END)")}
       AS pred FROM t""")
def trim_after_eos_q(spark, sf):
    p = EV.predictions(spark, sf).withColumn("pred", F.expr(trim_after_eos_sql("pred")))
    return p.select("doc_id", "chunk", render("pred"))


@query("logit_scores", sql="WITH " + O.logits_cte()[2:] + """
SELECT example_key, array_to_string(list_transform(logits, lambda v: list_position(v, list_max(v)) - 1), ' ') AS pred,
       round((SELECT count(*) FROM (SELECT unnest(list_transform(logits, lambda v: list_position(v, list_max(v)) - 1)) AS p,
                                         unnest(labels) AS l) WHERE p = l)::DOUBLE / len(labels), 6) AS padded_accuracy,
       round(list_sum(list_filter(list_transform(logits, lambda v, i: CASE WHEN labels[i] = -100 THEN NULL ELSE
             ln(list_sum(list_transform(v, lambda x: exp(x::DOUBLE - list_max(v)::DOUBLE)))) + list_max(v)::DOUBLE
             - v[labels[i] + 1]::DOUBLE END), lambda x: x IS NOT NULL)), 6) AS nll_sum,
       len(list_filter(labels, lambda l: l != -100))::INTEGER AS nll_n
FROM logit_ex""")
def logit_scores(spark, sf):
    d = M.argmax_tokens(EV.logits_examples(spark, sf), "logits", "pred")
    total, count = M.masked_nll_parts("logits", "labels")
    return d.select("example_key", render("pred"), F.round(M.padded_token_accuracy("pred", "labels"), 6)
                    .alias("padded_accuracy"), F.round(total, 6).alias("nll_sum"), count.alias("nll_n"))


@query("eval_batches", sql="WITH " + O.logits_cte()[2:] + """,
pe AS (SELECT example_key // 4 + 1 AS batch, logits, labels FROM logit_ex WHERE example_key // 4 + 1 < 5 * 2),
pp AS (SELECT batch, unnest(logits) AS v, unnest(labels) AS l FROM pe),
pq AS (SELECT batch, l, list_position(v, list_max(v)) - 1 AS p,
              CASE WHEN l = -100 THEN NULL ELSE ln(list_sum(list_transform(v, lambda x: exp(x::DOUBLE - list_max(v)::DOUBLE))))
                   + list_max(v)::DOUBLE - v[l + 1]::DOUBLE END AS nll FROM pp),
pb AS (SELECT batch, sum(nll) / count(nll) AS loss, sum(CASE WHEN p = l THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy
       FROM pq GROUP BY batch)
SELECT round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy, count(*) AS n_batches FROM pb""")
def eval_batches(spark, sf):
    ex = EV.logits_examples(spark, sf).withColumn("batch", (F.col("example_key") / 4).cast("bigint") + 1)
    r = M.evaluate_batches(ex, "batch", steps=5, grad_acc=2)
    return r.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"), "n_batches")


@query("eval_all_batches", sql=ORACLE["eval_batches"].replace(" WHERE example_key // 4 + 1 < 5 * 2", ""))
def eval_all_batches(spark, sf):
    """G16 over the whole table: as many steps as it has batches."""
    ex = EV.logits_examples(spark, sf).withColumn("batch", (F.col("example_key") / 4).cast("bigint") + 1)
    last = read_table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    steps = 1 if last is None else last // EV.POSITIONS // 4 + 2   # batches stop before it
    r = M.evaluate_batches(ex, "batch", steps=steps)
    return r.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"), "n_batches")


from spanweave.operators import rouge as RG  # noqa: E402


def _rouge_tokens_sql(col: str) -> str:
    t = f"trim(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g'))"
    return f"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, ' ') END"


_ROUGE_SCORES = """
lcs AS (SELECT item_id, pt, rt,
               list_reduce(pt,
                 lambda row, tok: [0::BIGINT] || list_transform(range(1, len(rt) + 1), lambda j:
                     list_max(list_transform(range(1, j + 1), lambda jj:
                         CASE WHEN rt[jj] = tok THEN row[jj] + 1 ELSE row[jj + 1] END))),
                 list_resize([]::BIGINT[], len(rt) + 1, 0)) AS r
        FROM pairs WHERE len(pt) > 0 AND len(rt) > 0),
f AS (SELECT p.item_id, coalesce(CASE WHEN l.r[len(l.r)] = 0 THEN 0.0 ELSE
        2.0 * (l.r[len(l.r)]::DOUBLE / len(p.pt)) * (l.r[len(l.r)]::DOUBLE / len(p.rt))
        / (l.r[len(l.r)]::DOUBLE / len(p.pt) + l.r[len(l.r)]::DOUBLE / len(p.rt)) END, 0.0) AS f
      FROM pairs p LEFT JOIN lcs l ON l.item_id = p.item_id)
SELECT round(avg(f) * 100, 6) AS rouge_l, count(*) AS n_pairs FROM f"""


@query("rouge_l", sql=f"""
WITH pairs AS (SELECT a.item_id, {_rouge_tokens_sql('a.text')} AS pt, {_rouge_tokens_sql('b.text')} AS rt
               FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),{_ROUGE_SCORES}""")
def rouge_l_q(spark, sf):
    r = RG.rouge_l(EV.text_pairs(spark, sf))
    return r.select(F.round("rouge_l", 6).alias("rouge_l"), "n_pairs")


@query("rouge_l_stemmed", sql=f"""
WITH raw AS (SELECT a.item_id, {_rouge_tokens_sql('a.text')} AS pt, {_rouge_tokens_sql('b.text')} AS rt
             FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
sw AS (SELECT unnest(pt) AS word FROM raw UNION SELECT unnest(rt) FROM raw),{O.stem_ctes("sw")},
sp AS (SELECT item_id, list(stem ORDER BY i) AS pt FROM (SELECT item_id, unnest(pt) AS word, unnest(range(len(pt))) AS i FROM raw)
       JOIN stemmed USING (word) GROUP BY item_id),
sr AS (SELECT item_id, list(stem ORDER BY i) AS rt FROM (SELECT item_id, unnest(rt) AS word, unnest(range(len(rt))) AS i FROM raw)
       JOIN stemmed USING (word) GROUP BY item_id),
pairs AS (SELECT raw.item_id, coalesce(sp.pt, []) AS pt, coalesce(sr.rt, []) AS rt
          FROM raw LEFT JOIN sp USING (item_id) LEFT JOIN sr USING (item_id)),{_ROUGE_SCORES}""")
def rouge_l_stemmed(spark, sf):
    """G13 as the reference scores it: over Porter stems."""
    r = RG.rouge_l(EV.text_pairs(spark, sf), stemmed=True)
    return r.select(F.round("rouge_l", 6).alias("rouge_l"), "n_pairs")


@query("word_stems", sql=f"""
WITH docs AS (SELECT unnest({_rouge_tokens_sql('text')}) AS word FROM documents),{O.stem_ctes("docs")}
SELECT word, stem FROM stemmed""")
def word_stems(spark, sf):
    """The stem of every distinct word of the corpus (a word is stemmed once, after the shuffle)."""
    words = documents(spark, sf).select(F.explode(RG.rouge_tokens("text")).alias("word")).distinct()
    return words.select("word", RG.stems(F.array("word"))[0].alias("stem"))


@query("decode_text", sql=O.corpus_ctes() + O.tokens_cte("chunks").replace("tk_rows AS", "tk_unused AS") + """,
dec AS (SELECT u.doc_id, u.chunk, string_agg(v.txt, '' ORDER BY u.pos) FILTER (WHERE v.id >= 3 AND v.id < 32000) AS t
        FROM tk_u u LEFT JOIN full_vocab v ON v.id = u.id GROUP BY u.doc_id, u.chunk)
SELECT doc_id, chunk, trim(replace(coalesce(t, ''), '▁', ' ')) AS text FROM dec""")
def decode_text(spark, sf):
    ch = corpus_chunks(spark, sf)
    vocab = corpus_vocab(spark, sf)
    return decode(ch, "input_ids", vocab, "text").select("doc_id", "chunk", "text")


# --- H1-H7 run-log analytics, B8 due steps -------------------------------------
from spanweave.operators import runlog as R  # noqa: E402
from spanweave.operators.tasks import REGISTRY, Goal, Task, register_task  # noqa: E402
from spanweave.operators.split import due_steps  # noqa: E402
from spanweave.plans.runs import run_log  # noqa: E402

_RL = """WITH rl AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS run, CASE WHEN event_type = 'view' THEN 'training' ELSE 'eval' END AS prefix,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS name, value, event_id, user_id
  FROM events)"""


@query("run_steps", sql=_RL + " SELECT run, event_id, step FROM rl")
def run_steps(spark, sf):
    return run_log(spark, sf).select("run", "event_id", "step")


@query("run_stats", sql=_RL + """,
ri AS (SELECT *, ceil(step / 10)::BIGINT AS interval FROM rl),
rr AS (SELECT *, row_number() OVER (PARTITION BY run, prefix, interval, name ORDER BY step DESC) AS r FROM ri)
SELECT run, prefix, interval, name, round(sum(value * pow(0.9, r)) / sum(pow(0.9, r)), 6) AS average,
       count(*) AS n_updates FROM rr GROUP BY run, prefix, interval, name""")
def run_stats(spark, sf):
    d = R.report_intervals(run_log(spark, sf), 10)
    a = R.average_stats(d, weight=0.9)
    return a.select("run", "prefix", "interval", "name", F.round("average", 6).alias("average"), "n_updates")


@query("best_steps", sql=_RL + """,
b AS (SELECT run, name AS metric, step AS best_step, value AS best_value,
             row_number() OVER (PARTITION BY run, name ORDER BY CASE WHEN name = 'purchase' THEN value ELSE -value END DESC,
                                step) AS k
      FROM rl WHERE name IN ('purchase', 'error'))
SELECT run, metric, best_step, best_value FROM b WHERE k = 1""")
def best_steps(spark, sf):
    rl = run_log(spark, sf)
    return R.best_step(rl, "purchase", True).unionByName(R.best_step(rl, "error", False))


_GOALS = {"sst2": ("example_accuracy", 1), "mrpc": ("example_f1", 1), "stsb": ("example_spearman", 1), "loss_task": ("loss", -1)}
_SCORE_OF = {"purchase": "example_accuracy", "click": "example_f1", "view": "example_spearman", "error": "loss"}


@query("best_steps_by_task", sql=_RL + f""",
tasks(k, task, metric, sign) AS (VALUES {", ".join(f"({k}, '{t}', '{m}', {s})" for k, (t, (m, s)) in enumerate(_GOALS.items()))}),
named(name, metric) AS (VALUES {", ".join(f"('{n}', '{m}')" for n, m in _SCORE_OF.items())}),
b AS (SELECT task, run, t.metric, step AS best_step, value AS best_value,
             row_number() OVER (PARTITION BY run ORDER BY sign * value DESC, step) AS r
      FROM rl JOIN tasks t ON t.k = user_id % 4 JOIN named n ON n.name = rl.name AND n.metric = t.metric)
SELECT task, run, metric, best_step, best_value FROM b WHERE r = 1""")
def best_steps_by_task(spark, sf):
    """H3 driven by the task records; ``loss_task`` is registered here with a goal that is to be small."""
    tasks = F.array(*[F.lit(t) for t in _GOALS])
    score = F.create_map(*[F.lit(x) for pair in _SCORE_OF.items() for x in pair])
    rl = run_log(spark, sf).withColumn("task", F.get(tasks, (F.col("user_id") % 4).cast("int"))).withColumn("name", score[F.col("name")])
    register_task(Task("loss_task", 1, goal=Goal("loss", "min")))
    try:
        return R.best_step_by_task(rl)
    finally:
        REGISTRY.pop("loss_task")


@query("early_stop", sql=_RL + """,
ev AS (SELECT run, list({'step': step, 'value': value} ORDER BY step) AS evals FROM rl WHERE name = 'purchase' GROUP BY run)
SELECT run, list_reduce(evals, lambda acc, e: CASE WHEN acc.stop IS NOT NULL THEN acc ELSE {
         'best': CASE WHEN acc.best IS NULL OR e.value > acc.best THEN e.value ELSE acc.best END,
         'bad': CASE WHEN acc.best IS NULL OR (e.value > acc.best AND abs(e.value - acc.best) > 0.5) THEN 0 ELSE acc.bad + 1 END,
         'stop': CASE WHEN NOT (acc.best IS NULL OR (e.value > acc.best AND abs(e.value - acc.best) > 0.5))
                       AND acc.bad + 1 >= 3 THEN e.step::BIGINT ELSE NULL::BIGINT END} END,
         {'best': NULL::DOUBLE, 'bad': 0, 'stop': NULL::BIGINT}).stop AS stopped_at_step,
       len(evals)::INTEGER AS n_evals
FROM ev""")
def early_stop_q(spark, sf):
    return R.early_stop(run_log(spark, sf), "purchase", patience=3, threshold=0.5)


@query("keep_last", sql=_RL + """,
due AS (SELECT run, step FROM rl WHERE step % 25 = 0 OR step > 1000)
SELECT run, step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS k FROM due) WHERE k <= 3""")
def keep_last_q(spark, sf):
    due = due_steps(run_log(spark, sf), "step", 25, 1000)
    return R.keep_last(due, 3).select("run", "step")


_SCHEDULERS = "array('constant', 'constant_with_warmup', 'linear', 'cosine')"


@query("sweep_rank", sql=_RL + f""",
runs AS (SELECT run, user_id, avg(value) AS metric FROM rl WHERE name = 'purchase' GROUP BY run, user_id),
cells AS (SELECT 'cola' AS task, 'lr_' || CAST((user_id * 7) % 5 AS VARCHAR) AS lr_bin,
                 ['constant', 'constant_with_warmup', 'linear', 'cosine'][{O.uniform('4', 'user_id')} + 1] AS scheduler,
                 run, metric FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task, lr_bin, scheduler ORDER BY metric DESC, run DESC) AS k FROM cells)
SELECT task, lr_bin, scheduler, count(*) AS n_runs, round(avg(metric), 6) AS mean_metric,
       max(CASE WHEN k = 1 THEN run END) AS best_run
FROM ranked GROUP BY task, lr_bin, scheduler""")
def sweep_rank(spark, sf):
    rl = run_log(spark, sf).filter(F.col("name") == "purchase")
    runs = rl.groupBy("run", "user_id").agg(F.avg("value").alias("metric"))
    cells = runs.select(F.lit("cola").alias("task"),
                        F.concat(F.lit("lr_"), F.pmod(F.col("user_id") * 7, F.lit(5)).cast("string")).alias("lr_bin"),
                        F.expr(f"element_at({_SCHEDULERS}, cast({uniform_sql('4', 42, 'user_id')} as int) + 1)")
                         .alias("scheduler"), "run", "metric")
    r = R.rank_sweep(cells)
    return r.select("task", "lr_bin", "scheduler", "n_runs", F.round("mean_metric", 6).alias("mean_metric"), "best_run")


@query("train_eval_gap", sql=_RL + """,
ep AS (SELECT run, ceil(step / 20)::BIGINT AS epoch, prefix, value FROM rl),
p AS (SELECT run, epoch, avg(value) FILTER (WHERE prefix = 'training') AS training,
             avg(value) FILTER (WHERE prefix = 'eval') AS eval FROM ep WHERE epoch % 2 = 0 GROUP BY run, epoch)
SELECT run, epoch, round(training, 6) AS training, round(eval, 6) AS eval, round(eval - training, 6) AS gap FROM p""")
def train_eval_gap_q(spark, sf):
    d = run_log(spark, sf).withColumn("epoch", F.ceil(F.col("step") / 20).cast("bigint"))
    g = R.train_eval_gap(d)
    return g.select("run", "epoch", F.round("training", 6).alias("training"), F.round("eval", 6).alias("eval"),
                    F.round("gap", 6).alias("gap"))


# --- A4, I1-I4 streaming ---------------------------------------------------------
from spanweave.streaming import streams as ST  # noqa: E402


def _doc_stream(spark, sf):
    return ST.stream_corpus(spark, f"{sf.rstrip('/')}/documents*.parquet", drop=("lang", "source", "n_chars"),
                            expected_shards=1)


@query("stream_corrupt", sql=_corrupt_sql(0.15, 128, 32))
def stream_corrupt(spark, sf):
    """I1 equals the batch corruption (same oracle as corrupt_random)."""
    vocab = corpus_vocab(spark, sf)
    out = ST.stream_encode_corrupt(spark, _doc_stream(spark, sf), vocab, ST.scratch_path(spark, "stream-corrupt"))
    d = spark.read.parquet(out)
    return d.select("doc_id", "chunk", render("input_ids"), render("labels"),
                    render("decoder_input_ids"), render("attention_mask"))


@query("stream_pack", sql=_complement_sql())
def stream_pack(spark, sf):
    """The test corpus is one file, hence one micro-batch; its rows equal those of corrupt_packed."""
    vocab = corpus_vocab(spark, sf)
    out = ST.stream_pack_corrupt(spark, _doc_stream(spark, sf), vocab, ST.scratch_path(spark, "stream-pack"),
                                 PACK_RAW, PACK_INPUT, PACK_TARGET, density=PACK_DENSITY, group_docs=PACK_GROUP_DOCS)
    return spark.read.parquet(out).select("pack_group", "row", render("input_ids"), render("labels"))


@query("stream_pack_whole", sql=ORACLE["pack_whole"])
def stream_pack_whole_q(spark, sf):
    """I2 with the remainder carried from batch to batch."""
    out = ST.stream_pack_whole(spark, _doc_stream(spark, sf), corpus_vocab(spark, sf), ST.scratch_path(spark, "stream-whole"), PACK_RAW)
    return spark.read.schema("row bigint, input_ids array<int>").parquet(out).select("row", render("input_ids"))


@query("stream_shuffle", sql=_THROUGH_SQL)
def stream_shuffle(spark, sf):
    """F2 over documents that arrive in three parts; the stream is started anew for each and goes on with its buffer."""
    docs = documents(spark, sf).select("doc_id", "text")
    low, high = docs.approxQuantile("doc_id", [1 / 3, 2 / 3], 0.01) or (0.0, 0.0)
    part = F.when(F.col("doc_id") > high, 2).when(F.col("doc_id") > low, 1).otherwise(0)
    src, out = ST.scratch_path(spark, "arrivals"), ST.scratch_path(spark, "stream-shuffle")
    for k in range(3):
        docs.where(part == k).write.mode("append").parquet(src)
        ST.stream_shuffle(spark, spark.readStream.schema(docs.schema).parquet(src), ["doc_id"], out, buffer=SHUFFLE_SLOTS)
    d = ST.read_shuffled(spark, out, docs.schema)
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_text"), "shuffle_idx")


@query("stream_take", sql="SELECT doc_id FROM documents ORDER BY doc_id LIMIT 500")
def stream_take(spark, sf):
    out = ST.stream_take(spark, _doc_stream(spark, sf).select("doc_id"), 500, "doc_id",
                         ST.scratch_path(spark, "stream-take"))
    return spark.read.parquet(out).select("doc_id")


@query("stream_stats", sql=_RL + """,
ri AS (SELECT *, ceil(step / 10)::BIGINT AS interval FROM rl)
SELECT run, prefix, interval, name, round(avg(value), 6) AS average, count(*) AS n_updates
FROM ri GROUP BY run, prefix, interval, name""")
def stream_stats(spark, sf):
    """I4: the run log (derived from events) written once, then aggregated as a stream."""
    return _stream_stats(spark, sf, None)


@query("stream_weighted_stats", sql=ORACLE["run_stats"])
def stream_weighted_stats(spark, sf):
    """I4 with the weights of H1: equals the batch result of run_stats."""
    return _stream_stats(spark, sf, 0.9)


def _stream_stats(spark, sf, weight):
    src = ST.scratch_path(spark, "run-log")
    run_log(spark, sf).select("run", "prefix", "step", "name", "value").write.parquet(src)
    schema = "run string, prefix string, step bigint, name string, value double"
    stream = spark.readStream.schema(schema).parquet(src)
    out = ST.stream_stats(spark, stream, 10, ST.scratch_path(spark, "stream-stats"), weight)
    d = ST.read_stats(spark, out)
    return d.select("run", "prefix", "interval", "name", F.round("average", 6).alias("average"), "n_updates")


# --- A5/J5 instances, C8-C11 instruction prompts ---------------------------------
from spanweave.operators import instructions as IN  # noqa: E402
from spanweave.plans.instructions import instruction_instances  # noqa: E402

_STRIP_D = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"
INSTR_MAX = 256


def _d_strip(x: str) -> str:
    return f"regexp_replace({x}, {_STRIP_D}, '', 'g')"


def _d_dot(x: str) -> str:
    return f"({x} || CASE WHEN length({x}) > 0 AND contains({O.punct_literal()}, right({x}, 1)) THEN '' ELSE '.' END)"


def _d_example(kind: str, e: str, k: str, expl: str) -> str:
    head = _d_dot(f"(' {kind} Example ' || CAST({k} AS VARCHAR) || ' -' || chr(10) || 'Input: ' || {_d_strip(e + '.input')})")
    body = _d_dot(f"({head} || chr(10) || ' Output: ' || {_d_strip(e + '.output')})")
    ex = _d_dot(f"({body} || chr(10) || ' Explanation: ' || {_d_strip(e + '.explanation')})")
    return (f"(CASE WHEN {expl} AND {e}.explanation IS NOT NULL THEN {ex} || chr(10) ELSE {body} || chr(10) END "
            f"|| chr(10))")


def _d_count(text: str) -> str:
    from spanweave.constants import PIECE_PATTERN
    return f"(len(regexp_extract_all({text}, '{PIECE_PATTERN}', 2)) + 1)"


def instruction_ctes(encoding_sql: str) -> tuple[str, str, str]:
    """CTEs up to ``b`` (instances with definition ``d`` and task input ``ti``) and the lists of candidate
    examples; ``encoding_sql`` yields columns name_f, def_f, npos, nneg, expl_f."""
    ti = f"({_d_dot(chr(39) + 'Now complete the following example -' + chr(39) + ' || chr(10) || ' + chr(39) + 'Input: ' + chr(39) + ' || ' + _d_strip('inp'))} || chr(10) || 'Output: ')"
    definition = (f"CASE WHEN def_f THEN {_d_dot(chr(39) + 'Definition: ' + chr(39) + ' || ' + _d_strip('definition'))} "
                  f"|| chr(10) || chr(10) ELSE '' END")
    pos_c = f"list_transform(pos[1 : npos], lambda e, i: {_d_example('Positive', 'e', 'i', 'expl_f')})"
    neg_c = f"list_transform(neg[1 : nneg], lambda e, i: {_d_example('Negative', 'e', 'i', 'expl_f')})"
    return f"""
WITH tt AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn) AS t
            FROM conversations GROUP BY conv_id),
tk AS (SELECT conv_id, 'task' || CAST(conv_id AS VARCHAR) AS task, t[1].text AS definition,
              list_transform(range(1, len(t)), lambda k: {{'input': t[k].text, 'output': t[k + 1].text,
                                                          'explanation': t[k + 1].role}}) AS pos,
              list_transform(range(1, len(t)), lambda k: {{'input': t[k + 1].text, 'output': t[k].text,
                                                          'explanation': t[k + 1].role}}) AS neg, t
       FROM tt),
ins AS (SELECT task, definition, pos, neg, i - 1 AS instance_pos,
               CAST(conv_id AS VARCHAR) || '-' || CAST(t[i + 1].turn AS VARCHAR) AS id,
               t[i].text AS inp, [t[i + 1].text, t[i + 1].role] AS output
        FROM tk, unnest(range(1, len(t))) r(i)),
enc AS (SELECT *, {encoding_sql} FROM ins WHERE instance_pos < 100),
b AS (SELECT *, {definition} AS d, {ti} AS ti FROM enc)""", pos_c, neg_c


def _instruction_sql(encoding_sql: str) -> str:
    """Oracle of instruction rendering."""
    ctes, pos_c, neg_c = instruction_ctes(encoding_sql)

    def fold(cands: str, prior: str) -> str:
        return (f"list_reduce({cands}, lambda s, c: CASE WHEN s.stop THEN s WHEN "
                f"{_d_count(f'(d || {prior} || array_to_string(s.acc, {chr(39)} {chr(39)}) || c || ti)')} <= {INSTR_MAX} "
                f"THEN {{'acc': list_append(s.acc, c), 'stop': false}} ELSE {{'acc': s.acc, 'stop': true}} END, "
                f"{{'acc': []::VARCHAR[], 'stop': false}}).acc")
    return f"""{ctes},
p AS (SELECT *, {fold(pos_c, "''")} AS pa FROM b),
n AS (SELECT *, {fold(neg_c, "array_to_string(pa, ' ')")} AS na FROM p)
SELECT id, CASE WHEN name_f THEN task || '. ' ELSE '' END || d || array_to_string(pa, '') || array_to_string(na, '') || ti
       AS source,
       output[{O.uniform('len(output)', 'id', chr(39) + 'ref' + chr(39))} + 1] AS target
FROM n"""


@query("instruction_prompts", sql=_instruction_sql(
    "true AS name_f, true AS def_f, 2 AS npos, 2 AS nneg, true AS expl_f"))
def instruction_prompts(spark, sf):
    e = instruction_instances(spark, sf, subset="test")
    e = IN.with_fixed_encoding(e, add_task_name=True, add_task_definition=True, num_pos_examples=2,
                               num_neg_examples=2, add_explanation=True)
    r = IN.choose_reference(IN.render_instruction(e, max_source_length=INSTR_MAX))
    return r.select("id", "source", "target")


def _encoding_case(field: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(
        [str(x).lower() if isinstance(x, bool) else str(x) for x in
         [e[{"name_f": 0, "def_f": 1, "npos": 2, "nneg": 3, "expl_f": 4}[field]] for e in IN.ENCODINGS]]))
    return f"CASE {O.uniform('5', 'id')} {cases} END AS {field}"


@query("instruction_mixed", sql=_instruction_sql(", ".join(
    _encoding_case(f) for f in ("name_f", "def_f", "npos", "nneg", "expl_f"))))
def instruction_mixed(spark, sf):
    """One of five encodings per instance (md5 uniform), then C8/C9/C11."""
    e = IN.choose_encoding(instruction_instances(spark, sf, subset="test"))
    r = IN.choose_reference(IN.render_instruction(e, max_source_length=INSTR_MAX))
    return r.select("id", "source", "target")


TRUNC_MAX = 64


@query("instruction_truncate", sql=O.vocab_ctes() + f""",
src AS ({_instruction_sql("true AS name_f, true AS def_f, 2 AS npos, 2 AS nneg, true AS expl_f")}),
sp_raw AS (SELECT id, source, regexp_extract_all(' ' || source, '{PIECE_PATTERN}', 1) AS ws,
                  regexp_extract_all(' ' || source, '{PIECE_PATTERN}', 2) AS core FROM src),
sp AS (SELECT id, source, list_transform(core, lambda c, i: CASE WHEN ws[i] = '' THEN c ELSE '{WORD_MARK}' || c END)
              AS pieces FROM sp_raw),
su AS (SELECT id, unnest(pieces) AS piece, unnest(generate_series(1, len(pieces))) AS pos FROM sp),
{O.spelled_ctes("sx", "su", ["id"])},
sn AS (SELECT id, tid, row_number() OVER (PARTITION BY id ORDER BY pos, sub) AS nth FROM sx),
sd AS (SELECT n.id, count(*) AS tokens, string_agg(v.piece, '' ORDER BY n.nth)
              FILTER (WHERE v.id IS NOT NULL AND n.nth <= {TRUNC_MAX}) AS t
       FROM sn n LEFT JOIN vocab v ON v.id = n.tid GROUP BY n.id)
SELECT sp.id, CASE WHEN coalesce(sd.tokens, 0) + 1 <= {TRUNC_MAX} THEN sp.source
                   ELSE trim(replace(coalesce(sd.t, ''), '{WORD_MARK}', ' ')) END AS source_text
FROM sp LEFT JOIN sd ON sd.id = sp.id""")
def instruction_truncate(spark, sf):
    """Prompts over the limit become the decoding of their first tokens."""
    e = instruction_instances(spark, sf, subset="test")
    e = IN.with_fixed_encoding(e, add_task_name=True, add_task_definition=True, num_pos_examples=2,
                               num_neg_examples=2, add_explanation=True)
    r = IN.render_instruction(e, max_source_length=INSTR_MAX)
    t = IN.truncate_source(r, corpus_vocab(spark, sf), TRUNC_MAX)
    return t.select("id", "source_text")


# --- A7 cache, A8 feature sink, G14 duplicate trimming ----------------------------
from spanweave.sources.tables import cached, stored, write_features  # noqa: E402
from spanweave.streaming.streams import scratch_path  # noqa: E402


@query("features_sink", sql=_corrupt_sql(0.15, 128, 32).replace(
    "SELECT doc_id, chunk, {0} AS input_ids".format(O.render('inp')), "SELECT {0} AS input_ids".format(O.render('inp')))
    .replace(f"       {O.render('dec')} AS decoder_input_ids, ", "       "))
def features_sink(spark, sf):
    """Only input_ids, attention_mask and labels reach the written features."""
    ch = corpus_chunks(spark, sf)
    out = scratch_path(spark, "features")
    write_features(corrupt(ch, "row_key", input_length=128, target_length=32, density=0.15), out)
    d = spark.read.parquet(out)
    return d.select(render("input_ids"), render("labels"), render("attention_mask"))


@query("cached_chunks", sql=O.corpus_ctes() + f"""
SELECT doc_id, chunk, {O.render('input_ids')} AS input_ids, {O.render('attention_mask')} AS attention_mask
FROM chunks""")
def cached_chunks(spark, sf):
    """Whole-text encoding behind a configuration-keyed cache."""
    cfg = {"source": sf, "table": "documents", "tokenizer": VOCAB_VERSION, "inputs": input_fingerprint(spark, f"{sf.rstrip('/')}/documents.parquet"), "max_len": 128, "overflow": "chunk"}
    d = cached(spark, cfg, lambda: corpus_chunks(spark, sf))
    return d.select("doc_id", "chunk", render("input_ids"), render("attention_mask"))


@query("dedup_predictions", sql=O.corpus_ctes() + O.predictions_cte() + """
SELECT DISTINCT doc_id, chunk, array_to_string(pred, ' ') AS pred FROM preds""")
def dedup_predictions(spark, sf):
    """The last distributed batch repeats rows; one row per example key survives."""
    p = stored(EV.predictions(spark, sf), "predictions")
    last = dense_index(p, ["doc_id", "chunk"], "_i")
    n = p.agg(F.count(F.lit(1))).scalar()
    repeated = p.unionByName(last.filter(F.col("_i") >= n - 32).drop("_i"))
    t = M.trim_duplicates(repeated, "row_key")
    return t.select("doc_id", "chunk", render("pred"))


# --- D4 per-sentence encoding, A6 phrase file, A9 prediction sink ------------------
from spanweave.operators.vocab import encode_sentences  # noqa: E402
from spanweave.sources.tables import read_phrases, write_predictions  # noqa: E402

SENT_LEN = 64


@query("encode_sentences", sql=O.vocab_ctes() + f""",
sents AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text,
                 unnest(generate_series(0, len(string_split(text, chr(10))) - 1))::INTEGER AS sentence_idx
          FROM conversations),
sk AS (SELECT *, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(sentence_idx AS VARCHAR) AS sk FROM sents)"""
    + O.text_ids_ctes("st", "sk", ["sk"], eos=False) + f""",
enc AS (SELECT sk, c::INTEGER AS chunk, ids[c * {SENT_LEN - 1} + 1 : c * {SENT_LEN - 1} + {SENT_LEN - 1}] || [1] AS seg
        FROM st_ids, unnest(range(0, greatest(ceil(len(ids) / {SENT_LEN - 1})::INTEGER, 1))) AS r(c))
SELECT k.conv_id, k.turn, k.sentence_idx, e.chunk, {O.render(O.fit('e.seg', SENT_LEN))} AS input_ids
FROM sk k JOIN enc e ON e.sk = k.sk""")
def encode_sentences_q(spark, sf):
    """Each line of a turn encoded on its own (rows out != rows in)."""
    conv = read_table(spark, sf, "conversations", balance=True).select("conv_id", "turn", "text")
    d = conv.withColumn("sentences", F.split("text", "\n")).drop("text")
    e = encode_sentences(d, "sentences", corpus_vocab(spark, sf), SENT_LEN)
    return e.select("conv_id", "turn", "sentence_idx", F.col("chunk").cast("int").alias("chunk"), render("input_ids"))


@query("phrase_file", sql=O.vocab_ctes() + O.mine_ctes(MINE_MIN_COUNT) + f"""
SELECT DISTINCT phrase FROM mined WHERE score >= {PHRASE_MIN_SCORE}""")
def phrase_file(spark, sf):
    """Mined phrases written one per line, read back as a set."""
    path = scratch_path(spark, "phrases")
    m = mine_phrases(documents(spark, sf), "text", max_n=5, min_count=MINE_MIN_COUNT, min_score=PHRASE_MIN_SCORE)
    m.select("phrase").write.text(path)
    return read_phrases(spark, path)


@query("prediction_sink", sql=O.corpus_ctes() + O.predictions_cte() + O.tokens_cte("chunks").replace("tk_rows AS", "tk_unused AS") + """,
fm AS (SELECT max(pred[1]) AS m FROM preds),
al AS (SELECT p.doc_id, p.chunk, CASE WHEN fm.m = 0 THEN p.pred[2 : len(p.pred)] || [0] ELSE p.pred END AS pred,
              list_transform(p.labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END) AS labels FROM preds p, fm),
pu AS (SELECT doc_id, chunk, unnest(pred) AS id, unnest(generate_series(1, len(pred))) AS pos FROM al),
lu AS (SELECT doc_id, chunk, unnest(labels) AS id, unnest(generate_series(1, len(labels))) AS pos FROM al),
pdx AS (SELECT u.doc_id, u.chunk, string_agg(v.txt, '' ORDER BY u.pos) FILTER (WHERE v.id >= 3 AND v.id < 32000) AS t
        FROM pu u LEFT JOIN full_vocab v ON v.id = u.id GROUP BY u.doc_id, u.chunk),
ldx AS (SELECT u.doc_id, u.chunk, string_agg(v.txt, '' ORDER BY u.pos) FILTER (WHERE v.id >= 3 AND v.id < 32000) AS t
        FROM lu u LEFT JOIN full_vocab v ON v.id = u.id GROUP BY u.doc_id, u.chunk)
SELECT 'corpus' AS task, 'train' AS split, a.doc_id, a.chunk, trim(replace(coalesce(b.t, ''), '▁', ' ')) AS input,
       trim(replace(coalesce(a.t, ''), '▁', ' ')) AS prediction,
       trim(replace(coalesce(b.t, ''), '▁', ' ')) AS reference
FROM pdx a JOIN ldx b ON b.doc_id = a.doc_id AND b.chunk = a.chunk""")
def prediction_sink(spark, sf):
    """Decoded predictions next to input and reference texts, partitioned by task and split. The
    corpus predictions are of the chunk itself, so the input is the chunk's text."""
    vocab = corpus_vocab(spark, sf)
    p = EV.predictions(spark, sf)
    p = M.align_predictions(p)
    p = decode(decode(p, "pred", vocab, "prediction"), "labels", vocab, "reference").withColumn("input", F.col("reference"))
    out = scratch_path(spark, "predictions")
    write_predictions(p.select(F.lit("corpus").alias("task"), F.lit("train").alias("split"), "doc_id", "chunk",
                               "input", "prediction", "reference"), out)
    return spark.read.parquet(out).select("task", "split", "doc_id", "chunk", "input", "prediction", "reference")


from spanweave.plans import surfaces  # noqa: E402, F401  (registers its queries)
