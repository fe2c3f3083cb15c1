"""Corpus plans over the shared tables: documents -> vocabulary -> ids -> corruption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanweave.constants import SPARK_PIECE_PATTERN, VOCAB_SIZE
from spanweave.operators.vocab import build_vocab, encode, read_subwords
from spanweave.sources.tables import cached, input_fingerprint, read_table

CHUNK_LEN = 128
#: Part of every artifact's key: changes with the algorithm, so that older artifacts are not reused.
VOCAB_VERSION = "bytes-subwords-pieces-3"
PHRASES_VERSION = "pmi-1"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", balance=True).select("doc_id", "text")


def corpus_vocab(spark: SparkSession, sf_dir: str, fresh: bool = False) -> DataFrame:
    """D1 over every document text, stored once as an artifact.

    The reference loads a pretrained tokenizer; here the vocabulary is built
    from the corpus once and kept under a key made of the input files (path,
    size, modification time), the piece pattern and the size, so a changed
    corpus or setting never reuses a stale vocabulary. ``fresh`` rebuilds.
    """
    if fresh:
        return build_vocab(documents(spark, sf_dir), "text")
    cfg = {"artifact": "vocabulary", "inputs": input_fingerprint(spark, f"{sf_dir.rstrip('/')}/documents.parquet"),
           "pattern": SPARK_PIECE_PATTERN, "size": VOCAB_SIZE, "subwords": read_subwords()[-1:],
           "version": VOCAB_VERSION}
    return cached(spark, cfg, lambda: build_vocab(documents(spark, sf_dir), "text"))


def corpus_chunks(spark: SparkSession, sf_dir: str, max_len: int = CHUNK_LEN,
                  vocab: DataFrame | None = None) -> DataFrame:
    """D2 in whole-text mode: every document becomes rows of ``max_len`` ids.

    Adds ``row_key`` = "doc_id:chunk", the key of every seeded choice.
    """
    docs = documents(spark, sf_dir)
    vocab = vocab if vocab is not None else corpus_vocab(spark, sf_dir)
    enc = encode(docs, "text", vocab, max_len, overflow="chunk")
    return (enc.withColumn("chunk", F.col("chunk").cast("int"))
               .withColumn("row_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string")))
               .drop("text"))


def corpus_phrases(spark: SparkSession, sf_dir: str, min_count: int, min_score: float, max_n: int = 5) -> DataFrame:
    """X1 phrases of the corpus, stored once as an artifact (the reference loads a phrase file)."""
    from spanweave.operators.phrases import mine_phrases
    cfg = {"artifact": "phrases", "inputs": input_fingerprint(spark, f"{sf_dir.rstrip('/')}/documents.parquet"),
           "pattern": SPARK_PIECE_PATTERN, "version": PHRASES_VERSION, "min_count": min_count, "min_score": min_score, "max_n": max_n}
    return cached(spark, cfg, lambda: mine_phrases(documents(spark, sf_dir), "text", max_n=max_n,
                                                   min_count=min_count, min_score=min_score).select("phrase"))
