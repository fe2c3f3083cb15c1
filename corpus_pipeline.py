"""Corpus preparation: five stages over ``documents``, each on all that the one before kept.

Language ID (documents without a language go), MinHash near-dedup (one document of each group stays),
benchmark decontamination (documents that hold a benchmark passage go), personal data (spans are
redacted), best-fit packing (token pieces in sequences). All stages but the last return the
columns of ``documents``; ``n_chars`` follows the redacted text.

Every stage takes an empty table (and gives one), repeated rows, null ids and texts, and columns of any further names, which
it carries along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanweave.llm.common import fresh, id_crc, shared_path, table
from spanweave.llm.decontamination import drop_contaminated
from spanweave.llm.language_id import UNKNOWN, identify
from spanweave.llm.near_dedup import drop_near_duplicates
from spanweave.llm.packing import pack
from spanweave.llm.pii import redact

#: A language that scores lower than this is no language of the labelled rows.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those without letters (null and empty texts too) or a clear
    language go. Repeated rows are judged alike."""
    lang, score = fresh(docs, "_lang_pred"), fresh(docs, "_lang_score")
    found = identify(docs, id_crc("doc_id") % 3 != 1, lang_out=lang, score_out=score)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the
    smallest id. Documents without words are copies of nothing and stay."""
    return drop_near_duplicates(docs, num=80, den=100).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``; null and empty texts hold none and stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data redacted; null texts stay null and keep their ``n_chars``."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                 .otherwise(F.length("text")).cast(kind))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, the sequence and the place in it, so that the sequences can be read from
    them alone; a null or empty text is its end id alone."""
    return pack(docs, with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Learned language ID, MinHash, SimHash and boosted trees have no SQL; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
