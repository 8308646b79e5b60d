"""The corpus pipeline: five stages over `documents`, each one of the operators in lakecat.llm.

Each stage takes what its predecessor kept and returns the columns of documents; the last one returns the encoded documents.

Defined results: a null text counts as empty wherever it is scored, hashed or encoded, and stays null in the rows; rows with null or equal
ids are documents of their own; exact copies are near-duplicates, so one of each group stays; ties between copies go to the
smallest id, null ids last, then the smallest text; texts of any length are worked on whole; an empty table passes through all stages as an
empty one; extra columns, whatever their names, pass through the stages that return documents. The operators' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakecat.llm import bpe, common, decontam, quality, simhash, substring


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows among `docs`."""
    scored = quality.scored(docs, common.table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays, the one with the smallest id."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 35 that starts anywhere else too are cut out; every document stays."""
    return substring.strip(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a paraphrase of one go."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of the ids and of the decoded text."""
    import public_tokenizers

    return bpe.summarised(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: A trained classifier and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each one's rows are written below the shared folder before the next one reads them, and what a
    stage has read or staged itself is deleted once its rows are written."""
    docs = common.table(spark, sf_dir, "documents")
    begin = common.staged_so_far()
    for name, stage in STAGES[:-1]:
        kept = common.staging(spark, f"stage-{name}")
        docs = common.staged_at(stage(spark, docs, sf_dir), kept)
        common.release(spark, [kept], begin)
    return STAGES[-1][1](spark, docs, sf_dir)
