"""Cleaning a corpus in stages, each by one operator of quantloom.llm.

Every stage works on all that its predecessor kept, written as a table and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import mixing, packing, quality, queries, recompression, simhash
from quantloom.llm.storage import bounded_batches, stored

#: SQL has no tokenizer and no XXH64; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject; the columns stay as they are.

    Null, empty and wordless texts are rejected as too short; texts of any length are judged whole; repeated rows are
    judged each for itself, with one verdict; null ids and other columns don't matter; an empty table gives an empty result."""
    bounded_batches(spark)
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, a null one being the largest.

    Candidates come from SimHashes and their deletion-variant signatures, and further ones from MinHash bands; each link is verified.
    Texts without words are one group; among rows of one id and group that of the smallest hash of all columns stays,
    and one of truly equal rows; a text of any length counts whole; other columns only tell rows apart, whatever
    their names; an empty table gives an empty result."""
    bounded_batches(spark)
    return simhash.keep_one_per_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; so do documents left without words by that.

    A null id counts as the largest, rows of one id are not earlier than each other; null and empty texts stay as
    they are; repeated rows stay repeated; texts of any length are compared whole; other columns stay, whatever
    their names; an empty table gives an empty result."""
    bounded_batches(spark)
    report = "repeats"
    while report.lower() in map(str.lower, docs.columns):
        report += "_"
    kept = recompression.remove_repeats(docs, window=13, keep=True, report=report)
    return kept.where(f"{report}.n_removed = 0 OR {report}.n_removed < {report}.n_words").drop(report)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, the last of a source cut to the words taken.

    Null sources are one source, the last; documents without words are never taken; a null id draws by the text; ties and
    repeated rows follow each other; a text of any length counts whole; other columns stay, whatever their
    names; an empty table gives an empty result."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    A null text is its end id alone; null ids stay null; repeated rows are packed each for itself; only longer documents
    than a sequence are cut; other columns are left out; an empty table gives an empty result."""
    bounded_batches(spark)
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
