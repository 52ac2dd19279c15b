"""The thin queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, cotraining, difference_cover, knn, line_dedup, mixing, oracles, packing, quality, recompression, simhash, url_filter, vector_codes
from .storage import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder.  The queries' session, which is theirs, passes rows of whole texts to Python in small batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: A host is listed if at least this share of its pages carries a campaign parameter.
TRACKED_SHARE = 0.2


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = F.col("url")
    tracked = F.coalesce(url.contains("utm_"), F.lit(False)).cast("double")
    listed = pages.groupBy(url_filter.url_host(url).alias("host")).agg(F.avg(tracked).alias("share")).where(F.col("share") >= TRACKED_SHARE).select("host")
    return url_filter.judge_urls(pages, listed, URL_RULES)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    pieces = chat_format.format_turns(chat_format.as_parts(turns))
    return chat_format.digests(chat_format.read_turns(pieces))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents"), window=13)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return knn.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents")).drop("cleaned")


def op7_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = difference_cover.repeated_bytes(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256.0)
    digests = F.create_map(*[F.lit(x) for d in books.books for x in (d, books.digest(d))]) if books.books else F.lit(None).cast("map<long,string>")
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digests[F.col("dim")].alias("codebooks_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), most_words=4, min_count=30, percent=80, most=2000)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "lines.*", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_format": op2_chat_format,
    "op3_recompression": op3_recompression,
    "op4_source_mix": op4_source_mix,
    "op5_kd_top_k": op5_kd_top_k,
    "op6_quality_rules": op6_quality_rules,
    "op7_co_training": op7_co_training,
    "op8_simhash_near_dup": op8_simhash_near_dup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_best_two_fit": op10_best_two_fit,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = oracles.ORACLES
