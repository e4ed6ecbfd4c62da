"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .ballmeans import ball_kmeans
from .blockmax import ranked_search
from .common import table
from .decontaminate import find_contamination
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .oracles import ball_kmeans_sql, ranked_search_sql
from .packing import pack
from .pii import personal_data_digest
from .simhash import near_duplicates
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .toxicity import fit_toxicity, score_toxicity
from .wrapper import extract_pages


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.crc32("text").alias("text_crc32"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, manifest)


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(spark, docs, fit_toxicity(spark, docs, table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), words=4, seed=42, max_bits=4)


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark, table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, table(spark, sf_dir, "documents"))


def op9_benchmark_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_rate=0.2)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(spark, table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64, scale=1024, seed="3")


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_additive_quantisation, op2_line_dedup, op3_token_files, op4_toxicity_cnn, op5_token_counts, op6_simhash_golay, op7_wrapper_induction, op8_license_scan, op9_benchmark_cgk,
        op10_best_fit_packing, op11_ball_kmeans, op12_block_max_wand, op13_pii_crf,
    )
}

ORACLE_SQL: dict[str, str] = {"op11_ball_kmeans": ball_kmeans_sql(), "op12_block_max_wand": ranked_search_sql()}
