"""The queries of this subpackage and their SQL: thin, they only name tables and production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import language_model, license_scan, line_dedup, merkle, periodic, topk, toxicity, warc
from siftline.llm.common import ship
from siftline.llm.decontaminate import decontaminate
from siftline.llm.mixing import mix_sizes
from siftline.llm.quality import classify
from siftline.llm.simhash import near_duplicates
from siftline.llm.token_files import token_table
from siftline.session import table

ship()

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A public tokenizer's file; every machine has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hash")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path(), end=0)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents"), min_docs=10).drop("keep")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("h")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5)


def op11_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodic.planted))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_digests(merkle.documents_manifest(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_benchmark_decontamination,
            op2_quality_classifier,
            op3_token_id_output,
            op4_lm_scoring,
            op5_warc,
            op6_line_dedup,
            op7_license_scan,
            op8_source_mixing,
            op9_simhash_near_dedup,
            op10_exact_top_k,
            op11_periodic_run_detection,
            op12_toxicity,
            op13_merkle_manifest,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": warc.ORACLE,
        "op6_line_dedup": line_dedup.ORACLE,
        "op7_license_scan": license_scan.oracle(),
        "op10_exact_top_k": topk.ORACLE,
        "op11_periodic_run_detection": periodic.oracle(),
        "op13_merkle_manifest": merkle.oracle(),
    }
