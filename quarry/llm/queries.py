"""The registered queries of this subpackage: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.tiff import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.context_mixing import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash import component_rows

    return component_rows(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op7_url_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op9_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), word_vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc_archives": op2_warc_archives,
    "op3_tiff_media": op3_tiff_media,
    "op4_context_mixing": op4_context_mixing,
    "op5_golay_simhash": op5_golay_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_propagation": op7_url_propagation,
    "op8_source_mixing": op8_source_mixing,
    "op9_label_sharding": op9_label_sharding,
    "op10_packing": op10_packing,
}

__all__ = ["ORACLES", "QUERIES"]
