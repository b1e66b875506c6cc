"""The contract queries of this package: thin wrappers that derive the asked columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, lm_ppm, mix, near_dedup, packing, quality_gam, rules, substring_dedup, url_filter
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.report(table(spark, sf_dir, "documents"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cleaned(table(spark, sf_dir, "documents"), with_text=False)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), width=near_dedup.SHINGLE)


def op9_lm_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ppm.scored(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "soft_terms")


_QUERIES = (op1_mix_sources, op2_quality_gam, op3_html_extract, op4_pack, op5_quality_rules, op6_exact_dedup, op7_substring_dedup, op8_near_dedup, op9_lm_ppm, op10_url_filter)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mix.oracle(), "op6_exact_dedup": exact_dedup.oracle(), "op7_substring_dedup": substring_dedup.oracle(), "op8_near_dedup": near_dedup.oracle(), "op10_url_filter": url_filter.oracle()}
