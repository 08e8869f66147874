"""The registered queries of this package and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_blocks, line_rules, mixing, mpeg_ts, ngram_join, packing, piece_nbest, pii, quality_qda, toxicity_cnn
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies", "t")


def op2_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_ts.media_digest(table(spark, sf_dir, "documents"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op4_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_nbest.encoded(table(spark, sf_dir, "documents"), check=True)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_texts(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_mpeg_ts, op3_line_rules, op4_piece_nbest, op5_ngram_join, op6_html_blocks, op7_pii, op8_quality_qda, op9_toxicity_cnn, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_rules": line_rules.ORACLE, "op7_pii": pii.oracle()}
