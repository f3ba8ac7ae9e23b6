"""The queries of this subpackage, for __spark_entry__.py: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmltext, idfiles, langid, lm, packing, quality, simhash, topk, toxicity
from .common import table


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out_of("doc_id")
    return langid.predict(docs, docs.where(~held_out), held_out=held_out)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.held_out_of("doc_id")
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out), held_out=held_out)


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), held_out=lm.held_out_of("doc_id"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.round_trip(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_toxicity": op2_toxicity,
    "op3_page_text": op3_page_text,
    "op4_lm_score": op4_lm_score,
    "op5_packing": op5_packing,
    "op6_top_k": op6_top_k,
    "op7_decontaminate": op7_decontaminate,
    "op8_id_files": op8_id_files,
    "op9_quality": op9_quality,
    "op10_near_duplicates": op10_near_duplicates,
}
ORACLE_SQL = {"op6_top_k": topk.ORACLE, "op7_decontaminate": decontam.ORACLE}
