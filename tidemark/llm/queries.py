"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.runtime import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import decontamination

    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import pii

    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import neighbours

    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import language_id

    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import secrets

    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import suffix_dedup

    return suffix_dedup.digest(suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), with_bytes=False))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import line_dedup

    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import conversation_repair

    return conversation_repair.digest(table(spark, sf_dir, "conversations"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import target_encoding

    return target_encoding.shop_rates(*[table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_decontamination, op3_quality, op4_pii, op5_simhash, op6_neighbours, op7_language_id, op8_secrets, op9_suffix_dedup, op10_line_dedup, op11_conversation_repair, op12_minhash, op13_target_encoding, pipeline)}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import decontamination, line_dedup, target_encoding

    return {"op2_decontamination": decontamination.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL, "op13_target_encoding": target_encoding.ORACLE_SQL}
