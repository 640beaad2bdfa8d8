"""Registered queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperline.llm import ann, bilinear, chat, decontam, idfiles, langid, mixing, negatives, ngram_join, runs, suffix_dedup, tokens, warc
from copperline.llm.common import read_table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents"), words=3, percent=90)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(read_table(spark, sf_dir, "pages"))
    return warc.read_manifest(manifest, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.read_ids(idfiles.write_ids(read_table(spark, sf_dir, "documents"), tokenizer_file()))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score_texts(read_table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id AS string) AS binary)) % 7 <> 2")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read_table(spark, sf_dir, "documents"), rewrite=True)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table.withColumn("label", label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_warc": op2_warc,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_token_counts": op5_token_counts,
        "op6_decontamination": op6_decontamination,
        "op7_token_files": op7_token_files,
        "op8_language_id": op8_language_id,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_mixing": op10_mixing,
        "op11_lm_scoring": op11_lm_scoring,
        "op12_runs": op12_runs,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": ngram_join.ORACLE, "op2_warc": warc.ORACLE, "op3_suffix_dedup": suffix_dedup.ORACLE, "op6_decontamination": decontam.ORACLE, "op12_runs": runs.ORACLE, "op13_hard_negatives": negatives.ORACLE}
