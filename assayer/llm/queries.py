"""One query for each operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.toxicity import ACCEPT, score

    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.line_dedup import dedup_lines

    found = dedup_lines(read(spark, sf_dir, "documents"))
    places = F.array_join(F.transform("removed", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_links", places.alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.fingerprints import edit_likeness

    return edit_likeness(read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.warc import round_trip

    return round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.personal_data import BASE, count_of, personal_data, rendered

    found = personal_data(read(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.concat("base", "added")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.quality import ACCEPT, score

    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.substring_dedup import dedup

    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.decontamination import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.near_dedup import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from assayer.llm import fingerprints, line_dedup, mixing, near_dedup, oracles, substring_dedup, warc

    return {
        "op1_mix_sources": mixing.ORACLE, "op3_line_dedup": oracles.lines_sql(line_dedup.EDITS, line_dedup.EACH), "op5_warc": warc.ORACLE,
        "op4_document_fingerprints": oracles.fingerprints_sql(fingerprints.SHINGLE, fingerprints.BINS, fingerprints.PROBES),
        "op8_substring_dedup": substring_dedup.ORACLE, "op10_simhash_near_dedup": oracles.simhash_sql(near_dedup.SHINGLE, near_dedup.RADIUS),
    }
