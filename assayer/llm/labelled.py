"""A bounded sample of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import table


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out remainder, those of the least hash of
    doc_id, written to the shared folder. ``rows`` is the only bound: texts are whole and of any length, and stay with the
    executors. Of rows that share a doc_id the least text counts; a document labelled twice counts under the smaller label."""
    picked = labels.where((F.col(label).isin(0, 1)) & (remainder(F.col("doc_id"), modulus) != held_out))
    picked = picked.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where("text is not null")
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return table(found.select("doc_id", "text", "label"), "labelled")
