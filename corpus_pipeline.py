"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Filtering stages
return the columns of documents, with n_chars following a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import labelled_sample, stored, table
from bitloom.llm.decontaminate import find_leaks
from bitloom.llm.near_dedup import near_duplicates
from bitloom.llm.packing import byte_bpe_file, pack
from bitloom.llm.quality import fit, score
from bitloom.llm.substring_dedup import without_passages


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is at least 0.3."""
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, max_rows=20_000))
    return score(docs, model).where("quality_score >= 0.3").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component; rows without an id stay."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document has."""
    return _measured(without_passages(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a text that was nothing else goes."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    left = found.where((hit == 0) | (hit < F.col("n_words"))).withColumn("text", F.when(hit > 0, F.col("clean_text")).otherwise(F.col("text")))
    return _measured(left.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their token ids."""
    return pack(docs, byte_bpe_file())


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("benchmark decontamination", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
