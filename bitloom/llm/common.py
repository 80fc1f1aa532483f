"""Shared helpers: table access, shared-folder tables, bounded labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bitloom.sources.shared import discard, shared_dir, stored

__all__ = ["crc_mod", "discard", "labelled_sample", "shared_dir", "stored", "table", "with_field"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_rows: int, max_bytes: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, y, extra): labelled training rows outside the held-out fold, about max_rows of them at most.

    With max_bytes their texts take about so many bytes at most, a text longer than a 32nd of
    that is not drawn, and an id gives one row, its greatest (text, extra). Bounds are kept by a hash
    threshold on the id, so the sample does not depend on the partitioning and no sort or global
    limit is needed. Both classes are drawn alike, but of a class that would get less than a 20th of
    the bounds as much as that is drawn, if it has it: a rare class is not lost, and past that point
    scores answer to the sample's rate of it. Labels that are null, and ids that are null, are left
    out; an id labelled twice takes the larger label.
    """
    marked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    rows = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    n = sum(rows.values())
    # the marked side is bounded by max_rows rows of 12 bytes; past 10 MB Spark is left to choose
    small = lambda m, most: F.broadcast(m) if most * 12 < 10_000_000 else m
    share = min(1.0, max_rows / max(n, 1))
    floor = {y: max_rows / 20 / k for y, k in rows.items()}
    texts = docs.select("doc_id", "text", *extra)
    if max_bytes is not None:
        texts = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes // 32)
        once = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")).join(small(marked, n), "doc_id").groupBy("doc_id", "y").agg(F.max("b").alias("b"))
        size = {r["y"]: max(r["b"], 1) for r in once.groupBy("y").agg(F.sum("b").alias("b")).collect()}
        share = min(share, max_bytes / max(sum(size.values()), 1))
        floor = {y: min(f, max_bytes / 20 / size.get(y, 1)) for y, f in floor.items()}
    most = n
    if share < 1:
        span = 1 << 30
        drawn = {y: min(1.0, max(share, f)) for y, f in floor.items()}
        most = int(sum(rows[y] * d for y, d in drawn.items())) + 1
        least = F.element_at(F.create_map(*(F.lit(v) for y, d in drawn.items() for v in (y, int(span * d)))), F.col("y"))
        marked = marked.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(span)) < least)
    found = texts.join(small(marked, most), "doc_id")
    if max_bytes is not None:
        found = found.groupBy("doc_id", "y").agg(F.max(F.struct("text", *extra)).alias("r")).select("doc_id", "r.*", "y")
    return found.select("doc_id", "text", "y", *extra)


def with_field(df: DataFrame, name: str, kind: str) -> StructType:
    """df's schema and one more field."""
    return StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])
