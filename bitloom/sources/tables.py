"""Reading of the demo tables and the inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, start, end, row): one half-open span for each lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 3
    return li.select(F.col("l_suppkey").alias("set_id"), start.alias("start"), (start + F.floor("l_quantity")).alias("end"), F.col("l_linenumber").alias("row"))


SPANS_SQL = 'spans AS (SELECT l_suppkey AS set_id, l_orderkey * 3 AS "start", l_orderkey * 3 + CAST(floor(l_quantity) AS BIGINT) AS "end", l_linenumber AS "row" FROM lineitem)'


def span_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans with seq, a total order of writes within each set."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 3
    return li.select(
        F.col("l_suppkey").alias("set_id"), start.alias("start"), (start + F.floor("l_quantity")).alias("end"), F.col("l_linenumber").alias("row"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.pmod(F.col("l_partkey"), F.lit(100))).alias("seq"),
    ).groupBy("set_id", "seq").agg(F.max_by(F.struct("start", "end", "row"), F.struct("end", "row")).alias("w")).select("set_id", "seq", "w.*")


WRITES_SQL = """writes AS (
  SELECT set_id, seq, w."start" AS "start", w."end" AS "end", w."row" AS "row" FROM (
    SELECT set_id, seq, arg_max({'start': "start", 'end': "end", 'row': "row"}, {'e': "end", 'r': "row"}) AS w FROM (
      SELECT l_suppkey AS set_id, l_orderkey * 3 AS "start", l_orderkey * 3 + CAST(floor(l_quantity) AS BIGINT) AS "end", l_linenumber AS "row",
             l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS seq FROM lineitem) GROUP BY set_id, seq))"""


def grid(spark: SparkSession, sf_dir: str, columns: int = 40, values: int = 3) -> DataFrame:
    """(pos, x, y, v): orders laid out in rows of `columns`."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % columns).alias("x"), F.floor(F.col("o_orderkey") / columns).alias("y"), (F.col("o_custkey") % values).alias("v"), "o_orderstatus")


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, argb): a colour for each lineitem row."""
    argb = F.when(F.col("l_partkey") % 17 == 0, F.lit(0)).otherwise(F.lit(4278190080)) + (F.col("l_partkey") * 7919) % 16777216
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", argb.alias("argb"))


COLORS_SQL = "colors AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 17 = 0 THEN 0 ELSE 4278190080 END + (l_partkey * 7919) % 16777216 AS argb FROM lineitem)"

#: Sixteen colours, entry 0 transparent: the demo palette.
PALETTE = [0, *(4278190080 + (i * 1118481 + i * i * 70003) % 16777216 for i in range(1, 16))]
PALETTE_SQL = "palette(idx, color) AS (VALUES " + ", ".join(f"({i}, {c})" for i, c in enumerate(PALETTE)) + ")"


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PALETTE)), "idx int, color long")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(box, x, y, w, h, brand): a rectangle for each part."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("box"), (F.col("p_partkey") % 200 - 20).alias("x"), ((F.col("p_partkey") * 13) % 150).alias("y"),
        (F.col("p_size") % 8 + 1).alias("w"), (F.col("p_size") % 5 + 1).alias("h"), F.col("p_brand").alias("brand"),
    )


BOXES_SQL = "boxes AS (SELECT p_partkey AS box, p_partkey % 200 - 20 AS x, (p_partkey * 13) % 150 AS y, p_size % 8 + 1 AS w, p_size % 5 + 1 AS h, p_brand AS brand FROM part)"
