"""Demo queries of layouts and expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import layout as L
from bitloom.operators import refs
from bitloom.operators.stamps import expand_stamps
from bitloom.plans.registry import query
from bitloom.sources.tables import grid, table

_PRESETS = {"rows2x2": L.Blocks(16, 2, 2), "columns4x2": L.Blocks(16, 4, 2, L.COLUMNS_FIRST), "interleave4x4": L.Blocks(16, 4, 4, L.ROW_INTERLEAVE), "wide": L.Blocks(16, 32, 2)}


@query(
    "f11_block_layout",
    """WITH s AS (SELECT o_orderkey AS slot FROM orders), p AS (
SELECT slot, 'rows2x2' AS preset, slot // 4 % 8 * 2 + slot % 4 % 2 AS x, slot // 4 // 8 * 2 + slot % 4 // 2 AS y FROM s
UNION ALL SELECT slot, 'columns4x2', slot // 8 % 4 * 4 + slot % 8 // 2, slot // 8 // 4 * 2 + slot % 8 % 2 FROM s
UNION ALL SELECT slot, 'interleave4x4', slot // 16 % 4 * 4 + slot % 16 % 4, slot // 16 // 4 * 4 + CASE WHEN slot % 16 // 4 < 2 THEN slot % 16 // 4 * 2 ELSE (slot % 16 // 4 - 2) * 2 + 1 END FROM s
UNION ALL SELECT slot, 'wide', slot % 32 % 16, slot // 32 * 2 + slot % 32 // 16 FROM s)
SELECT slot, preset, x, y, slot AS back FROM p""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    slots = table(spark, d, "orders").select(F.col("o_orderkey").alias("slot"))
    each = []
    for name, b in _PRESETS.items():
        x, y = b.position(F.col("slot"))
        each.append(F.struct(F.lit(name).alias("preset"), x.alias("x"), y.alias("y"), b.slot(x, y).alias("back")))
    return slots.select("slot", F.explode(F.array(*each)).alias("e")).select("slot", "e.*")


@query(
    "f12_page_order",
    "SELECT o_orderkey AS slot, (o_orderkey // 32 % 3 * 8 + o_orderkey % 32 % 8) + 24 * (o_orderkey // 32 // 3 * 4 + o_orderkey % 32 // 8) AS place FROM orders",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    b = L.page_place(F.col("slot"), 8, 4, 9, 3)
    x, y = b.position(F.col("slot"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("slot")).select("slot", (x + b.columns * y).alias("place"))


@query("f13_bitmap_reflow", "SELECT o_orderkey AS pos, o_orderkey // 256 * 256 + o_orderkey % 256 % 32 // 4 * 32 + o_orderkey % 256 // 32 * 4 + o_orderkey % 4 AS place FROM orders")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), L.reflow(F.col("o_orderkey"), 4, 8, 8).alias("place"))


@query(
    "j3_expand_then_join",
    """WITH u AS (SELECT p_partkey AS first, p_size % 2 = 1 AS fh, p_size % 3 = 0 AS fv, unnest(range(0, 4)) AS ord FROM part),
r AS (SELECT first, ord, first + (CASE WHEN fv THEN 1 - ord // 2 ELSE ord // 2 END) * 16 + CASE WHEN fh THEN 1 - ord % 2 ELSE ord % 2 END AS id FROM u)
SELECT first, ord, id, coalesce(p_brand, '') AS brand FROM r LEFT JOIN part ON p_partkey = id""",
)
def j3(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    ids = L.unit_ids(F.col("p_partkey"), 2, 2, 16, 1, F.col("p_size") % 2 == 1, F.col("p_size") % 3 == 0)
    units = p.select(F.col("p_partkey").alias("first"), F.posexplode(ids).alias("ord", "id"))
    return refs.resolve(units, "id", p.select("p_partkey", F.col("p_brand").alias("brand")), "p_partkey", {"brand": F.lit("")}).select("first", "ord", "id", "brand")


_STAMPS = "e AS (SELECT o_orderkey AS entry, o_custkey % 500 AS index FROM orders), n AS (SELECT max(entry) + 1 AS n FROM e)"


@query(
    "j4_stamp_expansion",
    f"""WITH {_STAMPS}, rows AS (SELECT CAST(ceil(n / 7.0) AS BIGINT) AS r FROM n),
p AS (SELECT unnest(range(0, r * 2 * 21)) AS pos FROM rows),
o AS (SELECT pos, pos // 21 // 2 * 7 + pos % 21 // 3 AS origin, pos % 21 % 3 + pos // 21 % 2 * 16 AS off FROM p)
SELECT pos, entry, index + off AS source, coalesce(p_brand, '') AS brand FROM o LEFT JOIN e ON entry = origin LEFT JOIN part ON p_partkey = index + off""",
)
def j4(spark: SparkSession, d: str) -> DataFrame:
    """Dense stamps of 3 x 2 in rows of 7, which do not divide the entries: the last row is filled up with blanks."""
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_custkey") % 500).alias("index"))
    drawn = expand_stamps(entries, "entry", "index", 7, 3, 2, 16, dense=True)
    return _branded(drawn, spark, d)


@query(
    "j4_sparse_stamps",
    f"""WITH {_STAMPS}, o AS (SELECT entry AS pos, (entry // 40 - entry // 40 % 2) * 40 + (entry % 40 - entry % 40 % 3) AS origin, entry % 40 % 3 + entry // 40 % 2 * 16 AS off FROM e)
SELECT pos, e.entry, index + off AS source, coalesce(p_brand, '') AS brand FROM o LEFT JOIN e ON e.entry = origin LEFT JOIN part ON p_partkey = index + off""",
)
def j4s(spark: SparkSession, d: str) -> DataFrame:
    """Sparse stamps of 3 x 2 in rows of 40: a position snaps to its stamp's corner; the last stamp of a row is cut."""
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_custkey") % 500).alias("index"))
    return _branded(expand_stamps(entries, "entry", "index", 40, 3, 2, 16), spark, d)


def _branded(drawn: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return refs.resolve(drawn, "source", table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand")), "p_partkey", {"brand": F.lit("")}).select("pos", "entry", "source", "brand")


@query(
    "w13_settle_to_first",
    """WITH g AS (SELECT o_orderkey AS pos, o_orderkey % 40 AS x, o_orderkey // 40 AS y, o_custkey % 3 AS v FROM orders)
SELECT pos, x, y, v, first_value(v) OVER (PARTITION BY x // 2, y // 2 ORDER BY pos) AS settled, count(*) OVER (PARTITION BY x // 2, y // 2) AS members FROM g""",
)
def w13(spark: SparkSession, d: str) -> DataFrame:
    return L.settle(grid(spark, d).drop("o_orderstatus"), "x", "y", 2, 2, "pos", "v")
