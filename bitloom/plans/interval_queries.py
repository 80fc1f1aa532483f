"""Demo queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import intervals as I
from bitloom.plans.registry import query
from bitloom.sources.tables import SPANS_SQL, WRITES_SQL, span_writes, spans, table

MERGED = """merged AS (
  SELECT set_id, min("start") AS "start", max("end") AS "end", count(*) AS n FROM (
    SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY set_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, max("end") OVER (PARTITION BY set_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM spans WHERE "end" > "start")) GROUP BY set_id, island)"""
#: Earlier start wins, then equal neighbours fuse.
NORMAL = """moved AS (
  SELECT * FROM (SELECT set_id, greatest("start", coalesce(max("end") OVER (PARTITION BY set_id ORDER BY "start", "end", "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "start")) AS "start", "end", "row"
    FROM spans WHERE "end" > "start") WHERE "end" > "start"),
normal AS (
  SELECT set_id, min("start") AS "start", max("end") AS "end", min("row") AS "row" FROM (
    SELECT *, sum(f) OVER (PARTITION BY set_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN lag("end") OVER w = "start" AND lag("row") OVER w = "row" THEN 0 ELSE 1 END AS f FROM moved WINDOW w AS (PARTITION BY set_id ORDER BY "start")))
  GROUP BY set_id, island)"""


@query("w1_merge_intervals", f'WITH {SPANS_SQL}, {MERGED} SELECT set_id, "start", "end", n, "end" - "start" AS covered FROM merged')
def w1(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_spans(spans(spark, d), ["set_id"]).withColumn("covered", F.col("end") - F.col("start"))


@query("w2_normalize_intervals", f'WITH {SPANS_SQL}, {NORMAL} SELECT set_id, "start", "end", "row" FROM normal')
def w2(spark: SparkSession, d: str) -> DataFrame:
    return I.normalize_spans(spans(spark, d), ["set_id"])


@query(
    "w3_coalesce_neighbours",
    """WITH q AS (SELECT o_custkey AS set_id, o_orderkey AS "start", lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS "end", o_orderstatus AS status FROM orders),
f AS (SELECT *, CASE WHEN lag("end") OVER w = "start" AND lag(status) OVER w = status THEN 0 ELSE 1 END AS f FROM q WHERE "end" IS NOT NULL WINDOW w AS (PARTITION BY set_id ORDER BY "start")),
i AS (SELECT *, sum(f) OVER (PARTITION BY set_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT set_id, min("start") AS "start", max("end") AS "end", min(status) AS status FROM i GROUP BY set_id, island""",
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    parts = table(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("start"), F.lead("o_orderkey").over(w).alias("end"), F.col("o_orderstatus").alias("status"))
    return I.coalesce_spans(parts.where("end is not null"), ["set_id"], "status")


def _flagged(spark: SparkSession, d: str, flag: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    start = F.col("l_orderkey") * 3
    return li.select(F.col("l_suppkey").alias("set_id"), start.alias("start"), (start + F.floor("l_quantity")).alias("end"))


def _flag_sql(flag: str, name: str) -> str:
    return f"""{name} AS (SELECT l_suppkey AS set_id, l_orderkey * 3 AS s, l_orderkey * 3 + CAST(floor(l_quantity) AS BIGINT) AS e FROM lineitem WHERE l_returnflag = '{flag}')"""


@query(
    "w4_subtract_intervals",
    f"""WITH {_flag_sql("A", "a")}, {_flag_sql("R", "b")},
ev AS (SELECT set_id, s AS pt, 1 AS da, 0 AS db FROM a WHERE e > s UNION ALL SELECT set_id, e, -1, 0 FROM a WHERE e > s UNION ALL SELECT set_id, s, 0, 1 FROM b WHERE e > s UNION ALL SELECT set_id, e, 0, -1 FROM b WHERE e > s),
g AS (SELECT set_id, pt, sum(da) AS da, sum(db) AS db FROM ev GROUP BY set_id, pt),
r AS (SELECT set_id, pt AS s, lead(pt) OVER w AS e, sum(da) OVER (PARTITION BY set_id ORDER BY pt ROWS UNBOUNDED PRECEDING) AS na, sum(db) OVER (PARTITION BY set_id ORDER BY pt ROWS UNBOUNDED PRECEDING) AS nb FROM g WINDOW w AS (PARTITION BY set_id ORDER BY pt)),
k AS (SELECT set_id, s, e, CASE WHEN lag(e) OVER (PARTITION BY set_id ORDER BY s) = s THEN 0 ELSE 1 END AS f FROM r WHERE na > 0 AND nb = 0 AND e IS NOT NULL),
i AS (SELECT *, sum(f) OVER (PARTITION BY set_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM k)
SELECT set_id, min(s) AS "start", max(e) AS "end" FROM i GROUP BY set_id, island""",
)
def w4(spark: SparkSession, d: str) -> DataFrame:
    return I.subtract_spans(_flagged(spark, d, "A"), _flagged(spark, d, "R"), ["set_id"])


@query(
    "w5_overwrite_intervals",
    f"""WITH {WRITES_SQL}, live AS (SELECT * FROM writes WHERE "end" > "start"),
pts AS (SELECT set_id, "start" AS pt FROM live UNION SELECT set_id, "end" FROM live),
seg AS (SELECT set_id, pt AS s, lead(pt) OVER (PARTITION BY set_id ORDER BY pt) AS e FROM pts),
v AS (SELECT seg.set_id, s, e, arg_max(live."row", live.seq) AS r FROM seg JOIN live ON seg.set_id = live.set_id AND live."start" <= s AND live."end" > s WHERE e IS NOT NULL GROUP BY seg.set_id, s, e),
k AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(r) OVER w = r THEN 0 ELSE 1 END AS f FROM v WINDOW w AS (PARTITION BY set_id ORDER BY s)),
i AS (SELECT *, sum(f) OVER (PARTITION BY set_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM k)
SELECT set_id, min(s) AS "start", max(e) AS "end", min(r) AS "row" FROM i GROUP BY set_id, island""",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    return I.overwrite_spans(span_writes(spark, d), ["set_id"])


@query(
    "w6_neighbour_overlaps",
    f"""WITH {SPANS_SQL}, n AS (SELECT *, lead("start") OVER w AS next_start, lead("end") OVER w AS next_end FROM spans WINDOW w AS (PARTITION BY set_id ORDER BY "start", "end", "row"))
SELECT set_id, "start", "end", "row", next_start, next_end FROM n WHERE next_start < "end" """,
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    return I.overlaps(spans(spark, d), ["set_id"], ["start", "end", "row"])


@query(
    "w7_gap_runs",
    """WITH ids AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem),
f AS (SELECT *, CASE WHEN l_orderkey - lag(l_orderkey) OVER w <= 9 THEN 0 ELSE 1 END AS f FROM ids WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey)),
i AS (SELECT *, sum(f) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT l_suppkey, min(l_orderkey) AS "first", max(l_orderkey) - min(l_orderkey) + 1 AS "count" FROM i GROUP BY l_suppkey, island""",
)
def w7(spark: SparkSession, d: str) -> DataFrame:
    return I.gap_runs(table(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey", 8)


@query(
    "p6_clip_to_bounds",
    f"""WITH {SPANS_SQL}, {NORMAL}, c AS (SELECT set_id, "start", least("end", 3000) AS "end", "row" FROM normal WHERE "start" < 3000 AND "row" <= 5),
k AS (SELECT *, CASE WHEN lag("end") OVER w = "start" AND lag("row") OVER w = "row" THEN 0 ELSE 1 END AS f FROM c WINDOW w AS (PARTITION BY set_id ORDER BY "start")),
i AS (SELECT *, sum(f) OVER (PARTITION BY set_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS island FROM k)
SELECT set_id, min("start") AS "start", max("end") AS "end", min("row") AS "row" FROM i GROUP BY set_id, island""",
)
def p6(spark: SparkSession, d: str) -> DataFrame:
    return I.clip_spans(I.normalize_spans(spans(spark, d), ["set_id"]), ["set_id"], 3000, 5)


@query(
    "j5_point_in_interval",
    f"""WITH {SPANS_SQL}, {NORMAL}, pts AS (SELECT o_orderkey, o_orderkey * 3 AS pt, o_custkey % 10 AS set_id FROM orders)
SELECT o_orderkey, pts.set_id, pt, coalesce("row", -1) AS "row" FROM pts LEFT JOIN normal ON pts.set_id = normal.set_id AND pt >= "start" AND pt < "end" """,
)
def j5(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("set_id"), (F.col("o_orderkey") * 3).alias("pt"))
    return I.value_at(points, I.normalize_spans(spans(spark, d), ["set_id"]), ["set_id"], "pt", default=-1)


_LAID = """laid AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "start" FROM documents)"""


@query("s6_multi_part_spans", f'WITH {_LAID} SELECT source, doc_id, n_chars, CAST("start" AS BIGINT) AS "start" FROM laid')
def s6(spark: SparkSession, d: str) -> DataFrame:
    return I.assembled(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars")


@query(
    "j6_owner_of_position",
    f"""WITH {_LAID}, pts AS (SELECT o_orderkey, 'src' || CAST(o_custkey % 12 AS VARCHAR) AS source, (o_orderkey * 37) % 60000 AS pos FROM orders)
SELECT o_orderkey, pts.source, pos, doc_id AS owner, CAST(pos - "start" AS BIGINT) AS local FROM pts LEFT JOIN laid ON pts.source = laid.source AND pos >= "start" AND pos < "start" + n_chars""",
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    laid = s6(spark, d).where("n_chars > 0")
    regions = laid.select("source", "start", (F.col("start") + F.col("n_chars")).alias("end"), F.struct("doc_id", "start").alias("piece"))
    points = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("src"), (F.col("o_custkey") % 12).cast("string")).alias("source"), ((F.col("o_orderkey") * 37) % 60000).alias("pos"))
    return I.value_at(points, regions, ["source"], "pos", "piece").select("o_orderkey", "source", "pos", F.col("piece.doc_id").alias("owner"), (F.col("pos") - F.col("piece.start")).alias("local"))


@query(
    "w16_piece_layout",
    """WITH p AS (SELECT source, doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS n, CASE WHEN doc_id % 3 = 0 THEN 500 WHEN doc_id % 11 = 0 THEN 64 END AS stated FROM documents),
x AS (SELECT *, CAST(coalesce(stated, ceil(n / 32.0) * 32, 0) AS BIGINT) AS extent, CASE WHEN n IS NULL THEN 'missing' WHEN stated > n THEN 'short' ELSE '' END AS problem FROM p)
SELECT source, doc_id, extent, problem, CAST(coalesce(sum(extent) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM x""",
)
def w16(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pieces = table(spark, d, "documents").select("source", "doc_id", F.when(i % 11 != 0, F.col("n_chars")).alias("n"), F.when(i % 3 == 0, 500).when(i % 11 == 0, 64).alias("stated"))
    return I.laid_out(pieces, ["source"], "doc_id", "stated", "n", 32).select("source", "doc_id", "extent", "problem", "start")
