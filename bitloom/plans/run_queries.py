"""Demo queries of runs and ordered groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import runs as R
from bitloom.plans.registry import query
from bitloom.sources.tables import table

RUNS = """r AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS re FROM events),
runs AS (SELECT user_id, event_type, min(rn) AS first_rn, count(*) AS length FROM r GROUP BY user_id, event_type, rn - re)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return R.runs(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("w8_run_length_encode", f"WITH {RUNS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_rn) - 1 AS run, event_type, length FROM runs")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


@query(
    "w8_run_packets",
    f"""WITH {RUNS}, n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_rn) - 1 AS run, event_type, length FROM runs),
p AS (SELECT *, unnest(range(0, CAST(floor((length - 1) / 2) AS BIGINT) + 1)) AS piece FROM n)
SELECT user_id, run, piece, event_type, least(2, length - piece * 2) AS length, least(2, length - piece * 2) < 2 AS literal FROM p""",
)
def w8p(spark: SparkSession, d: str) -> DataFrame:
    return R.run_packets(_runs(spark, d), ["user_id"], "event_type", 2, 2)


@query("w8_run_length_decode", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type FROM events")
def w8d(spark: SparkSession, d: str) -> DataFrame:
    return R.expand_runs(w8p(spark, d), ["user_id"], "event_type")


@query("a5_run_histogram", f"WITH {RUNS} SELECT event_type, length, count(*) AS n FROM runs GROUP BY event_type, length")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).groupBy("event_type", "length").agg(F.count("*").alias("n"))


@query(
    "w9_row_hidden_runs",
    """WITH h AS (SELECT o_orderkey AS p, o_orderkey // 40 AS y FROM orders WHERE o_orderstatus <> 'O'),
g AS (SELECT *, p - row_number() OVER (PARTITION BY y ORDER BY p) AS g FROM h)
SELECT min(p) % 40 AS x, y, count(*) AS width FROM g GROUP BY y, g""",
)
def w9(spark: SparkSession, d: str) -> DataFrame:
    return R.row_runs(table(spark, d, "orders"), "o_orderkey", 40, F.col("o_orderstatus") != "O")


@query(
    "w10_take_until_terminator",
    """WITH g AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT conv_id, turn, role, min(CASE WHEN turn >= 3 AND role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS e FROM conversations)
SELECT g.conv_id, turn, role FROM g LEFT JOIN (SELECT * FROM s WHERE e IS NULL OR turn < e) s ON g.conv_id = s.conv_id""",
)
def w10(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return R.until_terminator(c, ["conv_id"], "turn", (F.col("turn") >= 3) & (F.col("role") == "user"), c.select("conv_id").distinct())


@query(
    "w11_line_split",
    """WITH l AS (SELECT user_id, event_id, event_type, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM events)
SELECT user_id, CAST(line AS BIGINT) AS line, string_agg(event_type, ' ' ORDER BY event_id) AS body FROM l GROUP BY user_id, line""",
)
def w11(spark: SparkSession, d: str) -> DataFrame:
    lines = R.split_lines(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") == "purchase")
    return R.whole_lines(lines, ["user_id"], "event_id", "event_type")


@query("w12_first_claim", "SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1 AS owner FROM supplier")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return R.claims(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (-F.col("s_acctbal")).alias("b")), ["s_nationkey"], ["b", "s_suppkey"]).drop("b")
