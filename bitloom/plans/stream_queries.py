"""Demo queries of the streaming forms; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import refs as R
from bitloom.plans import ref_queries
from bitloom.plans.agg_queries import revisions
from bitloom.plans.registry import ORACLE_SQL, query
from bitloom.streaming import runs as S


@query("r1_incremental_intake", ORACLE_SQL["j7_signature_detection"])
def r1(spark: SparkSession, d: str) -> DataFrame:
    return S.intake(S.file_stream(spark, f"{d}/pages.parquet"), lambda pages: R.detect(pages, ref_queries._SIGNATURES))


@query("r2_dirty_state_stream", ORACLE_SQL["a9_dirty_flags"])
def r2(spark: SparkSession, d: str) -> DataFrame:
    return S.dirty_state(revisions(S.file_stream(spark, f"{d}/events.parquet")), "user_id", "event_id", "action", "rev")


@query("r3_session_runs", """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM i GROUP BY user_id, s""")
def r3(spark: SparkSession, d: str) -> DataFrame:
    runs = S.sessions(S.file_stream(spark, f"{d}/events.parquet"), "user_id", "ts", "6 hours", "1 day")
    return runs.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")
