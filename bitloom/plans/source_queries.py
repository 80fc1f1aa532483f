"""Demo queries of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import quality as Q
from bitloom.plans.quality_queries import q5
from bitloom.plans.registry import query
from bitloom.sources import corpus as C
from bitloom.sources.shared import shared_dir
from bitloom.sources.tables import table


@query("s1_binary_scan")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """The tables' own files: name, length and magic; a path that is not there reads as length -1."""
    files = C.scan(spark, d, "*.parquet", head=4)
    wanted = files.select("path").union(spark.range(1).select(F.lit("nowhere.parquet")))
    found = C.with_missing(wanted, files)
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.decode(F.substring("head", 1, 4), "UTF-8").alias("magic"))


@query("q11_file_existence", "SELECT 'B110' AS code, 'error' AS severity, '/' || n_nationkey || '/path' AS pointer, n_nationkey AS entry, '' AS entry_name, 'missing' AS message, 'ghost.parquet' AS detail FROM nation WHERE n_nationkey % 4 = 2")
def q11(spark: SparkSession, d: str) -> DataFrame:
    files = C.scan(spark, d, "*.parquet", head=0).select(F.regexp_extract("path", r"([^/]+\.parquet)(/[^/]*)?$", 1).alias("path"), "length").dropDuplicates(["path"])
    named = table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*[F.lit(f"{t}.parquet") for t in ("region", "nation", "ghost", "orders")]), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("path"))
    return Q.files(named, "B110", "n_nationkey", "path", files)


@query("s2_tolerant_catalog", """SELECT user_id, fatal, ord, entry FROM (SELECT user_id, CASE user_id % 6 WHEN 1 THEN 'F001' WHEN 2 THEN 'F002' WHEN 3 THEN 'F003' WHEN 4 THEN 'F004' END AS fatal,
 CASE WHEN user_id % 6 IN (0, 5) THEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 END AS ord, CASE WHEN user_id % 6 IN (0, 5) AND event_id % 7 <> 0 THEN '{"k":' || (event_id % 100) || '}' END AS entry FROM events)
 WHERE user_id % 6 IN (0, 5) UNION ALL SELECT DISTINCT user_id, CASE user_id % 6 WHEN 1 THEN 'F001' WHEN 2 THEN 'F002' WHEN 3 THEN 'F003' WHEN 4 THEN 'F004' END, NULL, NULL FROM events WHERE user_id % 6 NOT IN (0, 5)""")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """A catalog of each user's events; some users' documents are broken in each of the four ways."""
    e = F.col("event_id")
    item = F.when(e % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"k":'), (e % 100).cast("string"), F.lit("}")))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(e.alias("id"), item.alias("t")))), lambda s: s["t"]), ",")
    docs = table(spark, d, "events").groupBy("user_id").agg(rows.alias("r"))
    u = F.col("user_id") % 6
    text = F.when(u == 1, "{oops").when(u == 2, "[1]").when(u == 3, '{"version": 1}').when(u == 4, '{"entries": {"a": 1}}').otherwise(F.concat(F.lit('{"entries": ['), "r", F.lit("]}")))
    return C.read_catalogs(docs.select("user_id", text.alias("doc")), "user_id", "doc")


@query("s3_tolerant_fields", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, -5 AS absent, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kind FROM events")
def s3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", C.number(F.get_json_object("props", "$.k"), -1).alias("k"), C.number(F.get_json_object("props", "$.absent"), -5).alias("absent"), C.member(F.col("event_type"), ["view", "click"], "other").alias("kind"))


@query("s7_record_window", """WITH r AS (SELECT doc_id, text, unnest(range(1, least(CAST(ceil(greatest(length(text) - 5, 0) / 64.0) AS BIGINT), 1000000))) AS rec FROM documents)
SELECT doc_id, rec, rpad(substr(text, CAST(rec * 64 + 6 AS INTEGER), 64), 64, '0') AS body FROM r""")
def s7(spark: SparkSession, d: str) -> DataFrame:
    return C.records(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 64, 1, 1_000_000, 5)


@query("s8_sparse_records", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ from their defaults, written as JSON and parsed back."""
    j = table(spark, d, "orders").select("o_orderkey", C.sparse({"o_orderstatus": "O", "o_orderpriority": "5-LOW"}).alias("j"))
    return j.select("o_orderkey", F.get_json_object("j", "$.o_orderstatus").alias("o_orderstatus"), F.get_json_object("j", "$.o_orderpriority").alias("o_orderpriority"))


@query("s9_bounded_write_plan", """SELECT p_partkey, length(p_name) AS n, CASE WHEN length(p_name) > p_size THEN 'reject' WHEN p_partkey % 4 = 0 AND length(p_name) <> p_size THEN 'reject' WHEN p_partkey % 2 = 0 AND length(p_name) < p_size THEN 'pad' WHEN length(p_name) < p_size THEN 'keep tail' ELSE 'fit' END AS plan FROM part""")
def s9(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.length("p_name").alias("n"), C.write_plan(F.length("p_name"), F.col("p_size"), k % 2 == 0, k % 4 == 0).alias("plan"))


_PLAN = "CASE WHEN n > p_size THEN 'reject' WHEN k % 4 = 0 AND n <> p_size THEN 'reject' WHEN k % 2 = 0 AND n < p_size THEN 'pad' WHEN n < p_size THEN 'keep tail' ELSE 'fit' END"


@query("s9_bounded_write_bytes", f"""SELECT p_partkey, CASE plan WHEN 'fit' THEN h WHEN 'pad' THEN h || repeat('FF', p_size - n) WHEN 'keep tail' THEN h || repeat('2E', p_size - n) END AS bytes
FROM (SELECT *, {_PLAN} AS plan FROM (SELECT p_partkey, p_partkey AS k, p_size, length(p_name) AS n, hex(p_name) AS h FROM part))""")
def s9b(spark: SparkSession, d: str) -> DataFrame:
    """The slots' bytes after the writes; they held dots before."""
    k, size = F.col("p_partkey"), F.col("p_size")
    body = F.encode("p_name", "UTF-8")
    plan = C.write_plan(F.octet_length("p_name"), size, k % 2 == 0, k % 4 == 0)
    return table(spark, d, "part").select("p_partkey", F.hex(C.slot_bytes(body, F.encode(F.repeat(F.lit("."), size), "UTF-8"), plan, size)).alias("bytes"))


@query("s11_findings_sink", "SELECT severity, code, count(*) AS n FROM (SELECT 'warning' AS severity, 'B104' AS code FROM events WHERE event_type NOT IN ('view', 'click', 'signup')) GROUP BY severity, code")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Findings written to the shared folder as JSON and counted as they read back."""
    path = f"{shared_dir(spark)}/findings-{uuid.uuid4().hex}"
    C.write_findings(q5(spark, d), path)
    return spark.read.schema("code string, entry long, severity string").json(path).groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("s11_text_summary", """WITH f AS (SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'signup'))
SELECT 'entries[' || event_id || ']' AS line, count(*) AS n FROM f GROUP BY event_id UNION ALL SELECT '  warning B104 /' || event_id || '/event_type: unknown, reads as view (' || event_type || ')', count(*) FROM f GROUP BY event_id, event_type""")
def s11t(spark: SparkSession, d: str) -> DataFrame:
    """The text report written to the shared folder, its lines as they read back."""
    path = f"{shared_dir(spark)}/summary-{uuid.uuid4().hex}"
    C.write_summary(q5(spark, d), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
