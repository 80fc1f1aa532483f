"""Demo queries of the data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import quality as Q
from bitloom.operators.intervals import overlaps
from bitloom.operators.scan import ranges_of
from bitloom.plans.registry import query
from bitloom.sources.tables import SPANS_SQL, spans, table


def _sql(code: str, severity: str, entry: str, message: str, body: str, field: str = "", detail: str = "''", raw: bool = False) -> str:
    q = lambda s: s if raw else f"'{s}'"
    return f"SELECT '{code}' AS code, {q(severity)} AS severity, '/' || {entry} || '{'/' + field if field else ''}' AS pointer, {entry} AS entry, '' AS entry_name, {q(message)} AS message, CAST({detail} AS VARCHAR) AS detail {body}"


_Q2 = _sql("B101", "warning", "event_id", "unknown key", "FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) WHERE key NOT IN ('id')", detail="key")


@query("q2_unknown_keys", _Q2)
def q2(spark: SparkSession, d: str) -> DataFrame:
    return Q.unknown_keys(table(spark, d, "events"), "B101", "event_id", "props", ["id"])


_Q3 = f"""{_sql("B102", "error", "doc_id", "missing", "FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'de' AND quality IS NULL", "quality")}
UNION ALL {_sql("B102", "warning", "doc_id", "never read", "FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'es' AND toxic IS NOT NULL", "toxic")}"""


@query("q3_required_and_forbidden", _Q3)
def q3(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return Q.required(both, "B102", "doc_id", "lang", {"de": (["quality"], []), "es": ([], ["toxic"])})


_PK = "l_orderkey * 10 + l_linenumber"
_Q4 = f"""{_sql("B103", "error", "k", "too large", f"FROM (SELECT {_PK} AS k, * FROM lineitem) WHERE l_quantity > 45", "l_quantity", "NULL").replace("CAST(NULL AS VARCHAR)", "''")}
UNION ALL {_sql("B103", "error", "k", "too small", f"FROM (SELECT {_PK} AS k, * FROM lineitem) WHERE l_discount < 0.01", "l_discount", "NULL").replace("CAST(NULL AS VARCHAR)", "''")}"""


@query("q4_type_and_range", _Q4)
def q4(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    # numbers print differently in the two engines, so the detail is left out of the comparison
    return Q.ranges(li, "B103", "k", {"l_quantity": (0, 45), "l_discount": (0.01, 1)}).withColumn("detail", F.lit(""))


_Q5 = _sql("B104", "warning", "event_id", "unknown, reads as view", "FROM events WHERE event_type NOT IN ('view', 'click', 'signup')", "event_type", "event_type")


@query("q5_enumeration", _Q5)
def q5(spark: SparkSession, d: str) -> DataFrame:
    return Q.enumeration(table(spark, d, "events"), "B104", "event_id", "event_type", ["view", "click", "signup"], "view")


_Q6 = f"""WITH own AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_size < 20 AND p_partkey % 3 = 0 AND ascii(right(p_brand, 1)) % 2 = 0), other AS (SELECT DISTINCT p_brand AS id FROM part WHERE ascii(right(p_brand, 1)) % 3 = 0)
{_sql("B105", "CASE WHEN o.id IS NOT NULL OR true THEN 'error' END", "p_partkey", "CASE WHEN o.id IS NOT NULL THEN 'belongs to stage reshape' ELSE 'unknown id' END", "FROM part LEFT JOIN other o ON o.id = p_brand WHERE p_brand NOT IN (SELECT id FROM own)", "p_brand", "p_brand", raw=True)}"""


@query("q6_registry_membership", _Q6)
def q6(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    last = F.ascii(F.substring("p_brand", -1, 1))
    own = p.where((F.col("p_size") < 20) & (F.col("p_partkey") % 3 == 0) & (last % 2 == 0)).select(F.lit("codec").alias("stage"), F.col("p_brand").alias("id")).distinct()
    other = p.where(last % 3 == 0).select(F.lit("reshape").alias("stage"), F.col("p_brand").alias("id")).distinct()
    renamed = spark.createDataFrame([], "old string, new string")
    return Q.membership(p, "B105", "p_partkey", "p_brand", "codec", own.unionByName(other), renamed)


_Q7 = _sql("B106", "error", "o_orderkey", "CASE WHEN c_custkey IS NULL THEN 'no parent' ELSE 'parent is of the wrong kind' END", "FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 20 = 0 WHERE o_custkey % 10 = 0", "o_custkey", "o_custkey", raw=True).replace(", error AS severity", ", 'error' AS severity")


@query("q7_orphans", _Q7)
def q7(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return Q.orphans(table(spark, d, "orders"), "B106", "o_orderkey", "o_custkey", c.where("c_custkey % 10 <> 0"), "c_custkey", c.where("c_custkey % 20 = 0"))


_Q8 = _sql("B107", "error", "k", "parent comes after", f"FROM (SELECT {_PK} AS k, * FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate", "l_orderkey", "l_orderkey")


@query("q8_parent_precedes_child", _Q8)
def q8(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return Q.precedes(li, "B107", "k", "l_orderkey", F.col("l_shipdate"), table(spark, d, "orders"), "o_orderkey", "o_orderdate")


_Q9 = f"""WITH a AS (SELECT l_orderkey, list(DISTINCT l_partkey % 50 ORDER BY l_partkey % 50) AS items FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey),
b AS (SELECT l_orderkey, list(DISTINCT l_partkey % 50 ORDER BY l_partkey % 50) AS items FROM lineitem WHERE l_linenumber > 3 GROUP BY l_orderkey)
{_sql("B108", "error", "a.l_orderkey", "lists differ", "FROM a JOIN b ON a.l_orderkey = b.l_orderkey WHERE a.items <> b.items")}"""


@query("q9_lists_agree", _Q9)
def q9(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # the tasks are as many as the rows need; both lists are made, and meet, where their rows lie
    li = li.repartition(ranges_of(li), "l_orderkey")
    group = lambda cond: li.where(cond).groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 50)).alias("items"))
    return Q.same_lists(group("l_linenumber <= 3"), group("l_linenumber > 3").withColumn("entry_key", F.col("l_orderkey")), "B108", "l_orderkey", "entry_key")


_V = "(event_id * 7) % 130 - 2"
_Q10 = f"""{_sql("B109", f"CASE WHEN v = -1 THEN 'warning' ELSE 'error' END", "event_id", "m", f"FROM (SELECT *, CASE WHEN v = -1 THEN 'not set' WHEN v < 0 OR v >= 120 THEN 'out of range' WHEN v = event_id THEN 'refers to itself' WHEN v % 10 = 0 THEN 'target kind not allowed' END AS m FROM (SELECT event_id, {_V} AS v FROM events)) WHERE m IS NOT NULL", "v", "v", raw=True)}"""


@query("q10_index_bounds", _Q10)
def q10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") * 7) % 130 - 2).alias("v"))
    return Q.index_bounds(e, "B109", "event_id", "v", 120, table(spark, d, "customer").where("c_custkey % 10 = 0"), "c_custkey")


_Q12 = _sql("B111", "error", "doc_id", "CASE WHEN o >= n_chars THEN 'begins past the end' ELSE 'ends past the end' END", "FROM (SELECT doc_id, n_chars, (doc_id * 97) % 3000 AS o FROM documents) WHERE o >= n_chars OR o + 500 > n_chars", "offset", "o", raw=True).replace(", error AS severity", ", 'error' AS severity")


@query("q12_range_inside_container", _Q12)
def q12(spark: SparkSession, d: str) -> DataFrame:
    return Q.inside(table(spark, d, "documents"), "B111", "doc_id", (F.col("doc_id") * 97) % 3000, F.lit(500), F.col("n_chars"))


_Q13 = f"""WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS f FROM documents)
{_sql("B112", "warning", "doc_id", "same as an earlier entry", "FROM f WHERE doc_id <> f", detail="f")}"""


@query("q13_duplicate_owner", _Q13)
def q13(spark: SparkSession, d: str) -> DataFrame:
    return Q.duplicates(table(spark, d, "documents"), "B112", "doc_id", F.md5("text"))


_PAIRS = f"(SELECT ({_PK}) * 10000 + l_partkey % 10000 AS k, l_suppkey AS g, CASE WHEN l_suppkey % 9 = 0 AND l_linenumber = 7 THEN NULL ELSE l_orderkey % 50 END AS s, l_partkey % 50 AS t, l_partkey % 9 AS f FROM lineitem)"
_Q14 = f"""WITH p AS (SELECT *, bool_or(s IS NULL) OVER (PARTITION BY g) AS fatal, row_number() OVER (PARTITION BY g, s ORDER BY k) AS rs, row_number() OVER (PARTITION BY g, t ORDER BY k) AS rt FROM {_PAIRS}),
m AS (SELECT *, CASE WHEN fatal THEN 'list rejected' WHEN rs > 1 THEN 'slot mapped twice' WHEN rt > 1 THEN 'two slots to one target' WHEN f > 7 THEN 'flags out of range' END AS m FROM p)
{_sql("B113", "'error'", "k", "m", "FROM m WHERE m IS NOT NULL", detail="CASE WHEN s IS NULL THEN CAST(t AS VARCHAR) ELSE s || '->' || t END", raw=True)}"""


@query("q14_permutation_validity", _Q14)
def q14(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000 + F.col("l_partkey") % 10000
    s = F.when((F.col("l_suppkey") % 9 == 0) & (F.col("l_linenumber") == 7), None).otherwise(F.col("l_orderkey") % 50)
    pairs = li.select(k.alias("k"), F.col("l_suppkey").alias("g"), s.alias("s"), (F.col("l_partkey") % 50).alias("t"), (F.col("l_partkey") % 9).alias("f"))
    return Q.permutation(pairs, "B113", "k", "g", "s", "t", "f")


_Q15 = f"""WITH {SPANS_SQL}, n AS (SELECT *, "start" - 60 AS s, "end" - 60 AS e FROM spans), o AS (SELECT *, lead(s) OVER (PARTITION BY set_id ORDER BY s, e, "row") AS nx FROM n)
SELECT code, count(*) AS n, min(set_id) AS first_set FROM (SELECT set_id, CASE WHEN s < 0 THEN 'negative start' WHEN e <= s THEN 'empty' WHEN "row" > 6 THEN 'row too large' WHEN nx < e THEN 'overlap' END AS code FROM o) WHERE code IS NOT NULL GROUP BY code"""


@query("q15_interval_validity", _Q15)
def q15(spark: SparkSession, d: str) -> DataFrame:
    """Faults of spans moved down by 60: counts and the first set of each."""
    s = spans(spark, d).withColumn("start", F.col("start") - 60).withColumn("end", F.col("end") - 60)
    row = F.when(F.col("start") < 0, "negative start").when(F.col("end") <= F.col("start"), "empty").when(F.col("row") > 6, "row too large")
    crossing = overlaps(s, ["set_id"], ["start", "end", "row"]).where(row.isNull()).select("set_id", F.lit("overlap").alias("code"))
    own = s.select("set_id", row.alias("code")).where("code is not null")
    return own.unionByName(crossing).groupBy("code").agg(F.count("*").alias("n"), F.min("set_id").alias("first_set"))


_Q16 = _sql("B115", "CASE WHEN event_type = 'purchase' THEN 'error' ELSE 'warning' END", "event_id", "CASE WHEN event_type = 'purchase' THEN 'value is missing' ELSE 'value is never read' END", "FROM events WHERE (event_type = 'purchase') <> (value > 5)", raw=True)


@query("q16_mode_and_block", _Q16)
def q16(spark: SparkSession, d: str) -> DataFrame:
    return Q.agreement(table(spark, d, "events"), "B115", "event_id", F.col("event_type") == "purchase", F.col("value") > 5, "value")
