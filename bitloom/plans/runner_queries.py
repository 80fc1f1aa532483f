"""The rule runner over all data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import quality as Q
from bitloom.plans import quality_queries, source_queries  # noqa: F401
from bitloom.plans.quality_queries import _sql
from bitloom.plans.registry import ORACLE_SQL, QUERIES, query
from bitloom.sources.tables import SPANS_SQL, spans, table

#: Eight passes in their order.
PASSES = [
    ["q2_unknown_keys", "q3_required_and_forbidden"], ["q4_type_and_range", "q5_enumeration"], ["q6_registry_membership"],
    ["q7_orphans", "q8_parent_precedes_child", "q9_lists_agree", "q10_index_bounds"], ["q11_file_existence"],
    ["q12_range_inside_container", "q13_duplicate_owner"], ["q14_permutation_validity"], ["q16_mode_and_block"],
]
_COLUMNS = ", ".join(Q.COLUMNS)
#: Interval validity as findings, a pass-7 rule of its own.
_EMPTY = f"WITH {SPANS_SQL} " + _sql("B114", "error", "set_id", "empty", 'FROM spans WHERE "end" <= "start" + 3')
_EVERY = " UNION ALL ".join([f"SELECT 7 AS pass, {_COLUMNS} FROM ({_EMPTY})"] + [f"SELECT {i} AS pass, {_COLUMNS} FROM ({ORACLE_SQL[q]})" for i, names in enumerate(PASSES, 1) for q in names])
_FATAL = _sql("F001", "error", "n_nationkey", "not readable", "FROM nation WHERE n_nationkey % 10 = 3")


@query(
    "q1_rule_runner",
    f"""SELECT pass, code, severity, count(*) AS n, min(entry) AS first, max(entry) AS last FROM (SELECT 0 AS pass, {_COLUMNS} FROM ({_FATAL})
UNION ALL SELECT * FROM ({_EVERY}) WHERE entry % 40 NOT IN (SELECT n_nationkey % 40 FROM nation WHERE n_nationkey % 10 = 3)) GROUP BY pass, code, severity""",
)
def q1(spark: SparkSession, d: str) -> DataFrame:
    """Forty files, dealt by entry; those of three nations cannot be read, so no other pass tells of them."""
    unread = Q.rule(table(spark, d, "nation"), "F001", "error", F.col("n_nationkey") % 10 == 3, "n_nationkey", "not readable")
    empty = Q.rule(spans(spark, d), "B114", "error", F.col("end") <= F.col("start") + 3, "set_id", "empty")
    passes = [[QUERIES[q](spark, d) for q in names] for names in PASSES]
    passes[6].append(empty)
    every = Q.run(passes, unread, F.col("entry") % 40)
    return every.groupBy("pass", "code", "severity").agg(F.count("*").alias("n"), F.min("entry").alias("first"), F.max("entry").alias("last"))
