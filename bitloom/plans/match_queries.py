"""Demo queries of matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import match as M
from bitloom.plans.registry import query
from bitloom.sources.tables import BOXES_SQL, COLORS_SQL, PALETTE, PALETTE_SQL, boxes, colors, table

_NEAREST = f"""WITH {COLORS_SQL}, {PALETTE_SQL},
v AS (SELECT DISTINCT argb, (argb >> 16) & 255 AS r, (argb >> 8) & 255 AS g, argb & 255 AS b FROM colors),
c AS (SELECT idx, (color >> 16) & 255 AS r, (color >> 8) & 255 AS g, color & 255 AS b FROM palette WHERE color >> 24 > 0),
dist AS (SELECT argb, idx, ((512 + ((v.r + c.r) >> 1)) * (v.r - c.r) * (v.r - c.r) >> 8) + 4 * (v.g - c.g) * (v.g - c.g) + ((767 - ((v.r + c.r) >> 1)) * (v.b - c.b) * (v.b - c.b) >> 8) AS d FROM v, c),
best AS (SELECT argb, arg_min(idx, d * 100 + idx) AS idx, min(d) AS d FROM dist GROUP BY argb),
m AS (SELECT argb, CASE WHEN argb >> 24 = 0 THEN 0 ELSE idx END AS idx, argb >> 24 = 0 OR d = 0 AS exact FROM best)"""


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return M.nearest(colors(spark, d), "argb", PALETTE)


@query("j8_nearest_candidate", f"{_NEAREST} SELECT l_orderkey, l_linenumber, argb, idx, exact FROM colors JOIN m USING (argb)")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("l_orderkey", "l_linenumber", "argb", "idx", "exact")


@query(
    "j8_many_candidates",
    f"""WITH {COLORS_SQL}, cand AS (SELECT p_partkey AS idx, CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE 4278190080 END + (p_partkey * 104729 + p_size * 65793) % 16777216 AS c FROM part),
q AS (SELECT DISTINCT argb FROM colors), s AS (SELECT idx, (c >> 16) & 255 AS r, (c >> 8) & 255 AS g, c & 255 AS b FROM cand WHERE c >> 24 > 0),
v AS (SELECT argb, (argb >> 16) & 255 AS r, (argb >> 8) & 255 AS g, argb & 255 AS b FROM q WHERE argb >> 24 > 0),
d AS (SELECT argb, idx, ((((v.r + s.r) >> 1) + 512) * (v.r - s.r) * (v.r - s.r) >> 8) + 4 * (v.g - s.g) * (v.g - s.g) + ((767 - ((v.r + s.r) >> 1)) * (v.b - s.b) * (v.b - s.b) >> 8) AS d FROM v, s),
m AS (SELECT argb, arg_min(idx, d * 1000000 + idx) AS idx, min(d) = 0 AS exact FROM d GROUP BY argb)
SELECT l_orderkey, l_linenumber, colors.argb, CAST(coalesce(m.idx, 0) AS INT) AS idx, coalesce(m.exact, true) AS exact FROM colors LEFT JOIN m ON m.argb = colors.argb""",
)
def j8m(spark: SparkSession, d: str) -> DataFrame:
    """As many candidates as there are parts, in a table."""
    k = F.col("p_partkey")
    found = table(spark, d, "part").select(k.alias("idx"), (F.when(k % 37 == 0, F.lit(0)).otherwise(F.lit(4278190080)) + (k * 104729 + F.col("p_size") * 65793) % 16777216).alias("color"))
    return M.nearest_of(colors(spark, d), "argb", found).select("l_orderkey", "l_linenumber", "argb", "idx", "exact")


@query("a1_fidelity_report", f"""{_NEAREST} SELECT count(*) AS n_rows, count(*) FILTER (exact) AS exact_rows, count(DISTINCT argb) AS n_values, count(DISTINCT argb) FILTER (exact) AS exact_values,
 count(DISTINCT argb) - count(DISTINCT argb) FILTER (exact) AS approximated, count(*) = count(*) FILTER (exact) AS lossless FROM colors JOIN m USING (argb)""")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return M.fidelity(_nearest(spark, d), "argb")


_HITS = f"""WITH {BOXES_SQL}, pts AS (SELECT event_id, event_id * 7 % 200 - 20 AS px, event_id * 11 % 150 AS py FROM events),
hit AS (SELECT event_id, px, py, box, x, y, w, h FROM pts JOIN boxes ON px >= x AND px < x + w AND py >= y AND py < y + h)"""


@query("j19_rectangle_hit", f"""{_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (px - x + py - y) % 2 = 0 DESC, box) AS rn, count(*) OVER (PARTITION BY event_id) AS n FROM hit)
SELECT event_id, px, py, box, CASE WHEN box % 2 = 1 THEN w - 1 - (px - x) ELSE px - x END AS dx, py - y AS dy,
 CASE WHEN c BETWEEN 0 AND 4999 THEN c END AS cell FROM (SELECT *, box * 3 - 60 + (CASE WHEN box % 3 = 0 THEN h - 1 - (py - y) ELSE py - y END) * w + (CASE WHEN box % 2 = 1 THEN w - 1 - (px - x) ELSE px - x END) AS c FROM r WHERE rn = 1)""")
def j19(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").select("event_id", (F.col("event_id") * 7 % 200 - 20).alias("px"), (F.col("event_id") * 11 % 150).alias("py"))
    first = M.first_hits(points, boxes(spark, d), "px", "py", (F.col("px") - F.col("x") + F.col("py") - F.col("y")) % 2 == 0, "box")
    inside = F.col("px") - F.col("x")
    down, box = F.col("py") - F.col("y"), F.col("box")
    cell = M.resolved_id(inside, down, F.col("w"), box % 2 == 1, box % 3 == 0, F.col("w"), F.col("h"), box * 3 - 60, 5000)
    return first.select("event_id", "px", "py", "box", F.when(box % 2 == 1, F.col("w") - 1 - inside).otherwise(inside).alias("dx"), down.alias("dy"), cell.alias("cell"))


@query("a3_common_bounds", f"""WITH {BOXES_SQL} SELECT brand, CAST(floor(min(x) / 8.0) * 8 AS BIGINT) AS "left", CAST(floor(min(y) / 8.0) * 8 AS BIGINT) AS top,
 CAST(ceil(max(x + w) / 8.0) * 8 - floor(min(x) / 8.0) * 8 AS BIGINT) AS width, CAST(ceil(max(y + h) / 8.0) * 8 - floor(min(y) / 8.0) * 8 AS BIGINT) AS height FROM boxes GROUP BY brand""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return M.common_bounds(boxes(spark, d), ["brand"], 8)
