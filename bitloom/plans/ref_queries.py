"""Demo queries of references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import refs as R
from bitloom.plans.registry import query
from bitloom.sources.tables import PALETTE_SQL, palette, table


@query("j1_reference_with_blank", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_brand, 'blank') AS brand, coalesce(p_size, 0) AS size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 50")
def j1(spark: SparkSession, d: str) -> DataFrame:
    bank = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return R.resolve(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", bank, "p_partkey", {"brand": F.lit("blank"), "size": F.lit(0)}, base=50)


@query(
    "j2_chained_reference",
    """SELECT o_orderkey, (o_orderkey % 2 = 1) <> coalesce(c_custkey % 2 = 1, false) AS flip, o_custkey % 8 AS palette_row, o_orderstatus <> 'F' AS visible,
 coalesce(c_nationkey, 0) AS priority, coalesce(c_mktsegment, '') AS flags FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 20""",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Flips combine by exclusive or, row and visibility come from the referrer, the rest from the source."""
    cells = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    source = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 2 == 1).alias("flip"), F.col("c_nationkey").alias("priority"), F.col("c_mktsegment").alias("flags"))
    found = R.resolve(cells, "o_custkey", source, "c_custkey", {"flip": F.lit(False), "priority": F.lit(0), "flags": F.lit("")}, base=20)
    return found.select("o_orderkey", ((F.col("o_orderkey") % 2 == 1) != F.col("flip")).alias("flip"), (F.col("o_custkey") % 8).alias("palette_row"), (F.col("o_orderstatus") != "F").alias("visible"), "priority", "flags")


_SIGNATURES = [("spam", 1, "<!DOCTYPE html>", None, 0, 1), ("article", 1, "<html", None, 0, 2), ("paged", 1, None, ".html", 1500, 3), ("root", 1, None, "/", 0, 4), ("raw", 1, None, None, 0, 9)]
_SIG_SQL = "sig(name, pos, magic, suffix, min_size, ord) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in s) + ")" for s in _SIGNATURES) + ")"


_SIZES = [("odd", 1, None, ".html", 0, 1, None, (2, 1)), ("exact", 1, "<!DOCTYPE", None, 0, 2, 2048), ("four", 1, "<", None, 0, 3, None, (4, 0))]


@query("j7_sizes", """SELECT page_id, CASE WHEN four THEN 'four' WHEN odd THEN 'odd' ELSE 'raw' END AS container, CASE WHEN four THEN 2 WHEN odd THEN 1 ELSE 0 END AS score
FROM (SELECT page_id, length(html) % 2 = 1 AND ends_with(lower(url), '.html') AS odd, substr(html, 1, 1) = '<' AND length(html) % 4 = 0 AND NOT (length(html) = 2048 AND starts_with(html, '<!DOCTYPE')) AS four FROM pages)""")
def j7s(spark: SparkSession, d: str) -> DataFrame:
    """Signatures narrowed by exact size and by size modulo."""
    return R.detect(table(spark, d, "pages"), _SIZES)


@query(
    "j7_signature_detection",
    f"""WITH {_SIG_SQL}, s AS (SELECT page_id, name, ord, CASE WHEN length(html) < min_size THEN 0 WHEN magic IS NOT NULL THEN CASE WHEN substr(html, pos, length(magic)) = magic THEN 2 ELSE 0 END WHEN suffix IS NOT NULL THEN CASE WHEN ends_with(lower(url), suffix) THEN 1 ELSE 0 END ELSE 0 END AS score FROM pages, sig)
SELECT page_id, CASE WHEN score > 0 THEN name ELSE 'raw' END AS container, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS rn FROM s) WHERE rn = 1""",
)
def j7(spark: SparkSession, d: str) -> DataFrame:
    return R.detect(table(spark, d, "pages"), _SIGNATURES)


_HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^(m|www|blog)\\.', '')"


@query(
    "j11_parent_by_normal_key",
    f"""WITH h AS (SELECT page_id, {_HOST_SQL} AS key FROM pages), p AS (SELECT key, min(page_id) AS parent FROM h GROUP BY key)
SELECT page_id, h.key AS key, parent FROM h JOIN p ON h.key = p.key WHERE page_id <> parent""",
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("page_id", F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1)), r"^(m|www|blog)\.", "").alias("key"))
    return R.parents_by_key(h, "page_id", "key")


@query("j12_reverse_references", "SELECT l_partkey AS p_partkey, count(*) AS consumers, count(*) FILTER (l_returnflag <> 'R') = 0 AS only_returned FROM lineitem GROUP BY l_partkey")
def j12(spark: SparkSession, d: str) -> DataFrame:
    used = R.consumers(table(spark, d, "part"), "p_partkey", table(spark, d, "lineitem"), "l_partkey", F.col("l_returnflag") == "R")
    return used.select("p_partkey", "consumers", (F.col("others") == 0).alias("only_returned"))


@query(
    "j13_missing_references",
    """WITH r AS (SELECT o_custkey AS key, o_orderkey AS ord FROM orders UNION ALL SELECT l_suppkey, l_orderkey FROM lineitem)
SELECT key, min(ord) AS first_seen FROM r WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY key""",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"))
    other = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("ord"))
    return R.missing_keys([data, other], table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("key")), "key", "ord")


@query("j14_repoint_references", "SELECT c_custkey, CASE c_nationkey WHEN 3 THEN 103 WHEN 7 THEN 107 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(CASE c_nationkey WHEN 3 THEN 103 WHEN 7 THEN 107 ELSE c_nationkey END AS VARCHAR) ELSE c_name END AS label FROM customer")
def j14(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.col("c_name")).alias("label"))
    return R.repoint(c, "c_nationkey", spark.createDataFrame([(3, 103), (7, 107)], "old int, new int"), "label")


#: Entries of part: every fifth is a file, the others are children of the file before; a palette and further paths beside.
_ENTRIES = """e AS (SELECT p_partkey AS id, p_partkey % 5 = 0 AS is_file, CASE WHEN p_partkey % 10 = 0 THEN 'f' || (p_partkey - p_partkey % 5) || '.bin' ELSE p_name END AS name,
  '/r/f' || (p_partkey - p_partkey % 5) || '.bin' AS path, CASE WHEN p_partkey % 3 = 0 THEN '/r/f' || (p_size * 5) || '.bin' END AS palette,
  CASE WHEN p_partkey % 4 = 0 THEN ['/r/f' || (p_size * 10) || '.bin', '/r/x.bin', '/r/f' || (p_size * 5) || '.bin'] WHEN p_partkey % 4 = 1 THEN CAST([] AS VARCHAR[]) END AS extra FROM part)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    at = lambda n: F.concat(F.lit("/r/f"), n.cast("string"), F.lit(".bin"))
    name = F.when(k % 10 == 0, F.concat(F.lit("f"), (k - k % 5).cast("string"), F.lit(".bin"))).otherwise(F.col("p_name"))
    extra = F.when(k % 4 == 0, F.array(at(F.col("p_size") * 10), F.lit("/r/x.bin"), at(F.col("p_size") * 5))).when(k % 4 == 1, F.array().cast("array<string>"))
    return table(spark, d, "part").select(k.alias("id"), (k % 5 == 0).alias("is_file"), name.alias("name"), at(k - k % 5).alias("path"), F.when(k % 3 == 0, at(F.col("p_size") * 5)).alias("palette"), extra.alias("extra"))


@query(
    "j14_cascading_repoint",
    f"""WITH {_ENTRIES}, m AS (SELECT DISTINCT '/r/f' || p_partkey || '.bin' AS old, '/s/g' || p_partkey || '.dat' AS new FROM part WHERE p_partkey % 15 = 0),
x AS (SELECT id, list(coalesce(new, v) ORDER BY i) AS put, bool_or(new IS NOT NULL) AS hit FROM (SELECT id, unnest(extra) AS v, generate_subscripts(extra, 1) AS i FROM e) LEFT JOIN m ON old = v GROUP BY id)
SELECT e.id, CASE WHEN is_file AND a.new IS NOT NULL AND name = 'f' || e.id || '.bin' THEN 'g' || e.id || '.dat' ELSE name END AS name, coalesce(a.new, path) AS path, coalesce(b.new, palette) AS palette,
  array_to_string(coalesce(put, extra), ' ') AS extra, a.new IS NOT NULL OR b.new IS NOT NULL OR coalesce(hit, false) AS touched
FROM e LEFT JOIN m a ON a.old = path LEFT JOIN m b ON b.old = palette LEFT JOIN x ON x.id = e.id""",
)
def j14c(spark: SparkSession, d: str) -> DataFrame:
    """Two reference columns and an array of references; a file's name follows its path while it is the default."""
    keys = table(spark, d, "part").where("p_partkey % 15 = 0").select(F.col("p_partkey").cast("string").alias("k")).distinct()
    mapping = keys.select(F.concat(F.lit("/r/f"), "k", F.lit(".bin")).alias("old"), F.concat(F.lit("/s/g"), "k", F.lit(".dat")).alias("new"))
    out = R.repoint_all(_entries(spark, d), "id", mapping, ["path", "palette"], ["extra"], ("name", "path", F.col("is_file")))
    return out.select("id", "name", "path", "palette", F.array_join("extra", " ").alias("extra"), "touched")


@query(
    "j14_retargeted_files",
    f"""WITH {_ENTRIES}, m AS (SELECT id AS file, path AS old, '/t/h' || id || '.a' AS first, CASE WHEN id % 20 = 0 THEN ['/t/h' || id || '.b', '/t/h' || id || '.c'] ELSE CAST([] AS VARCHAR[]) END AS rest FROM e WHERE id % 10 = 0)
SELECT e.id, CASE WHEN id = file AND name = 'f' || id || '.bin' THEN 'h' || id || '.a' ELSE name END AS name, coalesce(first, path) AS path, array_to_string(CASE WHEN file IS NULL THEN extra ELSE rest END, ' ') AS extra, file IS NOT NULL AS touched
FROM e LEFT JOIN m ON old = path""",
)
def j14r(spark: SparkSession, d: str) -> DataFrame:
    """Files that get a new list of paths take their children along."""
    e = _entries(spark, d)
    at = lambda end: F.concat(F.lit("/t/h"), F.col("id").cast("string"), F.lit(end))
    moves = e.where("id % 10 = 0").select("id", F.when(F.col("id") % 20 == 0, F.array(at(".a"), at(".b"), at(".c"))).otherwise(F.array(at(".a"))).alias("paths"))
    out = R.retarget(e, moves, "id", "path", "extra", "name", F.col("is_file"))
    return out.select("id", "name", "path", F.array_join("extra", " ").alias("extra"), "touched")


@query("j15_missing_format_repair", "SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 5 = 0 AND p_size = 1) THEN p_brand ELSE 'default' END AS p_brand, p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 5 = 0 AND p_size = 1) AS repaired FROM part")
def j15(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return R.repair(p.select("p_partkey", "p_brand"), "p_brand", p.where("p_partkey % 5 = 0 and p_size = 1"), F.lit("default"))[0].select("p_partkey", "p_brand", "repaired")


@query("j15_repair_report", "SELECT p_brand AS old, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 5 = 0 AND p_size = 1) GROUP BY p_brand")
def j15r(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return R.repair(p.select("p_partkey", "p_brand"), "p_brand", p.where("p_partkey % 5 = 0 and p_size = 1"), F.lit("default"))[1]


@query(
    "j17_right_wins_overlay",
    """WITH a AS (SELECT c_custkey + 100 AS code, c_name AS text FROM customer WHERE c_custkey + 100 BETWEEN 0 AND 4095), b AS (SELECT s_suppkey * 5 AS code, s_name AS text FROM supplier)
SELECT * FROM a WHERE code NOT IN (SELECT code FROM b) UNION ALL SELECT * FROM b""",
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    a = R.shift_codes(table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("text")), "code", 100, 3)
    return R.overlay(a, table(spark, d, "supplier").select((F.col("s_suppkey") * 5).alias("code"), F.col("s_name").alias("text")), "code")


@query(
    "j18_partial_coverage_merge",
    """WITH o AS (SELECT vec_id AS tile, pos % 8 AS x, pos // 8 AS y, v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS pos FROM embeddings)),
n AS (SELECT tile + 3 AS tile, x, y, v * 2 AS v FROM o)
SELECT tile, x, y, CASE WHEN x < 5 AND y < 3 THEN coalesce(n.v, o.v) ELSE coalesce(o.v, n.v) END AS v FROM o FULL JOIN n USING (tile, x, y)""",
)
def j18(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("tile"), F.posexplode("embedding").alias("pos", "v")).select("tile", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).alias("y"), "v")
    return R.merge_partial(e, e.select((F.col("tile") + 3).alias("tile"), "x", "y", (F.col("v") * 2).cast("float").alias("v")), ["tile", "x", "y"], (F.col("x") < 5) & (F.col("y") < 3), "v")


@query("p8_legal_range", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey >= greatest(0, 50) AND l_partkey < least((SELECT count(*) FROM part) + 50, 1501)")
def p8(spark: SparkSession, d: str) -> DataFrame:
    low, high = R.legal_range(-50, F.col("n"), 1500)
    n = F.broadcast(table(spark, d, "part").agg(F.count("*").alias("n")))
    return table(spark, d, "lineitem").join(n, (F.col("l_partkey") >= low) & (F.col("l_partkey") < high)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("p9_aligned_subset", "SELECT p_partkey FROM part WHERE (p_partkey + 5) % 16 % 2 = 0 AND (p_partkey + 5) // 16 % 2 = 0")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(R.aligned(F.col("p_partkey"), 5, 16, 2, 2)).select("p_partkey")


@query("p10_default_fallback", f"WITH {PALETTE_SQL} SELECT l_orderkey, l_linenumber, l_partkey % 20 AS idx, coalesce(color, 4294902015) AS color FROM lineitem LEFT JOIN palette ON idx = l_partkey % 20")
def p10(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 20).alias("idx"))
    return R.resolve(li, "idx", palette(spark), "idx", {"color": F.lit(0xFFFF00FF)})
