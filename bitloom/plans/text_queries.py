"""Demo queries of the text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.functions import trie as W
from bitloom.plans.registry import query
from bitloom.sources.tables import table

#: Twenty two-letter spellings of the demo dictionary.
DIGRAMS = "th he in er an re nd on en at ou ed ha to or it is hi es ng".split()
_LIST = "[" + ", ".join(f"'{s}'" for s in DIGRAMS) + "]"
_PATTERN = "(?s)(" + "|".join(DIGRAMS) + "|.)"
_CODES = f"codes AS (SELECT doc_id, text, [CASE WHEN list_position({_LIST}, t) > 0 THEN list_position({_LIST}, t) - 1 ELSE -1 - ascii(t) END FOR t IN regexp_extract_all(text, '{_PATTERN}')] AS c FROM documents)"


@query("f19_safe_export_name", r"""SELECT page_id, CASE WHEN k = '' THEN 'export' ELSE k END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9\-_.]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS k FROM pages)""")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("f19_child_export_name", r"""SELECT page_id, CASE WHEN a = '' THEN 'export' ELSE a END || '_' || CASE WHEN b = '' THEN 'export' ELSE b END AS name FROM (
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '[^A-Za-z0-9\-_.]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS a, 'page_' || page_id AS b FROM pages)""")
def f19c(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.child_name(F.col("url"), F.concat(F.lit("page:"), F.col("page_id").cast("string"))).alias("name"))


@query("f20_stored_path", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/corpus/site/b.html' WHEN 1 THEN '/corpus/b.html' WHEN 2 THEN 'c:/x/b.html' ELSE '/corpus/site/a/b' || page_id END AS key,
CASE page_id % 4 WHEN 0 THEN 'b.html' WHEN 1 THEN '/Corpus/b.html' WHEN 2 THEN 'C:/x/b.html' ELSE 'a/B' || page_id END AS kept FROM pages""")
def f20s(spark: SparkSession, d: str) -> DataFrame:
    """Paths below and beside a base folder, rooted and not, with steps up."""
    k, base = F.col("page_id"), F.lit("/Corpus/Site/")
    path = F.when(k % 4 == 0, "a//../b.html").when(k % 4 == 1, "..\\b.html").when(k % 4 == 2, "C:\\x\\.\\y\\..\\b.html").otherwise(F.concat(F.lit("/corpus/SITE/./a/B"), k.cast("string"), F.lit("/")))
    return table(spark, d, "pages").select("page_id", T.path_key(path, base).alias("key"), T.stored_path(path, base).alias("kept"))


@query("f20_path_key", r"""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[\\/]+', '/', 'g'), '([^:])/$', '\1') AS key FROM pages""")
def f20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.path_key(F.col("url")).alias("key"))


@query("f21_greedy_tokens", f"WITH {_CODES} SELECT doc_id, len(c) AS n_codes, len([x FOR x IN c IF x >= 0]) AS n_digrams, md5(array_to_string(c, ' ')) AS codes_md5 FROM codes")
def f21(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", W.greedy_codes(F.col("text"), DIGRAMS).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n_codes"), F.size(F.filter("c", lambda x: x >= 0)).cast("long").alias("n_digrams"), F.md5(F.array_join(F.transform("c", lambda x: x.cast("string")), " ")).alias("codes_md5"))


@query("f22_codes_to_text", "SELECT doc_id, md5(text) AS text_md5, true AS same FROM documents")
def f22(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", "text", W.codes_text(W.greedy_codes(F.col("text"), DIGRAMS), DIGRAMS).alias("back"))
    return c.select("doc_id", F.md5("back").alias("text_md5"), (F.col("back") == F.col("text")).alias("same"))


@query("f22_commands_with_operands", """WITH RECURSIVE e AS (SELECT user_id, list(event_id % 8 ORDER BY event_id) AS c FROM events GROUP BY user_id),
r AS (SELECT user_id, c, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, '' AS piece FROM e
 UNION ALL SELECT user_id, c, i + 1 + CASE c[i] WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END, i,
  CASE c[i] WHEN 6 THEN '[wait' || coalesce(' $' || to_hex(c[i + 1]), '') || ']' WHEN 7 THEN '[jump' || coalesce(' $' || to_hex(c[i + 1]), '') || coalesce(' $' || to_hex(c[i + 2]), '') || ']' ELSE '<' || to_hex(c[i]) || '>' END
 FROM r WHERE i <= len(c))
SELECT user_id, string_agg(piece, '' ORDER BY n) AS body FROM r GROUP BY user_id""")
def f22c(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: (x % 8).cast("int")).alias("codes"))
    return e.select("user_id", T.commands_text(F.col("codes"), {6: ("wait", 1), 7: ("jump", 2)}).alias("body"))


@query("f23_dictionary_expansion", """WITH g AS (SELECT DISTINCT c AS char, ascii(c) - 32 AS code FROM (SELECT unnest(string_split(s_name, '')) AS c FROM supplier UNION ALL SELECT unnest(string_split(n_name, '')) FROM nation)),
e AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ''), 1) AS pos, unnest(string_split(p_name, '')) AS char FROM part)
SELECT p_partkey, CASE WHEN count(code) = count(*) THEN string_agg(CAST(code AS VARCHAR), ' ' ORDER BY pos) ELSE '' END AS codes FROM e LEFT JOIN g USING (char) GROUP BY p_partkey""")
def f23(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "supplier").select(F.explode(F.split("s_name", "")).alias("char")).union(table(spark, d, "nation").select(F.explode(F.split("n_name", ""))))
    glyphs = named.where("char <> ''").distinct().select("char", (F.ascii("char") - 32).alias("code"))
    return T.expand_words(table(spark, d, "part"), "p_partkey", "p_name", glyphs)


@query("f24_positional_run", "SELECT s_suppkey, i + 99 AS code, c AS char FROM (SELECT s_suppkey, generate_subscripts(string_split(s_name, ''), 1) AS i, unnest(string_split(s_name, '')) AS c FROM supplier) WHERE c <> '#'")
def f24(spark: SparkSession, d: str) -> DataFrame:
    return T.positional(table(spark, d, "supplier"), "s_suppkey", "s_name", 100, "#")


@query("s4_code_table_lines", "SELECT n_nationkey, n_nationkey AS code, CASE WHEN n_nationkey % 5 = 0 THEN '[' || n_name || ']' WHEN n_nationkey % 5 = 1 THEN n_name || '=x' ELSE n_name END AS text, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 0 END AS params, n_nationkey AS code2 FROM nation WHERE n_nationkey % 7 <> 3")
def s4(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    body = F.when(k % 5 == 0, F.concat(F.lit("["), "n_name", F.lit(", 2]"))).when(k % 5 == 1, F.concat("n_name", F.lit("=x"))).otherwise(F.col("n_name"))
    # every seventh line has no code and is ignored
    line = F.when(k % 7 == 3, F.concat(F.lit("?="), body)).otherwise(F.concat(F.hex(k), F.lit("="), body))
    back = F.concat(body, F.lit("=$"), F.hex(k))
    parsed = n.select("n_nationkey", T.parse_code_line(line).alias("a"), T.parse_code_line(back, text_first=True).alias("b")).where("a is not null")
    return parsed.select("n_nationkey", "a.code", "a.text", "a.params", F.col("b.code").alias("code2"))


@query("s5_code_records", """SELECT p_partkey % 50 AS spec, p_partkey AS code, CASE WHEN p_partkey % 3 = 0 THEN substr(p_brand, 1, 1) ELSE p_brand END AS text, CASE WHEN p_partkey % 3 = 0 OR length(p_brand) = 1 THEN 'text' ELSE 'dict' END AS role, p_size AS params FROM part WHERE p_partkey % 4 <> 1""")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """Records read back from JSON arrays of a hundred at most; those whose code is no number are skipped one by one."""
    k = F.col("p_partkey")
    rec = F.struct(F.when(k % 4 == 1, F.lit("none")).otherwise(k.cast("string")).alias("code"), F.when(k % 3 == 0, F.substring("p_brand", 1, 1)).otherwise(F.col("p_brand")).alias("text"), F.lit("text").alias("role"), F.col("p_size").cast("string").alias("params"))
    specs = table(spark, d, "part").groupBy((k % 50).alias("spec"), F.floor(k / 5000).alias("_file")).agg(F.to_json(F.collect_list(rec)).alias("j"))
    rows = specs.select("spec", F.explode(F.from_json("j", "array<struct<code: string, text: string, role: string, params: string>>")).alias("r")).select("spec", "r.*")
    typed = rows.withColumn("code", F.expr("try_cast(code as long)")).withColumn("params", F.expr("try_cast(params as int)")).where("code is not null and text is not null")
    return typed.withColumn("role", F.when(F.length("text") > 1, "dict").otherwise("text"))


@query("p1_every_word_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') AND contains(lower(p_name), 'cold')")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(T.matches(F.col("p_name"), "Widget cold")).select("p_partkey", "p_name")


@query("p2_search_keeps_ancestors", "SELECT 'supplier' AS kind, CAST(s_suppkey AS BIGINT) AS id FROM supplier WHERE contains(lower(s_name), '7') UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE contains(lower(n_name), '7') OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND contains(lower(s_name), '7'))")
def p2(spark: SparkSession, d: str) -> DataFrame:
    n, found = table(spark, d, "nation"), table(spark, d, "supplier").where(T.matches(F.col("s_name"), "7"))
    own = n.where(T.matches(F.col("n_name"), "7"))
    above = n.join(found, n["n_nationkey"] == found["s_nationkey"], "left_semi")
    parents = own.unionByName(above).distinct().select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"))
    return found.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")).unionByName(parents)
