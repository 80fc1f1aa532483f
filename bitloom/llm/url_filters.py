"""URL filters as a temporal list join, in DataFrame functions only.

A filter list is a log of dated entries (list, pattern, entry_date, action, category): 'add' opens a
pattern, 'remove' closes it. The log becomes validity intervals [valid_from, valid_to) by looking at
the next entry of the same list and pattern; a capture is judged against the intervals that hold at
its fetch time. Patterns are host names, which match the host and all hosts below it, or a host
followed by the first path segment.

The as-of join sees each (candidate pattern, fetch date) once, however many captures and hosts stand
behind it, and intervals unrolled into the months they touch: an equi join on (pattern, month) whose
keys hold at most a month's dates. What holds at a date then goes back to the captures' distinct
(patterns, date) rows by an equi join in which a pattern's rows are salted over `SALTS` keys, as one
host may own a large share of them. The list named `allow_list` overrides the others.

Defined results: a null url, or one without a host, matches nothing; a null fetch time matches
nothing; entries with a null list, pattern, date or unknown action are ignored; of entries of one
list and pattern on one date the last by action name ('remove' after 'add') and category counts;
an interval that closes on the day it opens is empty; repeated captures each get their row; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.llm.common import table


#: Keys that a pattern's captures are spread over on their way back from the as-of join.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def candidates(url: Column) -> Column:
    """Every pattern that could match: the host and each parent domain, alone and with the first path segment."""
    host = host_of(url)
    segment = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    with_path = F.transform(tails, lambda t: F.concat(t, F.lit("/"), segment))
    every = F.when(segment != "", F.concat(tails, with_path)).otherwise(tails)
    return F.when(host.isNotNull(), every)


def validity(entries: DataFrame) -> DataFrame:
    """(list, pattern, category, valid_from, valid_to): intervals of the log; an open end is null."""
    known = entries.where(F.col("action").isin("add", "remove") & F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("entry_date").isNotNull())
    daily = known.groupBy("list", "pattern", "entry_date").agg(F.max(F.struct("action", "category")).alias("e"))
    after = Window.partitionBy("list", "pattern").orderBy("entry_date")
    return (
        daily.select("list", "pattern", F.col("e.action").alias("action"), F.col("e.category").alias("category"), F.col("entry_date").alias("valid_from"), F.lead("entry_date").over(after).alias("valid_to"))
        .where(F.col("action") == "add")
        .drop("action")
    )


def judge(captures: DataFrame, entries: DataFrame, allow_list: str = "allow") -> DataFrame:
    """(capture_id, fetch_date, n_active, categories, allowed, blocked) for each capture.

    captures: (capture_id, url, fetch_date). n_active counts the lists' entries that hold at the
    fetch date, categories are theirs, sorted and joined by commas.
    """
    asked = captures.select("capture_id", "fetch_date", candidates(F.col("url")).alias("patterns"))
    # a capture's matches depend on its host, first segment and date only
    keyed = asked.withColumn("key", F.md5(F.concat_ws("|", F.array_join("patterns", " "), F.col("fetch_date").cast("string"))))
    distinct = keyed.where(F.col("patterns").isNotNull() & F.col("fetch_date").isNotNull()).groupBy("key").agg(F.first("patterns").alias("patterns"), F.first("fetch_date").alias("fetch_date"))
    wanted = distinct.select("key", "fetch_date", F.explode("patterns").alias("pattern"))
    points = wanted.select("pattern", "fetch_date").distinct().withColumn("month", F.trunc("fetch_date", "month"))
    last = captures.agg(F.max("fetch_date").alias("last"), F.min("fetch_date").alias("first"))
    spans = validity(entries).join(F.broadcast(last), (F.col("valid_from") <= F.col("last")) & (F.coalesce("valid_to", F.date_add("last", 1)) > F.col("first")))
    months = F.sequence(F.trunc(F.greatest("valid_from", "first"), "month"), F.trunc(F.least(F.coalesce("valid_to", "last"), "last"), "month"), F.expr("interval 1 month"))
    unrolled = spans.select("list", "pattern", "category", "valid_from", "valid_to", F.explode(months).alias("month"))
    holds = (F.col("fetch_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_date") < F.col("valid_to")))
    active = points.join(unrolled, ["pattern", "month"]).where(holds).groupBy("pattern", "fetch_date").agg(
        F.count("*").alias("n"), F.collect_set("category").alias("c"),
        F.max((F.col("list") == allow_list).cast("int")).alias("a"), F.max((F.col("list") != allow_list).cast("int")).alias("d"),
    )
    spread = active.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = wanted.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    found = salted.join(spread, ["pattern", "fetch_date", "salt"]).groupBy("key").agg(
        F.sum("n").alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))), ",").alias("categories"),
        F.max("a").alias("allow"), F.max("d").alias("deny"),
    )
    return keyed.join(found, "key", "left").select(
        "capture_id", "fetch_date",
        F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("categories", F.lit("")).alias("categories"),
        (F.coalesce("allow", F.lit(0)) == 1).alias("allowed"), ((F.coalesce("deny", F.lit(0)) == 1) & (F.coalesce("allow", F.lit(0)) == 0)).alias("blocked"),
    )


def _number(text: Column, begin: int) -> Column:
    """Four hexadecimal digits of the text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), begin, 4), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, with a fetch date in 2024 drawn from the id."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetch_date"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries over the hosts of the pages table, drawn from each host's md5."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    parent = hosts.select(F.regexp_replace("host", r"^[^.]+\.(?=[^.]+\.[^.]+)", "").alias("host"))
    paths = pages.select(F.concat(host_of(F.col("url")), F.lit("/"), F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)).alias("host")).where("host is not null and host not like '%/'")
    patterns = hosts.union(parent).union(paths).distinct()
    drawn = patterns.select("host", _number(F.col("host"), 1).alias("a"), _number(F.col("host"), 5).alias("b"), _number(F.col("host"), 9).alias("c")).where("a % 3 = 0")
    day = F.date_add(F.lit("2023-10-01").cast("date"), F.col("b") % 300)
    name = F.when(F.col("c") % 11 == 0, "allow").when(F.col("c") % 2 == 0, "malware").otherwise("adult")
    category = F.concat(name, F.lit("-"), (F.col("a") % 4).cast("string"))
    listed = drawn.select(name.alias("list"), F.col("host").alias("pattern"), category.alias("category"), day.alias("d"), "b", "c")
    steps = F.array(
        F.struct(F.col("d").alias("entry_date"), F.lit("add").alias("action")),
        F.struct(F.when(F.col("c") % 3 > 0, F.date_add("d", 20 + F.col("b") % 90)).alias("entry_date"), F.lit("remove").alias("action")),
        F.struct(F.when(F.col("c") % 3 > 1, F.date_add("d", 60 + F.col("b") % 90 + F.col("c") % 50)).alias("entry_date"), F.lit("add").alias("action")),
    )
    return listed.select("list", "pattern", "category", F.explode(steps).alias("e")).select("list", "pattern", "category", "e.entry_date", "e.action").where("entry_date is not null")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(page_captures(pages), page_entries(pages))
    return judged.select(F.col("capture_id").alias("page_id"), F.date_format("fetch_date", "yyyy-MM-dd").alias("fetch_date"), F.col("n_active").cast("long").alias("n_active"), "categories", "allowed", "blocked")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, lower(url) AS u, date '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetch_date,
         regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', '') AS host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg
  FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
pat AS (
  SELECT host AS pattern FROM h
  UNION SELECT CASE WHEN len(string_split(host, '.')) >= 3 THEN substr(host, strpos(host, '.') + 1) ELSE host END FROM h
  UNION SELECT host || '/' || seg FROM p WHERE host <> '' AND seg <> ''),
n AS (
  SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INTEGER AS a, ('0x' || substr(md5(pattern), 5, 4))::INTEGER AS b,
         ('0x' || substr(md5(pattern), 9, 4))::INTEGER AS c
  FROM pat),
l AS (
  SELECT pattern, CASE WHEN c % 11 = 0 THEN 'allow' WHEN c % 2 = 0 THEN 'malware' ELSE 'adult' END AS list,
         a, b, c, date '2023-10-01' + (b % 300) AS d
  FROM n WHERE a % 3 = 0),
iv AS (
  SELECT pattern, list, list || '-' || (a % 4) AS category, d AS f,
         CASE WHEN c % 3 > 0 THEN d + (20 + b % 90) END AS t FROM l
  UNION ALL
  SELECT pattern, list, list || '-' || (a % 4), d + (60 + b % 90 + c % 50), NULL FROM l WHERE c % 3 > 1),
cand AS (
  SELECT page_id, fetch_date, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS tail, seg
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')),
keys AS (SELECT page_id, fetch_date, tail AS pattern FROM cand UNION ALL SELECT page_id, fetch_date, tail || '/' || seg FROM cand WHERE seg <> ''),
hit AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS cats,
         bool_or(list = 'allow') AS al, bool_or(list <> 'allow') AS de
  FROM keys JOIN iv USING (pattern) WHERE fetch_date >= f AND (t IS NULL OR fetch_date < t) GROUP BY page_id)
SELECT p.page_id, strftime(p.fetch_date, '%Y-%m-%d') AS fetch_date, coalesce(n, 0) AS n_active, coalesce(cats, '') AS categories,
       coalesce(al, false) AS allowed, coalesce(de, false) AND NOT coalesce(al, false) AS blocked
FROM p LEFT JOIN hit USING (page_id)
"""
