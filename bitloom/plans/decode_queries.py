"""Demo queries of staged decoding and structure scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators import decode as D
from bitloom.plans.registry import query
from bitloom.sources.tables import table


def packed_texts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, raw, blob): whole texts as literal packets of at most 120 bytes; every 13th stream lacks its end."""
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    n = F.octet_length("raw")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(120)), lambda s: s < n)
    packet = F.transform(starts, lambda s: F.concat(F.hex(F.least(n - s, F.lit(120)) + 128), F.hex(F.substring("raw", s + 1, F.lit(120)))))
    end = F.when(F.col("doc_id") % 13 == 5, "").otherwise("FF")
    return docs.withColumn("blob", F.unhex(F.concat(F.array_join(packet, ""), end)))


@query("u2_staged_decode", """SELECT doc_id, doc_id % 13 <> 5 AS complete, CASE WHEN doc_id % 13 <> 5 THEN sha256(text) END AS output_sha, CASE WHEN doc_id % 13 = 5 THEN 'decompress' END AS stage, CASE WHEN doc_id % 13 = 5 THEN 'stream ends early' END AS message FROM documents""")
def u2(spark: SparkSession, d: str) -> DataFrame:
    done = D.decode(packed_texts(spark, d).select("doc_id", "blob"), "blob", "fill-rle")
    return done.select("doc_id", "complete", F.sha2("output", 256).alias("output_sha"), "stage", "message")


_STAGED = """WITH b AS (SELECT doc_id, text, doc_id % 13 AS a, doc_id % 4 AS r, doc_id % 17 AS c,
 strlen(text) + CAST(ceil(strlen(text) / 120.0) AS BIGINT) + CASE WHEN doc_id % 13 = 5 THEN 0 ELSE 1 END AS n FROM documents),
f AS (SELECT *, CASE WHEN c = 3 THEN 1 WHEN r = 1 AND n % 2 = 1 THEN 2 WHEN r = 3 THEN 3 WHEN a = 5 THEN 4 WHEN strlen(text) < 2 THEN 5 ELSE 0 END AS bad FROM b)
SELECT doc_id, 'texts' AS pathway, CASE WHEN bad = 0 THEN sha256(text) END AS output_sha,
 CASE WHEN bad = 0 THEN CAST(get_bit(CAST(encode(text) AS BIT), 0) * 128 + get_bit(CAST(encode(text) AS BIT), 1) * 64 + get_bit(CAST(encode(text) AS BIT), 2) * 32 + get_bit(CAST(encode(text) AS BIT), 3) * 16
  + get_bit(CAST(encode(text) AS BIT), 4) * 8 + get_bit(CAST(encode(text) AS BIT), 5) * 4 + get_bit(CAST(encode(text) AS BIT), 6) * 2 + get_bit(CAST(encode(text) AS BIT), 7) AS BIGINT) END AS first_byte,
 CASE bad WHEN 1 THEN 'container' WHEN 2 THEN 'container' WHEN 3 THEN 'container' WHEN 4 THEN 'decompress' WHEN 5 THEN 'interpret' END AS failed_stage,
 CASE bad WHEN 1 THEN 'cut' WHEN 2 THEN 'reshape' WHEN 3 THEN 'reshape' WHEN 4 THEN 'decode' WHEN 5 THEN 'fields' END AS failed_action,
 CASE bad WHEN 1 THEN 'slice' WHEN 2 THEN 'swap' WHEN 3 THEN 'mirror' WHEN 4 THEN 'fill-rle' WHEN 5 THEN 'fields' END AS plugin,
 CASE bad WHEN 1 THEN 'region past the end' WHEN 2 THEN 'no whole units of 2 bytes' WHEN 3 THEN 'unknown reshape' WHEN 4 THEN 'stream ends early' WHEN 5 THEN 'no room for first_two' END AS message FROM f"""


@query("u2_stages_and_failures", _STAGED)
def u2s(spark: SparkSession, d: str) -> DataFrame:
    """Packed texts behind a header of four bytes, some with swapped bytes; each stage fails for some."""
    docs = packed_texts(spark, d).select("doc_id", "blob")
    k, hexed = F.col("doc_id"), F.hex("blob")
    body = F.when(k % 4 == 1, F.unhex(F.regexp_replace(hexed, "(..)(..)", "$2$1"))).otherwise(F.col("blob"))
    whole = docs.select("doc_id", F.concat(F.unhex(F.lit("48454144")), body).alias("blob"))
    n = F.octet_length("blob")
    reshape = F.when(k % 4 == 1, "swap").when(k % 4 == 3, "mirror")
    done = D.staged(whole, "blob", "texts", F.lit(4), F.when(k % 17 == 3, n), reshape, F.lit("fill-rle"), {"first_byte": (0, 1), "first_two": (0, 2)})
    return done.select("doc_id", "pathway", F.sha2("output", 256).alias("output_sha"), "first_byte", "failed_stage", "failed_action", "plugin", "message")


def planted(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, blob): whole texts, every fifth followed by a sized stream of 32 literals and ten bytes more."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    digest = F.md5("text")
    groups = F.concat(*[x for i in range(4) for x in (F.lit("00"), F.hex(F.substring(digest, 8 * i + 1, 8)))])
    stream = F.unhex(F.concat(F.lit("10200000"), groups, F.lit("41" * 10)))
    text = F.encode("text", "UTF-8")
    return docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(text, stream)).otherwise(text).alias("blob"))


_FOUND = """SELECT doc_id, 'sized-lz' AS codec, CAST(strlen(text) AS BIGINT) AS "offset", 40 AS consumed, 32 AS size FROM documents WHERE doc_id % 5 = 0"""


@query("u3_structure_scan", _FOUND)
def u3(spark: SparkSession, d: str) -> DataFrame:
    return D.find_structures(planted(spark, d), "doc_id", "blob", ["sized-lz", "fill-rle"])


def planted_kinds(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, blob): whole texts followed by a stream of one of four kinds, or none; few by run streams, which hit nearly everywhere."""
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("t"))
    # sized: 6 bytes, a literal and a reference of 5; ring: 4 bytes, a literal and a reference of 3;
    # runs: a repeat and literals; the same after an address
    kinds = ["10060000406120 00", "04000000017AEEF0", "034182 4243FF", "7F0020034182 4243FF"]
    kind = F.when(F.col("doc_id") % 5 < 2, F.col("doc_id") % 5).when((F.col("doc_id") % 50).isin(2, 3), F.col("doc_id") % 50)
    stream = F.element_at(F.array(*[F.unhex(F.lit(x.replace(" ", ""))) for x in kinds]), (kind + 1).cast("int"))
    return docs.select("doc_id", F.when(kind.isNotNull(), F.concat("t", stream)).otherwise(F.col("t")).alias("blob"))


_BYTE = "CAST('0x' || substr(h, 2 * ({}) + 1, 2) AS BIGINT)"


def _number(at: str, n: int) -> str:
    return "(" + " + ".join(f"{_BYTE.format(f'{at} + {k}')} * {256**k}" for k in range(n)) + ")"


# Every hit of the four readers. Flagged streams: a step of `walk` reads a flag byte (k = 8) or takes one of its choices; a text without
# bytes 0 and 10h to 1Fh can hold no head of less than 16 MB, so only its last three bytes and what follows are looked at.
# Run streams: text has no FFh, so only blobs that end in one have any. A command below 80h leads two bytes on, so all places lead to the
# next other command of their parity (s, with c bytes from each place on); `runs` goes back over these from FFh.
_KINDS = rf"""WITH RECURSIVE blobs AS (SELECT doc_id, text, hex(encode(text)) || CASE WHEN doc_id % 5 = 0 THEN '1006000040612000' WHEN doc_id % 5 = 1 THEN '04000000017AEEF0'
  WHEN doc_id % 50 = 2 THEN '0341824243FF' WHEN doc_id % 50 = 3 THEN '7F00200341824243FF' ELSE '' END AS h FROM documents WHERE text IS NOT NULL),
tails AS (SELECT doc_id, base, substr(h, 2 * base + 1) AS h, strlen(h) // 2 - base AS n FROM (SELECT doc_id, h,
  CASE WHEN strlen(text) > 1800000 OR regexp_matches(text, '[\x00\x10-\x1f]') THEN 0 ELSE greatest(strlen(text) - 3, 0) END AS base FROM blobs)),
places AS (SELECT *, unnest(range(0, n - 4)) AS o FROM tails),
heads AS (SELECT *, 'sized-lz' AS codec, {_number("o + 1", 3)} AS size FROM places WHERE {_BYTE.format("o")} // 16 = 1 AND {_number("o + 1", 3)} > 0
  UNION ALL SELECT *, 'ring-lz', {_number("o", 4)} FROM places WHERE {_number("o", 4)} BETWEEN 1 AND 9 * (n - o - 4)),
walk AS (SELECT doc_id, codec, base, h, n, o, size, o + 4 AS i, CAST(0 AS BIGINT) AS f, 8 AS k, CAST(0 AS BIGINT) AS done FROM heads
  UNION ALL SELECT doc_id, codec, base, h, n, o, size, CASE WHEN ref THEN i + 2 ELSE i + 1 END, CASE WHEN k = 8 THEN a ELSE f END, CASE WHEN k = 8 THEN 0 ELSE k + 1 END,
   CASE WHEN k = 8 THEN done WHEN NOT ref THEN done + 1 WHEN codec = 'sized-lz' THEN least(size, done + a // 16 + 3) ELSE least(size, done + b % 16 + 3) END
  FROM (SELECT *, {_BYTE.format("i")} AS a, CASE WHEN i + 1 < n THEN {_BYTE.format("i + 1")} END AS b, CASE WHEN k = 8 THEN false WHEN codec = 'sized-lz' THEN (f >> (7 - k)) & 1 = 1 ELSE (f >> k) & 1 = 0 END AS ref
   FROM walk WHERE done < size AND i < n) WHERE NOT ref OR i + 1 < n AND (codec = 'ring-lz' OR done > a % 16 * 256 + b)),
bytes AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS p, CAST('0x' || unnest(l) AS BIGINT) AS v FROM (SELECT doc_id, regexp_extract_all(h, '..') AS l FROM blobs WHERE ends_with(h, 'FF'))),
commands AS (SELECT *, v > 127 OR (v = 127 AND codec = 'address-rle') AS other FROM bytes, (VALUES ('address-rle'), ('fill-rle')) r(codec)),
led AS (SELECT *, min(CASE WHEN other THEN p END) OVER back AS s, CAST(sum(CASE WHEN other THEN 0 ELSE v END) OVER back AS BIGINT) AS c FROM commands
  WINDOW back AS (PARTITION BY doc_id, codec, p % 2 ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
others AS (SELECT doc_id, codec, p, v, c, CASE WHEN v = 127 THEN 0 WHEN v = 128 AND codec = 'fill-rle' THEN 256 ELSE v - 128 END AS gain FROM led WHERE other),
links AS (SELECT a.doc_id, a.codec, a.p, a.c, y.p AS next, a.gain + x.c - y.c AS gain FROM others a
  JOIN led x ON x.doc_id = a.doc_id AND x.codec = a.codec AND x.p = CASE WHEN a.v = 127 THEN a.p + 3 ELSE a.p + 1 + a.gain END
  JOIN others y ON y.doc_id = x.doc_id AND y.codec = x.codec AND y.p = x.s WHERE a.v <> 255),
runs AS (SELECT doc_id, codec, p, c, p + 1 AS stop, CAST(0 AS BIGINT) AS gain FROM others WHERE v = 255
  UNION ALL SELECT l.doc_id, l.codec, l.p, l.c, r.stop, l.gain + r.gain FROM runs r JOIN links l ON l.doc_id = r.doc_id AND l.codec = r.codec AND l.next = r.p)
SELECT doc_id, codec, base + o AS "offset", i - o AS consumed, size FROM walk WHERE done = size
UNION ALL SELECT l.doc_id, l.codec, l.p, r.stop - l.p, l.c - r.c + r.gain FROM led l JOIN runs r ON r.doc_id = l.doc_id AND r.codec = l.codec AND r.p = l.s WHERE l.c - r.c + r.gain > 0"""


@query("u3_every_reader", _KINDS)
def u3r(spark: SparkSession, d: str) -> DataFrame:
    """Every hit of every reader; the run readers hit at most places before an end of theirs."""
    return D.find_structures(planted_kinds(spark, d), "doc_id", "blob", list(D.READERS))


@query("u4_extent_backfill", """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS "offset", CASE WHEN doc_id % 3 = 0 THEN 7 WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 40 END AS length, CASE WHEN doc_id % 7 = 0 THEN 'swap' END AS reshape FROM documents""")
def u4(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    slices = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("offset"), F.when(k % 3 == 0, 7).cast("long").alias("length"), F.when(k % 7 == 0, "swap").alias("reshape"))
    return D.backfill(slices, u3(spark, d), "doc_id")


@query("u1_codec_registry", """SELECT l_orderkey, l_linenumber, 4278190080 + ((r << 3) | (r >> 2)) * 65536 + ((g << 3) | (g >> 2)) * 256 + ((b << 3) | (b >> 2)) AS argb, true AS same
FROM (SELECT l_orderkey, l_linenumber, w & 31 AS r, (w >> 5) & 31 AS g, (w >> 10) & 31 AS b FROM (SELECT l_orderkey, l_linenumber, l_partkey * 37 % 32768 AS w FROM lineitem))""")
def u1(spark: SparkSession, d: str) -> DataFrame:
    """A colour codec called by its id, against the direct expression."""
    layout = B.parse_layout("-bbbbbgggggrrrrr")
    reg = D.Registry()
    reg.add("interpret", "bgr555", lambda c: B.decode_rgb(c, layout), native=True)
    w = F.col("l_partkey") * 37 % 32768
    direct = B.decode_rgb(w, layout)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reg.build("interpret", "bgr555", w).alias("argb"), (reg.build("interpret", "bgr555", w) == direct).alias("same"))


@query("u1_table_function", """SELECT doc_id, doc_id % 13 <> 5 AS complete, strlen(text) AS n FROM documents""")
def u1t(spark: SparkSession, d: str) -> DataFrame:
    """A byte reader as a table function of SQL."""
    reg = D.Registry()
    reg.add("decompress", "fill-rle", D.read_fill_rle)
    reg.register_table_functions(spark)
    packed_texts(spark, d).select("doc_id", "blob").createOrReplaceTempView("bitloom_packed")
    return spark.sql("SELECT doc_id, complete, CAST(octet_length(output) AS BIGINT) AS n FROM bitloom_packed, LATERAL decode_fill_rle(blob)")


#: Presets of the demo codecs: (preset, codec, params).
_PRESETS = [(0, "plain", "{}"), (1, "bounded", '{"limit": 64}'), (2, "bounded", '{"limit": 256}'), (3, "failing", "{}"), (4, "odd", "{}"), (5, "bounded", "{}")]


def _probed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each document has one of seven presets, of which the last does not exist."""
    reg = D.Registry()
    reg.add_optional("interpret", "plain")
    reg.add_optional("interpret", "bounded", index_limit=lambda p: p["limit"], cell_tiles=lambda p: (1, 2))
    reg.add_optional("interpret", "failing", index_limit=lambda p: 1 // 0)
    reg.add_optional("interpret", "odd", index_limit=lambda p: "many", cell_tiles=lambda p: 2)
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 7).cast("int").alias("preset"))
    rows = D.with_presets(docs, "preset", spark.createDataFrame(_PRESETS, "preset int, codec string, params string"))
    asked = {"index_limit": (int, -1, "int"), "cell_tiles": (lambda v: v[0] * v[1], 1, "int")}
    return D.probed(rows, reg, "interpret", asked)


@query("u1_guarded_probes", """SELECT doc_id, doc_id % 7 AS preset, CASE doc_id % 7 WHEN 1 THEN 64 WHEN 2 THEN 256 ELSE -1 END AS index_limit,
CASE WHEN doc_id % 7 IN (1, 2, 5) THEN 2 ELSE 1 END AS cell_tiles FROM documents""")
def u1p(spark: SparkSession, d: str) -> DataFrame:
    return _probed(spark, d)[0].select("doc_id", "preset", "index_limit", "cell_tiles")


@query("u1_probe_notices", """WITH n(k, codec, method) AS (VALUES (3, 'failing', 'index_limit'), (4, 'odd', 'index_limit'), (4, 'odd', 'cell_tiles'), (5, 'bounded', 'index_limit'), (6, NULL, 'index_limit'), (6, NULL, 'cell_tiles'))
SELECT codec, method, count(*) AS n FROM n JOIN documents ON doc_id % 7 = k GROUP BY codec, method""")
def u1n(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each notice stands for."""
    rows, notices = _probed(spark, d)
    hit = rows.alias("r").join(notices.alias("n"), F.col("r.codec").eqNullSafe(F.col("n.codec")) & F.col("r.params").eqNullSafe(F.col("n.params")))
    return hit.groupBy(F.col("n.codec").alias("codec"), "method").agg(F.count("*").alias("n"))
