"""Demo queries of the bit, address and colour expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators import substitute as S
from bitloom.plans.registry import query
from bitloom.sources.tables import COLORS_SQL, colors, table

#: Address layouts of the demo: (name, bank size, first bank, base address).
BANKINGS = [
    B.Banking("flat64k", 65536, 0, 0), B.Banking("half32k", 32768, 0, 32768), B.Banking("half32k-high", 32768, 128, 32768), B.Banking("paged16k", 16384, 0, 32768), B.Banking("paged16k-base", 16384, 0, 16384),
    B.Banking("paged8k", 8192, 0, 24576), B.Banking("wide64k-c0", 65536, 192, 0), B.Banking("page4k", 4096, 0, 0), B.Banking("page1k", 1024, 0, 0),
]
_BANK_SQL = "b(name, size, first_bank, base) AS (VALUES " + ", ".join(f"('{b.name}', {b.size}, {b.first_bank}, {b.base})" for b in BANKINGS) + ")"


@query("f1_hex_round_trip", "SELECT o_orderkey, printf('0x%06X', o_orderkey * 1009) AS text, o_orderkey * 1009 AS back, CAST(NULL AS BIGINT) AS bad FROM orders")
def f1(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", B.format_hex(F.col("o_orderkey") * 1009).alias("text"))
    return o.select("o_orderkey", "text", B.parse_hex(F.col("text")).alias("back"), B.parse_hex(F.concat(F.col("text"), F.lit("g"))).alias("bad"))


@query(
    "f2_banked_address",
    f"WITH {_BANK_SQL} SELECT o_orderkey, name, printf('%02X', o_orderkey * 4093 // size + first_bank) || ':' || printf('%04X', o_orderkey * 4093 % size + base) AS text, o_orderkey * 4093 AS back FROM orders, b",
)
def f2(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 4093).alias("offset"), F.explode(F.array(*[b.columns() for b in BANKINGS])).alias("b"))
    shown = each.select("o_orderkey", "b", B.format_address(F.col("offset"), F.col("b")).alias("text"))
    return shown.select("o_orderkey", "b.name", "text", B.parse_address(F.col("text"), F.col("b")).alias("back"))


_LAYOUT = B.parse_layout("vhop ppii iiii iiii")


@query(
    "f3_bit_field_unpack",
    """SELECT l_orderkey, l_linenumber, w, (w >> 15) & 1 AS v, (w >> 14) & 1 AS h, (w >> 13) & 1 AS o, (w >> 10) & 7 AS p, w & 1023 AS i, w AS packed
FROM (SELECT l_orderkey, l_linenumber, l_partkey * 257 % 65536 AS w FROM lineitem)""",
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 257 % 65536).alias("w"))
    fields = w.select("*", *[B.unpack_field(F.col("w"), b).alias(c) for c, b in _LAYOUT.items()])
    return fields.withColumn("packed", B.pack_fields({c: F.col(c) for c in _LAYOUT}, _LAYOUT))


_BGR = B.parse_layout("-bbbbbgggggrrrrr")


@query(
    "f4_field_scaling",
    """SELECT l_orderkey, l_linenumber, w, 4278190080 + ((r << 3) | (r >> 2)) * 65536 + ((g << 3) | (g >> 2)) * 256 + ((b << 3) | (b >> 2)) AS argb
FROM (SELECT l_orderkey, l_linenumber, w, w & 31 AS r, (w >> 5) & 31 AS g, (w >> 10) & 31 AS b FROM (SELECT l_orderkey, l_linenumber, l_partkey * 37 % 32768 AS w FROM lineitem))""",
)
def f4(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 37 % 32768).alias("w"))
    return w.withColumn("argb", B.decode_rgb(F.col("w"), _BGR))


@query(
    "f5_format_round_trip_loss",
    f"""WITH {COLORS_SQL}, q AS (SELECT argb, (argb >> 19) & 31 AS r, (argb >> 11) & 31 AS g, (argb >> 3) & 31 AS b FROM colors)
SELECT argb, 4278190080 + ((r << 3) | (r >> 2)) * 65536 + ((g << 3) | (g >> 2)) * 256 + ((b << 3) | (b >> 2)) AS held,
  argb <> 4278190080 + ((r << 3) | (r >> 2)) * 65536 + ((g << 3) | (g >> 2)) * 256 + ((b << 3) | (b >> 2)) AS lossy, count(*) AS n FROM q GROUP BY ALL""",
)
def f5(spark: SparkSession, d: str) -> DataFrame:
    c = colors(spark, d).groupBy("argb").agg(F.count("*").alias("n"))
    held = B.decode_rgb(B.encode_rgb(F.col("argb"), _BGR), _BGR)
    return c.select("argb", held.alias("held"), (held != F.col("argb")).alias("lossy"), "n")


@query("f6_luma", f"WITH {COLORS_SQL} SELECT l_orderkey, l_linenumber, argb, (argb >> 24) * 16777216 + (299 * ((argb >> 16) & 255) + 587 * ((argb >> 8) & 255) + 114 * (argb & 255)) // 1000 * 65793 AS gray FROM colors")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return colors(spark, d).select("l_orderkey", "l_linenumber", "argb", B.to_gray(F.col("argb")).alias("gray"))


@query("f7_sub_byte_entries", "SELECT p_partkey, k, (p_size >> (2 * k)) & 3 AS v FROM part, (SELECT unnest(range(0, 4)) AS k)")
def f7(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return p.select("p_partkey", "k", F.expr("shiftright(p_size, 2 * k) & 3").alias("v"))


_BYTES = "bytes AS (SELECT doc_id, pos, ascii(substr(text, pos + 1, 1)) % 256 AS v FROM (SELECT doc_id, text, unnest(range(0, length(text))) AS pos FROM documents))"


def byte_arrays(spark: SparkSession, d: str, empties: bool = False) -> DataFrame:
    """(doc_id, vs): codes of the characters of the whole text modulo 256, for texts that have any; with empties, one 0 for a text of none."""
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c) % 256)
    docs = table(spark, d, "documents").where(F.length("text") >= (0 if empties else 1))
    return docs.select("doc_id", F.filter(codes, lambda v: v.isNotNull()).alias("vs"))


def text_bytes(spark: SparkSession, d: str, empties: bool = False) -> DataFrame:
    """(doc_id, pos, v): code of each character of the whole text modulo 256; see byte_arrays."""
    return byte_arrays(spark, d, empties).select("doc_id", F.posexplode("vs").alias("pos", "v")).where(F.col("v") >= 0)


@query("f8_value_substitution", f"""WITH {_BYTES}, t AS (SELECT doc_id, (pos >> 1) & 1 AS sel, pos, CASE WHEN (pos >> 1) & 1 = 0 THEN (v * 5 + 3) % 256 ELSE (v * 77 + 41) % 256 END AS w FROM bytes)
SELECT doc_id, sel, count(*) AS n, CAST(sum(w) AS BIGINT) AS total, CAST(sum(w * (pos % 997)) AS BIGINT) AS placed FROM t GROUP BY doc_id, sel""")
def f8(spark: SparkSession, d: str) -> DataFrame:
    done = S.substitute(text_bytes(spark, d), ["doc_id"], "pos", "v", _tables(spark, 256), [1])
    return done.groupBy("doc_id", "sel").agg(F.count("*").alias("n"), F.sum("to").alias("total"), F.sum(F.col("to") * (F.col("pos") % 997)).alias("placed"))


def _tables(spark: SparkSession, size: int) -> DataFrame:
    """Two bijections of 0 .. size - 1, by rule."""
    tables = spark.range(2 * size).select((F.col("id") / size).cast("int").alias("sel"), (F.col("id") % size).cast("int").alias("v"))
    return tables.withColumn("to", F.when(F.col("sel") == 0, (F.col("v") * 5 + 3) % size).otherwise((F.col("v") * 77 + 41) % size))


@query("f8_substitution_undone", f"""WITH {_BYTES}, n AS (SELECT doc_id, count(*) AS n FROM bytes GROUP BY doc_id),
u AS (SELECT doc_id, pos - pos % 2 AS first, sum(CASE WHEN pos % 2 = 0 THEN v * 256 ELSE v END) AS w, count(*) AS k FROM bytes GROUP BY doc_id, pos - pos % 2),
m AS (SELECT doc_id, first, k, CASE WHEN k < 2 THEN w WHEN (first >> 3) & 1 = 0 THEN (w * 5 + 3) % 65536 ELSE (w * 77 + 41) % 65536 END AS w FROM u),
b AS (SELECT doc_id, CASE WHEN k = 2 THEN w // 256 + w % 256 ELSE w // 256 END AS s FROM m)
SELECT doc_id, CAST(sum(s) AS BIGINT) AS total, any_value(n) % 2 = 1 AS tail, true AS undone FROM b JOIN n USING (doc_id) GROUP BY doc_id""")
def f8u(spark: SparkSession, d: str) -> DataFrame:
    """Units of two bytes under a selector of bit 3, a single last byte left as it is, and the way back."""
    tables = _tables(spark, 65536)
    there = S.substitute_words(S.words_of(byte_arrays(spark, d), ["doc_id"], "vs", 2), tables, [3], 2)
    back = S.substitute_words(there.select("doc_id", "first", "n", F.col("word").alias("was"), F.col("new").alias("word")), S.inverse(tables), [3], 2)
    made = F.shiftright("word", 8) + F.col("word") % 256
    tail = (F.sum("n") % 2 == 1).alias("tail")
    return back.groupBy("doc_id").agg(F.sum(made).alias("total"), tail, F.bool_and(F.col("new") == F.col("was")).alias("undone"))


_POS = "pos AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part)"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """part keys are dense from 0, so the key is the position and no global window is needed."""
    return table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("pos"))


@query("f9_address_bit_permutation", f"WITH {_POS} SELECT p_partkey, pos, (pos >> 4 << 4) | ((pos >> 2) & 1) | (((pos >> 0) & 1) << 1) | (((pos >> 3) & 1) << 2) | (((pos >> 1) & 1) << 3) AS moved FROM pos")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, d).withColumn("moved", B.permute_bits(F.col("pos"), [2, 0, 3, 1]))


@query("f10_part_interleave", f"WITH {_POS}, n AS (SELECT count(*) // 8 * 8 AS n FROM pos) SELECT p_partkey, pos, CASE WHEN pos < n THEN (pos % (n // 2)) // 4 * 8 + (pos // (n // 2)) * 4 + pos % (n // 2) % 4 ELSE pos END AS \"to\", CASE WHEN pos < n THEN pos - pos % 2 + 1 - pos % 2 ELSE pos END AS swapped FROM pos, n")
def f10(spark: SparkSession, d: str) -> DataFrame:
    p = _positions(spark, d)
    n = p.agg((F.floor(F.count("*") / 8) * 8).alias("n"))
    half = F.floor(F.col("n") / 2)
    inside, part = F.col("pos") % half, F.floor(F.col("pos") / half)
    to = B.interleaved(part, F.floor(inside / 4), inside % 4, 2, 4)
    whole = F.col("pos") < F.col("n")
    return p.crossJoin(F.broadcast(n)).select("p_partkey", "pos", F.when(whole, to).otherwise(F.col("pos")).alias("to"), F.when(whole, F.col("pos").bitwiseXOR(1)).otherwise(F.col("pos")).alias("swapped"))


@query("f14_morton_index", """WITH g AS (SELECT o_orderkey AS pos, o_orderkey % 32 AS x, o_orderkey // 32 % 16 AS y FROM orders)
SELECT pos, x, y, x // 16 * 256 + ((x & 1) | ((y & 1) << 1) | ((x & 2) << 1) | ((y & 2) << 2) | ((x & 4) << 2) | ((y & 4) << 3) | ((x & 8) << 3) | ((y & 8) << 4)) AS z FROM g""")
def f14(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 32).alias("x"), (F.floor(F.col("o_orderkey") / 32) % 16).alias("y"))
    return g.withColumn("z", B.block_morton(F.col("x"), F.col("y"), 32, 16))


@query("f15_bit_plane_unpack", """WITH t AS (SELECT doc_id, tile, substr(text, CAST(tile * 16 + 1 AS INTEGER), 16) AS s FROM (SELECT doc_id, text, unnest(range(0, length(text) // 16)) AS tile FROM documents)),
p AS (SELECT doc_id, tile, i, ((ascii(substr(s, CAST(i // 8 + 1 AS INTEGER), 1)) % 256) >> (7 - i % 8)) & 1 AS lo, ((ascii(substr(s, CAST(i // 8 + 9 AS INTEGER), 1)) % 256) >> (7 - i % 8)) & 1 AS hi FROM t, (SELECT unnest(range(0, 64)) AS i))
SELECT doc_id, tile, string_agg(CAST(lo + 2 * hi AS VARCHAR), '' ORDER BY i) AS pixels FROM p GROUP BY doc_id, tile""")
def f15(spark: SparkSession, d: str) -> DataFrame:
    """Two planes of 8 bytes a tile of 16 bytes: bit k of a pixel comes from plane k; partial tiles drop."""
    # cut in one pass: a substring of a text is sought from its beginning
    pieces = F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{16}"), F.lit(0))).alias("tile", "s")
    tiles = table(spark, d, "documents").select("doc_id", pieces).withColumn("tile", F.col("tile").cast("long"))
    return tiles.select("doc_id", "tile", B.plane_pixels(F.col("s"), [0, 8], 8, 8).alias("pixels"))


@query("f17_row_base", "SELECT l_orderkey, l_linenumber, ((l_linenumber - 3) % 5 + 5) % 5 AS wrapped, greatest(0, l_linenumber - 3) AS clamped FROM lineitem")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", B.drawn_row(F.col("l_linenumber"), -3, 5).alias("wrapped"), B.drawn_row(F.col("l_linenumber"), -3).alias("clamped"))


@query("f18_saturating_shift", "SELECT l_orderkey, l_linenumber, greatest(0, least(255, CAST(floor(l_quantity) AS BIGINT) * 6 - 20)) AS v, (greatest(0, least(255, CAST(floor(l_quantity) AS BIGINT) * 6 - 20)) * 7 + 1) % 256 AS remapped FROM lineitem")
def f18(spark: SparkSession, d: str) -> DataFrame:
    v = B.shifted(F.floor("l_quantity") * 6, -20)
    remap = F.create_map(*[F.lit(x) for i in range(256) for x in (i, (i * 7 + 1) % 256)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), remap[v.cast("int")].alias("remapped"))
