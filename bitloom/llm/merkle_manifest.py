"""Merkle manifest of a dataset: levels stored as parent-linked rows, proofs by a recursive query.

Each row is a leaf. Leaves of one tree are numbered by a range shuffle, and rounds of one grouping each
build six levels at once: 64 neighbouring nodes meet, and each of them becomes a stored row with
its siblings on the way up those levels and a link to the row of its ancestor there. The subroots of
all trees are the leaves of a last tree.

A Spark recursive query starts from every leaf, each with the hash to be folded. A step joins a climbing
leaf with the row its link names, appends that row's siblings and folds the hash with them, until
the root's row gives no further link.

A node high up is an ancestor of many leaves, so its row is stored once for each lane of 64
neighbouring leaves below it: every join key has 64 leaves at most, and the copies are a 64th of the
leaves for each round above the second. Copies are made in two steps, lest one task make those of a
whole tree. Rows grow with the leaves, so they are joined by a shuffle at every size, never broadcast. A
task holds 64 nodes of a group.

Defined results: a null value counts as `-`; a null lang is a tree of its own, before all others;
null ids come first within a tree and are not tampered with; rows of one id are ordered by their leaf,
and equal rows are leaves each; texts of any length are hashed whole; extra columns, of any name, are
ignored; a single leaf is its own root, with an empty proof; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.llm.common import discard, stored, table

#: Levels that a round builds, and the nodes that meet for it.
STRIDE = 6
FAN = 1 << STRIDE
#: Leaves of a lane: those below one node after one round.
LANE = FAN
#: Lanes that one row is copied to at once.
COPIES = 4096
#: The tree over the subroots; the names of other trees are not empty.
TOP = ""


def field(c: Column | str) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column | str]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def numbered(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """leaves with place, the number from 0 within their tree in order, and n, the leaves of the tree.

    Rows are numbered within range partitions, over the counts of a tree in the partitions before.
    """
    parted = stored(leaves.repartitionByRange(tree, *order).withColumn("_p", F.spark_partition_id()), "leaves")
    local = parted.withColumn("_n", F.row_number().over(Window.partitionBy("_p", tree).orderBy(*order)))
    sizes = parted.groupBy(tree, "_p").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(tree)
    before = sizes.select(tree, "_p", (F.sum("_c").over(w.orderBy("_p")) - F.col("_c")).alias("_b"), F.sum("_c").over(w).alias("n"))
    out = local.join(before, [tree, "_p"]).withColumn("place", F.col("_b") + F.col("_n") - 1).drop("_p", "_n", "_b")
    out._parted = parted
    return out


def _above(level: Column) -> Column:
    """Hashes of each two neighbours, a lone last one by itself."""
    pair = lambda i: F.sha2(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)


def built(nodes: DataFrame, payload: list[str], most: int) -> list[DataFrame]:
    """Rounds of (tree, n, up, members, top, depth, lo, hi): groups of up to FAN nodes with their levels.

    nodes: tree, place, n, hash, lo, hi (the lanes below) and the payload, kept in the first round.
    members are (place, hash, lo, hi, payload, siblings) in order. A tree whose round has FAN nodes at most ends
    there: depth says after how many levels one node is left, and top is that node. most is the
    greatest n.
    """
    rounds = []
    while True:
        held = F.array_sort(F.collect_list(F.struct("place", "hash", "lo", "hi", *payload)))
        d = nodes.withColumn("up", F.floor(F.col("place") / FAN).cast("long")).groupBy("tree", "n", "up").agg(held.alias("g"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        d = d.withColumn("l0", F.transform("g", lambda x: x["hash"]))
        for j in range(STRIDE):
            d = d.withColumn(f"l{j + 1}", _above(F.col(f"l{j}")))
        depth = F.when(F.col("n") > FAN, STRIDE).when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
        d = d.withColumn("depth", depth.cast("int")).withColumn("top", F.get(F.element_at(F.array(*[f"l{j}" for j in range(STRIDE + 1)]), F.col("depth") + 1), F.lit(0)))
        beside = lambda i: F.array(*[F.when(F.lit(j) < F.col("depth"), F.unhex(F.get(F.col(f"l{j}"), F.shiftright(i, j).bitwiseXOR(F.lit(1))))) for j in range(STRIDE)])
        members = F.transform("g", lambda x, i: F.struct(*[x[c].alias(c) for c in ("place", "hash", "lo", "hi")], *[x[c].alias(c) for c in payload], beside(i).alias("siblings")))
        done = stored(d.select("tree", "n", "up", members.alias("members"), "top", "depth", "lo", "hi"), "levels")
        rounds.append(done)
        if most <= FAN:
            return rounds
        most = -(-most // FAN)
        nodes = done.where(F.col("n") > FAN).select("tree", F.col("up").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), F.col("top").alias("hash"), "lo", "hi")
        payload = []


def climbable(step: DataFrame, payload: list[str]) -> DataFrame:
    """One row a member: tree, n, place, lo, hi, siblings, side (its number in the group), depth, up and the payload."""
    x = step.select("tree", "n", "up", "depth", F.posexplode("members").alias("side", "m"))
    return x.select("tree", "n", "up", "depth", F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"), "side", F.col("m.place").alias("place"), F.col("m.siblings").alias("siblings"), *[F.col(f"m.{c}").alias(c) for c in payload])


#: Folds a hash with the siblings of a row; bit j of side says that the sibling of level j stands to the left.
_FOLD = """unhex(aggregate(sequence(0, {last}), lower(hex({hash})), (a, j) -> CASE WHEN j >= {row}.depth THEN a ELSE sha2(concat(
    CASE WHEN shiftright({row}.side, j) % 2 = 1 THEN coalesce(lower(hex({row}.siblings[j])), '') ELSE '' END, a,
    CASE WHEN shiftright({row}.side, j) % 2 = 0 THEN coalesce(lower(hex({row}.siblings[j])), '') ELSE '' END), 256) END))"""
_APPENDED = "unhex(concat_ws('', transform({row}.siblings, x -> hex(x))))"

CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT l.owner, l.lane, l.id, l.leaf, l.up_step, l.up_place, {_FOLD.format(hash="l.changed", row="l", last=STRIDE - 1)} AS folded, {_APPENDED.format(row="l")} AS proof FROM {{leaves}} l
  UNION ALL
  SELECT /*+ MERGE(r) */ c.owner, c.lane, c.id, c.leaf, r.up_step, r.up_place, {_FOLD.format(hash="c.folded", row="r", last=STRIDE - 1)}, concat(c.proof, {_APPENDED.format(row="r")})
  FROM climb c JOIN {{rows}} r ON c.owner = r.owner AND c.lane = r.lane AND c.up_step = r.step AND c.up_place = r.place
)
SELECT owner, id, leaf, folded, proof FROM climb WHERE up_step IS NULL"""


def manifest(leaves: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded) for leaves of (tree, id, leaf, changed).

    leaf and changed are hex hashes: the tree is built of leaf, and folded is the root that the proof
    makes of changed. tree is a string that is not empty or null; trees and subroots go by its bytes.
    proof is the bytes of all siblings, from the leaf to the root.
    """
    spark = leaves.sparkSession
    number = numbered(leaves, "tree", ["id", "leaf"])
    lane = F.floor(F.col("place") / LANE).cast("long")
    first = number.select("tree", "place", "n", F.col("leaf").alias("hash"), "id", F.unhex("leaf").alias("leaf"), F.unhex("changed").alias("changed"), lane.alias("lo"), lane.alias("hi"))
    most = number.agg(F.max("n")).first()[0]
    if most is None:
        discard(number._parted)
        return spark.createDataFrame([], leaves.select("id", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.lit(b"").alias("proof"), F.col("leaf").alias("folded")).schema)
    payload = ["id", "leaf", "changed"]
    own = built(first, payload, most)
    discard(number._parted)
    ends = [d.where(F.col("n") <= FAN).select(F.col("tree").alias("owner"), F.col("top").alias("subroot"), F.lit(i + 1).alias("rounds"), F.col("hi").alias("lanes")) for i, d in enumerate(own)]
    subroots = stored(numbered(reduce(DataFrame.unionByName, ends).withColumn("tree", F.lit(TOP)), "tree", ["owner"]).drop("tree"), "subroots")
    trees = subroots.count()
    over = subroots.select(F.lit(TOP).alias("tree"), "place", "n", F.col("subroot").alias("hash"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    top = built(over, [], trees)
    root = top[-1].first()["top"]

    columns = ["owner", "step", "place", "siblings", "side", "depth", "up_step", "up_place"]
    whole = lambda c: F.col(c).cast("long")
    links = [
        climbable(d, []).withColumn("step", F.lit(i)).withColumn("up_step", F.lit(i + 1)).withColumnRenamed("tree", "owner").withColumn("up_place", whole("up")).select("lo", "hi", *columns)
        for i, d in enumerate(own) if i
    ]
    for i, d in enumerate(top):
        path = subroots.select("owner", "rounds", "lanes", F.floor(F.col("place") / FAN**i).cast("long").alias("place")).join(climbable(d, []).select("place", "siblings", "side", "depth"), "place")
        up = F.lit(None).cast("int") if i + 1 == len(top) else F.col("rounds") + i + 1
        links.append(path.select(F.lit(0).cast("long").alias("lo"), F.col("lanes").alias("hi"), "owner", (F.col("rounds") + i).alias("step"), F.lit(0).cast("long").alias("place"), "siblings", "side", "depth", up.alias("up_step"), F.lit(0).cast("long").alias("up_place")))
    some = reduce(DataFrame.unionByName, links).withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(COPIES).cast("long")))).repartition("owner", "step", "place", "lo")
    rows = stored(some.select(F.explode(F.sequence("lo", F.least("hi", F.col("lo") + COPIES - 1))).alias("lane"), *columns), "links")
    starts = climbable(own[0], payload).select(F.col("tree").alias("owner"), F.floor(F.col("place") / LANE).cast("long").alias("lane"), "id", "leaf", "changed", "siblings", "side", "depth", F.lit(1).alias("up_step"), F.col("up").alias("up_place"))

    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        climbed = stored(spark.sql(CLIMB, leaves=starts, rows=rows), "climbed")
    finally:
        spark.conf.set(limit, before)
    discard(*own, *top, rows)
    hexed = lambda c: F.lower(F.hex(c))
    return climbed.join(subroots.select("owner", "subroot"), "owner").select("id", hexed("leaf").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof", hexed("folded").alias("folded"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, id, leaf, changed) of documents; changed is the leaf of a tampered row where the id is chosen."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    before, after = ["doc_id", "source", "lang"], ["text"]
    leaf = leaf_hash([*before, "n_chars", *after])
    changed = F.when(chosen & F.col("n_chars").isNotNull(), leaf_hash([*before, F.col("n_chars").cast("decimal(20,0)") + 1, *after])).otherwise(F.col("leaf"))
    tree = F.coalesce(F.concat(F.lit("v"), "lang"), F.lit("n"))
    return docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), leaf.alias("leaf"), *before, "n_chars", *after).select("tree", "id", "leaf", changed.alias("changed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(document_leaves(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: Trees as lists: one row a level, then each leaf climbs both.
OP13_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + CAST(xor(crc, 4294967295) % 7 = 0 AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(xor(crc, 4294967295) % 7 = 0 AS INT)), '-') || tail) AS changed FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
tree(lang, level, hashes) AS (
  SELECT lang, 0, list(leaf ORDER BY place) FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(hashes), 2), lambda i: sha256(hashes[i + 1] || coalesce(hashes[i + 2], ''))) FROM tree WHERE len(hashes) > 1),
subroots AS (SELECT lang, level AS height, hashes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tree WHERE len(hashes) = 1),
crown(level, hashes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(hashes), 2), lambda i: sha256(hashes[i + 1] || coalesce(hashes[i + 2], ''))) FROM crown WHERE len(hashes) > 1),
links AS (
  SELECT s.lang, t.level AS step, t.hashes, CAST(NULL AS BIGINT) AS at FROM subroots s JOIN tree t ON t.lang IS NOT DISTINCT FROM s.lang AND t.level < s.height
  UNION ALL
  SELECT s.lang, s.height + c.level, c.hashes, s.place >> c.level FROM subroots s JOIN crown c ON len(c.hashes) > 1),
climb(doc_id, lang, leaf, step, place, folded, proof) AS (
  SELECT doc_id, lang, leaf, 0, place, changed, '' FROM placed
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, c.step + 1, c.place // 2,
         CASE WHEN coalesce(l.at, c.place) % 2 = 1 THEN sha256(l.hashes[coalesce(l.at, c.place)] || c.folded) ELSE sha256(c.folded || coalesce(l.hashes[coalesce(l.at, c.place) + 2], '')) END,
         c.proof || coalesce(l.hashes[xor(coalesce(l.at, c.place), 1) + 1], '')
  FROM climb c JOIN links l ON l.lang IS NOT DISTINCT FROM c.lang AND l.step = c.step)
SELECT c.doc_id, c.leaf, s.subroot, r.root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.root AS verified
FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang, (SELECT hashes[1] AS root, level FROM crown WHERE len(hashes) = 1) r
WHERE c.step = s.height + r.level"""
