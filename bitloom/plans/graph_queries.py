"""Demo queries of permutations, orientations, chains, cycles and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import orient as O
from bitloom.operators import graph as G
from bitloom.plans.registry import query
from bitloom.sources.tables import grid, table

#: Permutation of part keys: within each ten, 0->1->2->0 and 4<->7.
_MAP_SQL = "map AS (SELECT p_partkey AS virtual, p_partkey + CASE p_partkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN -2 WHEN 4 THEN 3 WHEN 7 THEN -3 END AS actual FROM part WHERE p_partkey % 10 IN (0, 1, 2, 4, 7))"


def _map(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 10
    step = F.when(k == 0, 1).when(k == 1, 1).when(k == 2, -2).when(k == 4, 3).when(k == 7, -3)
    return table(spark, d, "part").where(k.isin(0, 1, 2, 4, 7)).select(F.col("p_partkey").alias("virtual"), (F.col("p_partkey") + step).alias("actual"))


@query("j20_permutation_gather", f"WITH {_MAP_SQL} SELECT p_partkey, coalesce(m.actual, p_partkey) AS actual, coalesce(i.virtual, p_partkey) AS back FROM part LEFT JOIN map m ON m.virtual = p_partkey LEFT JOIN map i ON i.actual = p_partkey")
def j20(spark: SparkSession, d: str) -> DataFrame:
    p, m = table(spark, d, "part").select("p_partkey"), _map(spark, d)
    return G.gather(G.gather(p, "p_partkey", m), "p_partkey", m, inverse=True).toDF("p_partkey", "actual", "back")


_MOVES_SQL = 'moves AS (SELECT p_partkey AS "to", p_partkey + CASE p_partkey % 10 WHEN 0 THEN 1 ELSE -1 END AS source FROM part WHERE p_partkey % 10 IN (0, 1))'


@query(
    "j21_permutation_compose",
    f"""WITH {_MAP_SQL}, {_MOVES_SQL}, n AS (SELECT "to" AS virtual, coalesce(actual, source) AS actual FROM moves LEFT JOIN map ON map.virtual = source
UNION ALL SELECT virtual, actual FROM map WHERE virtual NOT IN (SELECT "to" FROM moves)) SELECT virtual, actual FROM n WHERE virtual <> actual""",
)
def j21(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 10
    moves = table(spark, d, "part").where(k.isin(0, 1)).select(F.col("p_partkey").alias("to"), (F.col("p_partkey") + F.when(k == 0, 1).otherwise(-1)).alias("source"))
    return G.compose(_map(spark, d), moves)


#: Orientations 1 to 7 of ids by rule; the block of keys 0 and 1 of each ten is mirrored as a whole.
_HELD_SQL = "held AS (SELECT p_partkey AS id, p_partkey % 8 AS f FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 8 <> 0)"


def _held(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").where((k % 3 == 0) & (k % 8 != 0)).select(k.alias("id"), (k % 8).cast("int").alias("flags"))


@query(
    "j21_turned_blocks",
    f"""WITH {_MAP_SQL}, {_MOVES_SQL}, {_HELD_SQL}, n AS (SELECT "to" AS virtual, coalesce(actual, source) AS actual FROM moves LEFT JOIN map ON map.virtual = source
UNION ALL SELECT virtual, actual FROM map WHERE virtual NOT IN (SELECT "to" FROM moves)),
t AS (SELECT coalesce(actual, source) AS id FROM moves LEFT JOIN map ON map.virtual = source),
o AS (SELECT p_partkey AS id, CASE WHEN t.id IS NULL THEN coalesce(f, 0) WHEN coalesce(f, 0) & 4 = 4 THEN xor(f, 2) ELSE xor(coalesce(f, 0), 1) END AS flags
  FROM part LEFT JOIN held ON held.id = p_partkey LEFT JOIN t ON t.id = p_partkey)
SELECT p_partkey, coalesce(n.actual, p_partkey) AS actual, CAST(coalesce(o.flags, 0) AS INT) AS flags FROM part LEFT JOIN n ON n.virtual = p_partkey LEFT JOIN o ON o.id = coalesce(n.actual, p_partkey)""",
)
def j21t(spark: SparkSession, d: str) -> DataFrame:
    """Two neighbouring slots swapped and mirrored in x: what they show is turned on top of what it was."""
    k = F.col("p_partkey") % 10
    moves = table(spark, d, "part").where(k.isin(0, 1)).select(F.col("p_partkey").alias("to"), (F.col("p_partkey") + F.when(k == 0, 1).otherwise(-1)).alias("source"))
    mapping, turned = G.turned_block(_map(spark, d), _held(spark, d), moves, 1)
    return G.shown(mapping, turned, table(spark, d, "part").select("p_partkey"), "p_partkey")


@query("g2_bounded_orientations", f"WITH {_HELD_SQL} SELECT id, CAST(f AS INT) AS flags FROM held WHERE id < 1235")
def g2o(spark: SparkSession, d: str) -> DataFrame:
    return G.bounded_orientations(_held(spark, d), 1235)


@query(
    "f16_orientation_group",
    """WITH g AS (SELECT o_orderkey AS pos, o_orderkey % 8 AS f1, o_custkey % 8 AS f2, o_orderkey % 40 % 8 AS x, o_orderkey // 40 % 8 AS y FROM orders),
a AS (SELECT *, CASE WHEN f1 & 1 = 1 THEN 7 - x ELSE x END AS ax, CASE WHEN f1 & 2 = 2 THEN 7 - y ELSE y END AS ay FROM g),
b AS (SELECT pos, f1, f2, CASE WHEN f1 & 4 = 4 THEN ay ELSE ax END AS x1, CASE WHEN f1 & 4 = 4 THEN ax ELSE ay END AS y1 FROM a),
c AS (SELECT *, CASE WHEN f2 & 1 = 1 THEN 7 - x1 ELSE x1 END AS qx, CASE WHEN f2 & 2 = 2 THEN 7 - y1 ELSE y1 END AS qy FROM b)
SELECT pos, CASE WHEN f2 & 4 = 4 THEN qy ELSE qx END AS x2, CASE WHEN f2 & 4 = 4 THEN qx ELSE qy END AS y2, true AS same, 0 AS identity FROM c""",
)
def f16(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 8).alias("f1"), (F.col("o_custkey") % 8).alias("f2"), (F.col("o_orderkey") % 40 % 8).alias("x"), (F.floor(F.col("o_orderkey") / 40) % 8).alias("y"))
    f1, f2 = F.col("f1"), F.col("f2")
    x1, y1 = O.apply(f1, F.col("x"), F.col("y"), 8, 8)
    g = g.withColumns({"x1": x1, "y1": y1})
    x2, y2 = O.apply(f2, F.col("x1"), F.col("y1"), 8, 8)
    cx, cy = O.apply(O.compose(f2, f1), F.col("x"), F.col("y"), 8, 8)
    return g.select("pos", x2.alias("x2"), y2.alias("y2"), ((x2 == cx) & (y2 == cy)).alias("same"), O.compose(O.invert(f1), f1).alias("identity"))


_NEXT_SQL = "nx AS (SELECT c_custkey AS n, (c_custkey * 6 + 3) % (SELECT count(*) FROM customer) AS t FROM customer)"


def _next(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    return c.crossJoin(F.broadcast(c.agg(F.count("*").alias("total")))).select(F.col("c_custkey").alias("n"), ((F.col("c_custkey") * 6 + 3) % F.col("total")).alias("t"))


_CYCLES = f"""{_NEXT_SQL}, img AS (SELECT n, t, 1 AS k FROM nx UNION ALL SELECT img.n, nx.t, k + 1 FROM img JOIN nx ON nx.n = img.t WHERE k < 40),
cyc AS (SELECT DISTINCT t AS n FROM img WHERE k = 40),
walk AS (SELECT cyc.n, cyc.n AS t, 0 AS k FROM cyc UNION ALL SELECT walk.n, nx.t, k + 1 FROM walk JOIN nx ON nx.n = walk.t WHERE k < 400),
lab AS (SELECT n, min(t) AS label FROM walk GROUP BY n)"""


@query("g1_cycle_labels", f"WITH RECURSIVE {_CYCLES} SELECT nx.n AS node, label IS NOT NULL AS on_cycle, label FROM nx LEFT JOIN lab ON lab.n = nx.n")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return G.cycle_labels(_next(spark, d), "n", "t")


@query("q17_reference_cycles", f"WITH RECURSIVE {_CYCLES} SELECT label, n AS node, count(*) OVER (PARTITION BY label) AS members FROM lab")
def q17(spark: SparkSession, d: str) -> DataFrame:
    """One row a node, so that a cycle of any length is no single row."""
    return G.reference_cycles(_next(spark, d), "n", "t")


@query("g2_cycle_closed_bound", f"WITH {_MAP_SQL} SELECT virtual, actual FROM map WHERE virtual - virtual % 10 + CASE WHEN virtual % 10 < 3 THEN 2 ELSE 7 END < 1235")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return G.bounded(_map(spark, d), 1235)


@query("g3_alias_chains", """WITH RECURSIVE al AS (SELECT s_suppkey AS old, CASE WHEN s_suppkey % 7 <> 6 THEN s_suppkey + 1 END AS new FROM supplier), c AS (SELECT old, new AS last FROM al WHERE new IS NOT NULL UNION ALL SELECT c.old, al.new FROM c JOIN al ON al.old = c.last WHERE al.new IS NOT NULL)
SELECT old, max(last) AS last FROM c GROUP BY old""")
def g3(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("old"), F.when(F.col("s_suppkey") % 7 != 6, F.col("s_suppkey") + 1).alias("new"))
    return G.chain_ends(s, "old", "new")


@query("j16_alias_forwarding", """WITH RECURSIVE al AS (SELECT n_nationkey AS old, n_nationkey + 2 AS new FROM nation WHERE n_nationkey % 5 < 3), c AS (SELECT old, new AS last FROM al UNION ALL SELECT c.old, al.new FROM c JOIN al ON al.old = c.last),
e AS (SELECT old, max(last) AS last FROM c GROUP BY old) SELECT c_custkey, coalesce(last, c_nationkey) AS c_nationkey FROM customer LEFT JOIN e ON old = c_nationkey""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    al = table(spark, d, "nation").where("n_nationkey % 5 < 3").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 2).alias("new"))
    return G.forward(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", al)


_EDGES = """g AS (SELECT o_orderkey AS pos, o_orderkey % 40 AS x, o_orderkey // 40 AS y, o_custkey % 3 AS v FROM orders),
e AS (SELECT a.pos AS p, b.pos AS q FROM g a JOIN g b ON a.v = b.v AND a.y = b.y AND b.pos = a.pos + 1 UNION ALL SELECT b.pos, a.pos FROM g a JOIN g b ON a.v = b.v AND a.y = b.y AND b.pos = a.pos + 1
 UNION ALL SELECT a.pos, b.pos FROM g a JOIN g b ON a.v = b.v AND b.pos = a.pos + 40 UNION ALL SELECT b.pos, a.pos FROM g a JOIN g b ON a.v = b.v AND b.pos = a.pos + 40)"""


@query("g4_connected_regions", f"WITH RECURSIVE {_EDGES}, f AS (SELECT pos AS seed, pos FROM g UNION SELECT f.seed, q FROM f JOIN e ON p = f.pos) SELECT pos, min(seed) AS region FROM f GROUP BY pos")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return G.regions(grid(spark, d).drop("o_orderstatus"))


@query("g4_flood_fill", f"WITH RECURSIVE {_EDGES}, f AS (SELECT CAST(45 AS BIGINT) AS pos UNION SELECT q FROM f JOIN e ON p = pos) SELECT pos FROM f")
def g4f(spark: SparkSession, d: str) -> DataFrame:
    """The region of the cell at position 45."""
    return G.fill(grid(spark, d).drop("o_orderstatus"), 45)


@query("g4_bounded_fill", f"WITH RECURSIVE {_EDGES}, f AS (SELECT pos FROM g WHERE pos = 130 UNION SELECT q FROM f JOIN e ON p = f.pos JOIN g ON g.pos = q WHERE g.x BETWEEN 4 AND 23 AND g.y BETWEEN 2 AND 13) SELECT pos FROM f")
def g4b(spark: SparkSession, d: str) -> DataFrame:
    """The part of the region of the cell at position 130 that lies inside a rectangle; a seed outside it adds nothing."""
    cells = grid(spark, d).drop("o_orderstatus")
    return G.fill(cells, 130, bounds=(4, 2, 20, 12)).union(G.fill(cells, 30, bounds=(4, 2, 20, 12)))
