"""Permutations, alias chains, cycles of functional graphs and connected regions.

Iterations are joins whose number grows with the logarithm of the data; each round's table is
written to the cluster's shared folder, so a lost executor costs a round, and deleted when the next
one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import orient
from bitloom.sources.shared import discard, stored


def _round(table: DataFrame) -> DataFrame:
    """A table of a round, to be joined by a merge: its files are far smaller than its rows, so Spark would send it through the driver each round."""
    return table.hint("merge")


def cycle_labels(df: DataFrame, node: str, next_: str) -> DataFrame:
    """(node, on_cycle, label): nodes of an out-degree-1 graph; label is the least node of the cycle, null off cycles.

    After doubling the pointers past n steps every image lies on a cycle, and every cycle node is an
    image; the least node seen while doubling from a cycle node is its cycle's label. Doubling ends as soon as
    a round leaves the number of images and every least node as they were: the walk then permutes its
    images, so all of them lie on cycles, and each has seen its whole cycle. A node with several
    targets has the least of them. Rounds are merge joins, see _round.
    """
    links = stored(df.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(next_).alias("to")))
    walk = stored(links.join(_round(links.select(F.col("node").alias("to"), F.lit(True).alias("there"))), "to", "left").select("node", F.when(F.col("there"), F.col("to")).alias("jump"), F.col("node").alias("least")))
    steps, n, images = 1, links.count(), None
    while steps < n:
        ahead = walk.select(F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("least").alias("ahead"))
        least = F.least("least", "ahead")
        further = stored(walk.join(_round(ahead), "jump", "left").select("node", F.col("far").alias("jump"), least.alias("least"), (least < F.col("least")).alias("moved")))
        discard(walk)
        walk = further
        steps *= 2
        seen = walk.agg(F.count_distinct("jump").alias("images"), F.bool_or("moved").alias("moved")).first()
        if not seen["moved"] and seen["images"] == images:
            break
        images = seen["images"]
    on = walk.where("jump is not null").select(F.col("jump").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    # the walk of a cycle node has gone all the way round by now
    return walk.join(_round(on), "node", "left").select("node", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), F.when(F.col("on_cycle"), F.col("least")).alias("label"))


def reference_cycles(df: DataFrame, node: str, next_: str) -> DataFrame:
    """(label, node, members): the nodes of each cycle, which has `members` of them."""
    on = cycle_labels(df, node, next_).where("on_cycle").select("label", "node")
    return on.join(_round(on.groupBy("label").agg(F.count("*").alias("members"))), "label")


def chain_ends(aliases: DataFrame, old: str, new: str) -> DataFrame:
    """(old, last): the id at the end of each alias chain; a chain that loops ends at its own loop's least id.

    Pointers double until none moves, so rounds grow with the logarithm of the longest chain; loops
    are cut by their label first. An id with several aliases has the least of them.
    """
    links = aliases.where(F.col(old).isNotNull() & F.col(new).isNotNull()).groupBy(F.col(old).alias("old")).agg(F.min(new).alias("last"))
    loops = cycle_labels(links, "old", "last").where("on_cycle").select(F.col("node").alias("old"), "label")
    ends = links.join(_round(loops), "old", "left").select("old", F.coalesce("label", "last").alias("last"), F.col("label").isNotNull().alias("looped"))
    ends = stored(ends)
    while True:
        ahead = ends.select(F.col("old").alias("last"), F.col("last").alias("far"))
        next_ = F.when(F.col("looped"), F.col("last")).otherwise(F.coalesce("far", "last"))
        further = stored(ends.join(_round(ahead), "last", "left").select("old", next_.alias("last"), "looped", (next_ != F.col("last")).alias("moved")))
        discard(ends)
        ends = further
        if ends.where("moved").isEmpty():
            return ends.select("old", "last")


def forward(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with ids forwarded along their alias chains; unknown ids stay."""
    ends = chain_ends(aliases, "old", "new").select(F.col("old").alias("_old"), F.col("last").alias("_last"))
    joined = df.join(ends, F.col(column) == F.col("_old"), "left")
    return joined.select(*[F.coalesce("_last", column).alias(c) if c == column else F.col(c) for c in df.columns])


def gather(df: DataFrame, slot: str, mapping: DataFrame, inverse: bool = False) -> DataFrame:
    """df with actual, the stored id of each displayed slot (or slot of each id, inverse); identity where unmapped."""
    a, b = ("actual", "virtual") if inverse else ("virtual", "actual")
    m = mapping.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    return df.join(m, F.col(slot) == F.col("_a"), "left").select(*df.columns, F.coalesce("_b", slot).alias("actual"))


def compose(mapping: DataFrame, moves: DataFrame) -> DataFrame:
    """(virtual, actual): the map read through a bijective move set (to, source); identity pairs drop."""
    moved = moves.join(mapping.withColumnRenamed("virtual", "source"), "source", "left").select(F.col("to").alias("virtual"), F.coalesce("actual", "source").alias("actual"))
    still = mapping.join(moves.select(F.col("to").alias("virtual")), "virtual", "left_anti").select("virtual", "actual")
    return moved.unionByName(still).where("virtual <> actual")


def bounded(mapping: DataFrame, count: int) -> DataFrame:
    """Pairs of the permutation cycles all of whose members lie below count."""
    labels = cycle_labels(mapping, "virtual", "actual")
    kept = labels.where("on_cycle").groupBy("label").agg(F.max("node").alias("top")).where(F.col("top") < count)
    inside = labels.join(_round(kept), "label", "left_semi").select(F.col("node").alias("virtual"))
    return mapping.join(_round(inside), "virtual", "left_semi")


def oriented(orientations: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, flags): orientations with turns (id, flags) applied on top, each keyed by what is turned; upright ones drop.

    Moves leave orientations alone: they belong to an id, wherever it is shown. Several turns of one id
    have to come one after the other.
    """
    a, b = orientations.select("id", F.col("flags").alias("_held")), turns.select("id", F.col("flags").alias("_turn"))
    both = a.join(b, "id", "full_outer")
    flags = orient.compose(F.coalesce("_turn", F.lit(0)), F.coalesce("_held", F.lit(0)))
    return both.select("id", flags.alias("flags")).where("flags <> 0")


def shown(mapping: DataFrame, orientations: DataFrame, slots: DataFrame, slot: str) -> DataFrame:
    """slots with actual, the id that each shows, and flags, how that id is turned; identity and 0 where nothing is stored."""
    placed = gather(slots, slot, mapping)
    held = orientations.select(F.col("id").alias("_id"), F.col("flags").alias("_flags"))
    return placed.join(held, F.col("actual") == F.col("_id"), "left").select(*placed.columns, F.coalesce("_flags", F.lit(0)).alias("flags"))


def turned_block(mapping: DataFrame, orientations: DataFrame, moves: DataFrame, flags: int) -> tuple[DataFrame, DataFrame]:
    """(mapping, orientations) after a block of slots is turned as a whole.

    moves (to, source) say which slot of the block each slot takes its id from, fixed ones included; every
    id that is moved is also turned itself by flags.
    """
    held = gather(moves.select("source"), "source", mapping)
    turns = held.select(F.col("actual").alias("id"), F.lit(flags).alias("flags"))
    return compose(mapping, moves), oriented(orientations, turns)


def bounded_orientations(orientations: DataFrame, count: int) -> DataFrame:
    """Orientations of ids below count: each is dropped by itself, unlike the pairs of a cycle."""
    return orientations.where(F.col("id") < count)


def regions(grid: DataFrame, value: str = "v") -> DataFrame:
    """(pos, region): 4-connected areas of equal value, named by their least position.

    Cells of a row with equal values are fused into runs first; runs of neighbouring rows that
    overlap and agree are edges. Each round hooks every region to its least neighbour, shortens the
    hooks to their ends by pointer jumping and contracts the edges, so rounds grow with the
    logarithm of the number of runs, whatever a region's shape.
    """
    w = Window.partitionBy("y").orderBy("x")
    fresh = ~((F.lag("x").over(w) == F.col("x") - 1) & F.lag(value).over(w).eqNullSafe(F.col(value)))
    marked = grid.withColumn("_f", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_r", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = stored(marked.withColumn("run", F.min("pos").over(Window.partitionBy("y", "_r"))).select("pos", "x", "y", value, "run"))
    # neighbours below meet on an equi join of positions; distinct leaves one edge a pair of runs
    up = cells.select("x", (F.col("y") + 1).alias("y"), F.col(value).alias("_v"), F.col("run").alias("a"))
    live = stored(cells.join(_round(up), ["x", "y"]).where(F.col(value).eqNullSafe(F.col("_v"))).select(F.least("a", "run").alias("a"), F.greatest("a", "run").alias("b")).distinct())
    found = cells.select("run", F.col("run").alias("region")).distinct()
    while not live.isEmpty():
        both = live.select(F.col("a").alias("id"), F.col("b").alias("n")).union(live.select(F.col("b"), F.col("a")))
        hook = stored(both.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("root")))
        while True:
            ahead = hook.select(F.col("id").alias("root"), F.col("root").alias("far"))
            raised = stored(hook.join(_round(ahead), "root").select("id", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
            discard(hook)
            hook = raised
            if raised.where("moved").isEmpty():
                break
        hooked, hook = hook, hook.select("id", "root")
        placed = stored(found.join(_round(hook.withColumnRenamed("id", "region")), "region", "left").select("run", F.coalesce("root", "region").alias("region")))
        if hasattr(found, "_stored_at"):
            discard(found)
        found = placed
        a, b = hook.select(F.col("id").alias("a"), F.col("root").alias("x")), hook.select(F.col("id").alias("b"), F.col("root").alias("y"))
        rest = stored(live.join(_round(a), "a").join(_round(b), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
        discard(live, hooked)
        live = rest
    discard(live)
    return cells.select("pos", "run").join(_round(found), "run").select("pos", "region")


def fill(grid: DataFrame, seed: int, value: str = "v", bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(pos): the 4-connected area of equal value around the cell at position `seed`, inside bounds (x, y, width, height).

    A seed that the grid lacks or that lies outside the bounds gives nothing. Only cells of the
    seed's value inside the bounds are looked at.
    """
    inside = grid
    if bounds:
        x, y, w, h = bounds
        inside = grid.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    start = inside.where(F.col("pos") == seed).select(F.col(value).alias("_seed"))
    alike = inside.join(F.broadcast(start.limit(1)), F.col(value).eqNullSafe(F.col("_seed")), "left_semi")
    found = regions(alike, value)
    return found.join(F.broadcast(found.where(F.col("pos") == seed).select("region").limit(1)), "region", "left_semi").select("pos")
