"""Connected components of a large edge table, by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable from each id that edges (a, b) name.

    Every round hooks each component to its least neighbour, shortens the hooks to their roots and
    contracts the edges, so at least half of the components that still have an edge vanish; round
    tables are written to the shared folder and deleted when the next ones stand. Self loops, repeated edges and nulls are harmless.
    """
    link = edges.where("a is not null and b is not null")
    live = stored(link.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    found = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("id"), "b").union(live.select(F.col("b").alias("id"), "a"))
        hook = stored(both.groupBy("id").agg(F.min("b").alias("next")).select("id", F.least("id", "next").alias("root")), "hooks")
        while True:
            up = hook.select(F.col("id").alias("root"), F.col("root").alias("above"))
            raised = stored(hook.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")), "hooks")
            discard(hook)
            hook = raised
            if hook.where("moved").isEmpty():
                break
        to = hook.select(F.col("id").alias("component"), F.col("root"))
        if found is None:
            found = stored(hook.select("id", F.col("root").alias("component")), "components")
        else:
            placed = stored(found.join(to, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "components")
            discard(found)
            found = placed
        a, b = hook.select(F.col("id").alias("a"), F.col("root").alias("x")), hook.select(F.col("id").alias("b"), F.col("root").alias("y"))
        rest = stored(live.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
        discard(live, hook)
        live = rest
    if found is None:
        found = stored(live.select(F.col("a").alias("id"), F.col("a").alias("component")), "components")
    discard(live)
    return found
