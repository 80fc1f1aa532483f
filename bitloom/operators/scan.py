"""Scans over a total order, spread over all tasks however many rows a key has.

Rows are dealt by ranges of (keys, order) and stored with the number of their range. A key that lies in
one range needs nothing else: windows run within (range, key). A key that goes on in a further range is
the first or the last key of each, so at most two keys a range do: for these, and for these alone, one
associative summary a range is carried on from range to range. That table has at most twice as many
rows as there are ranges, whatever the data, so it is broadcast. Borders come from the data; there is no
stretch of the axis to tune, and the order may be of any columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from bitloom.sources.shared import stored

#: Rows of a range: what a task sorts and holds is bounded by this, whatever the number of rows.
RANGE_ROWS = 1 << 17
#: Columns that laid() adds: the number of a row's range, and whether its key lies in several.
PART, MANY = "_part", "_many"
BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def _same(d: DataFrame, keys: list[str], other: DataFrame) -> list[Column]:
    return [d[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)]


def ranges_for(rows: int, partitions: int) -> int:
    """How many ranges so many rows are dealt to: those of Spark's shuffles, fewer for few rows, more for many."""
    return max(min(partitions, 1 + rows // 8192), 1 + rows // RANGE_ROWS)


def ranges_of(df: DataFrame) -> int:
    return ranges_for(df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def laid(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with PART and MANY, dealt by ranges of keys and order; rows that are equal in both share a range.

    parts is the number of ranges, else one for each RANGE_ROWS rows, or Spark's number of shuffle partitions if
    that is more. The table stays dealt by its ranges in as many tasks, so windows and groups within a range
    need no further shuffle, and a task's share does not grow with the table.
    """
    by = [*keys, *order]
    parts = parts or ranges_of(df)
    d = stored(df.repartitionByRange(parts, *by).withColumn(PART, F.spark_partition_id()), "laid")
    if not keys:
        return d.repartition(parts, PART).withColumn(MANY, F.lit(True))
    spread = d.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(PART).alias("_low"), F.max(PART).alias("_high")).where("_low < _high")
    dealt = d.repartition(parts, PART)
    marked = dealt.join(F.broadcast(spread), _same(dealt, keys, spread), "left")
    return marked.select(*[dealt[c] for c in d.columns], spread["_low"].isNotNull().alias(MANY))


def within(keys: list[str], order: list[str]) -> WindowSpec:
    """The rows of a key within a range, in order."""
    return Window.partitionBy(PART, MANY, *keys).orderBy(*order)


def carried(d: DataFrame, keys: list[str], summary: dict[str, Column], carry: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """A laid table with what its key's other ranges carry into each range; null for a key within one range.

    summary has an aggregate a range, carry a window expression over those of a key, by range.
    """
    per = d.where(MANY).groupBy(*keys, PART).agg(*[c.alias(n) for n, c in summary.items()])
    w = Window.partitionBy(*keys).orderBy(PART)
    state = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(PART).alias("_kp"), *[f(w).alias(n) for n, f in carry.items()])
    joined = d.join(F.broadcast(state), [*_same(d, keys, state), d[PART] == state["_kp"]], "left")
    return joined.select(*[d[c] for c in d.columns], *[state[n] for n in carry])


def running(d: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """A laid table with the sum of amount over the rows of its key before each row."""
    d = carried(d.withColumn("_a", amount), keys, {"_sum": F.sum("_a")}, {"_in": lambda w: F.sum("_sum").over(w.rowsBetween(*BEFORE))})
    here = F.coalesce(F.sum("_a").over(within(keys, order).rowsBetween(*BEFORE)), F.lit(0)) + F.coalesce("_in", F.lit(0))
    return d.withColumn(name, here).drop("_a", "_in")


def fused(d: DataFrame, keys: list[str], order: list[str], fresh: Column, out: dict[str, tuple[Callable, Column]], goes_on: Callable[[Column], Column]) -> DataFrame:
    """(keys, out): rows of a laid table cut into islands, one row each.

    A row opens an island where `fresh` holds or is null. `out` gives each result's aggregate, which may
    be taken in two steps, and its input. Of a range's islands only the first and the last can meet
    another range's: goes_on tells of the island before (a struct of `out`) whether a range's first
    island is its continuation; _island is 0 there if fresh did not hold for the range's first row.
    """
    w = within(keys, order)
    d = d.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("long"))
    d = d.withColumn("_island", F.sum("_fresh").over(w.rowsBetween(*SO_FAR)))
    pieces = d.groupBy(PART, MANY, *keys, "_island").agg(*[f(c).alias(n) for n, (f, c) in out.items()])
    ends = Window.partitionBy(PART, MANY, *keys)
    edge = (F.col("_island") <= 1) | (F.col("_island") == F.max("_island").over(ends))
    return joined_pieces(pieces.withColumn("_edge", edge), keys, {n: f for n, (f, _) in out.items()}, goes_on)


def joined_pieces(pieces: DataFrame, keys: list[str], out: dict[str, Callable], goes_on: Callable[[Column], Column]) -> DataFrame:
    """Pieces of ranges (PART, MANY, keys, _island, _edge, out) with those that go on in the next range made one."""
    inner = pieces.where(~F.col(MANY) | ~F.col("_edge")).select(*keys, *out)
    met = pieces.where(F.col(MANY) & F.col("_edge"))
    w = Window.partitionBy(*keys).orderBy(PART, "_island")
    before = F.lag(F.struct(*out)).over(w)
    first = (F.lag(PART).over(w) != F.col(PART)) & F.coalesce(goes_on(before), F.lit(False))
    met = met.withColumn("_new", (~F.coalesce(first, F.lit(False))).cast("long")).withColumn("_chain", F.sum("_new").over(w.rowsBetween(*SO_FAR)))
    return inner.unionByName(met.groupBy(*keys, "_chain").agg(*[f(F.col(n)).alias(n) for n, f in out.items()]).select(*keys, *out))
