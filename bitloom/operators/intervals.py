"""Interval sets: half-open [start, end) spans with a value, kept canonical.

Every function takes key columns that name a set; a null key is a set like any other. A set may hold a
large share of all rows, so no window spans a whole set: rows are laid out by ranges of (set, start)
with borders taken from the data (operators/scan.py), windowed within their range, and only what a
range carries on, or its first and last piece, meets the next one. `parts` is the number of ranges.

Spans cost rows by their number, never by their length: a lookup takes the span that began last, and a write that covers whole ranges is split into aligned
powers of two of range numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bitloom.operators.scan import BEFORE, MANY, PART, SO_FAR, carried, fused, joined_pieces, laid, ranges_of, running, within
from bitloom.sources.shared import stored


def _reach(df: DataFrame, keys: list[str], order: list[str], parts: int | None) -> tuple[DataFrame, Column]:
    """Laid spans, and the greatest end before a row in its set."""
    live = laid(df, keys, order, parts)
    d = carried(live, keys, {"_top": F.max("end")}, {"_in": lambda w: F.max("_top").over(w.rowsBetween(*BEFORE))})
    return d, F.greatest(F.max("end").over(within(keys, order).rowsBetween(*BEFORE)), F.col("_in"))


def merge_spans(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """(keys, start, end, n): overlapping or abutting spans fused, empty ones dropped; n spans went in."""
    order = ["start", "end"]
    d, reach = _reach(df.where("end > start").select(*keys, "start", "end"), keys, order, parts)
    out = {"start": (F.min, F.col("start")), "end": (F.max, F.col("end")), "n": (F.sum, F.lit(1).cast("long"))}
    return fused(d, keys, order, F.col("start") > reach, out, lambda _: F.col("_island") == 0)


def _coalesced(d: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Laid disjoint spans with those fused that abut exactly and have equal values."""
    goes_on = lambda before: (before["end"] == F.col("start")) & before[value].eqNullSafe(F.col(value))
    before = F.lag(F.struct("end", value)).over(within(keys, ["start"]))
    out = {"start": (F.min, F.col("start")), "end": (F.max, F.col("end")), value: (F.first, F.col(value))}
    return fused(d, keys, ["start"], ~goes_on(before), out, goes_on)


def coalesce_spans(df: DataFrame, keys: list[str], value: str = "row", parts: int | None = None) -> DataFrame:
    """Disjoint spans that abut exactly and have equal values fused."""
    return _coalesced(laid(df.select(*keys, "start", "end", value), keys, ["start"], parts), keys, value)


def normalize_spans(df: DataFrame, keys: list[str], value: str = "row", parts: int | None = None) -> DataFrame:
    """Earlier start wins: each start moves to the end reached so far, covered spans vanish, equal neighbours fuse."""
    d, reach = _reach(df.where("end > start").select(*keys, "start", "end", value), keys, ["start", "end", value], parts)
    moved = d.withColumn("start", F.greatest("start", F.coalesce(reach, F.col("start")))).where("end > start")
    return _coalesced(moved, keys, value)


def _aligned(low: Column, high: Column, levels: int = 31) -> Column:
    """Aligned powers of two (level, at) that make up [low, high) of whole numbers from 0 to 2**31: two a level at most."""
    pieces = []
    for level in range(levels):
        unit = 1 << level
        a, b = F.shiftright(low + (unit - 1), level), F.shiftright(high, level)
        open_ = a < b
        pieces += [F.when(open_ & (a % 2 == 1), F.struct(F.lit(level).alias("level"), a.alias("at"))), F.when(open_ & (b % 2 == 1) & ~((a == b - 1) & (a % 2 == 1)), F.struct(F.lit(level).alias("level"), (b - 1).alias("at")))]
    return F.filter(F.array(*pieces), lambda x: x.isNotNull())


class _Reverse:
    """Orders the other way; None comes last."""

    __slots__ = ("v",)

    def __init__(self, v: object) -> None:
        self.v = v

    def __lt__(self, other: _Reverse) -> bool:
        return self.v is not None and (other.v is None or other.v < self.v)

    def __eq__(self, other: object) -> bool:
        return self.v == other.v


def _swept(keys: list[str], value: str, seq: str, schema: StructType):
    """A pass over writes in order of (range, set, start): pieces (set, start, end, value) of the winning writes."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, heap, piece, count, rows, types = None, 0, [], None, 0, [], None

        def give(edge: bool) -> None:
            nonlocal piece, count
            if piece is not None:
                count += 1
                rows.append((*last, count, edge or count == 1, *piece))
                piece = None

        def advance(to: int | None) -> None:
            nonlocal place, piece
            while heap and (to is None or place < to):
                end, v = heap[0][2:]
                if end <= place:
                    heapq.heappop(heap)
                    continue
                stop = end if to is None else min(end, to)
                if piece is not None and piece[1] == place and piece[2] == v:
                    piece = (piece[0], stop, v)
                else:
                    give(False)
                    piece = (place, stop, v)
                place = stop

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

        for b in batches:
            kinds = [f.type for f in b.schema]
            types = [*kinds[: n + 2], pa.int64(), pa.bool_(), kinds[n + 2], kinds[n + 3], kinds[n + 5]]
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, (start, end, order, v) = row[: n + 2], row[n + 2 :]
                if key != last:
                    advance(None)
                    give(True)
                    last, heap, count = key, [], 0
                advance(start)
                place = start
                heapq.heappush(heap, (_Reverse(order), _Reverse(v), end, v))
            if len(rows) >= 4096:
                yield batch()
        advance(None)
        give(True)
        if rows:
            yield batch()

    return run


def overwrite_spans(writes: DataFrame, keys: list[str], seq: str = "seq", value: str = "row", parts: int | None = None) -> DataFrame:
    """A log of writes: at each place the last write wins, of equal seq the greater value; equal neighbours fuse.

    Writes lie in ranges by their start. One that goes on past its range is clipped there, comes again,
    clipped, in the range where it ends, and covers those between wholly: of such covers a range needs
    the latest alone, which is found over aligned powers of two of range numbers, two a level. Each
    range is then swept once, with a heap of the writes open.
    """
    # a log may be costly to make, and counting, borders and layout each read it
    live = stored(writes.where("end > start").select(*keys, "start", "end", seq, value), "writes")
    parts = parts or ranges_of(live)
    d = laid(live, keys, ["start"], parts)
    k = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    # the ranges of sets that have several: two a range at most
    stripes = d.where(MANY).groupBy(*keys, PART).agg(F.min("start").alias("low"))
    borders = stripes.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("low", F.col(PART).alias("part")))).alias("_borders"))
    own = d.join(F.broadcast(borders), [d[c].eqNullSafe(borders[f"_k{i}"]) for i, c in enumerate(keys)], "left").select(*[d[c] for c in d.columns], "_borders")
    after = F.filter("_borders", lambda b: (b["part"] > F.col(PART)) & (b["low"] < F.col("end")))
    own = own.withColumn("_after", F.when(F.col(MANY), after))
    crossing = F.coalesce(F.size("_after") > 0, F.lit(False))
    here = own.select(*keys, PART, MANY, "start", F.when(crossing, F.least("end", F.get("_after", F.lit(0))["low"])).otherwise(F.col("end")).alias("end"), seq, value)
    far = own.where(crossing).withColumn("_last", F.element_at("_after", -1))
    ending = far.select(*keys, F.col("_last.part").alias(PART), MANY, F.col("_last.low").alias("start"), "end", seq, value)
    tile = far.select(*keys, F.explode(_aligned(F.col(PART) + 1, F.col("_last.part"))).alias("_t"), F.struct(seq, value).alias("_w"))
    best = tile.groupBy(*k, F.col("_t.level").alias("level"), F.col("_t.at").alias("at")).agg(F.max("_w").alias("_w"))
    asked = stripes.join(borders, [stripes[c].eqNullSafe(borders[f"_k{i}"]) for i, c in enumerate(keys)])
    high = F.get(F.filter("_borders", lambda b: b["part"] > F.col(PART)), F.lit(0))["low"]
    asked = asked.select(*[stripes[c].alias(c) for c in keys], PART, "low", high.alias("high"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("_level"))
    covered = asked.join(best, [*[asked[c].eqNullSafe(best[f"_k{i}"]) for i, c in enumerate(keys)], asked["_level"] == best["level"], F.expr(f"shiftright({PART}, _level)") == best["at"]])
    covered = covered.groupBy(*keys, PART, "low", "high").agg(F.max("_w").alias("_w")).where("high is not null")
    cover = covered.select(*keys, PART, F.lit(True).alias(MANY), F.col("low").alias("start"), F.col("high").alias("end"), F.col(f"_w.{seq}").alias(seq), F.col(f"_w.{value}").alias(value))
    rows = here.unionByName(ending).unionByName(cover).select(PART, MANY, *keys, "start", "end", seq, value)
    types = {f.name: f for f in rows.schema.fields}
    schema = StructType([types[PART], types[MANY], *[types[c] for c in keys], *StructType.fromDDL("_island long, _edge boolean").fields, types["start"], types["end"], types[value]])
    swept = rows.repartition(parts, PART, *keys).sortWithinPartitions(PART, *keys, "start").mapInArrow(_swept(keys, value, seq, schema), schema)
    goes_on = lambda before: (before["end"] == F.col("start")) & before[value].eqNullSafe(F.col(value))
    # inner and outer pieces are taken apart below: the sweep is run once for both
    return joined_pieces(stored(swept, "swept"), keys, {"start": F.min, "end": F.max, value: F.first}, goes_on)


def subtract_spans(a: DataFrame, b: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """(keys, start, end): what the merged spans of a have outside the spans of b.

    Depth counters at breakpoints replace any pairing of spans.
    """

    def steps(d: DataFrame, which: str) -> DataFrame:
        other = "in_b" if which == "in_a" else "in_a"
        edge = lambda c, n: d.where("end > start").select(*keys, F.col(c).alias("at"), F.lit(n).alias(which), F.lit(0).alias(other))
        return edge("start", 1).unionByName(edge("end", -1))

    moved = steps(a, "in_a").unionByName(steps(b, "in_b")).groupBy(*keys, "at").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    before = lambda c: lambda w: F.sum(c).over(w.rowsBetween(*BEFORE))
    d = carried(
        laid(moved, keys, ["at"], parts), keys, {"_a": F.sum("in_a"), "_z": F.sum("in_b"), "_at": F.min("at")},
        {"_was_a": before("_a"), "_was_b": before("_z"), "_next": lambda w: F.lead("_at").over(w)},
    )
    w = within(keys, ["at"])
    depth = lambda c, was: F.sum(c).over(w.rowsBetween(BEFORE[0], 0)) + F.coalesce(was, F.lit(0))
    state = d.select(
        *keys, PART, MANY, F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.col("_next")).alias("end"),
        (depth("in_a", "_was_a") > 0).alias("a"), (depth("in_b", "_was_b") > 0).alias("b"), F.lit(0).alias("_none"),
    )
    return _coalesced(state.where("a and not b and end is not null"), keys, "_none").drop("_none")


def overlaps(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Each span whose next neighbour begins before it ends, with that neighbour's start and end.

    The order begins with the start.
    """
    row = F.struct(*order, F.col("start").alias("_s"), F.col("end").alias("_e"))
    d = carried(laid(df, keys, order, parts), keys, {"_first": F.min(row)}, {"_next": lambda w: F.lead("_first").over(w)})
    following = F.coalesce(F.lead(row).over(within(keys, order)), F.col("_next"))
    return d.withColumn("_f", following).select(*df.columns, F.col("_f._s").alias("next_start"), F.col("_f._e").alias("next_end")).where("next_start < end")


def clip_spans(df: DataFrame, keys: list[str], limit: int, max_row: int, value: str = "row", parts: int | None = None) -> DataFrame:
    """Disjoint spans within [0, limit) of rows up to max_row; spans across the limit are shortened."""
    kept = df.where((F.col("start") < limit) & (F.col(value) <= max_row)).withColumn("end", F.least("end", F.lit(limit)))
    return coalesce_spans(kept, keys, value, parts)


def gap_runs(df: DataFrame, keys: list[str], index: str, gap: int, parts: int | None = None) -> DataFrame:
    """(keys, first, count): runs of distinct indexes; a hole of up to `gap` indexes does not end a run."""
    ids = df.select(*keys, F.col(index).alias("first"), F.col(index).alias("last")).where(F.col(index).isNotNull()).distinct()
    goes_on = lambda before: F.col("first") - before["last"] <= gap + 1
    before = F.lag(F.struct("last")).over(within(keys, ["first"]))
    runs = fused(laid(ids, keys, ["first"], parts), keys, ["first"], ~goes_on(before), {"first": (F.min, F.col("first")), "last": (F.max, F.col("last"))}, goes_on)
    return runs.select(*keys, "first", (F.col("last") - F.col("first") + 1).alias("count"))


def level_of(length: Column) -> Column:
    """Least level whose tiles of 8**level are as long as a span, up to 20; a level next to it would do as well."""
    return F.least(F.greatest(F.ceil(F.log(8.0, F.greatest(length, F.lit(1)))), F.lit(0)), F.lit(20)).cast("int")


def value_at(points: DataFrame, regions: DataFrame, keys: list[str], point: str, value: str = "row", default: int | None = None, parts: int | None = None) -> DataFrame:
    """points with the value of the region that holds each point, or the default.

    Regions are disjoint within a set, and of any length: the one that began last before a point is the only
    one that may hold it. Points and regions lie in the same ranges, and a range is told which region began last before it.
    """
    held = stored(regions.where("end > start").select(*keys, F.col("start").alias("_at"), F.lit(False).alias("_ask"), F.struct(F.col("end").alias("end"), F.col(value).alias("v")).alias("_region")), "regions")
    asked = points.select(*keys, F.floor(point).alias("_at"), F.lit(True).alias("_ask"), F.struct(*points.columns).alias("_row"))
    d = laid(held.unionByName(asked, allowMissingColumns=True), keys, ["_at"], parts)
    began = F.when(~F.col("_ask"), F.col("_at"))
    d = carried(d, keys, {"_top": F.max_by("_region", began)}, {"_in": lambda w: F.last("_top", ignorenulls=True).over(w.rowsBetween(*BEFORE))})
    here = F.coalesce(F.last("_region", ignorenulls=True).over(within(keys, ["_at", "_ask"]).rowsBetween(*SO_FAR)), F.col("_in"))
    d = d.withColumn("_here", here).where("_ask")
    return d.select("_row.*", F.coalesce(F.when(F.col("_at") < F.col("_here.end"), F.col("_here.v")), F.lit(default)).alias(value))


def assembled(pieces: DataFrame, keys: list[str], order: str, length: str, parts: int | None = None) -> DataFrame:
    """pieces with start, the running sum of the lengths before each, in order within its set."""
    return running(laid(pieces, keys, [order], parts), keys, [order], F.col(length), "start").drop(PART, MANY)


def laid_out(pieces: DataFrame, keys: list[str], order: str, stated: str, source: str, unit: int, parts: int | None = None) -> DataFrame:
    """Pieces with extent, start and problem.

    A stated length is kept to the byte, short sources being filled with zeros; without one a piece
    runs to the source's end, rounded up to a unit; a missing source keeps a stated extent.
    """
    extent = F.coalesce(F.col(stated), F.ceil(F.col(source) / unit) * unit, F.lit(0))
    problem = F.when(F.col(source).isNull(), "missing").when(F.col(stated) > F.col(source), "short").otherwise("")
    return assembled(pieces.withColumn("extent", extent.cast("long")).withColumn("problem", problem), keys, order, "extent", parts)
