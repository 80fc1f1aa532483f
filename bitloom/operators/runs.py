"""Runs and ordered groups: run-length coding, hidden runs, terminators, line splits, first claims.

Ordered groups are laid out by ranges of (keys, order), see operators/scan.py: a key that holds most of
the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.scan import MANY, PART, carried, laid, running, within


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, carry: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(keys, run, value, length, carry): maximal runs of equal values in a total order, numbered from 0.

    carry names columns of which each run keeps the least value.
    """
    d = carried(laid(df, keys, order, parts), keys, {"_l": F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))}, {"_before": lambda w: F.lag("_l").over(w)})
    before = F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(within(keys, order)), F.col("_before"))
    d = d.withColumn("_f", (before.isNull() | ~before["v"].eqNullSafe(F.col(value))).cast("long"))
    d = running(d, keys, order, F.col("_f"), "_n").withColumn("run", F.col("_n") + F.col("_f") - 1)
    return d.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("length"), *[F.min(c).alias(c) for c in carry])


def run_packets(coded: DataFrame, keys: list[str], value: str, max_packet: int, min_run: int) -> DataFrame:
    """Runs cut into packets of at most max_packet; packets of fewer than min_run are literals.

    (keys, run, piece, value, length, literal)
    """
    pieces = coded.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / max_packet).cast("int"))))
    length = F.least(F.lit(max_packet), F.col("length") - F.col("piece") * max_packet)
    return pieces.withColumn("length", length).withColumn("literal", F.col("length") < min_run).select(*keys, "run", "piece", value, "length", "literal")


def expand_runs(packets: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """(keys, pos, value): packets decoded to rows, numbered from 0 within their keys."""
    order = ["run", "piece"]
    based = running(laid(packets.select(*keys, *order, value, "length"), keys, order, parts), keys, order, F.col("length"), "_base")
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1))
    return based.where("length > 0").select(*keys, value, "_base", place.alias("_k")).select(*keys, (F.col("_base") + F.col("_k")).alias("pos"), value)


def row_runs(df: DataFrame, pos: str, columns: int, hidden: Column) -> DataFrame:
    """(x, y, width): runs of positions where `hidden` holds, never across a row of `columns`."""
    placed = df.select(F.col(pos).alias("p"), hidden.alias("h")).withColumn("y", F.floor(F.col("p") / columns))
    w = Window.partitionBy("y").orderBy("p")
    island = placed.where("h").withColumn("g", F.col("p") - F.row_number().over(w))
    return island.groupBy("y", "g").agg(F.min("p").alias("s"), F.count("*").alias("width")).select(F.pmod("s", F.lit(columns)).alias("x"), "y", "width")


def until_terminator(steps: DataFrame, keys: list[str], order: str, ends: Column, groups: DataFrame) -> DataFrame:
    """Steps of each group before its first terminator; groups without a step stay, with nulls.

    The first terminators are an aggregate of one row a key that has one. Null keys are a group.
    """
    first = steps.where(ends).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(order).alias("_end"))
    joined = steps.join(first, [steps[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(keys)], "left")
    kept = joined.where(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).select(*[steps[c].alias(f"_s_{c}") for c in steps.columns])
    rest = [c for c in steps.columns if c not in keys]
    out = groups.join(kept, [groups[k].eqNullSafe(kept[f"_s_{k}"]) for k in keys], "left")
    return out.select(*[groups[c] for c in groups.columns], *[F.col(f"_s_{c}").alias(c) for c in rest])


def split_lines(df: DataFrame, keys: list[str], order: str, breaks: Column, parts: int | None = None) -> DataFrame:
    """df with line: how many breaks stand before the row; a break ends the line it stands in."""
    return running(laid(df, keys, [order], parts), keys, [order], F.coalesce(breaks, F.lit(False)).cast("int"), "line").drop(PART, MANY)


def line_stretches(lines: DataFrame, keys: list[str], order: str, body: str, width: int = 4096, parts: int | None = None) -> DataFrame:
    """(keys, line, stretch, body): the bodies of split lines joined by spaces, `width` rows a stretch at most.

    A line of any length is many rows of bounded size, in order of stretch; one that fits is a single row.
    """
    by = [*keys, "line"]
    d = running(laid(lines.select(*by, order, body), by, [order], parts), by, [order], F.lit(1), "_n")
    held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, body))), lambda s: s[body]), " ")
    return d.withColumn("stretch", F.floor(F.col("_n") / width)).groupBy(*by, "stretch").agg(held.alias("body"))


def whole_lines(lines: DataFrame, keys: list[str], order: str, body: str, width: int = 4096, parts: int | None = None) -> DataFrame:
    """(keys, line, body): the whole body of each split line, put together from its stretches; a line is one row, as its text is one value."""
    by = [*keys, "line"]
    stretches = line_stretches(lines, keys, order, body, width, parts)
    held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stretch", "body"))), lambda s: s["body"]), " ")
    return stretches.groupBy(*by).agg(held.alias("body"))


def claims(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df with owner: is this row the first to claim its key."""
    return df.withColumn("owner", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)
