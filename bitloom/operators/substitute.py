"""Substitution of values by tables that bits of their position choose, and its inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selector(pos: Column, bits: list[int]) -> Column:
    """The number that bits of a position spell: bit i of it is bit bits[i] of the position."""
    return sum((F.shiftleft(F.shiftright(pos, b).bitwiseAND(1), i) for i, b in enumerate(bits)), F.lit(0)).cast("int")


def unsound_tables(tables: DataFrame, size: int) -> DataFrame:
    """(sel, problem) of tables (sel, v, to) that are no bijection of 0 .. size - 1; none if all are."""
    by = tables.groupBy("sel").agg(
        F.count("*").alias("n"), F.count_distinct("v").alias("given"), F.count_distinct("to").alias("made"),
        F.min(F.least("v", "to")).alias("low"), F.max(F.greatest("v", "to")).alias("high"),
    )
    problem = F.when((F.col("n") != size) | (F.col("given") != size), "not one row a value").when(F.col("made") != size, "two values become one").when((F.col("low") < 0) | (F.col("high") >= size), "a value outside")
    return by.select("sel", problem.alias("problem")).where("problem is not null")


def inverse(tables: DataFrame) -> DataFrame:
    """The tables that undo `tables`, under the same selector: a substitution moves nothing."""
    return tables.select("sel", F.col("to").alias("v"), F.col("v").alias("to"))


def substitute(df: DataFrame, key: list[str], pos: str, value: str, tables: DataFrame, selector_bits: list[int], unit: int = 1) -> DataFrame:
    """(key, pos, sel, value, to): bytes replaced by the table that bits of their unit's first position choose.

    tables (sel, v, to) are bijections of 256 ** unit values, see unsound_tables; they are joined by size
    as Spark measures it. A unit is `unit` neighbouring bytes, the first one the highest. Bytes of a
    unit that is not whole at the end pass through, and so does a value that no table has.
    """
    t = tables.select(F.col("sel").alias("_sel"), F.col("v").alias("_v"), F.col("to").alias("_to"))
    if unit == 1:
        d = df.select(*key, pos, selector(F.col(pos), selector_bits).alias("sel"), value)
        out = d.join(t, (F.col("sel") == F.col("_sel")) & (F.col(value) == F.col("_v")), "left")
        return out.select(*key, pos, "sel", value, F.coalesce("_to", value).cast("int").alias("to"))
    shift = lambda p: F.pow(F.lit(256), unit - 1 - F.pmod(p, F.lit(unit))).cast("long")
    first = (F.col(pos) - F.pmod(F.col(pos), F.lit(unit))).alias("first")
    units = df.groupBy(*key, first).agg(F.sum(F.col(value) * shift(F.col(pos))).alias("word"), F.count(value).alias("n"))
    done = substitute_words(units, tables, selector_bits, unit)
    byte = lambda w, i: (F.floor(w / F.pow(F.lit(256), unit - 1 - i)).cast("long") % 256).cast("int")
    every = done.select(*key, "first", "sel", "word", "new", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("_i"))
    return every.select(*key, (F.col("first") + F.col("_i")).alias(pos), "sel", byte(F.col("word"), F.col("_i")).alias(value), byte(F.col("new"), F.col("_i")).alias("to"))


def words_of(df: DataFrame, key: list[str], values: str, unit: int) -> DataFrame:
    """(key, first, n, word): the units of an array of bytes, cut where it lies, so that no byte is a shuffled row."""
    starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(unit))
    cut = F.transform(starts, lambda i: F.struct(i.cast("long").alias("first"), F.slice(values, i + 1, unit).alias("b")))
    each = df.where(F.size(values) > 0).select(*key, F.explode(cut).alias("_u")).select(*key, "_u.*")
    byte = lambda i: F.coalesce(F.get("b", F.lit(i)).cast("long"), F.lit(0)) * 256 ** (unit - 1 - i)
    return each.select(*key, "first", F.size("b").cast("long").alias("n"), sum((byte(i) for i in range(1, unit)), byte(0)).alias("word"))


def substitute_words(units: DataFrame, tables: DataFrame, selector_bits: list[int], unit: int) -> DataFrame:
    """units (first, n, word) with sel and new, the word that the table gives; a unit that is not whole keeps its own.

    Tables of at most a million rows in all are sent to the units; they are bounded by unit and selector, not by the data.
    """
    t = tables.select(F.col("sel").alias("_sel"), F.col("v").alias("_v"), F.col("to").alias("_to"))
    if 256**unit << len(selector_bits) <= 1 << 20:
        t = F.broadcast(t)
    d = units.withColumn("sel", selector(F.col("first"), selector_bits))
    done = d.join(t, (F.col("sel") == F.col("_sel")) & (F.col("word") == F.col("_v")) & (F.col("n") == unit), "left")
    return done.withColumn("new", F.coalesce("_to", "word").cast("long")).drop("_sel", "_v", "_to")
