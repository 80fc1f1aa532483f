"""Maps of stamps: entries that name a rectangle of another table's cells, drawn position by position.

A sparse map has an entry for each drawn position, of which only those at the corners of stamps count. A
dense one has one entry a stamp, so its drawn picture is larger than its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(n: Column, unit: int) -> Column:
    """n divided by unit, without a remainder."""
    return F.floor(n / unit).cast("long")


def stamp_origin(position: Column, columns: int, across: int, down: int, dense: bool) -> Column:
    """The entry that a drawn position takes its stamp from: the stamp's corner, or the position over the stamp's size."""
    width = columns * across if dense else columns
    x, y = position % width, whole(position, width)
    if dense:
        return whole(y, down) * columns + whole(x, across)
    return (y - y % down) * columns + (x - x % across)


def expand_stamps(entries: DataFrame, pos: str, index: str, columns: int, across: int, down: int, source_columns: int, dense: bool = False) -> DataFrame:
    """(pos, entry, source): for each drawn position the entry it comes from and the cell id it shows.

    entries (pos, index) are numbered from 0 in rows of `columns`. A stamp walks the source's own rows
    from its index on. A dense map is drawn in whole rows of entries: the last row is filled up with
    blanks, of a null source, and so is every place whose entry is missing. A sparse map has as many
    positions as entries; a position whose corner has no entry is blank.
    """
    across, down, columns = max(1, across), max(1, down), max(1, columns)
    width = columns * across if dense else columns
    held = entries.select(F.col(pos).cast("long").alias("entry"), F.col(index).alias("_index"))
    if dense:
        # the entries that fill up the last row; fewer than a row, so no more than `columns` of them
        n = held.agg((F.max("entry") + 1).alias("n")).where("n is not null")
        filler = n.select(F.explode(F.sequence("n", F.ceil(F.col("n") / columns) * columns)).alias("entry"), "n").where(F.col("entry") < F.ceil(F.col("n") / columns) * columns)
        every = held.unionByName(filler.select("entry", F.lit(None).cast(held.schema["_index"].dataType).alias("_index")))
        place = F.explode(F.sequence(F.lit(0), F.lit(across * down - 1))).alias("_k")
        each = every.select("entry", "_index", place).withColumn("_x", F.col("_k") % across).withColumn("_y", whole(F.col("_k"), across))
        at = (whole(F.col("entry"), columns) * down + F.col("_y")) * width + F.col("entry") % columns * across + F.col("_x")
        return each.select(at.alias("pos"), F.when(F.col("_index").isNotNull(), F.col("entry")).alias("entry"), (F.col("_index") + F.col("_x") + F.col("_y") * source_columns).alias("source"))
    drawn = entries.select(F.col(pos).cast("long").alias("pos")).withColumn("_o", stamp_origin(F.col("pos"), columns, across, down, False))
    joined = drawn.join(held, F.col("_o") == F.col("entry"), "left")
    offset = F.col("pos") % width % across + whole(F.col("pos"), width) % down * source_columns
    return joined.select("pos", "entry", (F.col("_index") + offset).alias("source"))
