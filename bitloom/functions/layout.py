"""Column expressions between slots, positions and ids of a grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_FIRST, COLUMNS_FIRST, ROW_INTERLEAVE = "rows", "columns", "interleave"


@dataclass(frozen=True)
class Blocks:
    """A canvas `columns` wide, cut into blocks, whose slots are filled in one of three orders.

    A block wider than the canvas is cut to it. Row interleave fills the even rows of a block
    before its odd rows.
    """

    columns: int
    block_columns: int
    block_rows: int
    order: str = ROWS_FIRST

    @property
    def width(self) -> int:
        return min(self.block_columns, self.columns)

    @property
    def across(self) -> int:
        return max(1, self.columns // self.width)

    @property
    def size(self) -> int:
        return self.width * self.block_rows

    def position(self, slot: Column) -> tuple[Column, Column]:
        """(x, y) of a slot."""
        block, k = F.floor(slot / self.size), slot % self.size
        if self.order == COLUMNS_FIRST:
            x, y = F.floor(k / self.block_rows), k % self.block_rows
        else:
            x, y = k % self.width, F.floor(k / self.width)
            if self.order == ROW_INTERLEAVE:
                even = (self.block_rows + 1) // 2
                y = F.when(y < even, 2 * y).otherwise(2 * (y - even) + 1)
        return block % self.across * self.width + x, F.floor(block / self.across) * self.block_rows + y

    def slot(self, x: Column, y: Column, slots: int | None = None) -> Column:
        """Slot at (x, y); null right of the last whole block or past `slots`."""
        bx, by, ix, iy = F.floor(x / self.width), F.floor(y / self.block_rows), x % self.width, y % self.block_rows
        if self.order == COLUMNS_FIRST:
            k = ix * self.block_rows + iy
        else:
            if self.order == ROW_INTERLEAVE:
                even = (self.block_rows + 1) // 2
                iy = F.when(iy % 2 == 0, F.floor(iy / 2)).otherwise(even + F.floor(iy / 2))
            k = iy * self.width + ix
        out = (by * self.across + bx) * self.size + k
        good = (x >= 0) & (y >= 0) & (bx < self.across)
        return F.when(good & (out < slots) if slots is not None else good, out)


def page_place(page: Column, columns: int, rows: int, pages: int, across: int) -> Blocks | None:
    """Blocks that lay pages out side by side, or None (identity) when they fill no rectangle."""
    return Blocks(columns * across, columns, rows) if across > 0 and pages % across == 0 else None


def reflow(pos: Column, bytes_per_row: int, tile_rows: int, columns: int) -> Column:
    """Where a byte of a wide bitmap lands when each stripe's rows are gathered tile by tile."""
    stripe = bytes_per_row * tile_rows * columns
    s, k = F.floor(pos / stripe), pos % stripe
    line, rest = F.floor(k / (bytes_per_row * columns)), k % (bytes_per_row * columns)
    return s * stripe + F.floor(rest / bytes_per_row) * (bytes_per_row * tile_rows) + line * bytes_per_row + rest % bytes_per_row


def unit_ids(first: Column, across: int, down: int, stride: int, column_stride: int, flip_h: Column, flip_v: Column) -> Column:
    """Array of ids of an across x down unit in drawn order; a flip turns the order of its axis."""
    n = across * down

    def at(i: Column) -> Column:
        x, y = i % across, F.floor(i / across)
        x, y = F.when(flip_h, across - 1 - x).otherwise(x), F.when(flip_v, down - 1 - y).otherwise(y)
        return first + y * stride + x * column_stride

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def settle(df: DataFrame, x: str, y: str, across: int, down: int, order: str, value: str) -> DataFrame:
    """df with settled, the value of the first member of each across x down square, and members."""
    w = Window.partitionBy(F.floor(F.col(x) / across), F.floor(F.col(y) / down))
    first = F.first(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("settled", first).withColumn("members", F.count("*").over(w))
