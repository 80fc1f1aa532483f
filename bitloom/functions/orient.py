"""The eight orientations of a square: bit 0 flips x, bit 1 flips y, bit 2 transposes afterwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _swapped(flags: Column) -> Column:
    """The flip bits with x and y exchanged."""
    return F.shiftleft(flags.bitwiseAND(1), 1).bitwiseOR(F.shiftright(flags, 1).bitwiseAND(1))


def compose(second: Column, first: Column) -> Column:
    """The orientation that applies `first` and then `second`."""
    turned = first.bitwiseAND(4) != 0
    flips = F.when(turned, _swapped(second)).otherwise(second.bitwiseAND(3)).bitwiseXOR(first.bitwiseAND(3))
    return flips.bitwiseOR(first.bitwiseXOR(second).bitwiseAND(4))


def invert(flags: Column) -> Column:
    turned = flags.bitwiseAND(4) != 0
    return F.when(turned, _swapped(flags)).otherwise(flags.bitwiseAND(3)).bitwiseOR(flags.bitwiseAND(4))


def apply(flags: Column, x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """Where (x, y) goes; a turn is ignored where the area is not square."""
    fx = F.when(flags.bitwiseAND(1) != 0, width - 1 - x).otherwise(x)
    fy = F.when(flags.bitwiseAND(2) != 0, height - 1 - y).otherwise(y)
    if width != height:
        return fx, fy
    turned = flags.bitwiseAND(4) != 0
    return F.when(turned, fy).otherwise(fx), F.when(turned, fx).otherwise(fy)
