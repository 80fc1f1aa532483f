"""Column expressions for addresses, bit fields, colours and positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_hex(text: Column) -> Column:
    """0x, $ or bare hex digits as a number up to 7FFFFFFFFFFFFFFF; null above that, or if the text is not that."""
    digits = F.regexp_extract(F.lower(F.trim(text)), r"^(?:0x|\$)?0*([0-9a-f]+)$", 1)
    fits = (F.length(digits) < 16) | ((F.length(digits) == 16) & (F.substring(digits, 1, 1) < "8"))
    return F.when((digits != "") & fits, F.conv(digits, 16, 10).cast("long"))


def format_hex(n: Column, digits: int = 6) -> Column:
    """0x and at least `digits` upper-case digits; longer numbers keep all of theirs."""
    h = F.hex(n)
    return F.concat(F.lit("0x"), F.when(F.length(h) >= digits, h).otherwise(F.lpad(h, digits, "0")))


@dataclass(frozen=True)
class Banking:
    """An address layout: bytes in a bank, number of the first bank, address of a bank's first byte."""

    name: str
    size: int
    first_bank: int
    base: int

    def columns(self) -> Column:
        """The layout as a literal row of a dimension."""
        return F.struct(F.lit(self.name).alias("name"), F.lit(self.size).alias("size"), F.lit(self.first_bank).alias("first_bank"), F.lit(self.base).alias("base"))


def _padded(n: Column, digits: int) -> Column:
    h = F.hex(n)
    return F.when(F.length(h) >= digits, h).otherwise(F.lpad(h, digits, "0"))


def format_address(offset: Column, banking: Column) -> Column:
    """bank:addr of an offset, under a struct column as Banking.columns makes it."""
    bank = F.floor(offset / banking["size"]) + banking["first_bank"]
    return F.concat(_padded(bank, 2), F.lit(":"), _padded(offset % banking["size"] + banking["base"], 4))


def parse_address(text: Column, banking: Column) -> Column:
    """Offset of bank:addr, or of a bare run of digits whose last four are the address; null outside a bank."""
    up = F.upper(F.trim(text))
    digits = F.translate(up, ":", "")
    right_form = up.rlike("^[0-9A-F]*:?[0-9A-F]{4}$")
    number = F.conv(F.when(right_form & (F.length(digits) < 16), digits), 16, 10).cast("long")
    bank = F.when(F.length(digits) > 4, F.shiftright(number, 16)).otherwise(banking["first_bank"].cast("long")) - banking["first_bank"]
    inside = number.bitwiseAND(65535) - banking["base"]
    return F.when((inside >= 0) & (inside < banking["size"]) & (bank >= 0), bank * banking["size"] + inside)


def parse_layout(text: str) -> dict[str, list[int]]:
    """A layout string, one letter a bit from the high end (blanks skipped), as bit places of each field.

    A letter may stand in several stretches; its bits join in the order written.
    """
    letters = text.replace(" ", "")
    fields: dict[str, list[int]] = {}
    for i, c in enumerate(letters):
        if c not in "-.":
            fields.setdefault(c, []).append(len(letters) - 1 - i)
    return fields


def unpack_field(word: Column, bits: list[int]) -> Column:
    """The field whose bits, high first, stand at these places of a word."""
    out = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(word.cast("long"), b).bitwiseAND(1), len(bits) - 1 - i))
    return out


def pack_fields(values: dict[str, Column], layout: dict[str, list[int]]) -> Column:
    """A word from fields; a value too wide for its field is masked."""
    out = F.lit(0).cast("long")
    for name, bits in layout.items():
        for i, b in enumerate(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(values[name].cast("long"), len(bits) - 1 - i).bitwiseAND(1), b))
    return out


def scale_up(raw: Column, width: int) -> Column:
    """An n-bit value as 8 bits by repeating its bits from the top; more than 8 bits are cut."""
    if width >= 8:
        return F.shiftright(raw, width - 8)
    out, have = F.lit(0).cast("long"), 0
    while have < 8:
        shift = 8 - have - width
        out = out.bitwiseOR(F.shiftleft(raw, shift) if shift >= 0 else F.shiftright(raw, -shift))
        have += width
    return out.bitwiseAND(255)


def scale_down(value: Column, width: int) -> Column:
    return F.shiftright(value, 8 - width) if width < 8 else F.shiftleft(value, width - 8)


def channel(argb: Column, place: int) -> Column:
    return F.shiftright(argb, place).bitwiseAND(255)


def decode_rgb(word: Column, layout: dict[str, list[int]]) -> Column:
    """ARGB of a word; without an alpha field alpha is 255, without another field that is 0."""
    part = lambda c, missing: scale_up(unpack_field(word, layout[c]), len(layout[c])) if c in layout else F.lit(missing).cast("long")
    return F.shiftleft(part("a", 255), 24) + F.shiftleft(part("r", 0), 16) + F.shiftleft(part("g", 0), 8) + part("b", 0)


def encode_rgb(argb: Column, layout: dict[str, list[int]]) -> Column:
    places = {"a": 24, "r": 16, "g": 8, "b": 0}
    return pack_fields({c: scale_down(channel(argb, places[c]), len(bits)) for c, bits in layout.items()}, layout)


def to_gray(argb: Column) -> Column:
    """Integer luma (299 R + 587 G + 114 B) / 1000 in all channels, alpha kept."""
    y = F.floor((299 * channel(argb, 16) + 587 * channel(argb, 8) + 114 * channel(argb, 0)) / 1000)
    return F.shiftleft(F.shiftright(argb, 24), 24) + y * 65793


def permute_bits(pos: Column, source: list[int]) -> Column:
    """Position whose bit j is bit source[j] of pos, within each span of 2**len(source); higher bits stay."""
    n = len(source)
    out = F.shiftleft(F.shiftright(pos, n), n)
    for j, s in enumerate(source):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(pos, s).bitwiseAND(1), j))
    return out


def interleaved(part: Column, k: Column, b: Column, parts: int, unit: int) -> Column:
    """Place of byte b of unit k of a part when the parts take turns unit by unit."""
    return k * (parts * unit) + part * unit + b


def morton(x: Column, y: Column, bits: int) -> Column:
    """Interleaved bits of x (even places) and y (odd places)."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), i).bitwiseAND(1), 2 * i))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(y.cast("long"), i).bitwiseAND(1), 2 * i + 1))
    return out


def block_morton(x: Column, y: Column, width: int, height: int) -> Column:
    """Morton order inside square blocks of the shorter side, blocks along the longer one."""
    side = min(width, height)
    bits = side.bit_length() - 1
    block = F.floor(x / side) if width >= height else F.floor(y / side)
    return block * (side * side) + morton(x % side, y % side, bits)


def plane_pixels(record: Column, planes: list[int], rows: int, stride: int) -> Column:
    """Digits of a record's pixels: bit k of pixel (x, y) is bit 7 - x of the byte at planes[k] + stride * y // 8.

    Up to three planes, a digit is a decimal one: a byte is looked up as the number its bits spell, planes
    are summed by their weights, and rows are joined two at a time.
    """
    if len(planes) <= 3 and rows % 2 == 0:
        spelt = F.array(*[F.lit(int(f"{b:b}")).cast("long") for b in range(256)])
        byte = lambda y, base: (F.ascii(F.substring(record, y * (stride // 8) + base + 1, 1)) % 256).cast("int")
        row = lambda y: sum((F.get(spelt, byte(y, base)) * (1 << k) for k, base in enumerate(planes)), F.lit(0).cast("long"))
        return F.concat(*[F.lpad((row(y) * 10**8 + row(y + 1)).cast("string"), 16, "0") for y in range(0, rows, 2)])

    def pixel(i: Column) -> Column:
        out = F.lit(0)
        for k, base in enumerate(planes):
            byte = F.ascii(F.substring(record, F.floor(i / 8).cast("int") * (stride // 8) + base + 1, F.lit(1))) % 256
            out = out + F.call_function("shiftleft", F.call_function("shiftright", byte, (7 - i % 8).cast("int")).bitwiseAND(1), F.lit(k))
        return out.cast("string")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(rows * 8 - 1)), pixel), "")


def drawn_row(row: Column, base: int, rows: int = 0) -> Column:
    """row + base, wrapped to `rows` where that is known, else not below 0."""
    return F.pmod(row + base, F.lit(rows)) if rows > 0 else F.greatest(F.lit(0), row + base)


def shifted(v: Column, bias: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v + bias))
