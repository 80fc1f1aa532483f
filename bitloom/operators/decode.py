"""Staged decoding and structure scans of byte columns.

Byte streams are decoded in Arrow batches by small per-row readers; cutting, reshaping and field
extraction stay native. A row that fails keeps its place with the stage and message of the failure
and nothing of its payload.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import partial
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What a reader gives: (output, bytes consumed, complete).
Reader = Callable[[bytes], tuple[bytes, int, bool]]


def _copy(out: bytearray, source: int, count: int) -> None:
    """Forward copy that may read what it has just written; places before the start read as zero."""
    for k in range(source, source + count):
        out.append(out[k] if k >= 0 else 0)


def _rle(data: bytes, skip_address: bool) -> tuple[bytes, int, bool]:
    """Control byte below 80h: repeat the next byte so often; above: that many (low 7 bits) literals; FFh ends."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c == 0xFF:
            return bytes(out), i, True
        if skip_address and c == 0x7F:
            if i + 2 > len(data):
                break
            i += 2
        elif c < 0x80:
            if i >= len(data):
                break
            out += data[i : i + 1] * c
            i += 1
        else:
            n = c & 0x7F or (0 if skip_address else 256)
            out += data[i : i + n]
            if i + n > len(data):
                break
            i += n
    return bytes(out), min(i, len(data)), False


def read_address_rle(data: bytes) -> tuple[bytes, int, bool]:
    """The reading in which 7Fh is followed by a two-byte address, left out here, and 80h does nothing."""
    return _rle(data, True)


def read_fill_rle(data: bytes) -> tuple[bytes, int, bool]:
    """The reading in which 7Fh is a repeat like any other and 80h stands for 256 literals."""
    return _rle(data, False)


def _lz(data: bytes, i: int, size: int, high_first: bool, link_bit: int, before: int, link: Callable[[int, int, int], tuple[int, int]]) -> tuple[bytes, int, bool]:
    """Flag bytes with eight choices each until `size` bytes are out; link gives (source, count) of a reference.

    A reference may reach `before` bytes back from the start of the output; one further back is no part of a stream.
    """
    out = bytearray()
    while len(out) < size:
        if i >= len(data):
            return bytes(out), i, False
        flags, i = data[i], i + 1
        for k in range(8):
            if len(out) >= size:
                break
            bit = flags >> (7 - k if high_first else k) & 1
            if bit != link_bit:
                if i >= len(data):
                    return bytes(out), i, False
                out.append(data[i])
                i += 1
            else:
                if i + 1 >= len(data):
                    return bytes(out), len(data), False
                source, count = link(data[i], data[i + 1], len(out))
                i += 2
                if source < -before:
                    return bytes(out), i, False
                _copy(out, source, min(count, size - len(out)))
    return bytes(out), i, True


def read_sized_lz(data: bytes) -> tuple[bytes, int, bool]:
    """1xh, 24-bit size; set bits (high first) are references: 4 bits of length - 3, 12 bits of distance - 1."""
    size = int.from_bytes(data[1:4], "little") if len(data) >= 4 and data[0] >> 4 == 1 else 0
    if not size:
        return b"", 0, False
    return _lz(data, 4, size, True, 1, 0, lambda a, b, at: (at - ((a & 15) << 8 | b) - 1, (a >> 4) + 3))


def read_ring_lz(data: bytes) -> tuple[bytes, int, bool]:
    """32-bit size; clear bits (low first) are references to a 4096-byte ring of zeros that begins at FEEh."""
    size = int.from_bytes(data[:4], "little") if len(data) >= 4 else 0
    if not size:
        return b"", 0, False

    def link(a: int, b: int, at: int) -> tuple[int, int]:
        place = a | (b & 0xF0) << 4
        back = (0xFEE + at - place) % 4096 or 4096
        return at - back, (b & 15) + 3

    return _lz(data, 4, size, False, 0, 4096, link)


def _heads_sized(data: np.ndarray) -> np.ndarray:
    """Offsets where a sized stream could begin."""
    if len(data) < 5:
        return np.zeros(0, np.int64)
    some = (data[1:-3] | data[2:-2] | data[3:-1]) > 0
    return np.flatnonzero((data[:-4] >> 4 == 1) & some)


def _heads_ring(data: np.ndarray) -> np.ndarray:
    """Streams of a size that the data behind can hold: a flag byte and eight references give at most 144 bytes for 17."""
    if len(data) < 5:
        return np.zeros(0, np.int64)
    size = data[:-4].astype(np.int64) | data[1:-3].astype(np.int64) << 8 | data[2:-2].astype(np.int64) << 16 | data[3:-1].astype(np.int64) << 24
    left = len(data) - 4 - np.arange(len(size))
    return np.flatnonzero((size > 0) & (size <= left * 9))


#: What a walk gives: (offset, consumed, size) of each complete, non-empty stream, from the last to the first.
Hits = Iterator[tuple[int, int, int]]


def _walk_rle(data: bytes, skip_address: bool) -> Hits:
    """Run streams in one pass from the end: a stream goes on where its first command leads, which is 257 bytes on at most."""
    n = data.rfind(b"\xff") + 1
    stop, size = [0] * 512, [0] * 512  # of the last 512 places
    for i in range(n - 1, -1, -1):
        c, at = data[i], i & 511
        if c == 0xFF:
            stop[at], size[at] = i + 1, 0
            continue
        if skip_address and c == 0x7F:
            after, gain = i + 3, 0
        elif c < 0x80:
            after, gain = i + 2, c
        else:
            gain = c & 0x7F or (0 if skip_address else 256)
            after = i + 1 + gain
        stop[at] = stop[after & 511] if after < n else 0
        if stop[at]:
            size[at] = gain + size[after & 511]
            if size[at]:
                yield i, stop[at] - i, size[at]


#: More than any stream gives.
_NEVER = 1 << 40


def _walk_lz(data: bytes, heads: list[tuple[int, int]], high_first: bool, link_bit: int, reach: Callable[[int, int], tuple[int, int]]) -> Hits:
    """Streams of `heads`, (offset, size) by offset, without reading one from its beginning; reach gives (count, least output before) of a reference.

    A flag byte and its eight choices lead to the next flag byte, whatever the stream. Each place has
    this step and a jump over several, with the bytes they give and the output they need before
    them, so a stream finds its last flag byte in a logarithm of its steps, and hostile data costs no more.
    """
    n, low = len(data), heads[0][0] + 4 if heads else len(data)
    step, jump, depth, gain, need, far, deep = (array("q", bytes(8 * (n - low + 1))) for _ in range(7))
    step[-1] = jump[-1] = n - low
    need[-1] = deep[-1] = -_NEVER
    shifts = range(7, -1, -1) if high_first else range(8)

    def group(at: int, out: int, size: int) -> tuple[int, int, int]:
        """(next place, output, output that was lacking) of the choices behind the flag byte at `at`, until size; a place past the end if they are cut."""
        flags, i, lack = data[at], at + 1, -_NEVER
        for k in shifts:
            if out >= size:
                break
            if flags >> k & 1 != link_bit:
                i, out = i + 1, out + 1
            elif i + 1 < n:
                count, before = reach(data[i], data[i + 1])
                lack = max(lack, before - out)
                i, out = i + 2, min(out + count, size)
            else:
                return n + 1, out, lack
        return i, out, lack

    waiting = len(heads) - 1
    for at in range(n - 1, low - 1, -1):
        p = at - low
        after, got, lack = group(at, 0, _NEVER)
        if after >= n:
            after, got = n, _NEVER
        q = after - low
        step[p], gain[p], need[p], depth[p] = q, got, lack, depth[q] + 1
        if depth[q] - depth[jump[q]] == depth[jump[q]] - depth[jump[jump[q]]]:
            r = jump[q]
            jump[p], far[p] = jump[r], got + far[q] + far[r]
            deep[p] = max(lack, deep[q] - got, deep[r] - got - far[q])
        else:
            jump[p], far[p], deep[p] = q, got, lack
        while waiting >= 0 and heads[waiting][0] + 4 == at:
            head, size = heads[waiting]
            waiting -= 1
            out = 0
            while True:
                if out + far[p] < size and deep[p] <= out:
                    out, p = out + far[p], jump[p]
                elif out + gain[p] < size and need[p] <= out:
                    out, p = out + gain[p], step[p]
                else:
                    break
            end, out, lack = group(p + low, out, size)
            if out == size and lack <= 0 and end <= n:
                yield head, end - head, size


def _walk_sized(data: bytes) -> Hits:
    heads = [(i, int.from_bytes(data[i + 1 : i + 4], "little")) for i in _heads_sized(np.frombuffer(data, np.uint8)).tolist()]
    return _walk_lz(data, heads, True, 1, lambda a, b: ((a >> 4) + 3, ((a & 15) << 8 | b) + 1))


def _walk_ring(data: bytes) -> Hits:
    """The ring reaches back before any stream, so its references need nothing."""
    heads = [(i, int.from_bytes(data[i : i + 4], "little")) for i in _heads_ring(np.frombuffer(data, np.uint8)).tolist()]
    return _walk_lz(data, heads, False, 0, lambda a, b: ((b & 15) + 3, 0))


#: Shipped readers, and walks that find all their streams in a blob at once.
READERS: dict[str, Reader] = {"sized-lz": read_sized_lz, "ring-lz": read_ring_lz, "fill-rle": read_fill_rle, "address-rle": read_address_rle}
WALKS: dict[str, Callable[[bytes], Hits]] = {"sized-lz": _walk_sized, "ring-lz": _walk_ring, "fill-rle": partial(_walk_rle, skip_address=False), "address-rle": partial(_walk_rle, skip_address=True)}


def _scan(name: str, data: bytes, probe: int) -> list[tuple[int, int, int]]:
    return [hit for hit in WALKS[name](data) if hit[1] <= probe][::-1]


#: The streams of at most `probe` bytes, by offset.
SCANS = {name: partial(_scan, name) for name in WALKS}


class Registry:
    """Codecs by (stage, id). Byte readers run in Arrow batches, column builders natively."""

    def __init__(self) -> None:
        self.readers: dict[tuple[str, str], Reader] = {}
        self.builders: dict[tuple[str, str], Callable[[Column], Column]] = {}
        self.optional: dict[tuple[str, str], dict[str, Callable[[dict], object]]] = {}

    def add_optional(self, stage: str, id_: str, **methods: Callable[[dict], object]) -> None:
        """Methods that a codec may have or lack, each from its parameters to an answer; see probed()."""
        self.optional.setdefault((stage, id_), {}).update(methods)

    def add(self, stage: str, id_: str, codec: Reader | Callable[[Column], Column], native: bool = False) -> None:
        if (stage, id_) in self.readers or (stage, id_) in self.builders:
            raise ValueError(f"{stage} {id_} is registered twice")
        (self.builders if native else self.readers)[stage, id_] = codec

    def build(self, stage: str, id_: str, column: Column) -> Column:
        return self.builders[stage, id_](column)

    def register_table_functions(self, spark: SparkSession) -> None:
        """Each reader as a table function of SQL, named after its id: (output, consumed, complete).

        A row function, since SQL's lateral joins refuse Arrow ones; jobs over many rows use decode().
        """
        from pyspark.sql.functions import udtf

        for (_, id_), reader in self.readers.items():

            class Decode:
                held = staticmethod(reader)

                def eval(self, blob: bytes):  # noqa: ANN201
                    yield self.held(bytes(blob or b""))

            spark.udtf.register(f"decode_{id_.replace('-', '_')}", udtf(Decode, returnType="output binary, consumed int, complete boolean"))


#: Rows that are decoded at once, and hits that are given at once: what a worker holds beside Spark's batch.
SLICE, HITS = 128, 1 << 14


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def decode(df: DataFrame, blob: str, codec: Column | str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """df with output, consumed, complete, stage and message; a failed row has a null output."""
    readers = readers or READERS
    given = df.withColumn("_reader", F.lit(codec) if isinstance(codec, str) else codec)
    at = given.columns.index(blob)
    schema = StructType([*df.schema.fields, *StructType.fromDDL("output binary, consumed int, complete boolean, stage string, message string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows: list[tuple] = []
            for raw, name in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if raw is None:
                    rows.append((None, None, None, "container", "no content"))
                elif name not in readers:
                    rows.append((None, None, None, "decompress", f"unknown codec {name}"))
                else:
                    out, used, done = readers[name](bytes(raw))
                    rows.append((out, used, True, None, None) if done else (None, used, False, "decompress", "stream ends early"))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.binary(), pa.int32(), pa.bool_(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "output", "consumed", "complete", "stage", "message"])

    return given.mapInArrow(run, schema)


def with_presets(df: DataFrame, preset: str, presets: DataFrame) -> DataFrame:
    """df with codec and params of the preset (preset, codec, params) that each row names; null where there is none."""
    held = presets.select(F.col("preset").alias("_preset"), "codec", "params")
    return df.join(held, F.col(preset) == F.col("_preset"), "left").drop("_preset")


def probed(df: DataFrame, registry: Registry, stage: str, asked: dict[str, tuple[Callable, object, str]]) -> tuple[DataFrame, DataFrame]:
    """(df with a column for each method asked, notices) for rows with codec and params, a JSON object.

    asked: {method: (read, default, type)}. Each distinct pair of codec and parameters is asked once. A
    codec without the method has the default, without a word. One whose method fails, or gives what
    `read` cannot turn into a value of the type, has the default too, and a notice row (codec, params,
    method, message); so has a codec that the registry does not know, or parameters that are no object.
    """
    optional = {id_: methods for (st, id_), methods in registry.optional.items() if st == stage}
    known = {id_ for st, id_ in [*registry.readers, *registry.builders, *registry.optional] if st == stage}
    names = list(asked)
    answers = StructType.fromDDL(", ".join(f"{n} {kind}" for n, (_, _, kind) in asked.items()))
    answer_type, notice_type = to_arrow_schema(answers), pa.list_(pa.struct([("method", pa.string()), ("message", pa.string())]))
    pairs = df.select("codec", "params").distinct()
    schema = StructType([*pairs.schema.fields, *answers.fields, *StructType.fromDDL("_notices array<struct<method:string,message:string>>").fields])

    def one(codec: str | None, params: str | None) -> tuple[dict, list[dict]]:
        values, notices = {n: default for n, (_, default, _) in asked.items()}, []
        try:
            if codec not in known:
                raise LookupError(f"unknown codec {codec}")
            given = json.loads(params or "{}")
            if not isinstance(given, dict):
                raise TypeError("parameters are no object")
        except (LookupError, TypeError, ValueError) as bad:
            return values, [{"method": n, "message": str(bad)} for n in names]
        for n, (read, _, _) in asked.items():
            method = optional.get(codec, {}).get(n)
            if method is None:
                continue
            try:
                value = read(method(given))
                pa.array([value], answer_type.field(n).type)
                values[n] = value
            except Exception as bad:  # noqa: BLE001  an optional method must not fail the job
                notices.append({"method": n, "message": f"{type(bad).__name__}: {bad}"})
        return values, notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(c, p) for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            made = [pa.array([v[n] for v, _ in got], answer_type.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, pa.array([m for _, m in got], notice_type)], schema.names)

    found = pairs.mapInArrow(run, schema).withColumnsRenamed({"codec": "_codec", "params": "_params"})
    joined = df.join(found, df["codec"].eqNullSafe(found["_codec"]) & df["params"].eqNullSafe(found["_params"]), "left")
    notices = found.select(F.col("_codec").alias("codec"), F.col("_params").alias("params"), F.inline("_notices"))
    return joined.select(*[df[c] for c in df.columns], *names), notices


#: Reshapes of a region: byte orders within units of so many bytes, by name.
RESHAPES = {"swap": [1, 0], "reverse-4": [3, 2, 1, 0]}


def staged(df: DataFrame, blob: str, pathway: str, offset: Column, length: Column, reshape: Column, codec: Column, fields: dict[str, tuple[int, int]], readers: dict[str, Reader] | None = None) -> DataFrame:
    """df with output, the named fields of it, and for a failed row (failed_stage, failed_action, plugin, message) instead.

    Four stages for each row: cut [offset, offset + length) out of the blob (a null length goes to its
    end), put its bytes in the order that `reshape` names (null: as they are), decompress by `codec`
    (null: as it is), and read little-endian fields {name: (first byte, bytes)} of the output. A
    failure keeps the row with its `pathway` and nothing of its payload.
    """
    size = F.octet_length(blob).cast("long")
    offset, length = offset.cast("long"), length.cast("long")
    # compared without a sum that could overflow; the numbers of a sound region are no larger than the blob
    past = (offset < 0) | (offset > size) | (length < 0) | (length > size - offset)
    cut_bad = F.when(F.col(blob).isNull(), "no content").when(F.coalesce(past, F.lit(False)) | offset.isNull(), "region past the end")
    region = F.when(cut_bad.isNull(), F.expr(f"substring({blob}, _offset + 1, _stop - _offset)"))
    sound = lambda c: F.when(cut_bad.isNull(), c).cast("int")
    given = df.withColumns({"_offset": sound(offset), "_stop": sound(F.coalesce(offset + F.when(cut_bad.isNull(), length), size)), "_reshape": reshape, "_codec": codec})
    cut = given.withColumn("_cut_bad", cut_bad).withColumn("_region", region)
    turned, bad = F.col("_region"), F.when(F.col("_reshape").isNotNull() & ~F.col("_reshape").isin(list(RESHAPES)), "unknown reshape")
    for name, order in RESHAPES.items():
        groups, wanted = "(..)" * len(order), "".join(f"${k + 1}" for k in order)
        mine = F.col("_reshape") == name
        turned = F.when(mine, F.unhex(F.regexp_replace(F.hex("_region"), groups, wanted))).otherwise(turned)
        bad = bad.when(mine & (F.octet_length("_region") % len(order) != 0), f"no whole units of {len(order)} bytes")
    shaped = cut.withColumn("_shape_bad", F.when(F.col("_cut_bad").isNull(), bad)).withColumn("_shaped", F.when(F.col("_shape_bad").isNull(), turned))
    # rows without a codec, or failed already, pass through an identity reader
    ready = F.when(F.col("_shaped").isNull(), F.lit("")).otherwise(F.coalesce("_codec", F.lit("")))
    known = {**(readers or READERS), "": lambda raw: (raw, len(raw), True)}
    read = decode(shaped.drop("_region").withColumn("_shaped", F.coalesce("_shaped", F.lit(b"").cast("binary"))).drop("output", "consumed", "complete", "stage", "message"), "_shaped", ready, known)
    short = F.coalesce(*[F.when(F.octet_length("output") < first + n, f"no room for {name}") for name, (first, n) in fields.items()], F.lit(None).cast("string"))
    steps = [
        ("container", "cut", F.lit("slice"), F.col("_cut_bad")), ("container", "reshape", F.col("_reshape"), F.col("_shape_bad")),
        ("decompress", "decode", F.col("_codec"), F.col("message")), ("interpret", "fields", F.lit("fields"), F.when(F.col("message").isNull(), short)),
    ]
    failed = F.coalesce(*[F.when(m.isNotNull(), F.struct(F.lit(st).alias("stage"), F.lit(ac).alias("action"), pl.alias("plugin"), m.alias("message"))) for st, ac, pl, m in steps])
    out = read.withColumn("_failed", failed)
    good = F.col("_failed").isNull()
    byte = lambda first, k: F.conv(F.hex(F.substring("output", first + k + 1, 1)), 16, 10).cast("long")
    number = lambda first, n: sum((F.shiftleft(byte(first, k), 8 * k) for k in range(n)), F.lit(0).cast("long"))
    return out.select(
        *[c for c in df.columns if c not in ("output", *fields)], F.lit(pathway).alias("pathway"), F.when(good, F.col("output")).alias("output"),
        *[F.when(good, number(*at)).alias(name) for name, at in fields.items()],
        F.col("_failed.stage").alias("failed_stage"), F.col("_failed.action").alias("failed_action"), F.col("_failed.plugin").alias("plugin"), F.col("_failed.message").alias("message"),
    )


def find_structures(df: DataFrame, key: str, blob: str, codecs: list[str], probe_bytes: int | None = None) -> DataFrame:
    """(key, codec, offset, consumed, size): every place where a reader gives a non-empty, complete result of the bytes from there on.

    Streams may be as long as the blob; with probe_bytes only those of so many bytes count. A blob is
    read whole, once for each codec, in time that grows with its length and not with that of its streams.
    """
    given = df.select(F.col(key).cast("long").alias("key"), blob)
    names, types = ["key", "codec", "offset", "consumed", "size"], (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for k, raw in zip(b.column(0), b.column(1), strict=True):
                data, k = raw.as_py() or b"", k.as_py()
                for name in codecs:
                    for at, used, size in WALKS[name](data):
                        if probe_bytes is None or used <= probe_bytes:
                            yield k, name, at, used, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(hits(batches), HITS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    found = given.mapInArrow(run, "key long, codec string, offset long, consumed long, size long")
    return found.withColumnRenamed("key", key)


def backfill(slices: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """slices (key, offset, length, reshape) whose unstated length becomes the consumed size, where nothing reshapes."""
    j = slices.join(found.select(key, "offset", "consumed"), [key, "offset"], "left")
    length = F.when(F.col("length").isNull() & F.col("reshape").isNull(), F.col("consumed")).otherwise(F.col("length"))
    return j.withColumn("length", length).drop("consumed")
