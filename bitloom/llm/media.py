"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton over magic bytes finds every place where a container may begin; a
validator of that format then walks its structure and either confirms it, with its exact length, or
rejects it. The confirmed container at offset 0 corrects a row's declared type; confirmed
containers further in are carved out with their offsets and lengths. Payloads are stored as 8-bit
mono WAVE without a declared type, typed and carved by the same sniffing, and read back from what it
carved.

Many headers may lead into the same data. Walks over GIF blocks, JPEG scans and Ogg pages depend on
the place alone, so what a walk found out about a place is kept, and the walks of one content take
linear time together; so do PNG chunks, of which a checksum over long data that other chunks
share is derived from checksums of the content's beginnings. Whether RIFF chunks fill a header's own
size is asked of a forest in which a chunk's parent is the next one, by jump pointers.

Defined results: null and empty contents are of type 'application/octet-stream' with nothing
carved; a truncated container is not confirmed; containers inside a confirmed one are reported
only when `nested`; repeated rows give repeated results; extra columns pass through untouched
unless they clash with the result's names, which then win.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from bitloom.llm.common import table

UNKNOWN = "application/octet-stream"


class Found(NamedTuple):
    kind: str
    offset: int
    length: int


class Seen:
    """What walks over one content have found out: for a kind of place, where a walk through it ends (0: nowhere).

    Places are kept from the second walk of a kind on, four bytes each.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.walks: dict[str, int] = {}
        self.ends: dict[str, array] = {}
        self.riffs, self.forest = False, None
        self.summed, self.sums = 0, None

    def walk(self, kind: str, at: int, step: Callable[[int], tuple[int, int | None]]) -> int:
        """The end of the walk from `at`; step gives (next place, None) or (anything, end)."""
        self.walks[kind] = self.walks.get(kind, 0) + 1
        if self.walks[kind] == 2:
            self.ends[kind] = array("i", bytes(4 * (self.size + 1)))
        known = self.ends.get(kind)
        path, end = [], None
        while end is None:
            if at > self.size:
                end = 0
            elif known is not None and known[at]:
                end = known[at] - 1
            else:
                if known is not None:
                    path.append(at)
                at, end = step(at)
        for p in path:
            known[p] = end + 1
        return end

    def chunks(self, b: bytes, start: int, end: int) -> dict[bytes, bool] | None:
        """Whether fmt and data are among the RIFF chunks from `start`, if these end at `end` exactly; else None.

        The first walk is a plain one. After that places form a forest: the parent of a chunk is the
        next one, and jump pointers answer in logarithmic time whether `end` lies on the way up.
        """
        if not self.riffs:
            self.riffs = True
            i, names = start, set()
            while i + 8 <= end:
                name, n = struct.unpack_from("<4sI", b, i)
                names.add(name)
                i += 8 + n + (n & 1)
            return {c: c in names for c in (b"fmt ", b"data")} if i == end and names else None
        if self.forest is None:
            # next place, jump, depth (0: not met yet), and the first fmt and data chunk from here on
            self.forest = tuple(array("i", bytes(4 * (self.size + 1))) for _ in range(5))
        up, jump, depth, fmt, data = self.forest
        path, i = [], start
        while i <= self.size and not depth[i]:
            path.append(i)
            i = i + 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + (n & 1) if i + 8 <= self.size else self.size + 1
        for p in reversed(path):
            if i > self.size:
                up[p], jump[p], depth[p], fmt[p], data[p] = p, p, 1, self.size, self.size
            else:
                far = jump[i]
                up[p], depth[p], fmt[p], data[p] = i, depth[i] + 1, fmt[i], data[i]
                jump[p] = jump[far] if depth[i] - depth[far] == depth[far] - depth[jump[far]] else i
            name = b[p : p + 4]
            if name == b"fmt ":
                fmt[p] = p
            elif name == b"data":
                data[p] = p
            i = p
        at = start
        while at < end and up[at] != at:
            at = jump[at] if jump[at] <= end else up[at]
        return {b"fmt ": fmt[start] < end, b"data": data[start] < end} if at == end > start else None

    def crc(self, b: bytes, start: int, stop: int) -> int:
        """crc32 of b[start:stop]. Once more has been summed than four times the content, long ranges come from sums of beginnings."""
        self.summed += stop - start
        if self.summed <= 4 * self.size or stop - start <= 1 << 16:
            return zlib.crc32(memoryview(b)[start:stop])
        if self.sums is None:
            self.sums = array("L", [0])
            for i in range(0, self.size, 4096):
                self.sums.append(zlib.crc32(b[i : i + 4096], self.sums[-1]))
        head, whole = (zlib.crc32(b[i & -4096 : i], self.sums[i >> 12]) for i in (start, stop))
        return whole ^ _times(_power(stop - start), head)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bits reflected."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def _powers() -> list[list[int]]:
    """x ** (8 * d * 16 ** k) for each hexadecimal digit d at each place k."""
    out, unit = [], 0x00800000
    for _ in range(10):
        row = [0x80000000]
        for _ in range(16):
            row.append(_times(row[-1], unit))
        unit = row.pop()
        out.append(row)
    return out


_POWERS = _powers()


def _power(n: int) -> int:
    """x ** (8 * n): what n further bytes do to a checksum."""
    out, k = 0x80000000, 0
    while n >> 4 * k:
        if d := n >> 4 * k & 15:
            out = _times(_POWERS[k][d], out)
        k += 1
    return out


def _png(b: bytes, at: int, seen: Seen) -> int:
    """Length of the PNG at `at`, 0 if it is none: chunks with right CRCs from an IHDR of 13 bytes to IEND."""

    def right(i: int, size: int) -> bool:
        return seen.crc(b, i + 4, i + 8 + size) == struct.unpack_from(">I", b, i + 8 + size)[0]

    def chunk(i: int) -> tuple[int, int | None]:
        if i + 12 > len(b):
            return i, 0
        size, kind = struct.unpack_from(">I4s", b, i)
        after = i + 12 + size
        if after > len(b) or kind == b"IHDR" or not kind.isalpha() or not right(i, size):
            return i, 0
        return after, after if kind == b"IEND" else None

    if at + 33 > len(b) or struct.unpack_from(">I4s", b, at + 8) != (13, b"IHDR") or not right(at + 8, 13):
        return 0
    end = seen.walk("png chunk", at + 33, chunk)
    return end - at if end else 0


def _gif(b: bytes, at: int, seen: Seen) -> int:
    """Header, colour tables, then blocks of sub-blocks up to the trailer."""

    def sub_block(i: int) -> tuple[int, int | None]:
        if i >= len(b):
            return i, 0
        return (i + b[i] + 1, None) if b[i] else (i, i + 1)

    def block(i: int) -> tuple[int, int | None]:
        if i >= len(b):
            return i, 0
        if b[i] == 0x3B:
            return i, i + 1
        if b[i] == 0x21:
            data = i + 2
        elif b[i] == 0x2C and i + 10 < len(b):
            data = i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 0x80 else 0)
        else:
            return i, 0
        after = seen.walk("gif sub-block", data, sub_block)
        return (after, None) if after else (i, 0)

    if at + 13 > len(b):
        return 0
    end = seen.walk("gif block", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), block)
    return end - at if end else 0


def _jpeg(b: bytes, at: int, seen: Seen) -> int:
    """Marker segments, entropy-coded data after each start of scan, up to end of image."""

    def scan(i: int) -> tuple[int, int | None]:
        """The marker that ends entropy-coded data."""
        i = b.find(b"\xff", i)
        if i < 0 or i + 1 >= len(b):
            return 0, 0
        return (i + 2, None) if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7 else (i, i)

    def segment(i: int) -> tuple[int, int | None]:
        if i + 4 > len(b) or b[i] != 0xFF or not 0xC0 <= b[i + 1] <= 0xFE:
            return i, 0
        after = i + 2 + struct.unpack_from(">H", b, i + 2)[0]
        if b[i + 1] != 0xDA:
            return after, None
        mark = seen.walk("jpeg scan", after, scan)
        if not mark:
            return i, 0
        return (mark, mark + 2) if b[mark + 1] == 0xD9 else (mark, None)

    end = seen.walk("jpeg segment", at + 2, segment)
    return end - at if end else 0


def _bmp(b: bytes, at: int, seen: Seen) -> int:
    if at + 30 > len(b):
        return 0
    size, _, pixels, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    good = header in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= pixels <= size
    return size if good and at + size <= len(b) and pixels + row * abs(height) <= size else 0


def _riff(b: bytes, at: int, seen: Seen) -> int:
    """RIFF of form WAVE or WEBP whose chunks fill the stated size exactly."""
    if at + 12 > len(b):
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if b[at + 8 : at + 12] not in (b"WAVE", b"WEBP") or at + size > len(b):
        return 0
    names = seen.chunks(b, at + 12, at + size)
    if names is None or b[at + 8 : at + 12] == b"WAVE" and not all(names.values()):
        return 0
    return size


def _ogg(b: bytes, at: int, seen: Seen) -> int:
    """Pages one after another, from one that begins a stream."""

    def page(i: int) -> tuple[int, int | None]:
        if i + 27 > len(b) or b[i : i + 5] != b"OggS\0":
            return i, i
        n = b[i + 26]
        after = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        return (i, 0) if i + 27 + n > len(b) or after > len(b) else (after, None)

    if at + 27 > len(b) or not b[at + 5] & 2:
        return 0
    end = seen.walk("ogg page", at, page)
    return end - at if end > at else 0


#: Magic bytes of public formats: fixed values.
SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int, Seen], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff),
    (b"OggS", "audio/ogg", _ogg),
]


def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def sniff(content: bytes, search, nested: bool = False) -> list[Found]:  # noqa: ANN001
    """Confirmed containers in order of offset."""
    out, free, seen = [], 0, Seen(len(content))
    hits = sorted((end + 1 - len(SIGNATURES[i][0]), i) for end, i in search.iter(content.decode("latin-1")))
    for at, i in hits:
        if at < free and not nested:
            continue
        _, kind, length_of = SIGNATURES[i]
        if n := length_of(content, at, seen):
            kind = "image/webp" if kind == "audio/wav" and content[at + 8 : at + 12] == b"WEBP" else kind
            out.append(Found(kind, at, n))
            free = max(free, at + n)
    return out


def to_wave(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as unsigned 8-bit mono samples; an odd size gets the format's pad byte."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def samples(wave: bytes) -> bytes:
    """The data chunk of a WAVE."""
    i = 12
    while i + 8 <= len(wave):
        name, n = struct.unpack_from("<4sI", wave, i)
        if name == b"data":
            return wave[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no data chunk")


_CARVED = "true_type string, corrected boolean, carved array<struct<type string, offset bigint, length bigint, sha256 string, content binary>>"
_CARVED_PA = [
    ("true_type", pa.string()), ("corrected", pa.bool_()),
    ("carved", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())]))),
]


def examine(blob: bytes, declared: str | None, search, nested: bool) -> tuple[str, bool, list[Found]]:  # noqa: ANN001
    """(true type, the declared one was another, containers) of a content."""
    found = sniff(blob, search, nested)
    true = next((f.kind for f in found if f.offset == 0), UNKNOWN)
    return true, declared != true, found


def sniff_media(df: DataFrame, content: str, declared: str | None = None, nested: bool = False, keep_content: bool = True) -> DataFrame:
    """df with true_type, corrected (the column of declared types, if given, says another) and carved containers."""
    kept = [c for c in df.columns if c not in ("true_type", "corrected", "carved")]
    rows = df.select(*kept)
    full = StructType([*rows.schema.fields, *StructType.fromDDL(_CARVED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for b in batches:
            named = b.schema.get_field_index(declared) if declared else -1
            said = b.column(named).to_pylist() if declared else [None] * len(b)
            kind, fixed, carved = [], [], []
            for blob, word in zip(b.column(b.schema.get_field_index(content)).to_pylist(), said, strict=True):
                blob = bytes(blob or b"")
                true, other, found = examine(blob, word, search, nested)
                kind.append(true)
                fixed.append(declared is not None and other)
                cut = [blob[f.offset : f.offset + f.length] for f in found]
                carved.append([{"type": f.kind, "offset": f.offset, "length": f.length, "sha256": hashlib.sha256(c).hexdigest(), "content": c if keep_content else None} for f, c in zip(found, cut, strict=True)])
            made = [pa.array(x, t) for x, (_, t) in zip((kind, fixed, carved), _CARVED_PA, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *(n for n, _ in _CARVED_PA)])

    return rows.mapInArrow(run, full)


_CHUNK = 8 << 20


def _chunked(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about _CHUNK bytes from (row, its bytes)."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= _CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def text_media(docs: DataFrame, block: int = 64, keep_media: bool = True) -> DataFrame:
    """Texts padded to whole blocks and stored as WAVE, typed and carved by sniffing, read back from what was carved, and described.

    The media are stored without a declared type; `corrected` tells that sniffing gave them one. The
    feature names the confirmed type, the payload's length, the mean and the energy of its samples
    about the mid level, and the types of media carved inside it. A row whose container is not
    confirmed has nulls for what would be read back. All in one pass, so a task has one Python worker.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("true_type", pa.string()), ("corrected", pa.bool_()), ("n_embedded", pa.int32()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        search = automaton()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                media = to_wave(raw + bytes(-len(raw) % block if raw else block))
                true, fixed, found = examine(media, UNKNOWN, search, nested=True)
                sha = hashlib.sha256(media).hexdigest()
                kept, size = (media, len(media)) if keep_media else (None, 256)
                inner = [f.kind for f in found if f.offset]
                outer = next((f for f in found if f.offset == 0), None)
                if outer is None:
                    yield (doc_id, len(raw), kept, None, None, None, len(media), sha, None, true, fixed, len(inner)), size
                    continue
                read = samples(media[: outer.length])
                wave = np.frombuffer(read, np.uint8)
                square = int(np.bincount(wave, minlength=256) @ (np.arange(256, dtype=np.int64) - 128) ** 2)
                feature = f"{true};n={len(read)};mean={int(wave.sum(dtype=np.int64)) / len(read):.4f};energy={square / len(read):.4f};embedded={','.join(inner)}"
                yield (doc_id, len(raw), kept, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), sha, feature, true, fixed, len(inner)), size

    kind = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, true_type string, corrected boolean, n_embedded int"
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return given.mapInArrow(lambda batches: _chunked(rows(batches), schema), kind)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"), keep_media=False).drop("media")
