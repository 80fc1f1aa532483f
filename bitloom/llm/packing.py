"""Packing by power-of-two decomposition.

A document's token stream (its ids and the closing id) is cut into pieces whose lengths are powers
of two: full pieces of `seq_len`, then the binary digits of the rest, longest first. Each piece is
a sequence of its own, so no sequence crosses documents and none needs padding; trainers draw
batches from buckets of equal length, which `batch_id` numbers within each Spark task.

Defined results: a null or empty text is the closing id alone (one piece of length 1); a null
doc_id is kept as it is; repeated rows give their pieces each, with their own sequence ids; extra
columns of any name are ignored; an empty table gives no pieces. No shuffle takes place, and a
task that is run again numbers its sequences as before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from bitloom.llm.common import table
from bitloom.llm.pretoken import UNSURE, code_points, kinds, span_hash, split_spaced
from bitloom.llm.textscan import Pool

#: Code points handled at once.
CHUNK = 1 << 19


@cache
def held_encoder(tokenizer_file: str) -> Encoder:
    """One for each Python worker, so that its pool serves task after task."""
    return Encoder(tokenizer_file)


class Encoder:
    """Ids of whole texts, equal to the library's, by way of a pool of pre-tokens."""

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pool = Pool()

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        codes = code_points(joined)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(codes) + 1, bool)
        first[np.concatenate([[0], ends[:-1]])] = True
        starts = split_spaced(codes, kinds(codes), first[: len(codes)])
        stops = np.append(starts[1:], len(codes))
        keys = span_hash(codes, starts, stops)
        slots = self.pool.find(keys)
        if (slots < 0).any():
            new, at = np.unique(keys[slots < 0], return_index=True)
            at = np.flatnonzero(slots < 0)[at]
            if self.pool.n + len(new) > self.pool.most:
                self.pool.clear()
                new, at = np.unique(keys, return_index=True)
            pieces = [joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
            for i in range(0, len(pieces), 20_000):
                found = self.tokenizer.encode_batch_fast(pieces[i : i + 20_000], add_special_tokens=False)
                self.pool.add(new[i : i + 20_000], [np.array(e.ids, np.int32) for e in found])
            slots = self.pool.find(keys)
        ids, size = self.pool.gather(slots)
        total = np.concatenate([[0], np.cumsum(size)])
        cuts = total[np.searchsorted(starts, ends)]
        return np.split(ids, cuts[:-1]) if len(texts) else []

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; memory is bounded by CHUNK and the longest text."""
        held: list[str] = []
        size = 0
        for text in texts:
            plain = not any(s in text for s in self.special) and (text.isascii() or not (kinds(code_points(text)) == UNSURE).any())
            if not plain or not text:
                yield from self._fast(held) if size else [np.zeros(0, np.int32)] * len(held)
                held, size = [], 0
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                continue
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._fast(held)
                held, size = [], 0
        if size:
            yield from self._fast(held)


def binary_lengths(n: int, seq_len: int) -> list[int]:
    """n as full lengths of seq_len and then falling powers of two."""
    full, rest = divmod(n, seq_len)
    return [seq_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32()), ("batch_id", pa.int64()),
])
_TYPES = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, batch_id long"


def pack(docs: DataFrame, tokenizer_file: str, seq_len: int = 1024, end_id: int = 0, batch_tokens: int = 1 << 16, keep_ids: bool = True) -> DataFrame:
    """Pieces of every document: (doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id).

    seq_len is a power of two. bucket is log2 of the length; batch_id groups pieces of one bucket
    into batches of at most batch_tokens tokens. keep_ids=False leaves ids null.
    """
    if seq_len & (seq_len - 1) or seq_len < 1:
        raise ValueError("seq_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(tokenizer_file)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        made, by_bucket = 0, [0] * seq_len.bit_length()
        rows: dict[str, list] = {n: [] for n in PIECES.names}
        held = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in PIECES], schema=PIECES)
            for x in rows.values():
                x.clear()
            return out

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(texts), strict=True):
                stream = np.append(ids, np.int32(end_id)).astype("<i4")
                start = 0
                for length in binary_lengths(len(stream), seq_len):
                    piece = stream[start : start + length]
                    bucket = length.bit_length() - 1
                    number = by_bucket[bucket] * length // max(batch_tokens, length)
                    by_bucket[bucket] += 1
                    values = (doc_id, start, length, piece if keep_ids else None, zlib.crc32(piece), len(stream), base + made, 0, bucket, base + (number << 5 | bucket))
                    for name, v in zip(PIECES.names, values, strict=True):
                        rows[name].append(v)
                    start, made, held = start + length, made + 1, held + 1
                if held >= 4096:
                    yield batch()
                    held = 0
        if held:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, _TYPES)


def byte_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), byte_bpe_file(), keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch_id")
