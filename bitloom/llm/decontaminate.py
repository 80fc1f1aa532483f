"""Benchmark decontamination with an FM-index for each training shard.

A shard is a stretch of a task's documents. Its index leaves out what cannot match: a phrase consists
of benchmark words, so an occurrence lies within a run of words that occur in the block of the
benchmark at hand, and that run is at least as long as the shortest phrase. Such runs, each closed by
its own end mark, are the indexed text; it holds every occurrence, and no occurrence crosses a mark.
The suffix order of the runs gives their Burrows-Wheeler transform, kept as a wavelet matrix; all
phrases are searched backwards at once through its ranks, their occurrences are located by walking
to sampled suffix positions, and the words they cover are merged into removal spans.

A benchmark of about `block_bytes` of text is sent to the tasks whole, as 4 bytes a word and 8 bytes
a distinct word (at most 6 bytes a byte of text), and the rows are read once. A larger one is searched
in blocks of that size (one item is never divided): a Bloom filter of all its words, of fixed size,
takes the place of the vocabulary, each shard is indexed once under its own alphabet and stored, and
every block is searched in the stored indexes, where only digests of texts, spans and items come out.
They meet the rows again at the end, by a join that Spark may broadcast where they are few and that
otherwise moves each text once. So the rows are read twice, however many blocks there are.

Defined results: null texts have no words; a null or wordless item gives no phrase; an item of
fewer words than the window is one phrase; equal phrases of several items count for each; a null
item_id is written as 'null'; repeated rows each get their result; a very long text is a shard of its
own; an empty table, or a benchmark without phrases, finds nothing; results are sets, so there are no
ties; extra columns pass through, those named like a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bitloom.llm.common import discard, stored, table
from bitloom.llm.textscan import NOT_WORD, Pool, Words, slices, text_buffer, words

SAMPLE = 8
SHARD_WORDS = 1 << 20
#: Bits of the Bloom filter over the words of a benchmark of many blocks. A full filter costs larger indexes, not results.
SIEVE = 1 << 25
#: Parts that the rows of one text are dealt to where they meet its spans.
SALTS = 32


class WaveletMatrix:
    """Ranks over a sequence of symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.zeros: list[np.ndarray] = []
        self.levels = levels
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        begin = np.zeros(len(end), np.int64)
        end = end.astype(np.int64)
        for k, zeros in enumerate(self.zeros):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            total = int(zeros[-1])
            begin = np.where(one, total + begin - zeros[begin], zeros[begin])
            end = np.where(one, total + end - zeros[end], zeros[end])
        return end - begin


class FMIndex:
    """Index of a sequence of symbols from 1 up, where each 0 ends a run."""

    def __init__(self, text: np.ndarray, alphabet: int) -> None:
        n = len(text)
        stops = np.flatnonzero(text == 0)
        # end marks are told apart by place, so no suffix is compared past the end of its run
        rank = text.astype(np.int64) + len(stops)
        rank[stops] = np.arange(len(stops))
        width, longest = 1, int(np.diff(np.concatenate([[-1], stops])).max())
        order = np.argsort(rank, kind="stable")
        while width < longest:
            ahead = np.zeros(n, np.int64)
            ahead[: n - width] = rank[width:] + 1
            key = rank * (n + alphabet + 2) + ahead
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.diff(key[order]) != 0])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            width *= 2
        self.bwt = np.where(order > 0, text[order - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.ranks = WaveletMatrix(self.bwt, max(1, int(alphabet).bit_length()))
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.place = np.where(self.sampled, order, -1)

    def parts(self) -> tuple[bytes, bytes, bytes]:
        """What has to be stored: the transform, which rows are sampled, and their positions."""
        return self.bwt.astype(np.int32).tobytes(), np.packbits(self.sampled).tobytes(), self.place[self.sampled].astype(np.int32).tobytes()

    @staticmethod
    def of_parts(parts: tuple[bytes, bytes, bytes], alphabet: int) -> FMIndex:
        """The index that parts() came from, without sorting anything again."""
        self = FMIndex.__new__(FMIndex)
        self.bwt = np.frombuffer(parts[0], np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.bwt, minlength=alphabet + 1))])
        self.ranks = WaveletMatrix(self.bwt, max(1, int(alphabet).bit_length()))
        self.sampled = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=len(self.bwt)).astype(bool)
        self.place = np.full(len(self.bwt), -1, np.int64)
        self.place[self.sampled] = np.frombuffer(parts[2], np.int32)
        return self

    def search(self, coded: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, given by the place of their last word in coded and their size."""
        end = coded[last]
        low, high = self.first[end].copy(), self.first[end + 1].copy()
        for step in range(2, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero((low < high) & (sizes >= step))
            if not len(live):
                break
            symbol = coded[last[live] - step + 1]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            symbol = self.bwt[at[todo]]
            at[todo] = self.first[symbol] + self.ranks.rank(symbol, at[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.place[at] + steps


@dataclass
class Phrases:
    """A block of items: distinct words, the words of all items by number from 1, where items begin, item ids."""

    vocabulary: np.ndarray
    coded: np.ndarray
    offs: np.ndarray
    items: list[str]
    window: int

    @staticmethod
    def of(items: list[tuple[object, str | None]], window: int) -> Phrases:
        data, offs = text_buffer(pa.array([t or "" for _, t in items], pa.string()))
        found = words(data, offs, NOT_WORD, fold=True)
        vocabulary, coded = np.unique(found.hash, return_inverse=True)
        return Phrases(vocabulary, (coded + 1).astype(np.int32), found.offs, ["null" if i is None else str(i) for i, _ in items], window)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, size, item) of every phrase: each window of an item, or the whole of a shorter one."""
        n = np.diff(self.offs)
        count = np.where(n > 0, np.maximum(n - self.window, 0) + 1, 0)
        item = np.repeat(np.arange(len(n)), count)
        first = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + self.offs[item]
        return first, np.minimum(n[item], self.window), item


def long_runs(known: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at least `least` known words within rows: (first words, lengths, where each run and its end mark stop)."""
    inside = np.concatenate([[False], known, [False]])
    first = np.zeros(len(known) + 2, bool)
    first[offs[:-1] + 1] = True
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[1:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[2:])) + 1
    long = ends - begins >= least
    size = (ends - begins)[long]
    return begins[long], size, np.cumsum(size + 1)


def laid(begins: np.ndarray, size: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the runs laid end to end: the word it shows, and whether it is an end mark."""
    source = np.arange(int(stop[-1])) - np.repeat(stop - size - 1, size + 1) + np.repeat(begins, size + 1)
    mark = np.zeros(len(source), bool)
    mark[stop - 1] = True
    return source, mark


class Finder:
    """Occurrences of a block's phrases in stretches of documents."""

    def __init__(self, block: Phrases) -> None:
        self.block = block
        self.pool = Pool(bits=max(10, (len(block.vocabulary) * 3).bit_length()))
        self.pool.index(block.vocabulary)
        first, size, item = block.windows()
        self.least = int(size.min()) if len(size) else 0
        # equal phrases are searched once; they end alike, so phrases are kept by their last word
        number = np.zeros(len(first), np.int64)
        for k in range(block.window):
            symbol = np.where(size > k, block.coded[np.minimum(first + size - 1 - k, len(block.coded) - 1)], 0) if len(first) else number
            _, number = np.unique(number * (len(block.vocabulary) + 1) + symbol, return_inverse=True)
        order = np.lexsort((item, number))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (number[order][1:] != number[order][:-1]) | (item[order][1:] != item[order][:-1])
        pair = order[fresh]
        self.pair_item = item[pair]
        _, lead = np.unique(number[pair], return_index=True)
        self.pair_begin = np.append(lead, len(pair))
        self.last, self.sizes = (first + size - 1)[pair[lead]], size[pair[lead]]

    def hits(self, hashed: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, size, phrase) of each occurrence, for rows of words cut by offs."""
        none = np.zeros(0, np.int64)
        if not self.least or not len(hashed):
            return none, none, none
        symbol = self.pool.find(hashed).astype(np.int64) + 1
        begins, length, stop = long_runs(symbol > 0, offs, self.least)
        if not len(begins):
            return none, none, none
        source, mark = laid(begins, length, stop)
        text = np.where(mark, 0, symbol[np.minimum(source, len(symbol) - 1)])
        index = FMIndex(text, len(self.block.vocabulary))
        place, phrase = self.occurrences(index, self.block.coded, np.arange(len(self.last)))
        return source[place], self.sizes[phrase], phrase

    def occurrences(self, index: FMIndex, coded: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, phrase) of each occurrence of the phrases asked for, their words coded as the index has them."""
        low, high = index.search(coded, self.last[asked], self.sizes[asked])
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return index.locate(rows), asked[which]

    def in_shard(self, index: FMIndex, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, phrase) of each occurrence in an index with its own alphabet of word hashes."""
        at = np.minimum(np.searchsorted(alphabet, self.block.vocabulary), len(alphabet) - 1)
        symbol = np.where(alphabet[at] == self.block.vocabulary, at + 1, 0)
        coded = symbol[self.block.coded - 1]
        missing = np.concatenate([[0], np.cumsum(coded == 0)])
        place, phrase = self.occurrences(index, coded, np.flatnonzero(missing[self.last + 1] == missing[self.last + 1 - self.sizes]))
        return place, self.sizes[phrase], phrase

    def rows(self, hashed: np.ndarray, offs: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """For each row: merged word spans, and the items found."""
        return self.merged(*self.hits(hashed, offs), offs)

    def merged(self, start: np.ndarray, size: np.ndarray, phrase: np.ndarray, offs: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Occurrences of rows() by the rows that offs cuts out."""
        n, total = len(offs) - 1, int(offs[-1])
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        if len(start):
            row = np.searchsorted(offs, start, "right") - 1
            depth = np.bincount(start, minlength=total + 1) - np.bincount(start + size, minlength=total + 1)
            covered = np.concatenate([[False], np.cumsum(depth)[:total] > 0, [False]])
            first = np.zeros(total + 2, bool)
            first[offs[:-1] + 1] = True
            a = np.flatnonzero(covered[1:-1] & (~covered[:-2] | first[1:-1]))
            b = np.flatnonzero(covered[1:-1] & (~covered[2:] | first[2:])) + 1
            for r, x, y in zip((np.searchsorted(offs, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
                spans[r].append((x - int(offs[r]), y - int(offs[r])))
            for r, p in np.unique(np.stack([row, phrase], axis=1), axis=0).tolist():
                items[r].update(self.block.items[i] for i in self.pair_item[self.pair_begin[p] : self.pair_begin[p + 1]])
        return spans, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_RESULT = "n_words long, spans array<struct<start: int, end: int>>, items array<string>, clean_text string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _bare(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("n_words", "spans", "items", "clean_text")]


def _shards(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[Words, np.ndarray]]:
    """Words of stretches of rows, of SHARD_WORDS words or a little more, and where each row's words begin."""
    parts: list[Words] = []
    size = 0
    for first, last in slices(offs):
        parts.append(words(data, offs[first : last + 1], NOT_WORD, fold=True))
        size += len(parts[-1].hash)
        if size >= SHARD_WORDS or last == len(offs) - 1:
            base = np.cumsum([0, *(len(p.hash) for p in parts)])
            at = np.concatenate([[0], *(p.offs[1:] + x for p, x in zip(parts, base[:-1], strict=True))])
            yield Words(*(np.concatenate([p[k] for p in parts]) for k in range(3)), at)
            parts, size = [], 0


def _results(df: DataFrame, cut: bool, given: int, finder: Callable[[], Callable[[Words, pa.RecordBatch, int], tuple[list, list]]]) -> DataFrame:
    """df without its last `given` columns, with the result columns.

    finder() makes, once a task, what gives (spans, items) of a shard's rows from its words, the batch
    and the number of its first row.
    """
    kept = df.columns[: len(df.columns) - given]
    schema = StructType([*df.select(*kept).schema.fields, *StructType.fromDDL(_RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for b in batches:
            column = b.column(kept.index("text"))
            data, offs = text_buffer(column)
            raw = data.tobytes() if cut else b""
            n_words: list[int] = []
            spans: list[list[tuple[int, int]]] = []
            items: list[list[str]] = []
            clean: list[str | None] = []
            for shard in _shards(data, offs):
                row = len(spans)
                found, named = find(shard, b, row)
                n_words += np.diff(shard.offs).tolist()
                for r, (mine, names, first) in enumerate(zip(found, named, shard.offs[:-1].tolist(), strict=True), row):
                    spans.append(mine)
                    items.append(sorted(names))
                    if cut:
                        left, pieces = int(offs[r]), []
                        for x, y in mine:
                            pieces.append(raw[left : shard.start[first + x]])
                            left = int(shard.end[first + y - 1])
                        clean.append(b"".join([*pieces, raw[left : int(offs[r + 1])]]).decode())
            there = column.is_valid().to_pylist()
            made = [
                pa.array(n_words, pa.int64()), _span_lists(spans), pa.array(items, pa.list_(pa.string())),
                pa.array([c if v else None for c, v in zip(clean, there, strict=True)] if cut else [None] * len(b), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], names=[*kept, "n_words", "spans", "items", "clean_text"])

    return df.mapInArrow(run, schema)


def _span_lists(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], _SPANS)


def _sieve(benchmark: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the benchmark's words, as 64-bit fields, and the size of its shortest phrase (0: it has none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, least = np.zeros(SIEVE, bool), window
        for b in batches:
            data, offs = text_buffer(b.column(0))
            for first, last in slices(offs):
                found = words(data, offs[first : last + 1], NOT_WORD, fold=True)
                for place in _places(found.hash):
                    seen[place] = True
                n = np.diff(found.offs)
                least = min(least, int(n[n > 0].min(initial=window)))
        bits = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at]), pa.array(np.full(len(at), least, np.int32))], names=["at", "bits", "least"])

    met = benchmark.select("text").mapInArrow(run, "at int, bits long, least int").groupBy("at").agg(F.bit_or("bits").alias("bits"), F.min("least").alias("least")).toArrow()
    bits = np.zeros(SIEVE // 64, np.uint64)
    bits[met.column("at").to_numpy()] = met.column("bits").to_numpy().view(np.uint64)
    return bits, int(met.column("least").to_numpy().min(initial=window)) if met.num_rows else 0


def _places(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each word in the filter."""
    return (hashed & np.uint64(SIEVE - 1)).astype(np.int64), ((hashed >> np.uint64(32)) & np.uint64(SIEVE - 1)).astype(np.int64)


def _passes(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    a, b = ((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) for place in _places(hashed))
    return (a & b).astype(bool)


_SHARD = "ids array<binary>, runs binary, alphabet binary, bwt binary, sampled binary, place binary"


def index_texts(docs: DataFrame, sieve: np.ndarray, least: int) -> DataFrame:
    """One row a shard: digests of its texts, its runs (text, first word, length), its alphabet, and its FM-index."""
    held = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for shard in _shards(*text_buffer(b.column(1))):
                ids = b.column(0).slice(row, len(shard.offs) - 1)
                row += len(ids)
                begins, size, stop = long_runs(_passes(held.value, shard.hash), shard.offs, least)
                if not len(begins):
                    continue
                source, mark = laid(begins, size, stop)
                alphabet, symbol = np.unique(shard.hash[source[~mark]], return_inverse=True)
                text = np.zeros(len(source), np.int64)
                text[~mark] = symbol + 1
                owner = np.searchsorted(shard.offs, begins, "right") - 1
                mine, number = np.unique(owner, return_inverse=True)
                runs = np.stack([number, begins - shard.offs[owner], size]).astype(np.int64)
                row_of = [pa.array([ids.take(pa.array(mine)).to_pylist()], pa.list_(pa.binary()))]
                row_of += [pa.array([x], pa.binary()) for x in (runs.tobytes(), alphabet.tobytes(), *FMIndex(text, len(alphabet)).parts())]
                yield pa.RecordBatch.from_arrays(row_of, names=["ids", "runs", "alphabet", "bwt", "sampled", "place"])

    texts = docs.where("text is not null").select(_digest().alias("id"), "text")
    return texts.mapInArrow(run, _SHARD)


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def search_index(index: DataFrame, block: Phrases) -> DataFrame:
    """(id, spans, items) of the indexed texts that hold phrases of the block."""
    held = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(held.value)
        for b in batches:
            for i in range(len(b) if finder.least else 0):
                runs = np.frombuffer(b.column(1)[i].as_py(), np.int64).reshape(3, -1)
                alphabet = np.frombuffer(b.column(2)[i].as_py(), np.uint64)
                fm = FMIndex.of_parts(tuple(b.column(k)[i].as_py() for k in (3, 4, 5)), len(alphabet))
                at = np.concatenate([[0], np.cumsum(runs[2] + 1)])
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for (number, first, _), mine, names in zip(runs.T.tolist(), *finder.merged(*finder.in_shard(fm, alphabet), at), strict=True):
                    if mine:
                        spans.setdefault(number, []).extend((first + x, first + y) for x, y in mine)
                        items.setdefault(number, set()).update(names)
                ids = b.column(0)[i].as_py() if spans else []
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in spans], pa.binary()), _span_lists(list(spans.values())), pa.array([sorted(items[k]) for k in spans], pa.list_(pa.string()))], names=["id", "spans", "items"])

    return index.mapInArrow(run, "id binary, spans array<struct<start: int, end: int>>, items array<string>")


def _block(items: DataFrame, window: int) -> Phrases:
    return Phrases.of(sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (str(r[0]), r[1])), window)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, cut: bool = True, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words, spans (words, half open), items, and clean_text (the text without the spans).

    benchmark: (item_id, text). Its size is measured first and decides the number of blocks.
    """
    asked = benchmark.select("item_id", "text").where("text is not null")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    kept = _bare(docs)
    if n == 1:
        held = docs.sparkSession.sparkContext.broadcast(_block(asked, window))

        def search() -> Callable[[Words, pa.RecordBatch, int], tuple[list, list]]:
            finder = Finder(held.value)
            return lambda shard, batch, row: finder.rows(shard.hash, shard.offs)

        return _results(docs.select(*kept), cut, 0, search)
    index = stored(index_texts(docs, *_sieve(asked, window)), "leak-index")
    asked = stored(asked.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "leak-items")
    tables = [stored(search_index(index, _block(asked.where(F.col("block") == i), window)), "leaks") for i in range(n)]
    # a text gives the same rows wherever it stands, so copies fall together before lists are gathered
    once = reduce(DataFrame.union, [t.withColumn("block", F.lit(i)) for i, t in enumerate(tables)]).distinct()
    found = stored(once.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "leaks")
    discard(index, asked, *tables)
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    rows = docs.select(F.struct(*kept).alias("row"), _digest().alias("id"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    met = rows.join(found.withColumn("salt", salt), ["id", "salt"], "left").select("row.*", "spans", "items")

    def look_up() -> Callable[[Words, pa.RecordBatch, int], tuple[list, list]]:
        def given(shard: Words, batch: pa.RecordBatch, row: int) -> tuple[list, list]:
            spans, items = (batch.column(len(kept) + k).slice(row, len(shard.offs) - 1).to_pylist() for k in (0, 1))
            return [merge_spans([(s["start"], s["end"]) for s in mine or []]) for mine in spans], [names or [] for names in items]

        return given

    return _results(met, cut, 2, look_up)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), cut=False)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, i, k, item_id FROM g JOIN p USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
