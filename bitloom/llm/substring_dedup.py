"""Substring dedup by recompression.

A document's words are the letters of a sequence that Spark rewrites in rounds. A run round replaces
equal neighbours by one symbol; in a pair round symbols fall into two halves by a bit of their name,
and each first-half symbol followed by a second-half symbol becomes one symbol. What a round wants to
name goes to Spark as distinct (left, right) rows; equal ones meet, each that at least two documents
have gets an id, and the ids are joined back to the documents that asked. So names are global, and
equal names mean equal words. For each symbol the rounds carry the stretch of words that its making
depended on (its certificate): wherever those words stand, the same symbol arises.

A pair that a single document has is left unnamed, and every window of `width` words that holds its
certificate ends there, since no other document can have that window. Symbols outside all living
windows are dropped, so the sequences shrink to what repeats. Rounds go on until symbols average an
eighth of a window or nothing is left to name. Each living window then takes, of the symbols
certified in it, the one of the highest round; windows meet by that symbol and are compared by the
hash of all their words.

Before the rounds, a sieve keeps most text out of them: each task rewrites its documents for a few
rounds with names that are hashes of what they stand for, and one grouping in Spark finds the
symbols of four words or more that only one document has. These end windows in the same way.

Documents with equal word sequences meet in the hash of their last sieve symbols, with a digest of
their words as the check, and are settled first: all but the one with the least id lose their
windows whole.

Defined results: null texts have no words; documents of fewer than `width` words lose nothing; rows
with a null doc_id are neither cut nor a source; rows that share a doc_id are judged one by one and
are no source for each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import discard, stored, table
from bitloom.llm.textscan import SPACES, U64, join_hash, mix, slices, text_buffer, words

#: Rounds of the sieve, and the words a symbol needs to be looked at there.
SIEVE_ROUNDS, SIEVE_WORDS = 4, 4
#: A place no window reaches: the border of a row, or a dropped symbol.
FAR = 1 << 30
#: Name of dropped symbols. Letters are negative, named symbols are from 1 << ROUND_BITS up.
DROPPED = 0
ROUND_BITS = 55
_BASE = 0x9E3779B97F4A7C15 | 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, U64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Spans:
    """Hashes of any stretch of a sequence of hashed words."""

    def __init__(self, hashed: np.ndarray) -> None:
        size = 1 << max(16, len(hashed).bit_length())
        up, self.down = _powers(size)
        self.total = np.concatenate([np.zeros(1, U64), np.cumsum(hashed * up[: len(hashed)], dtype=U64)])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[begin]) * self.down[begin] + (end - begin).astype(U64))


class Symbols(NamedTuple):
    """Symbols of several rows laid end to end: name, certificate within the row, row."""

    name: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def take(self, at: np.ndarray) -> Symbols:
        return Symbols(*(x[at] for x in self))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin of the left and end of the right neighbour's certificate; FAR outside the row."""
        left, right = np.full(len(self.row), -FAR, self.begin.dtype), np.full(len(self.row), FAR, self.end.dtype)
        same = self.row[1:] == self.row[:-1]
        left[1:][same], right[:-1][same] = self.begin[:-1][same], self.end[1:][same]
        return left, right

    def certain(self) -> np.ndarray:
        """Which certificates lie inside the row."""
        return (self.begin >= 0) & (self.end < FAR)


class Rewrite(NamedTuple):
    """A round's outcome before naming: the symbols, and the (left, right) of those that `fresh` marks."""

    symbols: Symbols
    fresh: np.ndarray
    left: np.ndarray
    right: np.ndarray


def runs(s: Symbols) -> Rewrite:
    """Equal neighbours as one symbol, (name, -length). Where a run ends is known only with both neighbours."""
    if not len(s.name):
        return Rewrite(s, np.zeros(0, bool), s.name, s.name)
    left, right = s.neighbours()
    first = np.ones(len(s.name), bool)
    first[1:] = (s.name[1:] != s.name[:-1]) | (s.row[1:] != s.row[:-1]) | (s.name[1:] == DROPPED)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(first)) - 1
    out = Symbols(s.name[at], left[at], right[last], s.row[at])
    gone = out.name == DROPPED
    out.begin[gone], out.end[gone] = -FAR, FAR
    long = last > at
    return Rewrite(out, long, out.name[long], (at - last - 1)[long])


def pairs(s: Symbols, salt: int) -> Rewrite:
    """First-half symbols joined with the second-half symbols behind them.

    A symbol left alone depends on the neighbour that might have joined it.
    """
    left, right = s.neighbours()
    live = s.name != DROPPED
    half = (mix(s.name.view(U64) + U64(salt)) & U64(1)) == 0
    joined = np.zeros(len(s.name), bool)
    joined[:-1] = half[:-1] & ~half[1:] & live[:-1] & live[1:] & (s.row[1:] == s.row[:-1])
    second = np.zeros(len(s.name), bool)
    second[1:] = joined[:-1]
    alone = live & ~joined & ~second
    begin, end = np.where(alone & ~half, left, s.begin), np.where(alone & half, right, s.end)
    at = np.flatnonzero(joined)
    end[at] = s.end[at + 1]
    kept = ~second
    return Rewrite(Symbols(s.name[kept], begin[kept], end[kept], s.row[kept]), joined[kept], s.name[at], s.name[at + 1])


def sieve_symbols(hashed: np.ndarray, offs: np.ndarray, rounds: int = SIEVE_ROUNDS) -> tuple[Symbols, np.ndarray]:
    """(symbols, words in each) after `rounds` rounds with hashes as names."""
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size)), size)
    place = (np.arange(len(hashed)) - np.repeat(offs[:-1], size)).astype(np.int32)
    made = runs(Symbols(hashed.view(np.int64), place, place + np.int32(1), row))
    s = made.symbols
    name = s.name.copy()
    name[made.fresh] = join_hash(made.left.view(U64), made.right.view(U64)).view(np.int64)
    count = np.ones(len(name), np.int32)
    count[made.fresh] = -made.right
    s = s._replace(name=name)
    for k in range(rounds):
        made = pairs(s, k + 1)
        at = np.flatnonzero(made.fresh)
        kept = np.ones(len(s.name), bool)
        starts = np.arange(len(at)) + at  # each pair before took one place more
        kept[starts + 1] = False
        grown = count[kept]
        grown[at] += count[starts + 1]
        count = grown
        name = made.symbols.name.copy()
        name[at] = join_hash(made.left.view(U64), made.right.view(U64)).view(np.int64)
        s = made.symbols._replace(name=name)
    return s, count


def tops(symbols: Symbols, rows: int) -> np.ndarray:
    """Top symbol of each row, the hash of its symbols' names in order."""
    at = np.searchsorted(symbols.row, np.arange(rows + 1))
    return Spans(symbols.name.view(U64))(at[:-1], at[1:])


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ref): ref tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("ref"))


_MARK = pa.list_(pa.struct([("name", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())]))
_PARSED = "doc_id long, n_words long, top long, sha string, ref long, marks array<struct<name: bigint, begin: int, end: int>>"


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in columns sorted by them."""
    fresh = np.ones(len(sorted_columns[0]), bool)
    if len(fresh):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return np.flatnonzero(fresh)


def _lists(begins: np.ndarray, values: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column cut out of values (an Arrow or int array) at begins."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind or pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)).astype(np.int32)), values)


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(values, row of each) of a list column; null lists are empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), size)


def parse(docs: DataFrame, width: int) -> DataFrame:
    """Each document's word count, top symbol, digest of its words, hash of its text, and sieve symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffer(b.column(1))
            for first, last in slices(offs):
                at = offs[first : last + 1]
                found = words(data, at, SPACES, fold=False)
                symbols, count = sieve_symbols(found.hash, found.offs)
                top = tops(symbols, last - first).view(np.int64)
                raw = data[at[0] : at[-1]].tobytes()
                sha = [hashlib.sha256(b" ".join(raw[x:y].split())).hexdigest() for x, y in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                fit = np.flatnonzero((count >= SIEVE_WORDS) & symbols.certain() & (symbols.end - symbols.begin <= width))
                mine = symbols.take(fit)
                # one entry a name and row, the first
                mine = mine.take(np.lexsort((mine.begin, mine.name, mine.row)))
                mine = mine.take(_starts(mine.row, mine.name))
                flat = pa.StructArray.from_arrays([pa.array(mine.name), pa.array(mine.begin), pa.array(mine.end)], fields=list(_MARK.value_type))
                marks = _lists(np.searchsorted(mine.row, np.arange(last - first)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(np.diff(found.offs)), pa.array(top), pa.array(sha), b.column(2).slice(first, last - first), marks], names=["doc_id", "n_words", "top", "sha", "ref", "marks"])

    return _identified(docs).mapInArrow(run, _PARSED)


class Living:
    """The windows of several rows that may still repeat, as flags over all windows laid end to end."""

    def __init__(self, size: np.ndarray, flags: np.ndarray, width: int) -> None:
        self.size, self.flags, self.width = size, flags, width
        self.base = np.cumsum(size) - size

    @staticmethod
    def of(spans: pa.ListArray, width: int) -> Living:
        """From lists of (first, last) windows in order."""
        values, row = _flat(spans)
        first, last = (values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        size = np.zeros(len(spans), np.int64)
        np.maximum.at(size, row, last + 1)
        depth = np.zeros(int(size.sum()) + 1, np.int64)
        base = np.cumsum(size) - size
        np.add.at(depth, base[row] + first, 1)
        np.add.at(depth, base[row] + last + 1, -1)
        return Living(size, np.cumsum(depth)[:-1] > 0, width)

    def _reach(self, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows, from and to, that hold each certificate; to < from where there is none."""
        low = np.maximum(end.astype(np.int64) - self.width, 0)
        high = np.minimum(begin.astype(np.int64), self.size[row] - 1)
        return low + self.base[row], high + self.base[row]

    def end(self, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Ends all windows that hold one of these certificates."""
        low, high = self._reach(row, begin, end)
        some = high >= low
        depth = np.zeros(len(self.flags) + 1, np.int64)
        np.add.at(depth, low[some], 1)
        np.add.at(depth, high[some] + 1, -1)
        self.flags &= np.cumsum(depth)[:-1] == 0

    def holds(self, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Does a living window hold each certificate."""
        low, high = self._reach(row, begin, end)
        total = np.concatenate([[0], np.cumsum(self.flags)])
        some = high >= low
        return some & (total[np.where(some, high + 1, 0)] > total[np.where(some, low, 0)])

    def spans(self) -> pa.ListArray:
        row = np.repeat(np.arange(len(self.size)), self.size)
        edge = np.ones(len(row), bool)
        edge[1:] = row[1:] != row[:-1]
        begin = self.flags.copy()
        begin[1:] &= ~self.flags[:-1] | edge[1:]
        stop = self.flags.copy()
        stop[:-1] &= ~self.flags[1:] | edge[1:]
        a, z = np.flatnonzero(begin), np.flatnonzero(stop)
        flat = pa.StructArray.from_arrays([pa.array((x - self.base[row[a]]).astype(np.int32)) for x in (a, z)], fields=list(_SPAN.value_type))
        return _lists(np.searchsorted(row[a], np.arange(len(self.size))), flat)


_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_ALIVE = "alive array<struct<first: int, last: int>>"


def _sifted(own: DataFrame, width: int) -> DataFrame:
    """(doc_id, ref, alive): windows without a sieve symbol that only their document has."""
    marks = own.select("doc_id", "ref", F.explode("marks").alias("m")).select("doc_id", "ref", "m.name", (F.col("m.begin").cast("long") * (width + 1) + F.col("m.end") - F.col("m.begin")).alias("place"))
    ranged = marks.groupBy("name").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("doc_id", "ref")], F.min("place").alias("place"))
    lonely = ranged.where("min_doc_id = max_doc_id and min_ref = max_ref").select(F.col("min_doc_id").alias("doc_id"), F.col("min_ref").alias("ref"), "place")
    ended = lonely.groupBy("doc_id", "ref").agg(F.collect_list("place").alias("places"))
    asked = own.select("doc_id", "ref", "n_words").join(ended, ["doc_id", "ref"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.maximum(b.column(2).to_numpy() - width + 1, 0)
            living = Living(size, np.ones(int(size.sum()), bool), width)
            place, row = _flat(b.column(3))
            place = place.to_numpy(zero_copy_only=False)
            begin = place // (width + 1)
            living.end(row, begin, begin + place % (width + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), living.spans()], names=["doc_id", "ref", "alive"])

    return asked.select("doc_id", "ref", "n_words", "places").mapInArrow(run, f"doc_id long, ref long, {_ALIVE}").where("size(alive) > 0")


_STATE = f"doc_id long, ref long, names array<long>, begins array<int>, ends array<int>, {_ALIVE}"


def _state_rows(b: pa.RecordBatch, s: Symbols, living: Living) -> pa.RecordBatch:
    """State of the rows that still have a living window, without the symbols no such window holds."""
    useful = (s.name != DROPPED) & s.certain()
    useful[useful] = living.holds(s.row[useful], s.begin[useful], s.end[useful])
    name, begin, end = np.where(useful, s.name, DROPPED), np.where(useful, s.begin, -FAR), np.where(useful, s.end, FAR)
    # dropped neighbours are one
    fresh = np.ones(len(name), bool)
    fresh[1:] = useful[1:] | useful[:-1] | (s.row[1:] != s.row[:-1])
    at = np.searchsorted(s.row[fresh], np.arange(len(b)))
    alive = living.spans()
    out = pa.RecordBatch.from_arrays(
        [b.column("doc_id"), b.column("ref"), _lists(at, name[fresh], pa.int64()), _lists(at, begin[fresh]), _lists(at, end[fresh]), alive],
        names=["doc_id", "ref", "names", "begins", "ends", "alive"],
    )
    return out.filter(pc.greater(pc.list_value_length(alive), 0))


def _symbols(b: pa.RecordBatch) -> Symbols:
    name, row = _flat(b.column("names"))
    return Symbols(name.to_numpy(zero_copy_only=False), *(b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("begins", "ends")), row)


def letters(held: DataFrame, width: int) -> DataFrame:
    """State before the first round: words as letters, named by a negative hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            for first, last in slices(offs):
                found = words(data, offs[first : last + 1], SPACES, fold=False)
                size = np.diff(found.offs)
                place = (np.arange(len(found.hash)) - np.repeat(found.offs[:-1], size)).astype(np.int32)
                name = (found.hash | U64(1 << 63)).view(np.int64)
                part = b.slice(first, last - first)
                yield _state_rows(part, Symbols(name, place, place + np.int32(1), np.repeat(np.arange(last - first), size)), Living.of(part.column("alive"), width))

    return held.mapInArrow(run, _STATE)


def _rewrite(s: Symbols, kind: str, number: int) -> Rewrite:
    return runs(s) if kind == "run" else pairs(s, number)


def wanted(state: DataFrame, kind: str, number: int, width: int) -> DataFrame:
    """(doc_id, ref, left, right): what each row's round wants to name, where the certificate fits a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _rewrite(_symbols(b), kind, number)
            new = made.symbols.take(made.fresh)
            fit = np.flatnonzero(new.certain() & (new.end - new.begin <= width))
            row, left, right = new.row[fit], made.left[fit], made.right[fit]
            order = np.lexsort((right, left, row))
            row, left, right = row[order], left[order], right[order]
            at = _starts(row, left, right)
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("ref").take(take), pa.array(left[at]), pa.array(right[at])], names=["doc_id", "ref", "left", "right"])

    return state.mapInArrow(run, "doc_id long, ref long, left long, right long")


def names(asked: DataFrame, number: int) -> DataFrame:
    """(left, right, name): a global name for each pair or run that at least two documents want."""
    shared = asked.groupBy("left", "right").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return shared.select("left", "right", (F.monotonically_increasing_id() + F.lit(number << ROUND_BITS)).alias("name"))


def renamed(state: DataFrame, asked: DataFrame, named: DataFrame, kind: str, number: int, width: int) -> DataFrame:
    """State after a round. What got no name is dropped, with the windows that hold its certificate."""
    given = asked.join(named, ["left", "right"]).groupBy("doc_id", "ref").agg(F.collect_list(F.struct("left", "right", "name")).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _rewrite(_symbols(b), kind, number)
            s, living = made.symbols, Living.of(b.column("alive"), width)
            flat, row = _flat(b.column("given"))
            left, right, name = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            key = lambda r, x, y: join_hash(join_hash(r.astype(U64), x.view(U64)), y.view(U64))
            known = key(row, left, right)
            order = np.argsort(known)
            fresh = np.flatnonzero(made.fresh)
            want = key(s.row[fresh], made.left, made.right)
            spot = np.searchsorted(known[order], want)
            spot[spot == len(known)] = 0
            got = order[spot] if len(known) else np.zeros(len(want), np.int64)
            hit = known[got] == want if len(known) else np.zeros(len(want), bool)
            new = s.name.copy()
            new[fresh] = DROPPED
            new[fresh[hit]] = name[got[hit]]
            none = fresh[~hit]
            none = none[s.certain()[none] & (s.end[none] - s.begin[none] <= width)]
            living.end(s.row[none], s.begin[none], s.end[none])
            yield _state_rows(b, s._replace(name=new), living)

    return state.join(given, ["doc_id", "ref"], "left").mapInArrow(run, _STATE)


def rounds_of(width: int) -> list[str]:
    """Kinds of the rounds: pair rounds until symbols, four thirds longer each time, average an eighth of a window."""
    out, size = [], 1.0
    while size < max(width / 8, 2):
        out += (["run"] if len(out) % 4 == 0 else []) + ["pair"]
        size *= 4 / 3
    return out


def recompress(held: DataFrame, width: int) -> DataFrame:
    """State of (doc_id, ref, text, alive) rows after all rounds."""
    state = stored(letters(held, width), "letters")
    for number, kind in enumerate(rounds_of(width), 1):
        asked = wanted(state, kind, number, width)
        named = stored(names(asked, number), "names")
        done = kind == "pair" and named.isEmpty()
        after = stored(renamed(state, asked, named, kind, number, width), "symbols")
        discard(state, named)
        state = after
        if done:
            break
    return state


def highest(s: Symbols, living: Living) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, name of its symbol of the highest round; ties by hash) of each living window; DROPPED without one."""
    row = np.repeat(np.arange(len(living.size)), living.size)[living.flags]
    window = np.flatnonzero(living.flags) - living.base[row]
    live = s.take(np.flatnonzero(s.name != DROPPED))
    if not len(live.name) or not len(window):
        return row, window, np.zeros(len(window), np.int64)
    age = np.where(live.name > 0, live.name >> ROUND_BITS, 0).astype(U64)
    rank = ((U64(127) - age) << U64(57)) | (mix(live.name.view(U64)) >> U64(7))
    # rows laid end to end in one axis
    step = np.int64(FAR)
    low = np.searchsorted(live.row * step + live.begin, row * step + window, "left")
    high = np.searchsorted(live.row * step + live.end, row * step + window + living.width, "right")
    count = np.maximum(high - low, 0)
    ladder = [np.arange(len(rank))]
    while 2 << (len(ladder) - 1) <= int(count.max(initial=0)):
        a, hop = ladder[-1], 1 << (len(ladder) - 1)
        b = np.concatenate([a[hop:], np.full(hop, len(rank) - 1)])
        ladder.append(np.where(rank[a] <= rank[b], a, b))
    level = np.zeros(len(window), np.int64)
    for k in range(1, len(ladder)):
        level[count >= 1 << k] = k
    out = np.zeros(len(window), np.int64)
    for k, rung in enumerate(ladder):
        at = np.flatnonzero((count > 0) & (level == k))
        a, b = rung[low[at]], rung[high[at] - (1 << k)]
        out[at] = live.name[np.where(rank[a] <= rank[b], a, b)]
    return row, window, out


def _window_rows(held: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """(doc_id, ref, key, hashed, places) of the living windows: their symbol, and the hash of their words."""
    both = held.select("doc_id", "ref", "text").join(state, ["doc_id", "ref"]).select("doc_id", "ref", "text", "names", "begins", "ends", "alive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            for first, last in slices(offs):
                found = words(data, offs[first : last + 1], SPACES, fold=False)
                part = b.slice(first, last - first)
                row, window, key = highest(_symbols(part), Living.of(part.column("alive"), width))
                at = window + found.offs[row]
                hashed = Spans(found.hash)(at, at + width).view(np.int64)
                order = np.lexsort((window, hashed, row))
                row, window, key, hashed = row[order], window[order], key[order], hashed[order]
                group = _starts(row, hashed)
                take = pa.array(row[group])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("ref").take(take), pa.array(key[group]), pa.array(hashed[group]), _lists(group, window)], names=["doc_id", "ref", "key", "hashed", "places"])

    return both.mapInArrow(run, "doc_id long, ref long, key long, hashed long, places array<int>")


def _cut(held: DataFrame, width: int) -> DataFrame:
    """(doc_id, ref, n_removed, kept_sha256, spans, kept_text) of rows with the places of their repeated windows."""
    kind = "doc_id long, ref long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffer(b.column(1))
            out: list[tuple] = []
            docs, ref, places = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)
            for first, last in slices(offs):
                found = words(data, offs[first : last + 1], SPACES, fold=False)
                for r in range(first, last):
                    a, z = int(found.offs[r - first]), int(found.offs[r - first + 1])
                    place = places[r].values.to_numpy()
                    place = np.unique(place)
                    depth = np.bincount(place, minlength=z - a + 1) - np.bincount(place + width, minlength=z - a + 1)
                    gone = np.cumsum(depth)[: z - a] > 0
                    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                    spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                    raw, base = data[offs[r] : offs[r + 1]].tobytes(), int(offs[r])
                    left, pieces = 0, []
                    for x, y in spans:
                        pieces.append(raw[left : int(found.start[a + x]) - base])
                        left = int(found.end[a + y - 1]) - base
                    kept = b"".join([*pieces, raw[left:]])
                    # words on both sides of a cut stay apart, as white space stood on both sides of it
                    out.append((docs[r], ref[r], int(gone.sum()), hashlib.sha256(b" ".join(kept.split())).hexdigest(), [{"start": x, "end": y} for x, y in spans], kept.decode()))
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "ref", "n_removed", "kept_sha256", "spans", "kept_text"])

    return held.select("doc_id", "text", "ref", "places").mapInArrow(run, kind)


def repeated_passages(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, ref, n_words, n_removed, kept_sha256, spans, kept_text) of each row.

    spans are the removed words (half open), kept_text the text without them, null where nothing
    was removed. ref is a hash of the row's text that tells rows of one doc_id apart.
    """
    wide = stored(parse(docs, width), "parsed")
    long = wide.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= width))
    owners = stored(long.groupBy("top", "sha").agg(F.min("doc_id").alias("owner")), "owners")
    own = stored(long.join(owners, ["top", "sha"]).where("doc_id = owner").select("doc_id", "ref", "n_words", "marks"), "own")
    # marks are most of what was parsed, and own has those that are needed
    parsed = stored(wide.drop("marks"), "counts")
    discard(wide)
    alive = stored(_sifted(own, width).dropDuplicates(["doc_id", "ref"]), "alive")
    discard(own)
    held = stored(_identified(docs).where("doc_id is not null").join(alive, ["doc_id", "ref"]).dropDuplicates(["doc_id", "ref"]), "held")
    state = recompress(held, width)
    rows = stored(_window_rows(held, state, width), "windows")
    discard(alive, state)
    repeated = stored(rows.groupBy("key", "hashed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", "hashed", "least"), "repeated")
    gone = rows.join(repeated, ["key", "hashed"]).where("doc_id > least").groupBy("doc_id", "ref").agg(F.flatten(F.collect_list("places")).alias("places"))
    cut = stored(_cut(held.drop("alive").join(gone, ["doc_id", "ref"]), width), "cut")
    discard(rows, repeated, held)
    base = parsed.join(owners, ["top", "sha"], "left").join(cut, ["doc_id", "ref"], "left")
    copy = F.col("owner") < F.col("doc_id")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return base.select(
        "doc_id", "ref", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.slice(whole, 1, 0))).alias("spans"),
        F.when(copy, "").otherwise(F.col("kept_text")).alias("kept_text"),
    )


def without_passages(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with repeated passages cut out of the texts; rows of which nothing is left go."""
    judged = repeated_passages(docs, width).where("n_removed > 0").select("doc_id", "ref", "kept_text", (F.col("n_removed") == F.col("n_words")).alias("nothing_left"))
    once = judged.dropDuplicates(["doc_id", "ref"]).select(F.struct("doc_id", "ref").alias("_row"), F.struct("kept_text", "nothing_left").alias("_cut"))
    marked = docs.withColumn("_row", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ref")))
    kept = marked.join(once, "_row", "left").where(~F.coalesce(F.col("_cut.nothing_left"), F.lit(False)))
    text = F.when(F.col("_cut").isNotNull(), F.col("_cut.kept_text")).otherwise(F.col("text"))
    return kept.withColumn("text", text).select(*docs.columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS f FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM g JOIN m USING (h) WHERE doc_id > f),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
r AS (SELECT k.doc_id, count(hit.j) AS n_removed, string_agg(word, ' ' ORDER BY k.j) FILTER (hit.j IS NULL) AS kept FROM k LEFT JOIN hit ON hit.doc_id = k.doc_id AND hit.j = k.j GROUP BY k.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
