"""Byte-level BPE by replaying merges over a corpus of pieces, and decoding.

The texts a task has are cut into pieces (matches of the byte-level pattern), and the distinct
pieces not met before are one corpus: their bytes lie in one array as a linked row of symbols. An
inverted index leads from each merge, named by its rank, to the places whose pair of symbols it
joins. Merges are taken in rank order; each applies to all its places at once, and only the two
pairs beside a joined symbol are looked up anew and entered under their own merge. Words that were
met before keep their ids in a bounded pool of the Python worker, so a corpus is replayed once.
No shuffle takes place.

Equality with the library: a piece is joined at its least rank first, leftmost among equal ones.
Joining all places of a merge at once differs from that only where a join makes a pair of a lesser
rank; such pieces are found out and replayed alone, one join at a time. A piece that is itself a
token is that token.

Defined results: a null or empty text has no tokens and decodes to nothing; special strings in a
text are ordinary text; a null id is kept; repeated rows give a row each; equal ranks do not occur
within a vocabulary; other columns, of any name, are left out; an empty table gives no rows. Long
texts are cut where white space follows something else, which no piece crosses, so memory is
bounded by CHUNK, the longest piece and the tokens of one text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import table, with_field
from bitloom.llm.pretoken import LETTER, NUMBER, OTHER, SPACE, code_points, span_hash, split_spaced
from bitloom.llm.textscan import Pool

#: Code points handled at once.
CHUNK = 1 << 19
#: Rows taken from an Arrow batch at once.
ROWS = 512
#: Rank of a pair that no merge joins.
NONE = np.int32(2**31 - 1)


@cache
def classes() -> np.ndarray:
    r"""Class of every code point, as the library's own regular expressions \p{L}, \p{N} and \s have them."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        matcher = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[code_points(bytes(matcher.encode_ordinary(every)).decode())] = kind
    return out


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches laid end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class Vocabulary:
    """Ranks of a rank file: tokens by bytes, bytes by id, and the merge of each pair of tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary needs a token for every byte")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, r in ranks.items():
            self.size[r] = len(token)
        self.begin = np.cumsum(self.size) - self.size
        self.known = self.size > 0
        self.flat = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.longest = max(map(len, ranks))

    @classmethod
    def read(cls, ranks_file: str) -> Vocabulary:
        with open(ranks_file, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    @cached_property
    def joined(self) -> dict[int, int]:
        """Rank of the merge of each pair of tokens, keyed by both ids."""
        ranks = self.ranks
        return {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    @cached_property
    def sorted_joins(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = sorted(self.joined.items())
        return np.array([p for p, _ in pairs] + [2**63 - 1], np.int64), np.array([r for _, r in pairs] + [NONE], np.int32)

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols, NONE where there is none; -1 is no symbol."""
        key = left.astype(np.int64) << 32 | right
        pair, merge = self.sorted_joins
        at = np.searchsorted(pair, key)
        return np.where(pair[at] == key, merge[at], NONE)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.flat[spread(self.begin[ids], self.size[ids])].tobytes()


def replay(vocabulary: Vocabulary, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids laid end to end, ids of each piece) for distinct, non-empty pieces that lie end to end in data."""
    n = len(data)
    ends = np.append(begins[1:], n)
    symbol = np.append(vocabulary.single[data], np.int32(-1))
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1], before[begins] = n, n  # place n stands for nothing
    rank = np.append(vocabulary.joins(symbol[:n], symbol[after[:n]]), NONE)
    # the index: places by rank, those of the beginning and those that joins bring about
    order = np.argsort(rank, kind="stable")
    order = order[: np.searchsorted(rank[order], NONE)]
    names, first = np.unique(rank[order], return_index=True)
    index = {int(r): [places] for r, places in zip(names, np.split(order, first[1:]), strict=True)} if len(names) else {}
    waiting = list(index)
    heapq.heapify(waiting)
    alone: list[np.ndarray] = []
    while waiting:
        r = heapq.heappop(waiting)
        held = index.pop(r)
        p = held[0] if len(held) == 1 else np.concatenate(held)
        p = p[rank[p] == r]
        if len(p) > 1:
            p = np.unique(p)
            chained = after[p[:-1]] == p[1:]
            if chained.any():  # of overlapping pairs every second one, from the left
                place = np.arange(len(p))
                start = np.maximum.accumulate(np.where(np.append(False, chained), 0, place))
                p = p[(place - start) % 2 == 0]
        if not len(p):
            continue
        q = after[p]
        far = after[q]
        if len(p) > 1:  # a join sees its right neighbour before that one is joined
            early = vocabulary.joins(np.full(len(p), r), symbol[far]) < r
            alone.append(p[early])
        symbol[p], symbol[q], rank[q] = r, -1, NONE
        after[p] = far
        before[far] = p
        left = before[p]
        touched = np.concatenate([p, left[left < n]])
        fresh = vocabulary.joins(symbol[touched], symbol[after[touched]])
        rank[touched] = fresh
        live = fresh < NONE
        touched, fresh = touched[live], fresh[live]
        if not len(fresh):
            continue
        if (fresh < r).any() and len(p) > 1:
            alone.append(touched[fresh < r])
        by = np.argsort(fresh, kind="stable")
        touched, fresh = touched[by], fresh[by]
        cuts = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
        lows = [0, *cuts.tolist(), len(fresh)]
        for i, k in enumerate(fresh[np.append(0, cuts)].tolist()):
            places = touched[lows[i] : lows[i + 1]]
            if k in index:
                index[k].append(places)
            else:
                index[k] = [places]
                heapq.heappush(waiting, k)
    alive = symbol[:n] >= 0
    ids, size = symbol[:n][alive], np.add.reduceat(alive, begins, dtype=np.int64) if n else np.zeros(0, np.int64)
    again = {int(i): replayed_alone(vocabulary, data[begins[i] : ends[i]]) for i in np.unique(np.searchsorted(begins, np.concatenate(alone), "right") - 1)} if alone else {}
    for i in np.flatnonzero((size > 1) & (ends - begins <= vocabulary.longest)).tolist():
        if (whole := vocabulary.ranks.get(data[begins[i] : ends[i]].tobytes())) is not None:
            again[i] = np.array([whole], np.int32)
    if again:
        parts = np.split(ids, np.cumsum(size)[:-1])
        for i, other in again.items():
            parts[i], size[i] = other, len(other)
        ids = np.concatenate(parts)
    return ids, size


def replayed_alone(vocabulary: Vocabulary, data: np.ndarray) -> np.ndarray:
    """Ids of one piece, joined one pair at a time: the least rank first, leftmost among equal ones."""
    n, none = len(data), int(NONE)
    symbol, after, before = [*vocabulary.single[data].tolist(), -1], [*range(1, n + 1), n], [*range(-1, n - 1), n]

    def joined(i: int) -> int:
        return vocabulary.joined.get(symbol[i] << 32 | symbol[after[i]], none) if after[i] < n else none

    heap = [(r, i) for i in range(n) if (r := joined(i)) < none]
    rank = {i: r for r, i in heap}
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if rank.get(i) != r:
            continue
        j = after[i]
        symbol[i], symbol[j], after[i] = r, -1, after[j]
        rank.pop(i)
        rank.pop(j, None)
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if 0 <= k < n:
                rank.pop(k, None)
                if (new := joined(k)) < none:
                    rank[k] = new
                    heapq.heappush(heap, (new, k))
    return np.array([s for s in symbol[:n] if s >= 0], np.int32)


@cache
def held_vocabulary(ranks_file: str) -> Vocabulary:
    return Vocabulary.read(ranks_file)


@cache
def held_encoder(ranks_file: str) -> Encoder:
    """One for each Python worker, so that its pool serves task after task."""
    return Encoder(held_vocabulary(ranks_file))


class Encoder:
    """Ids of whole texts by merge replay over the pieces that the pool does not have yet."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.pool = vocabulary, Pool()

    def _ids(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of each stretch of code points; a stretch begins and ends where pieces do."""
        codes = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        first = np.zeros(len(codes), bool)
        first[np.concatenate([[0], ends[:-1]])] = True
        starts = split_spaced(codes, classes()[codes], first)
        stops = np.append(starts[1:], len(codes))
        keys = span_hash(codes, starts, stops)
        slots = self.pool.find(keys)
        if (slots < 0).any():
            missing = np.flatnonzero(slots < 0)
            new, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            if self.pool.n + len(new) > self.pool.most:
                self.pool.clear()
                new, at = np.unique(keys, return_index=True)
            taken = codes[spread(starts[at], stops[at] - starts[at])]
            wide = 1 + (taken > 0x7F) + (taken > 0x7FF) + (taken > 0xFFFF)
            size = np.add.reduceat(wide, np.cumsum(stops[at] - starts[at]) - (stops[at] - starts[at]))
            data = np.frombuffer(taken.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            ids, counts = replay(self.vocabulary, data, np.cumsum(size) - size)
            self.pool.add(new, np.split(ids, np.cumsum(counts)[:-1]))
            slots = self.pool.find(keys)
        ids, size = self.pool.gather(slots)
        total = np.concatenate([[0], np.cumsum(size)])
        return np.split(ids, total[np.searchsorted(starts, ends)][:-1])

    @staticmethod
    def _stretches(text: str) -> Iterator[np.ndarray]:
        """A text's code points, cut about every CHUNK where white space follows something else."""
        codes = code_points(text)
        while len(codes) > CHUNK:
            space = classes()[codes] == SPACE
            cuts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            if not len(cuts):
                break
            cut = int(cuts[max(int(np.searchsorted(cuts, CHUNK, "right")) - 1, 0)])
            yield codes[:cut]
            codes = codes[cut:]
        yield codes

    def _many(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        full = [p for p in parts if len(p)]
        found = iter(self._ids(full) if full else [])
        return [next(found) if len(p) else np.zeros(0, np.int32) for p in parts]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            if len(text) > CHUNK:
                yield from self._many(held)
                held, size = [], 0
                yield np.concatenate([self._many([part])[0] for part in self._stretches(text)])
                continue
            held.append(code_points(text))
            size += len(text)
            if size >= CHUNK:
                yield from self._many(held)
                held, size = [], 0
        yield from self._many(held)


def encode(docs: DataFrame, ranks_file: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tokens): the ids of each whole text as little-endian unsigned 32-bit integers laid end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(ranks_file)
        few = (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))
        for b in few:
            texts = [t or "" for t in b.column(1).to_pylist()]
            done, size, rows = 0, 0, []
            for i, ids in enumerate(encoder.encode(texts)):
                rows.append(ids.astype("<u4").tobytes())
                size += len(rows[-1])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(rows)), pa.array(rows, pa.binary())], [id, "tokens"])
                    done, size, rows = i + 1, 0, []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(rows)), pa.array(rows, pa.binary())], [id, "tokens"])

    return docs.select(id, text).mapInArrow(run, with_field(docs.select(id), "tokens", "binary"))


def decode(tokens: DataFrame, ranks_file: str, id: str = "doc_id") -> DataFrame:
    """(id, tokens, decoded): the bytes of each row of tokens; null where an id is not in the vocabulary or a row is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held_vocabulary(ranks_file)
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            decoded = []
            for row in b.column(1).to_pylist():
                ids = np.frombuffer(row or b"", "<u4")
                sound = row is not None and (not len(ids) or (int(ids.max()) < len(vocabulary.known) and bool(vocabulary.known[ids].all())))
                decoded.append(vocabulary.bytes_of(ids) if sound else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(decoded, pa.binary())], [id, "tokens", "decoded"])

    two = tokens.select(id, "tokens")
    return two.mapInArrow(run, with_field(two, "decoded", "binary"))


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op11_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = decode(encode(table(spark, sf_dir, "documents"), rank_file()), rank_file())
    return read_back.select(
        "doc_id", F.expr("octet_length(tokens) div 4").cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
