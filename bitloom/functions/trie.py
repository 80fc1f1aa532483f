"""Dictionary coding of texts by a trie, in Arrow batches.

A spelling's code is its place in the dictionary, from 0; a character that no spelling takes has the code
-1 - its code point. The two cannot meet, whatever the size of the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_POINTS = 0x110000


class Trie:
    """States and their steps as one sorted array; all places of a batch walk it together."""

    def __init__(self, spellings: list[str]) -> None:
        steps: dict[tuple[int, int], int] = {}
        ends = [-1]
        for code, spelling in enumerate(spellings):
            state = 0
            for c in spelling:
                step = (state, ord(c))
                if step not in steps:
                    steps[step] = len(ends)
                    ends.append(-1)
                state = steps[step]
            if state and ends[state] < 0:  # of equal spellings the first one counts
                ends[state] = code
        keys = sorted((s * _POINTS + c, t) for (s, c), t in steps.items())
        self.keys = np.array([k for k, _ in keys] + [2**63 - 1], np.int64)
        self.next = np.array([t for _, t in keys] + [-1], np.int32)
        self.ends = np.array(ends, np.int32)

    def longest(self, points: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, length) of the longest spelling from each place on, within its text; -1 and 1 where there is none.

        points are the code points of texts laid end to end, stops the end of the text a place is in.
        """
        code, length = np.full(len(points), -1, np.int32), np.ones(len(points), np.int32)
        at, state, depth = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        while len(at):
            key = state * _POINTS + points[at + depth]
            found = np.searchsorted(self.keys, key)
            hit = self.keys[found] == key
            at, state = at[hit], self.next[found[hit]].astype(np.int64)
            depth += 1
            done = self.ends[state] >= 0
            code[at[done]], length[at[done]] = self.ends[state[done]], depth
            live = at + depth < stops[at]
            at, state = at[live], state[live]
        return code, length


def _lists(codes: np.ndarray, counts: list[int], nulls: pa.Array) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(nulls.to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int32()))


#: Code points, or codes, of texts that are worked on at once; a longer text makes a batch of its own.
CHUNK = 1 << 18


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows [first, last) of at most CHUNK together, or of one."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + CHUNK, "right")), first + 1)
        yield first, last
        first = last


def greedy_codes(text: Column, spellings: list[str], blank: int | None = None) -> Column:
    """Codes of a text: at each place the longest spelling, else the one character there, or `blank` for it.

    The empty spelling is never taken. A null text is null, an empty one has no codes.
    """
    trie = Trie(spellings)

    @F.arrow_udf("array<int>")
    def coded(texts: pa.Array) -> pa.Array:
        out, counts = [], []
        for first, last in _chunks(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)):
            rows = [t or "" for t in texts.slice(first, last - first).to_pylist()]
            points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            sizes = np.array([len(t) for t in rows])
            ends = np.cumsum(sizes)
            code, length = trie.longest(points, np.repeat(ends, sizes))
            taken, jump, place = [], length.tolist(), 0
            for end in ends.tolist():
                before = len(taken)
                while place < end:
                    taken.append(place)
                    place += jump[place]
                counts.append(len(taken) - before)
            taken = np.array(taken, np.int64)
            single = -1 - points[taken] if blank is None else np.full(len(taken), blank)
            out.append(np.where(code[taken] >= 0, code[taken], single).astype(np.int32))
        return _lists(np.concatenate(out) if out else np.zeros(0, np.int32), counts, texts.is_null())

    return coded(text)


def codes_text(codes: Column, spellings: list[str]) -> Column:
    """The text of codes made by greedy_codes; a code of neither kind shows as [$HEX], a null one as nothing."""

    @F.arrow_udf("string")
    def text(streams: pa.Array) -> pa.Array:
        seen = pc.unique(streams.flatten()).to_pylist()
        shown = {c: spellings[c] if 0 <= c < len(spellings) else chr(-1 - c) if -_POINTS <= c < 0 and not 0xD800 <= -1 - c < 0xE000 else f"[${c & 0xFFFFFFFF:X}]" for c in seen if c is not None}
        shown[None] = ""
        sizes = pc.fill_null(pc.list_value_length(streams), 0).to_numpy(zero_copy_only=False)
        # Python objects for some rows at a time: those of a whole batch take ten times its bytes and more
        parts = [pa.array([None if s is None else "".join([shown[c] for c in s]) for s in streams.slice(first, last - first).to_pylist()], pa.string()) for first, last in _chunks(sizes)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return text(codes)
