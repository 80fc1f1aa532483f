"""Exact token counts at every prefix, by dynamic programming over BPE merges.

For a prefix p of a pre-token, encode(p) is encode(p without its last token) and that last token,
and exactly one vocabulary entry ending at p is a last token that BPE would not have merged across.
So one left-to-right pass finds the last token of each prefix, and its count is one more than the
count where that token begins. Entries that close a word are tried as the end of every prefix,
which gives the count of the text cut there. Laid end to end over a text's pre-tokens this is a
table of the exact token count at each prefix; truncation and budget questions are look-ups in it.

Positions are characters of the text in normal form C and lower case, as the vocabulary's own
normaliser makes them. Defined results: null and empty texts have no tokens and an empty table; a
null doc_id is kept; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import table
from bitloom.llm.pretoken import UNSURE, code_points, kinds, span_hash, split_words
from bitloom.llm.textscan import U64, Pool, mix

CHUNK = 1 << 20
_CONTRACTED = {"'s", "'t", "'m", "'d", "'re", "'ve", "'ll"}


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: letter -> byte, by their public rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A BPE with an end-of-word mark, as arrays over symbols ranked by the merge that makes them."""

    def __init__(self, model: dict) -> None:
        self.mark = model["end_of_word_suffix"]
        letters = byte_letters()
        spelled: dict[str, int] = {}
        self.left, self.right, self.text = [], [], []

        def symbol(s: str) -> int:
            if s not in spelled:
                spelled[s] = len(self.text)
                closed = s.endswith(self.mark)
                self.text.append((bytes(letters[c] for c in (s[: -len(self.mark)] if closed else s)), closed))
                self.left.append(spelled[s])
                self.right.append(spelled[s])
            return spelled[s]

        for c in letters:
            symbol(c)
            symbol(c + self.mark)
        self.base = len(self.text)
        pairs = []
        for a, b in model["merges"]:
            made = len(self.text)
            known = a + b in spelled
            s = symbol(a + b)
            x, y = spelled[a], spelled[b]
            if not known:
                self.left[made], self.right[made] = x, y
            pairs.append((x, y, s))
        self.left, self.right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        pairs = np.array(pairs, np.int64)
        self.pair_made, self.pairs = pairs[:, 2], Pool(bits=18)
        self.pairs.index(_pair_key(pairs[:, 0], pairs[:, 1]))
        self.answered, self.answers = Pool(bits=21), np.zeros(1_200_000, bool)
        self.longest = max(len(t) for t, _ in self.text)
        # spellings: hash -> its open and its closed symbol
        spelling = sorted({t for t, _ in self.text})
        place = {t: i for i, t in enumerate(spelling)}
        self.symbols = np.full((len(spelling) + 1, 2), -1, np.int64)
        for i, (t, closed) in enumerate(self.text):
            self.symbols[place[t], int(closed)] = i
        self.spellings = Pool(bits=18)
        self.spellings.index(np.array([_byte_hash(np.frombuffer(t, np.uint8)[None, :])[-1][0] for t in spelling], U64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """(open, closed) symbol of each hashed spelling, -1 if there is none."""
        return self.symbols[self.spellings.find(keys)]

    def stays(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Would BPE keep symbol x followed by symbol y apart? Answers are kept in a bounded table."""
        keys = _pair_key(x, y)
        at = self.answered.find(keys)
        if (at < 0).any():
            new, first = np.unique(keys[at < 0], return_index=True)
            first = np.flatnonzero(at < 0)[first]
            if self.answered.n + len(new) > len(self.answers):
                self.answered.clear()
                new, first = np.unique(keys, return_index=True)
                if len(new) > len(self.answers):
                    return self._stays(x, y)
            n = self.answered.n
            self.answered.index(new)
            self.answers[n : n + len(new)] = self._stays(x[first], y[first])
            at = self.answered.find(keys)
        return self.answers[at]

    def _stays(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The answer itself.

        Undo merges from the latest; at each state a merge across the border that comes before
        the last one undone would have been taken, so the two could not both stand.
        """
        n = len(x)
        ok, todo = np.ones(n, bool), np.arange(n)
        x, y, limit = x.copy(), y.copy(), np.full(n, np.iinfo(np.int64).max)
        while len(todo):
            a, b = x[todo], y[todo]
            at = self.pairs.find(_pair_key(a, b))
            crossed = (at >= 0) & (self.pair_made[at] < limit[todo])
            ok[todo[crossed]] = False
            todo, a, b = todo[~crossed], a[~crossed], b[~crossed]
            a_base, b_base = a < self.base, b < self.base
            live = ~(a_base & b_base)
            todo, a, b, a_base, b_base = (v[live] for v in (todo, a, b, a_base, b_base))
            from_left = ~a_base & (b_base | (a > b))
            # a merge on the left wins ties of rank against a later border merge, one on the right does not
            limit[todo] = np.where(from_left, a, b + 1)
            x[todo] = np.where(from_left, self.right[a], a)
            y[todo] = np.where(from_left, b, self.left[b])
        return ok

    def tables(self, tokens: list[bytes]) -> list[np.ndarray]:
        """For each pre-token, the token count of each of its byte prefixes taken as a whole word."""
        out: list[np.ndarray] = [None] * len(tokens)  # type: ignore[list-item]
        order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
        i = 0
        while i < len(order):
            width = len(tokens[order[i]])
            j = i + 1
            while j < len(order) and len(tokens[order[j]]) <= max(8, width * 5 // 4) and (j - i) * width < 1 << 20:
                j += 1
            width = len(tokens[order[j - 1]])
            group = sorted(order[i:j], key=tokens.__getitem__)  # equal prefixes lie together
            data = np.zeros((len(group), width), np.uint8)
            for r, k in enumerate(group):
                data[r, : len(tokens[k])] = np.frombuffer(tokens[k], np.uint8)
            counts = self._dp(data, np.array([len(tokens[k]) for k in group]))
            for r, k in enumerate(group):
                out[k] = counts[r, : len(tokens[k])]
            i = j
        return out

    def _dp(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rows, width = data.shape
        last = np.full((rows, width + 1), -1, np.int64)
        count = np.zeros((rows, width + 1), np.int32)
        closed = np.zeros((rows, width), np.int32)
        hashes: dict[int, list[np.ndarray]] = {}
        # the first byte in which a row differs from the one before; up to it their states are one
        differs = data[1:] != data[:-1]
        shared = np.concatenate([[0], np.minimum(differs.argmax(axis=1), sizes[:-1])]) if rows > 1 else np.zeros(1, np.int64)
        for end in range(1, width + 1):
            every = np.flatnonzero(sizes >= end)
            own = shared < end
            alive = every[own[every]]
            hashes[end - 1] = _byte_hash(data[:, end - 1 : end - 1 + self.longest])
            hashes.pop(end - 1 - self.longest, None)
            taken = np.zeros((2, rows), bool)
            for size in range(min(end, self.longest), 0, -1):
                begin = end - size
                asked = alive[~(taken[0, alive] & taken[1, alive])]
                if not len(asked):
                    break
                found = self.find(hashes[begin][size - 1][asked])
                for close in (0, 1):
                    has = (found[:, close] >= 0) & ~taken[close, asked]
                    spot, symbol = asked[has], found[has, close]
                    if begin and len(spot):
                        fits = self.stays(last[spot, begin], symbol)
                        spot, symbol = spot[fits], symbol[fits]
                    if close:
                        closed[spot, end - 1] = count[spot, begin] + 1
                    else:
                        last[spot, end], count[spot, end] = symbol, count[spot, begin] + 1
                    taken[close, spot] = True
            like = np.maximum.accumulate(np.where(own, np.arange(rows), 0))[every]
            last[every, end], count[every, end], closed[every, end - 1] = last[like, end], count[like, end], closed[like, end - 1]
        return closed


def _pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix((x.astype(U64) << U64(32)) | y.astype(U64))


def _byte_hash(data: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 1, 2, ... bytes of each row."""
    out, h = [], np.full(len(data), U64(0x243F6A8885A308D3))
    for c in range(data.shape[1]):
        h = mix(h * U64(0x9E3779B97F4A7C15) + data[:, c].astype(U64) + U64(1))
        out.append(h)
    return out


def normal(text: str) -> str:
    """Normal form C, then lower case letter by letter (no rule for a final sigma)."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()


@cache
def held_counter(tokenizer_file: str) -> PrefixCounter:
    """One for each Python worker, so that its pool serves task after task."""
    return PrefixCounter(tokenizer_file)


class PrefixCounter:
    """Prefix tables of whole texts; tables of pre-tokens are kept in a bounded pool."""

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pool = Pool()

    def _word_tables(self, words: list[str]) -> list[np.ndarray]:
        out = self.merges.tables([w.encode() for w in words])
        for i, w in enumerate(words):
            if w in _CONTRACTED:
                out[i] = np.array([len(self.tokenizer.encode(w[:k], add_special_tokens=False).ids) for k in range(1, len(w) + 1)], np.int32)
            elif not w.isascii():
                out[i] = out[i][np.cumsum([len(c.encode()) for c in w]) - 1]
        return out

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        codes = code_points(joined)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(codes) + 1, bool)
        first[np.concatenate([[0], ends[:-1]])] = True
        starts, stops = split_words(codes, kinds(codes), first[: len(codes)])
        keys = span_hash(codes, starts, stops)
        slots = self.pool.find(keys)
        if (slots < 0).any():
            new, at = np.unique(keys[slots < 0], return_index=True)
            at = np.flatnonzero(slots < 0)[at]
            if self.pool.n + len(new) > self.pool.most:
                self.pool.clear()
                new, at = np.unique(keys, return_index=True)
            pieces = [joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
            self.pool.add(new, self._word_tables(pieces))
            slots = self.pool.find(keys)
        inner, size = self.pool.gather(slots)
        stop = np.cumsum(size)
        whole = inner[stop - 1] if len(stop) else np.zeros(0, np.int32)
        before = np.cumsum(whole) - whole
        # steps: 0 at a space; inside a pre-token, the change of the count of words before and within
        out = np.zeros(len(codes), np.int64)
        if len(starts):
            place = np.repeat(starts - (stop - size), size) + np.arange(len(inner))
            out[place] = inner + np.repeat(before, size)
            # a space keeps the count of the last pre-token before it
            done = np.zeros(len(codes), np.int64)
            done[stops - 1] = whole
            space = np.ones(len(codes), bool)
            space[place] = False
            out[space] = np.cumsum(done)[space]
        total = np.concatenate([[0], np.cumsum(whole)])[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return [out[a:b] - t for a, b, t in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), total[:-1].tolist(), strict=True)]

    def _slow(self, raw: str) -> np.ndarray:
        """Texts with special strings: a special string counts once, at its last character."""
        out, base = [], 0
        pieces = self.special.split(raw) if self.special else [raw]
        for i in range(0, len(pieces), 2):
            plain, mark = normal(pieces[i]), pieces[i + 1] if i + 1 < len(pieces) else ""
            whole = plain + mark[:-1]
            if whole:
                codes = code_points(whole)
                counted = self._fast([whole])[0] if not (kinds(codes) == UNSURE).any() else self._by_library(whole)
                out.append(counted + base)
                if plain:
                    base += int(counted[len(plain) - 1])
            if mark:
                base += 1
                out.append(np.array([base]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _by_library(self, text: str) -> np.ndarray:
        """Characters of unsure class: the library cuts the text, the programme counts each piece."""
        out, at, base = np.zeros(len(text), np.int64), 0, 0
        cuts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        for (_, (a, b)), counted in zip(cuts, self._word_tables([text[a:b] for _, (a, b) in cuts]), strict=True):
            out[at:a] = base
            out[a:b] = counted + base
            at, base = b, base + int(counted[-1])
        out[at:] = base
        return out

    def count(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The prefix table of each text: entry k is the token count of its first k+1 characters."""
        held: list[str] = []
        size = 0
        for raw in texts:
            text = normal(raw)
            special = self.special is not None and self.special.search(raw)
            if special or not text or not (text.isascii() or not (kinds(code_points(text)) == UNSURE).any()):
                yield from self._fast(held) if held else []
                held, size = [], 0
                yield self._slow(raw)
                continue
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._fast(held)
                held, size = [], 0
        if held:
            yield from self._fast(held)


COUNTS = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64()), ("prefix_counts", pa.list_(pa.int32())),
])
_TYPES = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_counts array<int>"


def prefix_token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 2048, keep_table: bool = True) -> DataFrame:
    """Each document with its prefix table.

    prefix_counts[k] is the exact token count of the first k+1 characters; n_tokens its last entry;
    over_limit n_tokens > limit; fit_chars the longest prefix whose count is within the limit.
    keep_table=False answers the same questions without shipping the table. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held_counter(tokenizer_file)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows, held = [], 0
            for doc_id, text, counts in zip(b.column(0).to_pylist(), texts, counter.count(texts), strict=True):
                n = int(counts[-1]) if len(counts) else 0
                fit = len(counts) if n <= limit and not (counts > limit).any() else int(np.flatnonzero(counts <= limit)[-1]) + 1 if (counts <= limit).any() else 0
                rows.append((doc_id, len(text.encode()), n, n > limit, fit, counts.astype(np.int32) if keep_table else None))
                held += len(counts) if keep_table else 1
                if held >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTS, strict=True)], schema=COUNTS)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTS, strict=True)], schema=COUNTS)

    return docs.select("doc_id", "text").mapInArrow(run, _TYPES)


def within_budget(counted: DataFrame, budget: int) -> DataFrame:
    """From prefix tables alone: the characters that fit `budget` tokens, without encoding again."""
    fits = F.filter(F.sequence(F.lit(1), F.size("prefix_counts")), lambda k: F.element_at("prefix_counts", k) <= budget)
    return counted.withColumn("budget_chars", F.when(F.size("prefix_counts") > 0, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0))


def word_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_token_counts(table(spark, sf_dir, "documents"), word_bpe_file(), limit=2048, keep_table=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")
