"""Vectorised pre-tokenisation for the two BPE vocabularies of the tokenizers library.

A BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids laid end to end.
Each distinct pre-token is encoded once by the library and kept in a bounded pool. Texts that hold
a special string, or a character whose Unicode class is younger than version 3.2, take the
library's own path as a whole.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from bitloom.llm.textscan import U64, mix

SPACE, LETTER, NUMBER, OTHER, UNSURE = 0, 1, 2, 3, 4
#: White_Space of Unicode: fixed values.
_WHITE = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_APOSTROPHE = 39


@cache
def classes() -> np.ndarray:
    """Class of each code point below 65,536; the last entry stands for all above."""
    table = np.full((1 << 16) + 1, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0
    for c in range(1 << 16):
        kind, before = unicodedata.category(chr(c))[0], old.category(chr(c))
        if c in _WHITE:
            table[c] = SPACE
        elif before != "Cn" and before[0] == kind:
            table[c] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def kinds(codes: np.ndarray) -> np.ndarray:
    return classes()[np.minimum(codes, 1 << 16)]


def _contractions(codes: np.ndarray, begins: np.ndarray, first: np.ndarray) -> None:
    """Marks 's 't 'm 'd 're 've 'll as pre-tokens where an apostrophe begins one."""
    at = np.flatnonzero((codes == _APOSTROPHE) & begins)
    if not len(at):
        return
    padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
    fresh = np.concatenate([first, np.ones(3, bool)])
    a, b = padded[at + 1], padded[at + 2]
    one = np.isin(a, [ord(c) for c in "stmd"]) & ~fresh[at + 1]
    two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~fresh[at + 1] & ~fresh[at + 2]
    n = len(codes)
    for found, size in ((at[one], 2), (at[two], 3)):
        begins[found + 1] = False
        after = found + size
        after = after[after < n]
        begins[after] = True


def split_spaced(codes: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of pre-tokens of the byte-level pattern, where a space leads the word after it.

    first marks the first code point of each text. Every code point lies in one pre-token.
    """
    n = len(codes)
    before = np.concatenate([[SPACE], kind[:-1]])
    begins = first | (kind != before)
    begins[0] = True
    space = kind == SPACE
    last = np.concatenate([first[1:], [True]])
    # the last white space of a run, with something after it in the same text, stands apart
    lead = space & ~last & np.concatenate([~space[1:], [False]])
    begins[lead] = True
    # ... and if it is a space, what follows belongs to it
    plain = np.flatnonzero(lead & (codes == 32))
    begins[plain + 1] = False
    if n:
        _contractions(codes, begins, first)
    return np.flatnonzero(begins)


def split_words(codes: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the word pattern: letter runs, single numbers, runs of the rest; no spaces."""
    before = np.concatenate([[SPACE], kind[:-1]])
    begins = first | (kind != before) | (kind == NUMBER)
    _contractions(codes, begins, first)
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(codes))
    keep = kind[starts] != SPACE
    return starts[keep], ends[keep]


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    n = len(codes)
    mark = np.zeros(n + 1, np.int32)
    mark[starts] = 1
    place = np.arange(n, dtype=np.int32)
    place -= np.maximum.accumulate(np.where(mark[:n] == 1, place, np.int32(0)))
    part = mix(codes.astype(U64) + (place.astype(U64) << U64(24)))
    mark[ends] -= 1
    part[np.cumsum(mark[:n]) == 0] = 0
    return mix(np.add.reduceat(part, starts) + (ends - starts).astype(U64))
