"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is bound by multiplying the first
letter's vector rotated twice, the second's rotated once and the third's; a document bundles its
trigrams by adding them. A language's prototype is the sum of its documents' unit bundles, less
what all languages share; a document takes the language whose prototype has the largest cosine.

Words are padded with one blank on each side, digits and signs count as blanks, letters are folded.
Defined results: null texts and texts without a letter are 'und' with score 0; documents whose lang
is null are not learned from; equal cosines go to the language first in order of its name; without
any labelled document all are 'und'; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import crc_mod, table
from bitloom.llm.textscan import U64, mix

UNKNOWN = "und"
CHUNK = 1 << 18


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(codes: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The +1/-1 vector of each code point, the same everywhere."""
    words = mix(codes.astype(U64)[:, None] * U64(1 << 16) + np.arange((dims + 63) // 64, dtype=U64) + mix(np.array([seed], U64)))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(codes), -1), axis=1)[:, :dims]
    return (bits.astype(np.int8) << 1) - 1


def bundles(texts: list[str], dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(bundle of each text, its number of letters)."""
    out, letters = np.zeros((len(texts), dims), np.float32), np.zeros(len(texts), np.int64)
    joined = "\n".join(texts).lower() + "\n"
    # lower() may lengthen a letter, so rows are cut at the line ends put between them
    rows = [t.lower() for t in texts]
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in rows])
    is_letter = letter_table()[codes]
    letters += np.bincount(row[is_letter], minlength=len(texts))
    codes = np.where(is_letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1] | (row[1:] != row[:-1])
    codes, row = codes[keep], row[keep]
    present = np.zeros(0x110000, bool)
    present[codes] = True
    alphabet = np.flatnonzero(present)
    small = np.zeros(int(alphabet[-1]) + 1, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    coded, size = small[codes], len(alphabet)
    # each text begins with a blank: the end of the one before, or the one put in front here
    blank = small[32] if present[32] else 0
    coded, row = np.concatenate([[blank], coded]), np.concatenate([[0], row])
    tri = (coded[:-2] * size + coded[1:-1]) * size + coded[2:]
    owner = row[2:]
    tri = tri[owner == row[1:-1]] if len(tri) else tri
    owner = owner[owner == row[1:-1]] if len(owner) else owner
    if not len(tri):
        return out, letters
    if size**3 <= 1 << 22:
        seen = np.zeros(size**3, bool)
        seen[tri] = True
        distinct = np.flatnonzero(seen)
        number = np.zeros(size**3, np.int64)
        number[distinct] = np.arange(len(distinct))
        tri = number[tri]
    else:
        distinct, tri = np.unique(tri, return_inverse=True)
    vectors = letter_vectors(alphabet, dims, seed)
    twice, once = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    for begin in range(0, len(distinct), 4096):
        part = distinct[begin : begin + 4096]
        bound = (twice[part // size // size] * once[part // size % size] * vectors[part % size]).astype(np.float32)
        here = (tri >= begin) & (tri < begin + len(part))
        counts = np.bincount(owner[here] * len(part) + (tri[here] - begin), minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ bound
    return out, letters


def _groups(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK or len(held) >= 256:
            yield held
            held, size = [], 0
    if held:
        yield held


def learn(docs: DataFrame, dims: int = 1024, seed: int = 11) -> dict[str, np.ndarray]:
    """Prototype of each language from all (text, lang) rows, however few a language has.

    Each task adds up its own documents; the sums meet per language and dimension in a shuffle, so
    what reaches the driver is one vector a language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, at = b.column(1).to_pylist(), 0
            for texts in _groups(b.column(0).to_pylist()):
                made, letters = bundles(texts, dims, seed)
                norm = np.linalg.norm(made, axis=1)
                for i in np.flatnonzero((letters > 0) & (norm > 0)):
                    sums.setdefault(langs[at + i], np.zeros(dims))
                    sums[langs[at + i]] += made[i] / norm[i]
                at += len(texts)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(v)], names=["lang", "dim", "value"])

    parts = known.select("text", "lang").mapInArrow(run, "lang string, dim int, value double")
    rows = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).collect()
    protos = {r["lang"]: np.array([x["value"] for x in r["v"]]) for r in rows}
    protos = {k: v / (np.linalg.norm(v) or 1) for k, v in protos.items()}
    if len(protos) > 1:
        common = np.mean(list(protos.values()), axis=0)
        protos = {k: v - common for k, v in protos.items()}
    return {k: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for k, v in sorted(protos.items())}


def nearest(texts: list[str | None], matrix: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(column of the nearest prototype, its share of the sharpened cosines) of each text; -1 and 0 without letters."""
    best, share = [np.zeros(0, np.int64)], [np.zeros(0)]
    for part in _groups([t or "" for t in texts]):
        made, letters = bundles(part, len(matrix), seed)
        if not matrix.shape[1]:
            best.append(np.full(len(part), -1))
            share.append(np.zeros(len(part)))
            continue
        cosine = (made @ matrix) / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
        sharp = np.exp(20 * (cosine - cosine.max(axis=1, keepdims=True)))
        best.append(np.where(letters > 0, cosine.argmax(axis=1), -1))
        share.append(np.where(letters > 0, (1 / sharp.sum(axis=1)).astype(float), 0.0))
    return np.concatenate(best), np.concatenate(share)


def as_matrix(prototypes: dict[str, np.ndarray], dims: int = 1024) -> np.ndarray:
    """Prototypes as columns."""
    return np.stack(list(prototypes.values()), axis=1) if prototypes else np.zeros((dims, 0), np.float32)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dims: int = 1024, seed: int = 11) -> DataFrame:
    """(doc_id, lang_pred, score): the nearest prototype, and its share of the sharpened cosines."""
    names, matrix = list(prototypes), as_matrix(prototypes, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, share = nearest(b.column(1).to_pylist(), matrix, seed)
            pred = [names[k] if k >= 0 else UNKNOWN for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    prototypes = learn(docs.where(~held))
    return predict(docs, prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")
