"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed vectors of the whole word and of its first 3 to 8 bytes.
Filters of one to five words, with weights for each place, and box filters of 16, 64 and 256 words,
whose places share their weights so that they answer to the density of a word class, slide over the
words. Each filter is max-pooled over the text; a logistic layer joins the pooled values. Thresholds
are calibrated by language on training rows that the network has not seen. A text's language is its
nearest prototype of language identification, learned from the training rows; at scoring time the
text alone decides, never a column.

The network is trained in one task, on a sample that `labelled_sample` bounds in rows and bytes.

Defined results: null and empty texts pool to zero and are scored; labels that are null are not
learned from; without both classes in the training set every score is the mean label (0.5 if there
is none); texts without letters, or without any prototype, take the common threshold; repeated rows
repeat; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import crc_mod, discard, labelled_sample, stored, table, with_field
from bitloom.llm.language_id import as_matrix, learn, nearest
from bitloom.llm.textscan import _ROUND, _TABLE, FOLD, NOT_WORD, U64, mix, slices, text_buffer, words

BUCKETS = 1 << 16
PREFIXES = (3, 4, 5, 6, 7, 8)
PLACED, BOXES = (1, 2, 3, 4, 5), (16, 64, 256)
DIMS, FILTERS = 8, 8
WIDTHS = PLACED + BOXES
N_POOLED = FILTERS * len(WIDTHS)
PAD = max(PLACED) - 1


def coded(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of texts: (word buckets n x 7, word offsets of rows)."""
    data, offs = text_buffer(column)
    for a, b in slices(offs):
        at = offs[a : b + 1]
        found = words(data, at, NOT_WORD, fold=True)
        n = len(found.hash)
        if not n:
            yield np.zeros((0, len(PREFIXES) + 1), np.int32), found.offs
            continue
        raw = FOLD[data[at[0] : at[-1]]].astype(np.int32)
        start, size = found.start - at[0], found.end - found.start
        buckets = np.empty((n, len(PREFIXES) + 1), np.int32)
        buckets[:, 0] = found.hash & U64(BUCKETS - 1)
        total = np.zeros(n, U64)
        for k in range(max(PREFIXES)):
            inside = np.minimum(start + k, len(raw) - 1)
            total += np.where(size > k, _TABLE[((k & (_ROUND - 1)) << 8) | raw[inside]], U64(0))
            if k + 1 in PREFIXES:
                # a word shorter than the prefix counts as bucket 0, which stays at zero
                hashed = (mix(total + U64(k + 1)) & U64(BUCKETS - 1)).astype(np.int32)
                buckets[:, PREFIXES.index(k + 1) + 1] = np.where(size > k, hashed, 0)
        yield buckets, found.offs


@dataclass
class Net:
    """Embeddings, filters (PLACED: one matrix a place; BOXES: one), biases, logistic layer, thresholds, prototypes.

    `cut` has one logit for each language and, last, the one for texts of no language.
    """

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    cut: np.ndarray
    languages: np.ndarray

    @staticmethod
    def fresh(seed: int, languages: np.ndarray) -> Net:
        rng = np.random.default_rng(seed)
        shapes = [(w if w in PLACED else 1, DIMS, FILTERS) for w in WIDTHS]
        filters = [(rng.normal(size=s) * 0.5 / np.sqrt(s[0])).astype(np.float32) for s in shapes]
        out = (np.abs(rng.normal(size=N_POOLED)) * 0.1 * rng.choice([-1, 1], N_POOLED)).astype(np.float32)
        return Net(np.zeros((BUCKETS, DIMS), np.float32), filters, np.full(N_POOLED, 0.1, np.float32), out, 0.0, np.zeros(languages.shape[1] + 1), languages)

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        out = self.table[buckets[:, 0]]
        for j in range(1, buckets.shape[1]):
            out += self.table[buckets[:, j]]
        return out

    def convolve(self, vectors: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each width: (values of the filters at all places, first place and end of each row's windows).

        Rows with words are laid out one after another with PAD zeros behind each, so narrow windows
        may reach past the end of a row; a box is cut down to a row shorter than it. The place of
        word i of row r (of those with words) is i + PAD * r.
        """
        size = np.diff(offs)
        size = size[size > 0]
        end = np.cumsum(size) + PAD * np.arange(len(size))
        start = end - size
        n = int(end[-1]) + PAD
        laid = np.zeros((n, DIMS), vectors.dtype)
        laid[np.arange(len(vectors)) + PAD * np.repeat(np.arange(len(size)), size)] = vectors
        for w, f in zip(WIDTHS, self.filters, strict=True):
            if w in PLACED:
                value = laid @ f[0]
                for p in range(1, w):
                    value[: n - p] += laid[p:] @ f[p]
                yield np.ascontiguousarray(value.T), start, end
            else:
                run = np.zeros((FILTERS, n + 1))
                np.cumsum(np.ascontiguousarray((laid @ f[0]).T), axis=1, dtype=np.float64, out=run[:, 1:])
                value = np.zeros((FILTERS, n))
                if n >= w:
                    value[:, : n + 1 - w] = run[:, w:] - run[:, : n + 1 - w]
                short = size < w
                value[:, start[short]] = run[:, end[short]] - run[:, start[short]]
                value /= np.sqrt(w)
                yield value, start, np.maximum(end - w, start) + 1

    def pooled(self, vectors: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Max of each filter over each row; zero for rows without words."""
        best = np.zeros((len(offs) - 1, N_POOLED))
        some = np.flatnonzero(np.diff(offs))
        if len(some):
            for k, (value, start, stop) in enumerate(self.convolve(vectors, offs)):
                best[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(value, np.stack([start, stop], axis=1).ravel(), axis=1)[:, ::2].T
        return best

    def logits(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.out + self.shift

    def predict(self, column: pa.Array) -> np.ndarray:
        """Logit of each text."""
        return np.concatenate([np.zeros(0), *(self.logits(self.pooled(self.vectors(buckets), offs)) for buckets, offs in coded(column))])

    def score(self, column: pa.Array) -> np.ndarray:
        """Score of each text; 0.5 is the threshold of its language."""
        language, _ = nearest(column.to_pylist(), self.languages)
        return _sigmoid(self.predict(column) - self.cut[language])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(net: Net, vectors: np.ndarray, offs: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, float]:
    """Weighted mean logistic loss of rows, and its gradients by vectors, filters, bias, out and shift."""
    rows, some = len(offs) - 1, np.flatnonzero(np.diff(offs))
    best, where = np.zeros((rows, N_POOLED)), np.zeros((rows, N_POOLED), np.int64)
    for k, (value, start, stop) in enumerate(net.convolve(vectors, offs) if len(some) else ()):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        for i, r in enumerate(some):
            part = value[:, int(start[i]) : int(stop[i])]
            top = part.argmax(axis=1)
            best[r, cols], where[r, cols] = part[np.arange(FILTERS), top], top + int(offs[r])
    active = best + net.bias
    hidden = np.maximum(active, 0)
    z = hidden @ net.out + net.shift
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum() / rows)
    error = (_sigmoid(z) - y) * weight / rows
    g_best = error[:, None] * net.out * (active > 0)
    g_vectors = np.zeros(vectors.shape)
    g_filters = [np.zeros(f.shape) for f in net.filters]
    for k, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        g, at, stop = g_best[some, cols], where[some, cols], offs[some + 1][:, None]
        if w in PLACED:
            for p in range(w):
                inside = at + p < stop
                spot, part = np.where(inside, at + p, 0), np.where(inside, g, 0)
                g_filters[k][p] = np.einsum("rf,rfd->df", part, vectors[spot])
                np.add.at(g_vectors, spot.ravel(), (part[:, :, None] * f[p].T).reshape(-1, DIMS))
        else:
            end = np.minimum(at + w, stop)
            part = g / np.sqrt(w)
            run = np.concatenate([np.zeros((1, DIMS)), np.cumsum(vectors, axis=0, dtype=np.float64)])
            g_filters[k][0] = np.einsum("rf,rfd->df", part, run[end] - run[at])
            step = np.zeros((len(vectors) + 1, DIMS))
            each = (part[:, :, None] * f[0].T).reshape(-1, DIMS)
            np.add.at(step, at.ravel(), each)
            np.add.at(step, end.ravel(), -each)
            g_vectors += np.cumsum(step, axis=0)[:-1]
    return loss, g_vectors, g_filters, g_best.sum(axis=0), hidden.T @ error, float(error.sum())


def train(texts: pa.Array, y: np.ndarray, languages: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.15, seed: int = 9) -> Net:
    """Adagrad on the weighted logistic loss; every fifth row is kept for the thresholds."""
    net = Net.fresh(seed, languages)
    rng = np.random.default_rng(seed)
    rows = [buckets[a:b] for buckets, offs in coded(texts) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    held = np.arange(len(y)) % 5 == 4
    use = np.flatnonzero(~held)
    weight = np.where(y == 1, min(8.0, max(1.0, float((y == 0).sum()) / max(1, int((y == 1).sum())) / 2)), 1.0)
    params = [*net.filters, net.bias, net.out]
    squares = [np.full(p.shape, 1e-3) for p in params]
    table_square, shift_square = np.full(net.table.shape, 1e-3, np.float32), 1e-3
    for epoch in range(epochs):
        step = rate * (0.7**epoch)
        for chosen in np.array_split(rng.permutation(use), max(1, len(use) // batch)):
            parts = [rows[i] for i in chosen]
            offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            buckets = np.concatenate(parts)
            _, g_vectors, g_filters, g_bias, g_out, g_shift = gradients(net, net.vectors(buckets), offs, y[chosen], weight[chosen])
            moved = np.flatnonzero(np.abs(g_vectors).max(axis=1, initial=0) > 0)
            touched, number = np.unique(buckets[moved], return_inverse=True)
            g_table = np.zeros((len(touched), DIMS))
            np.add.at(g_table, number.ravel(), np.repeat(g_vectors[moved], buckets.shape[1], axis=0))
            g_table[touched == 0] = 0
            table_square[touched] += g_table**2
            net.table[touched] -= step * g_table / np.sqrt(table_square[touched] + 1e-4)
            for p, q, g in zip(params, squares, [*g_filters, g_bias, g_out], strict=True):
                q += g**2
                p -= (0.3 * step) * (g + 1e-5 * p) / np.sqrt(q)
            shift_square += g_shift**2
            net.shift -= 0.3 * step * g_shift / np.sqrt(shift_square)
    check = np.flatnonzero(held)
    if len(check):
        seen = texts.take(pa.array(check))
        z, (language, _) = net.predict(seen), nearest(seen.to_pylist(), languages)
        every = best_cut(z, y[check], 0.0)
        net.cut = np.array([*(best_cut(z[language == g], y[check][language == g], every) for g in range(languages.shape[1])), every])
    return net


def best_cut(z: np.ndarray, y: np.ndarray, other: float) -> float:
    """The logit that divides best by F1, midway between neighbours; `other` if positives are under ten."""
    if (y == 1).sum() < 10 or (y == 0).sum() < 10:
        return other
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + hit[-1])
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)[-1]
    z = z[order]
    return float(z[top] + (z[top + 1] if top + 1 < len(z) else z[top])) / 2


def fit(sample: DataFrame, languages: np.ndarray | None = None, seed: int = 9) -> Net | float:
    """A net from (doc_id, text, y), trained in one task: the sample is bounded by whoever drew it.

    languages: prototypes of languages as columns.
    """
    protos = as_matrix({}) if languages is None else languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        blob = io.BytesIO()
        if got:
            t = pa.Table.from_batches(got).combine_chunks().sort_by("doc_id")
            y = t.column("y").to_numpy().astype(np.float64)
            if 0 < y.sum() < len(y):
                net = train(t.column("text").combine_chunks(), y, protos, seed=seed)
                np.savez(blob, table=net.table, bias=net.bias, out=net.out, shift=net.shift, cut=net.cut, **{f"f{i}": f for i, f in enumerate(net.filters)})
            else:
                np.savez(blob, rate=y.mean())
        else:
            np.savez(blob, rate=0.5)
        yield pa.RecordBatch.from_arrays([pa.array([blob.getvalue()], pa.binary())], names=["net"])

    got = sample.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "net binary").collect()
    if not got:
        return 0.5
    with np.load(io.BytesIO(bytes(got[0][0]))) as z:
        if "rate" in z:
            return float(z["rate"])
        return Net(z["table"], [z[f"f{i}"] for i in range(len(WIDTHS))], z["bias"], z["out"], float(z["shift"]), z["cut"], protos)


def score(docs: DataFrame, net: Net | float) -> DataFrame:
    """docs with toxic_score, 0 to 1; 0.5 is the calibrated threshold of the text's language."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model = held.value
            out = np.full(len(b), model) if isinstance(model, float) else model.score(b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "toxic_score"])

    kept = docs.drop("toxic_score")
    return kept.mapInArrow(run, with_field(kept, "toxic_score", "double"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = stored(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, max_rows=10_000, max_bytes=64 << 20, extra=("lang",)), "toxicity-sample")
    net = fit(sample, as_matrix(learn(sample)))
    discard(sample)
    scored = score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
