"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text gives a short row of statistics (mix of character classes, word and line lengths,
repetition). Cosines of random projections of the standardised row approximate a Gaussian kernel.
Every partition sums its part of the normal equations; entry by entry they meet in a shuffle, and
the driver solves one system whose size depends on the number of features alone. Pool-adjacent
violators over binned scores of a fifth of the rows, which the ridge has not seen, then make
probabilities of the scores.

Defined results: null and empty texts have statistics of zero and are scored like any text; labels
that are null are not learned from; a training set without both classes gives every text its mean
label (0.5 if there is none); repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import crc_mod, labelled_sample, stored, table, with_field
from bitloom.llm.textscan import SPACES, slices, text_buffer, words

_BYTE = np.arange(256)
_SYMBOL = np.isin(_BYTE, list(b"#$%&*+/<=>@\\^_`{|}~"))
_CLASSES = np.stack([
    (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122), (_BYTE >= 48) & (_BYTE <= 57), _BYTE == 32, _BYTE == 10, _SYMBOL,
    _BYTE == 33, np.isin(_BYTE, list(b".?")), np.isin(_BYTE, list(b",;:'\"()-")), _BYTE >= 128, (_BYTE < 32) & (_BYTE != 10),
], axis=1).astype(np.float64)
_LINES = _BYTE == 10
N_STATS = _CLASSES.shape[1] + 8


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    data, offs = text_buffer(column)
    rows = [np.zeros((0, N_STATS))]
    for a, b in slices(offs):
        at, n = offs[a : b + 1], b - a
        size = np.diff(at).astype(float)
        row = np.repeat(np.arange(n), np.diff(at))
        counts = np.bincount(row * 256 + data[at[0] : at[-1]], minlength=n * 256).reshape(n, 256)
        share = counts @ _CLASSES / np.maximum(size, 1)[:, None]
        found = words(data, at, SPACES, fold=True)
        n_words = np.diff(found.offs).astype(float)
        owner = np.repeat(np.arange(n), np.diff(found.offs))
        length = np.bincount(owner, (found.end - found.start), minlength=n) / np.maximum(n_words, 1)
        order = np.lexsort((found.hash, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (found.hash[order][1:] != found.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=n)
        same = np.zeros(len(owner), bool)
        same[1:] = (found.hash[1:] == found.hash[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner[same], minlength=n) / np.maximum(n_words, 1)
        lines = words(data, at, _LINES, fold=False)
        line_owner = np.repeat(np.arange(n), np.diff(lines.offs))
        n_lines = np.diff(lines.offs).astype(float)
        pair = np.unique(np.stack([line_owner.astype(np.uint64), lines.hash], axis=1), axis=0)[:, 0] if len(line_owner) else np.zeros(0, np.uint64)
        line_share = np.bincount(pair.astype(np.int64), minlength=n) / np.maximum(n_lines, 1)
        bar = counts[:, ord("|")] / np.maximum(n_words, 1)
        extra = [np.log1p(size), np.log1p(n_words), length, distinct / np.maximum(n_words, 1) ** 0.9, repeats, line_share, bar, (counts.max(axis=1) / np.maximum(size, 1))]
        rows.append(np.concatenate([share, np.stack(extra, axis=1)], axis=1))
    return np.concatenate(rows)


@dataclass
class Model:
    """Centre and scale of the statistics, projection, weights, and the calibration's steps."""

    centre: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.scale, -8, 8)
        f = np.cos(z @ self.project + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([f, np.ones((len(f), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability; between two steps it rises in a line, so that ranks are kept."""
        return np.interp(self.raw(stats), self.knots, self.values)


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins sorted by x: (mean x, mean y) of each block."""
    blocks: list[list[float]] = []
    for a, t, w in zip(x, total, weight, strict=True):
        blocks.append([a * w, t, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit(sample: DataFrame, n_features: int = 256, width: float = 4.0, ridge: float = 1e-2, seed: int = 5) -> Model:
    """A model from (doc_id, text, y). The sample is bounded by whoever drew it."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(statistics(b.column(0))), pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "y", "spare"])

    spare = (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)) == 0).alias("spare")
    rows = stored(sample.select("text", "y", spare).mapInArrow(describe, "x array<double>, y int, spare boolean"), "quality-sample")
    seen = rows.where("spare").agg(F.count_distinct("y")).first()[0]
    # too small a sample for two parts is used for both
    solved, calibrated = (rows.where("not spare"), rows.where("spare")) if seen == 2 and rows.where("not spare").select("y").distinct().count() == 2 else (rows, rows)
    sums = [f(F.element_at("x", i + 1)) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]
    first = rows.agg(F.count("*"), F.avg("y"), *sums).collect()[0]
    flat = np.zeros(1)
    if not first[0] or first[1] in (0.0, 1.0):
        rate = 0.5 if not first[0] else float(first[1])
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, 1)), flat, np.zeros(2), flat, np.array([rate]))
    moments = np.array(first[2:], float).reshape(N_STATS, 2)
    rng = np.random.default_rng(seed)
    model = Model(moments[:, 0], np.maximum(moments[:, 1], 1e-6), rng.normal(size=(N_STATS, n_features)) / width, rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), flat, flat)
    size = n_features + 1
    upper = np.triu_indices(size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            f, y = model.features(np.stack(b.column(0).to_numpy(zero_copy_only=False))), b.column(1).to_numpy()
            gram += f.T @ f
            moment += f.T @ y
        value = np.concatenate([gram[upper], moment])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], names=["i", "v"])

    met = solved.select("x", "y").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    value = np.zeros(len(upper[0]) + size)
    value[met.column("i").to_numpy()] = met.column("v").to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = value[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    model.weights = np.linalg.solve(gram + ridge * np.eye(size), value[len(upper[0]) :])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.raw(np.stack(b.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(s * 500).clip(-5000, 5000).astype(np.int32)), b.column(1)], names=["s", "y"])

    bins = calibrated.select("x", "y").mapInArrow(binned, "s int, y int").groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("y")).toArrow().to_pandas().sort_values("s")
    knots, values = isotonic(bins.s.to_numpy() / 500, bins.y.to_numpy(float), bins.n.to_numpy(float))
    # a thin slope beyond the outer blocks keeps the order of scores there
    model.knots = np.concatenate([[knots[0] - 2], knots, [knots[-1] + 2]])
    model.values = np.concatenate([[values[0] * 0.98], 0.98 * values + 0.01, [0.98 * values[-1] + 0.02]])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score, 0 to 1, in place: no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(statistics(b.column(b.schema.get_field_index("text")))))], names=[*b.schema.names, "quality_score"])

    kept = docs.drop("quality_score")
    return kept.mapInArrow(run, with_field(kept, "quality_score", "double"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, max_rows=20_000))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
