"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Fourteen statistics of the whole text (shares of character classes, word lengths, repetition)
are standardised and mapped by random Fourier features that approximate a Gaussian kernel.
Partitions sum the normal equations, the driver adds these sums and solves for ridge weights,
and an isotonic fit on labelled rows that the ridge hasn't seen turns scores into probabilities.

Bounds: about ``MAX_TRAIN`` labelled documents at most, chosen by hash, are learnt from, and
their statistics lie in ``PARTS`` partitions, so the driver gets at most ``PARTS`` sums of fixed size.
Every text is scored whole. Null and empty texts have all statistics 0 and are scored like any
other; a null id is never held out and has no label; of repeated labels the highest counts;
without labels of both kinds all scores are their mean (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, plain_text, text_slices, words_of
from .toxicity import fold, isotonic, label_sample

MAX_TRAIN, PARTS, FEATURES, RIDGE, SEED, THRESHOLD = 60_000, 16, 256, 1e-4, 7, 0.3
HELD_OUT = (5, 0)

_CLASS = np.full(256, 6, np.uint8)  # other signs
_CLASS[[9, 32]] = 0
_CLASS[10] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[48:58] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:'\"-"]] = 7
STATS = 14


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` numbers for each text."""
    n = len(off) - 1
    out = np.zeros((n, STATS))
    size = np.diff(off)
    has = size > 0
    if not has.any():
        return out
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 8 + _CLASS[raw], minlength=n * 8).reshape(n, 8)
    out[:, :8] = counts / np.maximum(size, 1)[:, None]
    out[:, 8] = np.log1p(size)
    words, starts, ends, wo = words_of(raw, off)
    k = np.diff(wo)
    some = np.maximum(k, 1)
    if len(words):
        of = np.repeat(np.arange(n), k)
        length = (ends - starts).astype(float)
        mean = np.bincount(of, length, n) / some
        out[:, 9] = np.log1p(mean)
        out[:, 10] = np.sqrt(np.maximum(np.bincount(of, length**2, n) / some - mean**2, 0))
        order = np.lexsort((words, of))
        w, d = words[order], of[order]
        fresh = np.concatenate(([True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])))
        distinct = np.bincount(d[fresh], minlength=n)
        out[:, 11] = distinct / some
        out[:, 12] = np.log1p(distinct) / np.log1p(some)
        again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        out[:, 13] = np.bincount(of[1:][again], minlength=n) / some
    return out


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.waves = draw.normal(0, 1 / np.sqrt(STATS), (STATS, FEATURES))
        self.phase = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots = (np.array([0.0]), np.array([0.0]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.cos(x @ self.waves + self.phase) * np.sqrt(2 / FEATURES)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def raw_score(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if len(stats) else np.empty(0)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_score(stats), *self.knots), 0.0, 1.0)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(raw, off) for _, _, raw, off in text_slices(batch, 2)]
        rows = np.concatenate(parts) if parts else np.empty((0, STATS))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "calibrate", "stats"])


def _matrix(table) -> np.ndarray:
    column = table["stats"] if isinstance(table, pa.Table) else table.column(table.schema.get_field_index("stats"))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, STATS)


def fit(documents: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """Learn from labelled rows outside the held-out fold."""
    spark = documents.sparkSession
    mod, out_fold = HELD_OUT
    calibrate = F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0
    sample = label_sample(labels, column, fold(mod) != out_fold, MAX_TRAIN).withColumn("calibrate", calibrate)
    rows = documents.select("doc_id", plain_text().alias("text")).join(F.broadcast(sample), "doc_id").select("label", "calibrate", "text")
    stats = materialise(rows.mapInArrow(_labelled, "label int, calibrate boolean, stats array<double>").repartition(PARTS))
    train = stats.where(~F.col("calibrate"))
    moments = train.agg(
        F.count(F.lit(1)), F.avg("label"), *[F.avg(F.get("stats", F.lit(i))) for i in range(STATS)], *[F.stddev_pop(F.get("stats", F.lit(i))) for i in range(STATS)]
    ).first()
    if not moments[0]:
        return Model(np.zeros(STATS), np.ones(STATS))
    model = Model(np.array(moments[2 : 2 + STATS], float), np.array(moments[2 + STATS :], float))
    base = float(moments[1])
    model.knots = (np.array([0.0]), np.array([base]))
    held = spark.sparkContext.broadcast(model)

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        gram, moment = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            stats, label = _matrix(batch), batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(stats), 4096):
                z = held.value.features(stats[at : at + 4096])
                gram += z.T @ z
                moment += z.T @ (label[at : at + 4096] - base)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], names=["gram", "moment"])

    sums = train.select("label", "stats").coalesce(PARTS).mapInArrow(normal_equations, "gram binary, moment binary").collect()
    gram = sum(np.frombuffer(r["gram"]).reshape(FEATURES + 1, FEATURES + 1) for r in sums)
    moment = sum(np.frombuffer(r["moment"]) for r in sums)
    model.weights = np.linalg.solve(gram + RIDGE * moments[0] * np.eye(FEATURES + 1), moment)
    unseen = stats.where("calibrate").select("label", "stats").toArrow()
    if unseen.num_rows:
        y = unseen["label"].to_numpy().astype(float)
        model.knots = isotonic(model.raw_score(_matrix(unseen)), y, np.ones(len(y)))
    return model


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op6: one row per document."""
    held = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [held.value.score(statistics(raw, off)) for _, _, raw, off in text_slices(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["doc_id", "score"])

    rows = documents.select("doc_id", plain_text().alias("text")).mapInArrow(scorer, f"doc_id {kind}, score double")
    mod, out_fold = HELD_OUT
    return rows.select("doc_id", F.coalesce(fold(mod) == out_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
