"""Quality classifier with Naive Bayes support vectors (operator 3).

Features are hashed indicators of n-grams: one, two and three words in a row, in lower case, and as many word
shapes (letters by case, digits, and every other character, runs of a kind as one; a word equal to
the one before has a shape of its own). Each indicator is scaled by the log ratio of its smoothed
share in the two classes, and a linear hinge-loss model is fitted to these by dual coordinate
descent. A logistic curve over margins of rows kept from the fit turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import U, Words, chunks, mix

#: Feature buckets (a power of two); the model is one float for each.
BITS = 20
#: The bounds of the fit: labelled rows at most, those with the smallest hashes, and bytes of their texts.
#: A text that is longer than a hundredth of these is left out of the fit; all texts are scored in full.
FIT_ROWS, FIT_BYTES = 12_000, 96 << 20
#: A feature in fewer rows of the fit tells nothing and has no weight.
LEAST_ROWS = 2
#: Of those, one in so many is kept for the logistic curve.
CURVE = 5

_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58] = 48
_KIND[65:91] = 65
_KIND[97:123] = 97
_KIND[128:] = 97
_RUNS = np.zeros(256, bool)
_RUNS[[48, 65, 97]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of each text and the n + 1 offsets."""
    w = Words(data, offsets, lower=True)
    text = w.text_of_word()
    kind = _KIND[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_RUNS[kind[1:]]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep |= edge[:-1]
    s = Words(kind[keep], np.concatenate([[0], np.cumsum(keep)])[offsets])
    again = np.zeros(len(w.hashes), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
    s.hashes = np.where(again, U(0x61C8864680B583EB), s.hashes)
    found, of = [], []
    for n in (1, 2, 3):
        for words, salt in ((w, 0x2545F4914F6CDD1D), (s, 0)):
            h, t = words.windows(n)
            found.append(mix((h ^ U(salt)) + U(n)))
            of.append(t)
    key = (np.concatenate(of).astype(np.int64) << BITS) | (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)
    key = np.unique(key)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(offsets)))


@dataclass
class Model:
    weight: np.ndarray  # log ratio times hinge weight of each feature
    bias: float
    slope: float
    shift: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        f, at = features(data, offsets)
        sums = np.concatenate([[0.0], np.cumsum(self.weight[f].astype(np.float64))])
        return sums[at[1:]] - sums[at[:-1]] + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * self.margins(data, offsets) + self.shift)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, *, epochs: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """L1-loss linear support vectors over scaled indicators, a constant feature included."""
    random = np.random.default_rng(seed)
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    diagonal = np.array([1.0 + (scale[r] ** 2).sum() for r in rows])
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(rows)):
            r = rows[i]
            s = scale[r]
            g = y[i] * (w[r] @ s + bias) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                most = max(most, abs(step))
                w[r] += step * s
                bias += step
                alpha[i] = new
        if most < 1e-6:
            break
    return w, bias


def fit(rows: list[np.ndarray], label: np.ndarray, *, smooth: float = 1.0, cost: float = 0.1) -> Model:
    """A model from the features and 0/1 labels of some texts."""
    size = 1 << BITS
    positive = label == 1
    if positive.all() or not positive.any():  # one class, or no row: its share, smoothed
        share = (positive.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(size, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    curve = np.arange(len(rows)) % CURVE == CURVE - 1
    if len(rows) < 10 * CURVE or len(set(label[curve])) < 2 or len(set(label[~curve])) < 2:
        curve = np.zeros(len(rows), bool)
    own = np.flatnonzero(~curve)
    counts = [smooth + np.bincount(np.concatenate([np.zeros(0, np.int32), *(rows[i] for i in own if positive[i] == c)]), minlength=size) for c in (False, True)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[counts[0] + counts[1] < 2 * smooth + LEAST_ROWS] = 0.0
    y = np.where(positive, 1.0, -1.0)
    n = positive[own].mean()
    weights = np.where(positive[own], 0.5 / n, 0.5 / (1 - n)) * cost  # both classes weigh the same
    w, bias = dual_descent([rows[i] for i in own], ratio, y[own], weights)
    weight = w * ratio
    judged = np.flatnonzero(curve) if curve.any() else own
    margin = np.array([weight[rows[i]].sum() + bias for i in judged])
    # a logistic curve by Newton steps, on targets smoothed as usual
    t = np.where(positive[judged], (positive[judged].sum() + 1) / (positive[judged].sum() + 2), 1 / ((~positive[judged]).sum() + 2))
    b = np.array([1.0, 0.0])
    z = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = _logistic(z @ b)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, z.T @ (t - p) - 1e-6 * b)
        b = b + move * min(1.0, 2.0 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-7:
            break
    return Model(weight.astype(np.float32), float(bias), float(max(b[0], 1e-3)), float(b[1]))


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; rows with 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in chunks(batches):
        f, at = features(data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(f))], ["label", "features"])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Fit on the labelled rows that are not held out, ``fit_rows`` of them at most.

    Features are made by Spark's tasks; the rows of the fit meet on the driver, at most ``fit_rows`` of them with at most
    ``fit_bytes`` of text, which makes some six features of 4 bytes for each word. A label other than 0 and 1 is not used; for repeated labels
    of a doc_id the largest counts, for repeated rows of a document the smallest text.
    """
    named = labels.where((remainder(F.col("doc_id")) != 1) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = named.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(fit_rows)
    # at most fit_rows narrow rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the sizes of fit_rows texts at most are added up in one task
    sized = rows.withColumn("size", size).where(F.col("size") * 100 <= fit_bytes)
    fits = sized.select("doc_id", F.sum("size").over(order).alias("total")).where(F.col("total") <= fit_bytes).select("doc_id")
    got = sized.join(F.broadcast(fits), "doc_id", "left_semi").select("label", "text", "doc_id").orderBy("doc_id").select("label", "text").mapInArrow(_featured, "label int, features array<int>").toArrow()
    return fit([np.asarray(f) for f in got.column("features").to_numpy()], got.column("label").to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1, higher for label 1),
    predicted. No shuffle. A null or empty text has no feature and gets the score of the bias;
    other columns, and doc_id, are never looked at for a score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.scores(data, offsets))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
