"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed word unigrams and bigrams. Each is scaled by the log of the
ratio of its smoothed shares in the two classes; a linear model with hinge loss is fitted on the scaled features, of unit length for each document, by
dual coordinate descent. A logistic curve fitted on a held-out fifth of the fitting rows turns margins into scores.

The fit takes a bounded sample of labelled rows (``max_rows``, the first in a seeded hash order); scoring covers whole texts of all rows.

Defined cases: null and empty texts have no features and get the bias's score; labels other than 0 and 1
are ignored, of repeated labels of a document the larger counts; without rows of both classes every score is the share of label 1
(0.5 without any); ties of the sampling order go by id; repeated documents are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BASES, chunks, tidy, word_hashes

FEATURES = 1 << 20


@dataclass
class Model:
    ratio: np.ndarray  # scale of each feature
    weight: np.ndarray  # scale times the linear model's weight
    bias: float
    slope: float
    shift: float

    def scores(self, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(owner, self.weight[feature], minlength=n)
        length = np.sqrt(np.bincount(owner, self.ratio[feature].astype(float) ** 2, minlength=n))
        margin = np.divide(total, length, out=np.zeros(n), where=length > 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, feature)``, distinct and sorted; ASCII letters compare without case."""
    sizes, hashes, _ = word_hashes(texts, lower=True)
    owner = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        pair = (hashes[:-1] * BASES[0] + hashes[1:]) * BASES[1]
    inside = owner[:-1] == owner[1:]
    shift = np.uint64(64 - 20)
    code = np.concatenate((owner * FEATURES + (hashes >> shift).astype(np.int64), owner[:-1][inside] * FEATURES + (pair[inside] >> shift).astype(np.int64)))
    code = np.unique(code)
    return code // FEATURES, code % FEATURES


def _features_of(df: DataFrame) -> DataFrame:
    """``(doc_id, label, text)`` to ``(doc_id, label, features)``."""

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = []
            for i, j, texts in chunks(batch.column(2)):
                owner, feature = features(texts)
                lists += np.split(feature.astype(np.int32), np.searchsorted(owner, np.arange(1, j - i)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "label", "features"])

    return df.mapInArrow(tidy(extract), "doc_id bigint, label int, features array<int>")


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is a feature of value 1."""
    values = []
    for at in rows:
        v = ratio[at].astype(np.float64)
        size = np.sqrt(v @ v)
        values.append(v / size if size else v)
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(cost[i], max(0.0, alpha[i] - slope / square[i]))
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * y[i] * values[i]  # features are distinct in a row
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def fit(labelled: DataFrame, max_rows: int = 6000, cost: float = 4.0, smoothing: float = 1.0, rounds: int = 30, seed: int = 11) -> Model:
    """``labelled(doc_id, label, text)``, already cut to at most ``max_rows`` rows; features are collected, a bounded number of rows."""
    got = _features_of(labelled).toPandas().sort_values("doc_id", kind="stable").head(max_rows)
    label = got["label"].to_numpy(int)
    rows = [np.asarray(f, np.int64) for f in got["features"]]
    share = float(label.mean()) if len(label) else 0.5
    zero = np.zeros(FEATURES, np.float32)
    if len(set(label.tolist())) < 2:
        odds = np.log(share / (1 - share)) if 0 < share < 1 else 35.0 * (share - 0.5) * 2
        return Model(zero, zero, 0.0, 0.0, float(odds))
    held = np.random.default_rng(seed).random(len(rows)) < 0.2

    def train(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        count = np.full((2, FEATURES), smoothing)
        for i in np.flatnonzero(use):
            count[label[i], rows[i]] += 1
        count /= count.sum(1, keepdims=True)
        ratio = np.log(count[1] / count[0])
        y = np.where(label == 1, 1.0, -1.0)
        balance = np.where(label == 1, 0.5 / max(label[use].mean(), 1e-9), 0.5 / max(1 - label[use].mean(), 1e-9))
        w, bias = descend([rows[i] for i in np.flatnonzero(use)], y[use], ratio, (cost * np.sqrt(balance))[use], rounds, seed)
        return ratio, w, bias

    def model(parts: tuple[np.ndarray, np.ndarray, float], slope: float, shift: float) -> Model:
        ratio, w, bias = parts
        return Model(ratio.astype(np.float32), (ratio * w).astype(np.float32), float(bias), slope, shift)

    slope, shift = 3.0, 0.0
    if 0 < label[held].sum() < held.sum():
        first = model(train(~held), 1.0, 0.0)
        at = np.flatnonzero(held)
        owner = np.repeat(np.arange(len(at)), [len(rows[i]) for i in at])
        p = first.scores(owner, np.concatenate([rows[i] for i in at]), len(at))
        margin = np.log(p / (1 - p))
        for _ in range(50):  # Newton's method for the logistic curve
            q = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -35, 35)))
            v = np.maximum(q * (1 - q), 1e-6)
            x = np.stack((margin, np.ones_like(margin)))
            step = np.linalg.solve((x * v) @ x.T + 1e-3 * np.eye(2), x @ (q - label[held]))
            slope, shift = slope - step[0], shift - step[1]
            if abs(step).max() < 1e-6:
                break
        slope = max(slope, 1e-3)
    return model(train(np.ones(len(rows), bool)), float(slope), float(shift))


def sample_labelled(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The first ``max_rows`` labels in hash order, with their texts; the labels are a bounded broadcast."""
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_rows)
    return docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(F.col(id_col).cast("long").alias("doc_id"), "label", F.col(text_col).alias("text"))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for whole texts."""
    parts = (model.ratio, model.weight, model.bias, model.slope, model.shift)
    shared = df.sparkSession.sparkContext.broadcast(parts)  # two arrays of FEATURES numbers

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Model(*shared.value)
        for batch in batches:
            out = []
            for i, j, texts in chunks(batch.column(1)):
                owner, feature = features(texts)
                out.append(model.scores(owner, feature, j - i))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(predict), "doc_id bigint, score double")
