"""Token statistics of texts and the membership scores computed from them.

``BigramModel`` is a character bigram model with add-k smoothing, trained by aggregation; it stands in for a neural
scorer, which any function from ``(id, text)`` to the same statistics can replace. Statistics are arrays (token log-probability; mean and
sample standard deviation of the log-probability over the vocabulary), so every detector is a column expression on
one pass of scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import let, zlib_bits

STATS = "token_logprob array<double>, mu array<double>, sigma array<double>"


#: Characters counted and scored at once in a Python worker; a scored one takes 24 bytes, on its way to the JVM too.
_COUNTED, _SCORED = 1 << 20, 1 << 16


def _chunks(texts: list[str | None], most: int | None, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, code points, lengths)`` of runs of texts; a null text has no characters."""
    start, held, total = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "")[:most])
        total += len(held[-1])
        if total >= size or i == len(texts) - 1:
            yield start, np.frombuffer("".join(held).encode("utf-32-le"), np.uint32).astype(np.int64), np.array([len(h) for h in held], np.int64)
            start, held, total = i + 1, [], 0


def _pairs(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of consecutive characters that lie in one text."""
    inside = np.ones(max(0, len(codes) - 1), bool)
    ends = np.cumsum(lengths)
    inside[ends[(ends > 0) & (ends < len(codes))] - 1] = False
    return ((codes[:-1] << 32) | codes[1:])[inside]


def pair_counts(df: DataFrame, text_col: str, most: int | None = None) -> DataFrame:
    """``(prev, cur, c)``: how often each pair of consecutive characters (code points) occurs."""

    def count(batches):
        for batch in batches:
            for _, codes, lengths in _chunks(batch.column(0).to_pylist(), most, _COUNTED):
                keys, c = np.unique(_pairs(codes, lengths), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(c.astype(np.int64))], ["prev", "cur", "c"])

    return df.select(text_col).mapInArrow(count, "prev long, cur long, c long").groupBy("prev", "cur").agg(F.sum("c").alias("c"))


@dataclass
class BigramModel:
    """Counts are aggregated on the executors; what is held has one entry a distinct pair or character."""

    pairs: np.ndarray  # sorted keys of seen pairs
    lp: np.ndarray
    contexts: np.ndarray  # sorted code points
    floor: np.ndarray  # log-probability of an unseen pair
    mu: np.ndarray
    sigma: np.ndarray
    flat: float  # log-probability in an unknown context: uniform over the vocabulary

    @classmethod
    def train(cls, corpus: DataFrame, text_col: str = "text", most: int | None = None, k: float = 0.5) -> BigramModel:
        """Of whole texts, unless ``most`` characters are asked for."""
        rows = pair_counts(corpus, text_col, most).toArrow()
        prev, cur, c = (rows.column(i).to_numpy() for i in range(3))
        order = np.argsort(keys := (prev << 32) | cur)
        keys, prev, c = keys[order], prev[order], c[order].astype(float)
        v = len(np.union1d(prev, cur))
        contexts, at, types = np.unique(prev, return_inverse=True, return_counts=True)
        n = np.bincount(at, c, len(contexts))
        lp = np.log((c + k) / (n[at] + k * v))
        floor = np.log(k / (n + k * v))
        s = np.bincount(at, lp, len(contexts)) + (v - types) * floor
        ss = np.bincount(at, lp * lp, len(contexts)) + (v - types) * floor * floor
        mu = s / max(v, 1)
        sigma = np.sqrt(np.maximum(0.0, (ss - s * mu) / max(v - 1, 1))) if v > 1 else np.zeros(len(contexts))
        return cls(keys, lp, contexts, floor, mu, sigma, -float(np.log(v)) if v else float("nan"))

    def score(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability, mean and deviation of each pair."""
        if not len(self.pairs):
            return np.full(len(keys), self.flat), np.full(len(keys), self.flat), np.zeros(len(keys))
        prev = keys >> 32
        context = np.minimum(np.searchsorted(self.contexts, prev), len(self.contexts) - 1)
        known = self.contexts[context] == prev
        pair = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        lp = np.where(self.pairs[pair] == keys, self.lp[pair], np.where(known, self.floor[context], self.flat))
        return lp, np.where(known, self.mu[context], self.flat), np.where(known, self.sigma[context], 0.0)

    def stats(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """``(id, *keep, n_tokens, token_logprob, mu, sigma)`` of whole texts, unless ``most`` characters are asked for; texts of fewer than two characters are unscorable and absent."""
        model, held = self, [id_col, *keep]

        def run(batches):
            for batch in batches:
                kept = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(held))], held)
                for start, codes, lengths in _chunks(batch.column(len(held)).to_pylist(), most, _SCORED):
                    rows = np.flatnonzero(lengths >= 2)
                    if not len(rows):
                        continue
                    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths[rows] - 1)]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in model.score(_pairs(codes, lengths))]
                    own = kept.take(pa.array(rows + start))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array((lengths[rows] - 1).astype(np.int32)), *lists], [*held, "n_tokens", "token_logprob", "mu", "sigma"])

        one = df.select(*held, F.col(text_col).alias("_text"))
        schema = T.StructType([*one.schema.fields[:-1], T.StructField("n_tokens", T.IntegerType()), *T.StructType.fromDDL(STATS).fields])
        return one.mapInArrow(run, schema)

    def scores(self, df: DataFrame, names: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", most: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """``(id, *keep, n_tokens, *names)``: detectors of ``BY_ARRAY`` computed where the text is scored, so that no token statistic leaves the worker."""
        model, held = self, [id_col, *keep]
        detectors = [BY_ARRAY[n] for n in names]

        def run(batches):
            for batch in batches:
                kept = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(held))], held)
                for start, codes, lengths in _chunks(batch.column(len(held)).to_pylist(), most, _COUNTED):
                    rows = np.flatnonzero(lengths >= 2)
                    if not len(rows):
                        continue
                    lp, mu, sigma = model.score(_pairs(codes, lengths))
                    at = np.concatenate([[0], np.cumsum(lengths[rows] - 1)])
                    found = [[d(lp[a:b], mu[a:b], sigma[a:b]) for d in detectors] for a, b in zip(at[:-1], at[1:], strict=True)]
                    own = kept.take(pa.array(rows + start))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array((lengths[rows] - 1).astype(np.int32)), *[pa.array(c, pa.float64()) for c in zip(*found, strict=True)]], [*held, "n_tokens", *names])

        one = df.select(*held, F.col(text_col).alias("_text"))
        schema = T.StructType([*one.schema.fields[:-1], T.StructField("n_tokens", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])
        return one.mapInArrow(run, schema)

    def loglik(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
        return self.scores(df, ("loglik",), id_col, text_col, most).select(id_col, "loglik")


def mean(values: Column) -> Column:
    return let(values, lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def bottom(values: Column, percent: float) -> Column:
    """The smallest ``max(1, ceil(percent / 100 * n))`` values."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    return let(F.sort_array(values), lambda v: F.slice(v, F.lit(1), F.greatest(F.lit(1), F.ceil(F.lit(percent) / 100 * F.size(v)).cast("int"))))


def loss() -> Column:
    return mean(F.col("token_logprob"))


def perplexity() -> Column:
    return -F.exp(-loss())


def min_k(percent: float = 20) -> Column:
    return mean(bottom(F.col("token_logprob"), percent))


def min_k_plus_plus(percent: float = 20) -> Column:
    z = F.zip_with(F.zip_with("token_logprob", "mu", lambda x, m: x - m), "sigma", lambda d, s: d / (s + 1e-6))
    return mean(bottom(z, percent))


def zlib_ratio(text_col: str = "text", bits_col: str | None = None) -> Column:
    """Log-likelihood over compressed bits; needs the text, or its bits, beside the statistics."""
    bits = F.col(bits_col) if bits_col else zlib_bits(F.col(text_col))
    return F.aggregate("token_logprob", F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), bits)


def _lowest(percent: float) -> Callable[[np.ndarray], float]:
    """Mean of the smallest ``max(1, ceil(percent / 100 * n))`` values."""

    def of(values: np.ndarray) -> float:
        k = max(1, int(np.ceil(percent / 100 * len(values))))
        return float(np.partition(values, k - 1)[:k].mean())

    return of


#: The same detectors as functions of the arrays (log-probability, mean, deviation) of one text.
BY_ARRAY: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], float]] = {
    "loss": lambda lp, mu, sigma: float(lp.mean()),
    "perplexity": lambda lp, mu, sigma: float(-np.exp(-lp.mean())),
    "min_10_prob": lambda lp, mu, sigma: _lowest(10)(lp),
    "min_20_prob": lambda lp, mu, sigma: _lowest(20)(lp),
    "min_20_plusplus": lambda lp, mu, sigma: _lowest(20)((lp - mu) / (sigma + 1e-6)),
    "mu_mean": lambda lp, mu, sigma: float(mu.mean()),
    "sigma_mean": lambda lp, mu, sigma: float(sigma.mean()),
    "loglik": lambda lp, mu, sigma: float(lp.sum()),
}


#: Detectors by name; higher means more member-like.
DETECTORS: dict[str, Callable[[], Column]] = {"loss": loss, "perplexity": perplexity, "min_20_prob": min_k, "min_10_prob": lambda: min_k(10), "min_20_plusplus": min_k_plus_plus, "zlib_ratio": zlib_ratio}
DEFAULT_SUITE = ("loss", "min_20_prob", "min_20_plusplus", "zlib_ratio")


def detector(name: str) -> Column:
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; known: {', '.join(DETECTORS)}")
    return DETECTORS[name]()


def scores(stats: DataFrame, names: tuple[str, ...] = DEFAULT_SUITE, keep: tuple[str, ...] = ()) -> DataFrame:
    if "token_logprob" not in stats.columns:
        raise ValueError("scores need token statistics: run a scorer first")
    if not {"loss", "perplexity"} <= set(names):
        return stats.select(*keep, *[detector(n).alias(n) for n in names])
    once = stats.select(*keep, *[detector(n).alias(n) for n in names if n != "perplexity"])
    return once.withColumn("perplexity", -F.exp(-F.col("loss"))).select(*keep, *names)


def mock_stats(text_col: str = "text", member_col: str | None = None, signal: float = 1.0, vocabulary: int = 50304) -> Column:
    """Seeded pseudo-statistics of a text, for tests of everything behind the scorer."""

    @F.pandas_udf(f"struct<{STATS.replace(' array', ':array')}>")
    def draw(text, member):
        import hashlib

        import pandas as pd

        out = []
        for t, m in zip(text, member, strict=True):
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little"))
            n = max(2, min(256, len(t.split()) + 5))
            lp = -rng.gamma(2.0, 1.0, n) + (signal if m else 0.0)
            mu = -np.log(vocabulary) + rng.normal(0, 0.5, n)
            out.append((lp.tolist(), mu.tolist(), rng.uniform(1.5, 3.0, n).tolist()))
        return pd.DataFrame(out, columns=["token_logprob", "mu", "sigma"])

    return draw(F.col(text_col), F.col(member_col) if member_col else F.lit(0))
