"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte n-grams (words with their borders, lower case), counted
over every training document. A text is a mixture of languages: expectation-maximisation finds its
proportions from n-gram likelihoods; languages are then dropped, weakest first, while that
raises the likelihood penalised by ``penalty`` for each language. The text is given the
language of largest proportion, and that proportion is its score.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; equal proportions go to the first
language in code-point order; training rows with a null text or language count for nothing; without any training row
every text is ``und``; repeated rows count as often as they stand; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, SPACE, bound_batches, chunks, mix, release, tidy

BUCKETS = 1 << 16
#: Lengths of the n-grams in bytes, and the overlapping n-grams that count as one independent draw.
SIZES, EVIDENCE = (3,), 1.5
UNKNOWN = "und"


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, bucket)`` of every n-gram (of SIZES bytes) of texts; digits and white space are one border each."""
    joined = np.frombuffer(b" " + b" \x00 ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 3 for t in texts])
    codes = LOWER[joined]
    plain = SPACE[codes] | ((codes >= 48) & (codes < 58)) | (codes == 0)
    codes = np.where(plain, 32, codes).astype(np.uint64)
    keep = ~(plain & np.concatenate(([False], plain[:-1])))  # runs of borders count once
    at = np.flatnonzero(keep)
    owner = np.searchsorted(ends, at, "right")
    codes = codes[at]
    found, whose = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        value = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            value = (value << np.uint64(8)) | codes[k : len(codes) - n + 1 + k]
        inside = owner[: len(value)] == owner[n - 1 :]
        value = mix(value + np.uint64(n << 40))
        found.append((value >> np.uint64(48)).astype(np.int64)[inside])
        whose.append(owner[: len(inside)][inside])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.minimum(np.concatenate(whose), len(texts) - 1), np.concatenate(found)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """``(languages, log-likelihoods[language, bucket])``; counts are summed per task and language before they are shuffled."""

    def count(batches: Iterator) -> Iterator:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, j, texts in chunks(batch.column(1)):
                owner, bucket = grams(texts)
                names = sorted(set(langs[i:j]))
                code = np.array([names.index(x) for x in langs[i:j]])
                for k, name in enumerate(names):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(bucket[code[owner] == k], minlength=BUCKETS)
        for name, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(values[at])], ["lang", "bucket", "n"])

    rows = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col))
    counted = rows.mapInArrow(tidy(count), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most BUCKETS rows a language
    names = sorted(got["lang"].unique())
    table = np.full((len(names), BUCKETS), smoothing)
    if len(names):
        table[np.searchsorted(names, got["lang"].to_numpy(str)), got["bucket"].to_numpy()] += got["n"].to_numpy()
    return names, np.log(table / table.sum(1, keepdims=True)) if len(names) else table


def infer(likelihood: np.ndarray, counts: np.ndarray, penalty: float, rounds: int = 12) -> tuple[int, float]:
    """Language number and proportion of one text; ``likelihood[n-gram, language]``, scaled by row.

    After the first fit the weakest languages go together as far as all of them are worth less than one penalty: without set S the likelihood falls at most by
    ``N log(1 - share of S) - sum of counts x log(1 - responsibility of S)``. One fit over all languages is enough then, however many there are.
    """

    def fit(chosen: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        p = likelihood[:, chosen]
        share = start
        for _ in range(rounds):
            weight = p * share
            total = weight.sum(1)
            new = (counts / total) @ weight / counts.sum()
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(counts @ np.log(p @ share))

    chosen = np.arange(likelihood.shape[1])
    share, value = fit(chosen, np.full(len(chosen), 1 / len(chosen)))
    order = np.argsort(share, kind="stable")[:-1]
    if len(order):
        weight = likelihood[:, order] * share[order]
        gone = np.cumsum(weight, 1) / (likelihood @ share)[:, None]
        lost = counts.sum() * np.log1p(-np.minimum(np.cumsum(share[order]), 1 - 1e-12)) - counts @ np.log1p(-np.minimum(gone, 1 - 1e-12))
        keep = np.setdiff1d(chosen, order[: int((lost <= penalty).cumprod().sum())])
        if len(keep) < len(chosen):
            share, value = fit(keep, share[keep] / share[keep].sum())
            chosen = keep
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), int(share.argmin()))
        start = np.maximum(share[rest], 1e-6)
        fewer, without = fit(chosen[rest], start / start.sum())
        if value - without > penalty:
            break
        chosen, share, value = chosen[rest], fewer, without
    top = int(share.argmax())
    return int(chosen[top]), float(min(1.0, share[top]))


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row per row."""
    found = tagger(df.sparkSession, model, penalty)(F.col(text_col))
    return df.select(F.col(id_col).alias("doc_id"), found.alias("found")).select("doc_id", "found.lang_pred", "found.score")


def tagger(spark: SparkSession, model: tuple[list[str], np.ndarray], penalty: float = 12.0) -> Callable[[Column], Column]:
    """A function from a text column to ``(lang_pred, score)``. Only texts go to Python and only labels come back; other columns stay where they are."""
    names, table = model
    shared = spark.sparkContext.broadcast(table.astype(np.float32))  # languages x BUCKETS, fixed
    bound_batches(spark)

    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        letter = regex.compile(r"\p{L}")
        table = shared.value
        for column in columns:
            langs, scores = [UNKNOWN] * len(column), np.zeros(len(column))
            for i, j, texts in chunks(column) if names else ():
                owner, bucket = grams(texts)
                code, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
                bounds = np.searchsorted(code, np.arange(j - i + 1) * BUCKETS)
                for k in range(i, j):
                    a, b = bounds[k - i], bounds[k - i + 1]
                    if b > a and letter.search(texts[k - i].decode("utf-8")):
                        logs = table[:, code[a:b] % BUCKETS].T.astype(np.float64)  # of one text: at most BUCKETS n-grams x languages
                        top, scores[k] = infer(np.exp(logs - logs.max(1, keepdims=True)), count[a:b] / EVIDENCE, penalty)
                        langs[k] = names[top]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang_pred", "score"])
        release()

    return F.arrow_udf(predict, "lang_pred string, score double").asNondeterministic()  # evaluated once, whatever reads it
