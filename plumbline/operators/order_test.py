"""Order-permutation test: is the canonical order of examples likelier than shuffled ones?"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.scoring import BigramModel

#: ``(df with id and text) -> (id, loglik)``
Scorer = Callable[[DataFrame], DataFrame]


def orderings(examples: DataFrame, group: str, pos: str, text: str, permutations: int, seed: int, separator: str = "\n") -> DataFrame:
    """``(group, r, key, text)``: each group's examples joined in order; r = 0 is the canonical order."""
    many = examples.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    key = F.when(F.col("r") == 0, F.lpad(F.col(pos).cast("string"), 20, "0")).otherwise(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col(group).cast("string"), F.col(pos).cast("string"))))
    rows = many.groupBy(group, "r").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(pos).alias("p"), F.col(text).alias("t")))).alias("x"))
    return rows.filter(F.size("x") >= 2).select(group, "r", F.concat_ws("|", group, "r").alias("key"), F.array_join(F.col("x.t"), separator).alias("text"))


def permutation_test(examples: DataFrame, scorer: Scorer, group: str, pos: str, text: str = "text", permutations: int = 500, seed: int = 0) -> DataFrame:
    """``(group, p_value, canonical_loglik, null_mean, null_std)``; groups of fewer than two examples are absent."""
    if permutations < 1:
        raise ValueError("at least one permutation")
    joined = orderings(examples, group, pos, text, permutations, seed)
    scored = joined.select(group, "r", "key").join(scorer(joined.select("key", "text")), "key")
    canon = F.max(F.when(F.col("r") == 0, F.col("loglik")))
    seen = scored.groupBy(group).agg(canon.alias("canonical_loglik"))
    null = scored.filter("r > 0").join(seen, group)
    return null.groupBy(group).agg(
        ((1 + F.sum((F.col("loglik") >= F.col("canonical_loglik")).cast("int"))) / (F.count("*") + 1)).alias("p_value"),
        F.first("canonical_loglik").alias("canonical_loglik"), F.avg("loglik").alias("null_mean"), F.stddev_pop("loglik").alias("null_std"),
    )


def _bigram_null(model: BigramModel, name: str | None, items: list[tuple], permutations: int, seed: int) -> tuple[float, float, float, float] | None:
    """The p-value and log-likelihoods of one group, ``items`` being (position, text) in order of both; None if there is nothing to score."""
    lp = lambda chars: model.score(np.array([(ord(a) << 32) | ord(b) for a, b in chars], np.int64))[0]
    items = [(p, t) for p, t in items if t is not None]
    if sum(len(t) + 1 for _, t in items) < 3:
        return None
    full = [t for _, t in items if t]
    inside = sum(float(lp(zip(t, t[1:])).sum()) for t in full if len(t) > 1)
    empty = np.array([not t for _, t in items])
    start, end = np.zeros(len(items)), np.zeros(len(items))
    start[~empty], end[~empty] = lp([("\n", t[0]) for t in full]), lp([(t[-1], "\n") for t in full])
    line = float(lp([("\n", "\n")])[0])
    fixed = inside + float(start.sum() + end.sum())

    def ends(r: int) -> tuple[int, int]:
        if r:
            parts = [str(seed), str(r), *([name] if name is not None else [])]
            keys = [hashlib.md5("|".join([*parts, *([str(p)] if p is not None else [])]).encode()).hexdigest() for p, _ in items]
        else:
            keys = [(p is not None, str(p).rjust(20, "0")[:20]) for p, _ in items]
        order = [(k, i) for i, k in enumerate(keys)]
        return min(order)[1], max(order)[1]

    first, last = np.array([ends(r) for r in range(permutations + 1)]).T
    # Separators beside an empty text pair with each other; the ends of the joined text have no separator beyond them.
    lines = len(items) - len(full) - empty[first].astype(int) - empty[last]
    loglik = np.round(fixed - start[first] - end[last] + line * lines, 6)
    null = loglik[1:]
    return (1 + int((null >= loglik[0]).sum())) / (permutations + 1), float(loglik[0]), float(null.mean()), float(null.std())


def bigram_permutation_test(examples: DataFrame, model: BigramModel, group: str, pos: str, text: str = "text", permutations: int = 1000, seed: int = 0) -> DataFrame:
    """``permutation_test`` (line feeds between examples, log-likelihoods to 6 digits) scored by ``model``, without a row for each permutation.

    Under a bigram model an ordering differs from another only by the pairs that its first and last examples
    lack, so the whole joined text is scored from the insides and ends of its examples.
    """
    if permutations < 1:
        raise ValueError("at least one permutation")
    groups = examples.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("x")).filter(F.size("x") >= 2)
    groups = groups.select(group, F.col(group).cast("string").alias("name"), F.col("x.p").alias("p"), F.col("x.t").alias("t"))
    names = ["p_value", "canonical_loglik", "null_mean", "null_std"]

    def run(batches):
        for batch in batches:
            name, p, t = (batch.column(i).to_pylist() for i in (1, 2, 3))
            found = [_bigram_null(model, n, list(zip(ps, ts)), permutations, seed) for n, ps, ts in zip(name, p, t)]
            at = [i for i, f in enumerate(found) if f is not None]
            columns = [pa.array([found[i][j] for i in at], pa.float64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [group, *names])

    return groups.mapInArrow(run, T.StructType([groups.schema[group], *[T.StructField(n, T.DoubleType()) for n in names]]))
