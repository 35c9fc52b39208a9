"""Counts of words over a corpus, and texts by how frequent their words are; counted and looked up in Arrow batches, not row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.kept import keep


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of a batch's tokens, one list after the other, their dictionary, and the list of each."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    words = column.flatten().dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, np.repeat(np.arange(len(lengths)), lengths)


def word_counts(tokens: DataFrame) -> DataFrame:
    """``(t, c)`` of a table with one column of arrays of words: how often each occurs."""

    def count(batches):
        for batch in batches:
            codes, known, _ = _flat(batch.column(0))
            if len(known):
                yield pa.RecordBatch.from_arrays([known, pa.array(np.bincount(codes, minlength=len(known)).astype(np.int64))], ["t", "c"])

    return tokens.mapInArrow(count, "t string, c long").groupBy("t").agg(F.sum("c").alias("c"))


def commonness(df: DataFrame, id_col: str, frequent: int, ids: DataFrame | None = None) -> DataFrame:
    """``(id, commonness)`` of ``(id, tokens)``: mean log share of a text's tokens in the pooled counts; 0 without tokens. ``ids`` are the ids alone, if they can be read without tokens.

    The most frequent words, ``frequent`` at most by count, go to the texts with their shares, so that most tokens are summed where they
    are; tokens of other words meet their counts in a shuffle.
    """
    pooled = keep(word_counts(df.select("tokens")), "pooled")
    sizes = pooled.groupBy(F.length(F.bin("c")).alias("bits")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.col("bits").desc()).collect()  # 63 rows at most
    total, held, least = sum(s["c"] for s in sizes), 0, 1 << 62
    for s in sizes:
        held += s["n"]
        if held > frequent:
            break
        least = 1 << (s["bits"] - 1)
    share = F.log(F.col("c") / F.lit(total))
    top = pooled.filter(F.col("c") >= least).select("t", share.alias("s")).toArrow()
    hot, shares = pa.concat_arrays([pa.array([], pa.string()), *top.column(0).cast(pa.string()).chunks]), np.append(top.column(1).to_numpy(), 0.0)

    def look_up(batches):
        """A row a text for all its frequent words, and one for each other word of it."""
        for batch in batches:
            codes, known, text = _flat(batch.column(1))
            at = pc.fill_null(pc.index_in(known, hot), len(hot)).to_numpy(zero_copy_only=False)[codes] if len(known) else codes
            near = at < len(hot)
            n, sums = np.bincount(text[near], minlength=batch.num_rows), np.bincount(text[near], shares[at[near]], batch.num_rows).astype(float)
            rows = np.flatnonzero(n)
            pairs, times = np.unique(text[~near] * max(1, len(known)) + codes[~near], return_counts=True)
            own = batch.column(0).take(pa.array(np.concatenate([rows, pairs // max(1, len(known))])))
            t = pa.concat_arrays([pa.nulls(len(rows), known.type), known.take(pa.array(pairs % max(1, len(known))))])
            s = pa.concat_arrays([pa.array(sums[rows]), pa.nulls(len(pairs), pa.float64())])
            yield pa.RecordBatch.from_arrays([own, t, s, pa.array(np.concatenate([n[rows], times]).astype(np.int64))], names)

    rows, names = df.select(id_col, "tokens"), [id_col, "t", "s", "n"]
    parts = rows.mapInArrow(look_up, T.StructType([rows.schema[id_col], T.StructField("t", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())]))
    if least > 1:
        parts = keep(parts, "parts")
        far = parts.filter("t is not null").join(pooled.filter(F.col("c") < least), "t").select(id_col, (F.col("n") * share).alias("s"), "n")
        parts = parts.filter("t is null").select(id_col, "s", "n").unionByName(far)
    mean = parts.groupBy(id_col).agg((F.sum("s") / F.sum("n")).alias("commonness"))
    return (df if ids is None else ids).select(id_col).join(mean, id_col, "left").select(id_col, F.coalesce("commonness", F.lit(0.0)).alias("commonness"))
