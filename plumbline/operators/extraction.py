"""Prefix-continuation extraction: generate after a prefix, compare with the true suffix."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import split_runs, windows
from plumbline.sources.kept import keep as kept
from plumbline.sources.readers import size_of

#: Rows (of words) up to which a table is broadcast.
BROADCAST_WORDS = 200_000
#: Bytes of the corpus for each part of its pairs of words.
_PART_BYTES = 4 << 20


def split_at(tokens: Column, prefix_len: int, suffix_len: int) -> tuple[Column, Column]:
    """Prefix and suffix of the first ``prefix_len + suffix_len`` tokens."""
    if prefix_len <= 0 or suffix_len < 0:
        raise ValueError("prefix_len must be positive")
    return F.slice(tokens, 1, prefix_len), F.slice(tokens, prefix_len + 1, suffix_len)


def matched(suffix: Column, generated: Column) -> Column:
    """Leading tokens that agree; a short continuation stops the count."""
    first = F.array_position(F.zip_with(suffix, generated, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(first == 0, F.size(suffix)).otherwise(F.least(F.size(suffix), (first - 1).cast("int"))).cast("int")


def outcomes(df: DataFrame, suffix: str = "suffix", generated: str = "generated") -> DataFrame:
    """Add ``matched_tokens``, ``extracted`` and ``frac_extracted``."""
    df = df.withColumn("matched_tokens", matched(F.col(suffix), F.col(generated)))
    size = F.size(suffix)
    return df.withColumn("extracted", F.col("matched_tokens") == size).withColumn("frac_extracted", F.when(size > 0, F.col("matched_tokens") / size).otherwise(F.lit(0.0)))


def items(df: DataFrame, prefix_len: int, suffix_len: int, least: int, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``(*keep, prefix, suffix)`` of texts of at least ``least`` words, which are at most ``prefix_len + suffix_len``; no more words of a text are read."""
    most = prefix_len + suffix_len
    if not 0 < prefix_len <= least <= most:
        raise ValueError("least must lie between prefix_len and prefix_len + suffix_len")

    def cut(batches):
        for batch in batches:
            w = [(t or "").split(None, most)[:most] for t in batch.column(len(keep)).to_pylist()]
            at = [i for i, x in enumerate(w) if len(x) >= least]
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([w[i][part] for i in at], pa.list_(pa.string())) for part in (slice(prefix_len), slice(prefix_len, None))]], [*keep, "prefix", "suffix"])

    rows = df.select(*keep, text_col)
    return rows.mapInArrow(cut, T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("prefix", "suffix")]]))


def most_likely_next(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """``(prev, next)``: each word's most frequent follower, the smallest of equals.

    Pairs are counted by runs of texts in the worker, parted by their hash and sent packed; each part is summed in batches too, and gives its best pair of each word.
    """
    parts = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_of(corpus) // _PART_BYTES))
    names = ["prev", "next", "n"]

    def count(batches):
        for words, lengths in split_runs(b.column(0).to_pylist() for b in batches):
            codes, known, at = words.indices.to_numpy().astype(np.int64), len(words.dictionary), windows(lengths, 2)
            pairs, n = np.unique(codes[at] * known + codes[at + 1], return_counts=True)
            one, two = pairs // known, pairs % known
            each = np.array([crc32(w.encode()) for w in words.dictionary.to_pylist()], np.uint64)
            mixed = (each[one] * np.uint64(0x9E3779B97F4A7C15) + each[two]) * np.uint64(0xBF58476D1CE4E5B9)
            part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            held, begin = np.unique(part[order], return_index=True)
            offsets = pa.array(np.append(begin, len(order)).astype(np.int32))
            columns = [words.dictionary.take(pa.array(one[order])), words.dictionary.take(pa.array(two[order])), pa.array(n[order].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.ListArray.from_arrays(offsets, c) for c in columns]], ["part", *names])

    def best(batches):
        some = [pa.table([c.flatten() for c in b.columns[1:]], names) for b in batches]
        if some:
            summed = pa.concat_tables(some).group_by(["prev", "next"]).aggregate([("n", "sum")])
            most = summed.group_by("prev").aggregate([("n_sum", "max")])
            top = summed.join(most, "prev").filter(pc.field("n_sum") == pc.field("n_sum_max")).group_by("prev").aggregate([("next", "min"), ("n_sum", "max")])
            yield from top.select(["prev", "next_min", "n_sum_max"]).rename_columns(names).to_batches(1 << 16)

    packed = corpus.select(text_col).mapInArrow(count, "part int, prev array<string>, next array<string>, n array<long>").repartitionById(parts, "part")
    each = packed.mapInArrow(best, "prev string, next string, n long")
    return each.groupBy("prev").agg(F.min(F.struct((-F.col("n")).alias("n"), "next")).alias("best")).select("prev", F.col("best.next").alias("next"))


def _sent(df: DataFrame, n: int | None = None) -> DataFrame:
    """A kept table, to be broadcast if it is small by count."""
    return F.broadcast(df) if (df.count() if n is None else n) <= BROADCAST_WORDS else df


def continuations(starts: DataFrame, table: DataFrame, steps: int) -> DataFrame:
    """``(_last, generated)`` of each distinct word ``_last``: up to ``steps`` words after it. The table's rows that a step can reach are picked out first."""
    starts = kept(starts.distinct(), "starts")
    links, frontier = None, starts.select(F.col("_last").alias("prev"))
    for k in range(steps):
        n = frontier.count()
        if not n and k:
            break
        found = kept(table.select("prev", "next").join(_sent(frontier, n), "prev", "left_semi"), "links")
        links = found if links is None else links.unionByName(found)
        if k < steps - 1:
            frontier = kept(found.select(F.col("next").alias("prev")).distinct().join(links.select("prev"), "prev", "left_anti"), "frontier")
    out = starts.withColumn("generated", F.array().cast("array<string>")).withColumn("_at", F.col("_last"))
    links = _sent(links.withColumnsRenamed({"prev": "_prev", "next": "_next"}))
    for _ in range(steps):
        out = out.join(links, F.col("_at") == F.col("_prev"), "left")
        out = out.withColumn("generated", F.when(F.col("_next").isNotNull(), F.concat("generated", F.array("_next"))).otherwise(F.col("generated"))).withColumn("_at", F.col("_next")).drop("_prev", "_next")
    return out.drop("_at")


def generate(df: DataFrame, table: DataFrame, steps: int, prefix: str = "prefix") -> DataFrame:
    """Add ``generated``: up to ``steps`` words after the prefix, stopping where a word has no follower. Only its last word counts, so each distinct one is continued once."""
    df = df.withColumn("_last", F.element_at(prefix, -1))
    made = _sent(kept(continuations(df.select("_last").filter("_last is not null"), table, steps), "continuations").withColumnRenamed("_last", "_of"))
    out = df.join(made, F.col("_last") == F.col("_of"), "left")
    return out.withColumn("generated", F.coalesce("generated", F.array().cast("array<string>"))).drop("_last", "_of")


#: Upper ends of the buckets of matched tokens, with their names (fixed values).
MATCH_BUCKETS = ((0, "0"), (1, "1"), (2, "2"), (4, "3-4"), (9, "5-9"), (24, "10-24"), (50, "25-50"))
#: Edges of the histogram of fractions (fixed values).
FRACTION_EDGES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0, 1.0001)


def match_bucket(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for upto, name in reversed(MATCH_BUCKETS):
        out = F.when(value <= upto, F.lit(name)).otherwise(out)
    return out


def fraction_bucket(value: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in FRACTION_EDGES[1:]]), lambda e: e <= value))


def summary(df: DataFrame) -> DataFrame:
    one = F.col("extracted").cast("int")
    return df.agg(F.count("*").alias("n_items"), F.coalesce(F.avg(one), F.lit(0.0)).alias("rate"), F.coalesce(F.avg("frac_extracted"), F.lit(0.0)).alias("mean_fraction"), F.median("frac_extracted").alias("median_fraction"))


def cached_selection(spark: SparkSession, root: str, parameters: dict, select: Callable[[], DataFrame]) -> DataFrame:
    """A selection written once under a name made of all its parameters, and read from there afterwards: a resumed run scores the same items."""
    name = "_".join(f"{k}-{quote(str(v), safe='')}" for k, v in sorted(parameters.items()))
    path = f"{root}/selection_{name}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    select().write.mode("overwrite").parquet(path)  # complete once its commit marker is there
    return spark.read.parquet(path)


def resumable(items: DataFrame, path: str, generator: Callable[[], Callable[[DataFrame], DataFrame]], id_col: str, keep: tuple[str, ...] = (), restart: bool = False) -> DataFrame:
    """Outcomes of all ``items(id, prefix, suffix)``, of which only those not yet at ``path`` are generated; ``generator()`` is called only if there are any.

    Rows are keyed by id, so one that was written twice counts once.
    """
    spark = items.sparkSession
    done = None
    if not restart:
        try:
            done = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    todo = items if done is None else items.join(done.select(id_col), id_col, "left_anti")
    if done is None or todo.limit(1).count():
        found = outcomes(generator()(todo)).select(id_col, *keep, "matched_tokens", "extracted", "frac_extracted")
        found.write.mode("overwrite" if done is None else "append").parquet(path)
    return spark.read.parquet(path).dropDuplicates([id_col])
