"""Corpus-side contamination: which n-grams of benchmark items occur in a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import ngrams, split_runs, windows, words
from plumbline.sources.kept import keep
from plumbline.sources.readers import size_of

Tokenizer = Callable[[Column], Column]
#: Distinct item n-grams up to which they are broadcast against the corpus (about 100 bytes each).
BROADCAST_GRAMS = 200_000


def grams_of(df: DataFrame, id_col: str, n: int, text_col: str = "text", tokenizer: Tokenizer = words, separator: str = " ") -> DataFrame:
    """``(id, gram)`` with multiplicity."""
    return df.select(id_col, F.explode(ngrams(tokenizer(F.col(text_col)), n, separator)).alias("gram"))


def build_index(corpus: DataFrame | Iterable[DataFrame], n: int, text_col: str = "text", tokenizer: Tokenizer = words, separator: str = " ") -> DataFrame:
    """Distinct n-grams of one or several corpora."""
    parts = [corpus] if isinstance(corpus, DataFrame) else list(corpus)
    if not parts:
        raise ValueError("an index needs a corpus")
    tables = [c.select(F.explode(ngrams(tokenizer(F.col(text_col)), n, separator)).alias("gram")) for c in parts]
    return reduce(DataFrame.unionByName, tables).distinct()


def gram_counts(df: DataFrame, id_col: str, n: int, text_col: str = "text") -> DataFrame:
    """``(id, n_grams, n_distinct)`` of word n-grams, of ids that have any. They are counted where the text lies; only rows that share an id are shuffled by n-grams."""

    def count(batches):
        for batch in batches:
            at, held, distinct = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                w = (t or "").split()
                if len(w) >= n:
                    ends = list(accumulate(len(x) + 1 for x in w))
                    joined = " ".join(w)
                    at.append(k)
                    held.append(len(w) - n + 1)
                    distinct.append(len({joined[a : b - 1] for a, b in zip([0, *ends], ends[n - 1 :])}))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(held, pa.int64()), pa.array(distinct, pa.int64())], [id_col, "n_grams", "n_distinct"])

    rows = df.select(id_col, text_col)
    schema = T.StructType([rows.schema[id_col], T.StructField("n_grams", T.LongType()), T.StructField("n_distinct", T.LongType())])
    again = keep(rows.groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(id_col).alias("_again")), "again")
    many = again.count()
    if not many:
        return rows.mapInArrow(count, schema)
    shared = F.broadcast(again) if many <= BROADCAST_GRAMS else again
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    apart = grams_of(rows.join(shared, same, "left_semi"), id_col, n, text_col).groupBy(id_col).agg(F.count("*").alias("n_grams"), F.count_distinct("gram").alias("n_distinct"))
    return rows.join(shared, same, "left_anti").mapInArrow(count, schema).unionByName(apart)


#: Bytes of the corpus for each bucket of hashes.
_BUCKET_BYTES = 8 << 20


def _gram_hashes(words: pa.DictionaryArray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each n-gram: words are hashed as a whole, n-grams by two polynomials of their words' hashes, which are mixed then."""
    each = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in words.dictionary.to_pylist()), "<u8").reshape(-1, 2)
    codes, at = words.indices.to_numpy(), windows(lengths, n)
    out = []
    for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        h = each[codes, k]
        every = np.zeros(max(0, len(h) - n + 1), np.uint64)  # windows that cross texts are left out after
        for i in range(n):
            every *= np.uint64(odd)
            every += h[i : i + len(every)]
        total = every[at]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(total ^ (total >> np.uint64(29)))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def index_size(corpus: DataFrame, n: int, text_col: str = "text", tokenizer: Tokenizer = words, separator: str = " ") -> DataFrame:
    """Number of distinct n-grams, counted by hashes: the n-grams themselves are not shuffled.

    N-grams of words are hashed to 96 bits, parted by hash and travel packed, 12 bytes each, once from each run of texts; a task counts one part, which has a share of the corpus of fixed size.
    """
    if tokenizer is not words or separator != " ":
        hashes = F.transform(ngrams(tokenizer(F.col(text_col)), n, separator), lambda g: F.struct(F.xxhash64(g).alias("a"), F.xxhash64(F.lit(1), g).alias("b")))
        return corpus.select(F.explode(hashes).alias("h")).select("h.*").distinct().agg(F.count("*").alias("n_grams"))
    parts = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_of(corpus) // _BUCKET_BYTES))
    kind = np.dtype([("one", "<u8"), ("two", "<u4")])

    def pack(batches):
        for some, lengths in split_runs(b.column(0).to_pylist() for b in batches):
            one, two = _gram_hashes(some, lengths, n)
            order = np.argsort(one)
            one, two = one[order], two[order]
            new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(one) else np.zeros(0, bool)  # equal ones apart by a collision of the first 64 bits may stay
            rows = np.empty(int(new.sum()), kind)
            rows["one"], rows["two"] = one[new], two[new]
            ends = np.searchsorted(rows["one"], np.array([(p << 64) // parts for p in range(1, parts)], np.uint64))
            cut = [0, *ends.tolist(), len(rows)]
            held = [p for p in range(parts) if cut[p] < cut[p + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([rows[cut[p] : cut[p + 1]].tobytes() for p in held], pa.binary())], ["part", "packed"])

    def distinct(batches):
        rows = np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for b in batches for x in b.column(0)]])
        order = np.argsort(rows["one"])
        one, two = rows["one"][order], rows["two"][order]
        if ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
        yield pa.RecordBatch.from_arrays([pa.array([int(((one[1:] != one[:-1]) | (two[1:] != two[:-1])).sum()) + (len(rows) > 0)], pa.int64())], ["n"])

    packed = corpus.select(text_col).mapInArrow(pack, "part int, packed binary").repartitionById(parts, "part")
    return packed.select("packed").mapInArrow(distinct, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_grams"))


def overlap(items: DataFrame, corpus: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text", tokenizer: Tokenizer = words, separator: str = " ") -> DataFrame:
    """``(id, score)``: the share of an item's n-grams, with multiplicity, that the corpus has; 0 without n-grams.

    The items' distinct n-grams, if they are few by count, go to the corpus rather than the corpus's n-grams
    through a shuffle: most corpus n-grams are dropped where they are made.
    """
    grams = grams_of(items, id_col, n, text_col, tokenizer, separator)
    wanted = grams.select("gram").distinct()
    small = wanted.count() <= BROADCAST_GRAMS
    made = corpus.select(F.explode(ngrams(tokenizer(F.col(text_col)), n, separator)).alias("gram"))
    found = made.join(F.broadcast(wanted) if small else wanted, "gram", "left_semi").distinct().withColumn("_hit", F.lit(1))
    score = grams.join(F.broadcast(found) if small else found, "gram", "left").groupBy(id_col).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("score"))
    return items.select(id_col).join(score, id_col, "left").select(id_col, F.coalesce("score", F.lit(0.0)).alias("score"))


def contains_overlap(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    return scores.withColumn("contaminated", F.col("score") > threshold)


def matrix(items: DataFrame, corpus: DataFrame, sizes: tuple[int, ...] = (13, 8), by: str = "benchmark", id_col: str = "item_id") -> DataFrame:
    """Per benchmark and n: items, items with any overlap, rate, mean and largest score."""
    parts = []
    for n in sizes:
        scored = overlap(items, corpus, n, id_col).join(items.select(id_col, by), id_col)
        hit = (F.col("score") > 0).cast("long")
        parts.append(scored.groupBy(by).agg(F.count("*").alias("n_items"), F.sum(hit).alias("n_flagged"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")).withColumn("n", F.lit(n)))
    return reduce(DataFrame.unionByName, parts)


def separation(scores: DataFrame, label: str = "member") -> DataFrame:
    """Mean, least and largest score of members and others, their difference, and flagged counts."""
    one, zero = F.when(F.col(label) == 1, F.col("score")), F.when(F.col(label) == 0, F.col("score"))
    return scores.agg(
        F.avg(one).alias("member_mean"), F.min(one).alias("member_min"), F.max(one).alias("member_max"), F.avg(zero).alias("other_mean"), F.min(zero).alias("other_min"), F.max(zero).alias("other_max"),
        (F.avg(one) - F.avg(zero)).alias("separation"), F.sum((zero > 0).cast("long")).alias("other_flagged"),
    )
