"""Shared building blocks of the training-data operators.

* ``keep`` cuts lineage through a Parquet table in the cluster's shared checkpoint folder (shared with the rest of the library).
* ``running_offset`` is a prefix sum inside groups of any size: groups are cut into hash
  ranges, so that no task holds a whole group.
* ``connected_components`` labels components by alternating large-star and small-star steps.
* ``word_hashes`` and ``rolling`` hash word sequences in NumPy.
* ``plain`` puts a table's columns under internal names, so that no column of the caller's can clash with one of an operator's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.kept import discard, keep

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python worker holds as arrays at a time (a longer text is one chunk of its own); an array of numbers takes eight times as many.
CHUNK_BYTES = 250_000


#: Bytes of an Arrow batch on its way to or from Python: rows hold whole texts, of which Spark's own bound would hold 64 MB at a time, on both sides.
ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches to ARROW_BYTES, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "67108864b")).rstrip("bB")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def release() -> None:
    """Give memory that arrays took back to the system: Python workers are used again by later stages, and what each has held would add up."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(of: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that takes bounded batches and releases its memory at the end of the task."""
    bound_batches(SparkSession.active())

    def run(batches: Iterator) -> Iterator:
        try:
            yield from of(batches)
        finally:
            release()

    return run


def plain(df: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... in order, and these names of the columns ``named`` (found without regard to case)."""
    given = [c.lower() for c in df.columns]
    return df.toDF(*[f"c{k}" for k in range(len(given))]), [f"c{given.index(n.lower())}" for n in named]


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added while another column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def hash_bits(rows: int, rows_per_bucket: int = 1000, most: int = 20) -> int:
    """Bits of a hash range so that a bucket of evenly hashed rows holds about ``rows_per_bucket``."""
    return min(most, max(2, math.ceil(math.log2(max(1, rows) / rows_per_bucket + 1))))


def running_offset(df: DataFrame, group: list[str], hashed: str, ties: list[str], value: Column, out: str, bits: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before.

    Rows are ordered by the signed 64-bit column ``hashed``, then ``ties``. Sums are built in two
    levels, per (group, top bits of the hash) and inside such a bucket, so a group is never
    gathered in one task. Group columns are compared null-safely. ``df`` is read twice.
    """
    bucketed = df.withColumn("_bucket", F.shiftright(F.col(hashed), 64 - bits)).withColumn("_value", value.cast("long"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = bucketed.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    base = base.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(hashed, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = F.col("_bucket") == F.col("_b")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(base, same).select(*df.columns, (F.col("_base") + F.col("_inside")).alias(out))


def count_at_most(entries: Column, value: Column, field: str | None = None, bits: int = 21) -> Column:
    """How many entries of a sorted array (or their ``field``) are at most ``value``: binary search of up to 2^bits entries."""
    entry = lambda at: F.get(entries, at - 1)[field] if field else F.get(entries, at - 1)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size(entries)) & (entry(n + step) <= value), n + step).otherwise(n))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``; component is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., 2014) until the edge set is a fixed
    point. Each round is written to the shared folder, so lost executors only cost one round.
    Null ends and loops are ignored; nodes without edges are absent from the result.
    """
    now = keep(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, now = now, keep(small.filter("a <> b").distinct(), "edges")
        discard(last)
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if (tuple(seen)) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    leaves = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Odd multipliers of the two rolling hashes.
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Hashes of all windows of k consecutive entries, by doubling; len(h) - k + 1 of them."""
    if len(h) < k:
        return h[:0]
    with np.errstate(over="ignore"):
        power, width, level = base, 1, h
        out, done = None, 0
        while True:
            if k & width:
                if out is None:
                    out, done = level, width
                else:  # out covers the first `done` entries; append a block of `width`
                    n = len(h) - done - width + 1
                    out, done = out[:n] * power + level[done : done + n], done + width
            if done == k:
                return mix(out[: len(h) - k + 1])
            n = len(level) - width
            level = level[:n] * power + level[width : width + n]
            power, width = power * power, width * 2


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is the empty text."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sequence_hash(h: np.ndarray, start: np.ndarray, base: np.uint64) -> np.ndarray:
    """One hash for each segment of ``h``; ``start`` has the segments' bounds, one more than segments."""
    n = len(start) - 1
    if n == 0:
        return np.empty(0, np.uint64)
    size = np.diff(start)
    with np.errstate(over="ignore"):
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(start[:-1], size).astype(np.uint64)
        mixed = mix(h + mix((place + np.uint64(1)) * base))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
        return mix(sums[start[1:]] - sums[start[:-1]] + size.astype(np.uint64) * base)


#: Rows of ids (or of pairs of ids) up to which a side of a join is broadcast: at most 16 MB of numbers.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a kept table of ids if its counted rows allow it; otherwise the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= limit else df


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with ASCII letters in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(texts: list[bytes], lower: bool = False, kinds: tuple[int, ...] = (0,)) -> tuple:
    """``(sizes, hashes of each kind, ..., begin)``: words of each text, 64-bit hashes of all in order, and each text's first word.

    Kinds 0 and 1 are independent hashes of the whole word. Stretches of 64 bytes are hashed by tabulation, with a random number for each
    (place in the stretch, byte); the stretches of a longer word are mixed one by one with their place before they are added.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if lower:
        data = LOWER[data]
    at = np.flatnonzero(~SPACE[data])
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    begin = np.flatnonzero(first)
    start = at[begin]
    lengths = np.diff(np.append(begin, len(at)))
    place = (at - np.repeat(start, lengths)) & 63
    code = (place << 8) | data[at]
    pieces = np.flatnonzero(place == 0)
    stretches = (lengths + 63) >> 6
    long = stretches > 1
    out = []
    for kind in kinds:
        table = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * BASES[kind] + mix(BASES[1 - kind : 2 - kind]))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(table[code], pieces) if len(pieces) else np.empty(0, np.uint64)
            sized = lengths.astype(np.uint64) * BASES[1 - kind]
            one = sums[np.cumsum(stretches) - stretches]
            if long.any():
                one[long] = sequence_hash(sums[np.repeat(long, stretches)], np.concatenate(([0], np.cumsum(stretches[long]))), BASES[kind])
            out.append(mix(one + sized))
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    return np.diff(bounds), *out, bounds


def chunks(column) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of an Arrow string column of about CHUNK_BYTES, with their texts in UTF-8; null is the empty text."""
    import pyarrow.compute as pc

    at = 0
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_BYTES, "right")) + at)
        yield at, upto, texts_of(column.slice(at, upto - at))
        at = upto
