"""Substring dedup by De Bruijn compaction.

The edges of the graph are the windows of ``k`` consecutive words, its nodes the (k - 1)-word overlaps. A text's edges are first cut into
non-branching paths by content: consecutive windows whose least (k - w)-word seed stands at the same place are one path, so equal windows lie
at the same place of paths with the same seed. Seeds that occur once in the corpus go at once: none of their windows repeats.
Paths that are equal as a whole compact into one class by a Spark join, whose later members repeat entirely. Only the first member of a class is opened
into edges again, and only where its seed has several classes, which is where paths branch; an edge's least source coordinate then tells
which others repeat. Edges are told apart by two independent hashes of whole words, 128 bits.

Every repeated span is verified at its source coordinates: the words that stand there are read from the source's text, and a span whose own words are not the same (by a 128-bit hash of
their bytes) is not removed.

A word is removed if a window that covers it starts earlier elsewhere: at a smaller id, or earlier in the same document.

Defined cases: a null text has no words; texts of fewer than ``k`` words lose nothing; a null id counts as the largest; rows that share an id
are one document's, told apart by a hash of their text, and identical rows are judged alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BASES, chunks, discard, keep, mix, rolling, signed, small_side, tidy, word_hashes

LAST = (1 << 63) - 1
#: Spans of a side (some 50 bytes each with their text's keys) that may be broadcast instead of shuffling the text.
BROADCAST_SPANS = 250_000
#: Paths of one seed in a chunk from which on all but two are dealt out on their own: the two show that the seed is repeated.
OFTEN = 8


def paths(hashes: np.ndarray, others: np.ndarray, sizes: np.ndarray, begin: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, ...]:
    """``(text, start, windows, seed hash, path hash)`` of the paths of several texts; start is a word of the text. Seeds are of one word hash, paths of the other."""
    n = len(hashes) - k + 1
    if n < 1:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    seeds = rolling(hashes, seed, BASES[0])
    span = k - seed + 1
    # The least seed of each window and its leftmost place, by doubling.
    place = np.arange(len(seeds))
    value, width = seeds, 1
    while width < span:
        step = min(width, span - width)
        left, right = value[: len(value) - step], value[step:]
        take = right < left
        place = np.where(take, place[step:], place[: len(place) - step])
        value = np.where(take, right, left)
        width += step
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = owner[:n] == owner[k - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return paths(hashes[:0], others[:0], sizes, begin, k, seed)
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    grams = rolling(others, k, BASES[1])
    with np.errstate(over="ignore"):
        inside = np.arange(len(at)) - np.repeat(first, count)
        weighed = mix(grams[at] + mix((inside + 1).astype(np.uint64) * BASES[0]))
        total = mix(np.add.reduceat(weighed, first) + count.astype(np.uint64) * BASES[1])
    text = owner[start]
    return text, start - begin[text], count, value[start], total


def deal(seeds: np.ndarray) -> np.ndarray:
    """0, or for all but two rows of a seed that is frequent here a number from 1 to 1024."""
    value, first, count = np.unique(seeds, return_index=True, return_counts=True)
    out = np.zeros(len(seeds), np.int16)
    if (count > OFTEN).any():
        order = np.argsort(seeds, kind="stable")
        begin = np.cumsum(count) - count
        place = np.arange(len(seeds)) - np.repeat(begin, count)
        hot = np.repeat(count > OFTEN, count) & (place > 1)
        out[order[hot]] = 1 + place[hot] % 1024
    return out


def path_table(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """``docs(doc, key, text)`` to paths; ``dealt`` is not 0 for rows that are known to be repeated."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, texts in chunks(batch.column(2)):
                sizes, one, two, begin = word_hashes(texts, kinds=(0, 1))
                text, start, count, seeds, total = paths(one, two, sizes, begin, k, seed)
                columns = (signed(seeds), deal(seeds), signed(total), ids[i:j][text], keys[i:j][text], start.astype(np.int32), count.astype(np.int32))
                yield pa.record_batch([pa.array(c) for c in columns], ["seed", "dealt", "path", "doc", "key", "start", "windows"])

    return docs.mapInArrow(tidy(build), "seed bigint, dealt smallint, path bigint, doc bigint, key bigint, start int, windows int")


def repeated_seeds(rows: DataFrame) -> DataFrame:
    """Paths whose seed has another path: one shuffle and sort by seed, then neighbours are compared as they stream by. Rows known to be repeated are spread over tasks of their own."""

    def neighbours(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, same = None, False
        for batch in batches:
            whole = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            seed, dealt = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            equal = np.concatenate(([same], (seed[1:] == seed[:-1]) & (dealt[1:] == dealt[:-1])))
            found = equal | (dealt != 0)
            found[:-1] |= equal[1:]
            found[-1] = False
            yield from whole.filter(pa.array(found)).to_batches()
            held, same = whole.slice(len(seed) - 1).to_batches()[0], bool(equal[-1])
        if held is not None and (same or held.column(1)[0].as_py()):
            yield held

    return rows.repartition("seed", "dealt").sortWithinPartitions("seed", "dealt").mapInArrow(tidy(neighbours), rows.schema).drop("dealt")


def _beside(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``(doc, key, text, spans)``: texts joined to their ``rows(doc, key, ...)``, which are broadcast while their counted number is small; else texts that have any are shuffled."""
    lists = keep(rows.groupBy("doc", "key").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("doc", "key")])).alias("spans")), "spans")
    texts, spans = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if texts + spans <= BROADCAST_SPANS:
        lists = F.broadcast(lists)
    elif how == "inner":
        docs = docs.join(small_side(lists.select("doc", "key")), ["doc", "key"], "left_semi")
    return docs.join(lists, ["doc", "key"], how).select("doc", "key", "text", "spans")


def edge_table(docs: DataFrame, opened: DataFrame, k: int) -> DataFrame:
    """``(e1, e2, doc, key, at)`` of the windows of opened paths."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, keys, spans = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for i, j, texts in chunks(batch.column(2)):
                _, one, two, begin = word_hashes(texts, kinds=(0, 1))
                lists = spans.slice(i, j - i)
                owner = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                first, count = flat.field("start").to_numpy() + begin[owner], flat.field("windows").to_numpy().astype(np.int64)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                owner = np.repeat(owner, count)
                columns = (signed(rolling(one, k, BASES[0])[at]), signed(rolling(two, k, BASES[1])[at]), ids[i:j][owner], keys[i:j][owner], (at - begin[owner]).astype(np.int32))
                yield pa.record_batch([pa.array(c) for c in columns], ["e1", "e2", "doc", "key", "at"])

    return _beside(docs, opened, "inner").mapInArrow(tidy(build), "e1 bigint, e2 bigint, doc bigint, key bigint, at int")


def _digest(words: list[bytes], start: int, windows: int, k: int) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words[start : start + windows + k - 1]))


def at_sources(docs: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """``spans`` with ``said``: a hash of the words at their source coordinates."""
    source = ["source_doc", "source_key", "source_start", "windows"]

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, j, texts in chunks(batch.column(2)):
                rows = []
                for t, text in enumerate(texts):
                    words = text.split()
                    rows += [(batch.column(0)[i + t].as_py(), batch.column(1)[i + t].as_py(), s["start"], s["windows"], _digest(words, s["start"], s["windows"], k)) for s in batch.column(3)[i + t].as_py()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [*source, "said"])

    places = spans.select(*source).distinct().toDF("doc", "key", "start", "windows")
    # Written down, so that both sides of the join are plain shuffles, of which a frequent source can be split.
    said = keep(_beside(docs, places, "inner").mapInArrow(tidy(read), "source_doc bigint, source_key bigint, source_start int, windows int, said binary").dropDuplicates(source), "said")
    return spans.join(said, source).select("doc", "key", "start", "windows", "said")


def repeated_spans(docs: DataFrame, k: int = 20, seed: int = 6) -> DataFrame:
    """``(doc, key, start, windows, said)``: runs of windows that start earlier elsewhere, and what stands there; ``docs(doc, key, text)``."""
    rows = keep(repeated_seeds(path_table(docs, k, seed)), "paths")
    classes = keep(rows.groupBy("seed", "path", "windows").agg(F.min(F.struct("doc", "start", "key")).alias("first")), "classes")
    source = lambda at: [F.col("first.doc").alias("source_doc"), F.col("first.key").alias("source_key"), F.col(f"first.{at}").alias("source_start")]
    # Rows that share id and text are the same source, so a place is compared without its text's key where ids are equal.
    whole = rows.join(classes, ["seed", "path", "windows"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    branching = classes.groupBy("seed").agg(F.count("*").alias("_n")).filter("_n > 1").select("seed")
    opened = keep(classes.join(branching, "seed", "left_semi").select("first.doc", "first.key", "first.start", "windows").distinct(), "opened")
    # Edges of repeated rows come twice, at the same place: none is later than the other.
    edges = keep(edge_table(docs, opened, k), "edges")
    least = edges.groupBy("e1", "e2").agg(F.min(F.struct("doc", "at", "key")).alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    later = edges.join(least, ["e1", "e2"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    spans = whole.select("doc", "key", "start", "windows", *source("start")).unionByName(later.select("doc", "key", F.col("at").alias("start"), F.lit(1).alias("windows"), *source("at")))
    spans = keep(spans, "repeats")
    for used in (rows, classes, opened, edges):
        discard(used)
    return at_sources(docs, spans, k)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row per row: the words that stay, joined by one space."""
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = [None if d == LAST else d for d in batch.column(0).to_pylist()]
            for i, j, texts in chunks(batch.column(2)):
                out = ([], [], [])
                for t, text in enumerate(texts):
                    words = text.split()
                    spans = batch.column(3)[i + t].as_py() or ()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        start, windows = s["start"], s["windows"]
                        if _digest(words, start, windows, k) == s["said"]:
                            gone[start] += 1
                            gone[start + windows + k - 1] -= 1
                    stays = np.cumsum(gone)[: len(words)] == 0
                    if not stays.all():
                        words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                    for o, v in zip(out, (len(stays), len(stays) - len(words), b" ".join(words)), strict=True):
                        o.append(v)
                yield pa.record_batch([pa.array(ids[i:j], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return _beside(docs, repeated_spans(docs, k), "left").mapInArrow(tidy(cut), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
