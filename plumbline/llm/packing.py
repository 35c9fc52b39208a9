"""Pattern packing by non-negative least squares.

Lengths form a histogram of at most ``capacity`` bins, so its plan fits on the driver at any number of
documents. Patterns of few documents are enumerated over coarse bins; non-negative least
squares (Lawson-Hanson) fits how often to repeat each to the histogram; repeats are rounded
down and carried out on exact lengths that fill the capacity without a gap; what is left over is
packed best-fit, longest first. The plan is a list of
runs ``(length, first rank, count, sequence, offset)``; a piece finds its run by its rank among pieces
of its length, which hash ranges number in parallel.

Defined cases: a null or empty text gives no ids but the separator; repeated rows are packed each;
an empty table gives an empty result; only a document longer than the capacity is cut, its last
piece being shorter. Ties of a hash are ordered by id, piece and checksum.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, count_at_most, hash_bits, keep, running_offset, tidy

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Encoded words that a worker remembers before it starts afresh.
CACHE_WORDS = 500_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Lawson and Hanson's active-set method: x >= 0 with least |a x - b|."""
    gram, right = a.T @ a, a.T @ b
    x, held = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = right - gram @ x
        slope[held] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * max(1.0, abs(right).max()):
            break
        held[j] = True
        while held.any():
            at = np.flatnonzero(held)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], right[at], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            held[at[x[at] <= 1e-12]] = False
            x[~held] = 0
    return x


def pattern_repeats(histogram: np.ndarray, capacity: int, bins: int = 32, most: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """``(bins of a pattern, longest first; repeats)`` from the fit; bin i holds lengths from i * width + 1."""
    width = -(-capacity // bins)
    coarse = np.array([histogram[i * width + 1 : (i + 1) * width + 1].sum() for i in range(bins)], float)
    patterns = [p for n in range(1, most + 1) for p in combinations_with_replacement(range(bins - 1, -1, -1), n) if bins - 1 <= sum(p) + n / 2 <= bins]
    if not patterns or not coarse.any():
        return []
    a = np.zeros((bins, len(patterns)))
    for j, p in enumerate(patterns):
        for i in p:
            a[i, j] += 1
    weight = np.sqrt((np.arange(bins) + 1.0) / bins)  # short documents left over still fit anywhere
    x = nnls(a * weight[:, None], coarse * weight)
    return sorted(((p, int(n)) for p, n in zip(patterns, x, strict=True) if n >= 1), key=lambda t: (-t[1], t[0]))


class _Left:
    """Counts of the lengths not yet packed, with the lengths kept sorted."""

    def __init__(self, histogram: np.ndarray):
        self.count = {n: int(c) for n, c in enumerate(histogram) if c and n}
        self.lengths = sorted(self.count)

    def longest(self, most: int, least: int = 1) -> int:
        at = bisect_right(self.lengths, most) - 1
        return self.lengths[at] if at >= 0 and self.lengths[at] >= least else 0

    def take(self, lengths: list[int], times: int) -> None:
        for n in lengths:
            self.count[n] -= times
            if not self.count[n]:
                del self.count[n]
                self.lengths.remove(n)

    def exact(self, pattern: tuple[int, ...], capacity: int, width: int) -> list[int]:
        """Lengths from the pattern's bins, as long as they can be, that sum to the capacity; none if there are none."""
        chosen, space = [], capacity
        for i in pattern[:-2]:
            n = self.longest(min(space, (i + 1) * width), i * width + 1)
            while n and self.count[n] <= chosen.count(n):
                n = self.longest(n - 1, i * width + 1)
            if not n:
                return []
            chosen.append(n)
            space -= n
        if len(pattern) == 1:
            return [space] if self.count.get(space) else []
        i, j = pattern[-2:]
        n = self.longest(min(space, (i + 1) * width), i * width + 1)
        while n:
            both = [*chosen, n, space - n]
            if j * width < space - n <= (j + 1) * width and all(self.count.get(m, 0) >= both.count(m) for m in both[-2:]):
                return both
            n = self.longest(n - 1, i * width + 1)
        return []

    def fill(self, chosen: list[int], space: int) -> None:
        """Best fit: the longest length that fits, while any is left beyond those chosen."""
        used: dict[int, int] = {}
        for n in chosen:
            used[n] = used.get(n, 0) + 1
        while n := self.longest(space):
            while n and self.count[n] <= used.get(n, 0):
                n = self.longest(n - 1)
            if not n:
                break
            chosen.append(n)
            used[n] = used.get(n, 0) + 1
            space -= n


#: Shares of the fitted repeats that are tried, the largest first.
SHARES = (1.0, 0.98, 0.95, 0.9, 0.8, 0.65, 0.5, 0.25, 0.0)


def plan(histogram: np.ndarray, capacity: int, bins: int = 32, most: int = 4) -> list[tuple[list[int], int]]:
    """``(lengths of a sequence, times)`` covering the histogram exactly.

    The fit knows no rounding: carried out in full it may use up short documents that the residuals need. So it is carried out in several shares, and the plan of fewest
    sequences is taken, of equals that with the most patterns. Share 0 is best fit alone, which the plan never exceeds.
    """
    repeats = pattern_repeats(histogram, capacity, bins, most)
    least = -(-int(histogram @ np.arange(len(histogram))) // capacity)
    best, count = [], None
    for share in SHARES:
        found = _carried_out(histogram, capacity, bins, [(p, int(n * share)) for p, n in repeats])
        sequences = sum(times for _, times in found)
        if count is None or sequences < count:
            best, count = found, sequences
        if count == least:
            break
    return best


def _carried_out(histogram: np.ndarray, capacity: int, bins: int, patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[list[int], int]]:
    left, out = _Left(histogram), []
    width = -(-capacity // bins)

    def emit(chosen: list[int], cap: int) -> int:
        times = min([cap, *(left.count[n] // chosen.count(n) for n in set(chosen))])
        out.append((chosen, times))
        left.take(chosen, times)
        return times

    for pattern, repeats in patterns:
        while repeats > 0 and (chosen := left.exact(pattern, capacity, width)):
            repeats -= emit(chosen, repeats)
    while left.lengths:
        chosen = [left.lengths[-1]]
        left.fill(chosen, capacity - chosen[0])
        emit(chosen, 1 << 62)
    return out


#: Fixed value: how the vocabulary's splitter parts a word; the alternatives stand in its order.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of Latin, Greek and Cyrillic without white space, where all Unicode tables agree on letters and numbers.
SETTLED = r"[\x00-\x08\x0e-\x1b\x21-\x84\x86-\x9f\xa1-\u052f]+"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class WordIds:
    """Packed little-endian ids of white-space words, remembered in two generations of CACHE_WORDS.

    The vocabulary drops white space and its splits never cross it, so a text's ids are those of its
    words in order. Words of settled letters are split here and merged by rank, a space marking the end of a part (a token's
    id is its rank); others are encoded together by the tokenizer itself and told apart by their offsets.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        byte, ranks = byte_of(), {}
        for word, i in self.model.get_vocab(with_added_tokens=False).items():
            if not word.startswith("<|"):
                ranks[bytes(byte[c] for c in word.removesuffix("</w>")) + (b" " if word.endswith("</w>") else b"")] = i
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for w, i in ranks.items() if len(w) > 1 and w.endswith(b" ")]] = True
        self.merger = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.parts, self.settled = regex.compile(PARTS), regex.compile(SETTLED)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _merge(self, words: list[str]) -> tuple[bytes, list[int]]:
        """Ids of settled words in order, and the byte where each word's begin, and the end."""
        counts, parts = [], []
        for word in self.model.normalizer.normalize_str(" ".join(words)).split(" "):
            if word.isalpha():
                parts.append(word)
                counts.append(1)
            else:
                found = self.parts.findall(word)
                parts += found
                counts.append(len(found))
        ids = np.array(self.merger.encode_ordinary(" ".join(parts) + " "), "<u4")
        bounds = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        return ids.tobytes(), (bounds[np.cumsum([0, *counts])] * 4).tolist()

    def _offsets(self, words: list[str]) -> tuple[bytes, list[int]]:
        """The same of any words."""
        got = self.model.encode(" ".join(words), add_special_tokens=False)
        begin = np.cumsum([0, *[len(w) + 1 for w in words]])
        owner = np.searchsorted(begin, np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids)), "right") - 1
        return np.array(got.ids, "<u4").tobytes(), (np.searchsorted(owner, np.arange(len(words) + 1)) * 4).tolist()

    def _learn(self, new: list[bytes]) -> None:
        groups: tuple[list[str], list[str]] = ([], [])
        for word in new:
            text = word.decode("utf-8")
            groups["<|" in text or not self.settled.fullmatch(text)].append(text)
        for words, ids_of in zip(groups, (self._merge, self._offsets), strict=True):
            if words:
                packed, cut = ids_of(words)
                self.young.update((w.encode("utf-8"), packed[i:j]) for w, i, j in zip(words, cut[:-1], cut[1:], strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ASCII letters are lower-cased first, as the vocabulary does, unless a special token could be spelled."""
        split = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        missing = set().union(*split).difference(self.young)
        if self.old:
            known = missing.intersection(self.old)
            self.young.update((w, self.old[w]) for w in known)
            missing -= known
        if missing:
            self._learn(list(missing))
        return [b"".join(map(self.young.__getitem__, words)) for words in split]


def pieces(df: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str, separator: int = 0) -> DataFrame:
    """Cut tokenised documents (ids, then the separator) into pieces of at most ``capacity`` ids."""
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = WordIds(vocabulary)
        for batch in batches:
            rows = ([], [], [], [], [])
            docs = batch.column(0).to_pylist()
            for i, j, texts in chunks(batch.column(1)):
                for doc, ids in zip(docs[i:j], words.encode(texts), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for out, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            out.append(value)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(cut), PIECES)


def pack(df: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", separator: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece."""
    spark = df.sparkSession
    cut = keep(pieces(df, vocabulary, capacity, id_col, text_col, separator).withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for chosen, times in plan(counts, capacity):
        offset = 0
        for n in chosen:
            rows.append((n, int(used[n]), int(times), sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    runs = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "_length bigint, _first bigint, _times bigint, _sequence bigint, _offset bigint")
    ranked = running_offset(cut, ["length"], "_h", ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank", hash_bits(int(counts.max())))
    # A rank's run is the last one of its length that begins at or before it: found by an ordered list per length.
    lists = runs.groupBy("_length").agg(F.array_sort(F.collect_list(F.struct("_first", "_sequence", "_offset"))).alias("_runs"))
    found = ranked.join(F.broadcast(lists), F.col("length") == F.col("_length"))

    run = F.get("_runs", F.col("_at") - 1)
    return found.withColumn("_at", count_at_most(F.col("_runs"), F.col("_rank"), "_first")).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (run["_sequence"] + F.col("_rank") - run["_first"]).alias("sequence_id"), run["_offset"].alias("offset"),
    )
