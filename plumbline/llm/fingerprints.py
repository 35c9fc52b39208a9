"""Document fingerprints: a homomorphic multiset hash of paragraphs [native].

A paragraph is a line, parted where its own words say so: after a word whose last character is a clause mark, or a character below U+0100 whose code point leaves 7 on
division by 8. What changes in a paragraph so leaves its other pieces as they are. Each piece is hashed to a wide vector
(LANES lanes of odd numbers from -255 to 255, whose mean is 0: sums of distinct pieces do not drift) and a document's fingerprint is the lane-wise sum modulo 2^32. The sum does not depend
on order, and pieces are inserted or deleted by adding or subtracting their vectors (``combine``).
Equal multisets have equal fingerprints.

The expected square of a lane of a sum of n distinct pieces is n times a lane's variance, so
the squared length of the difference of two fingerprints estimates the size of the symmetric difference;
``likeness`` is 1 minus that over the sum of both sizes, estimated the same way, cut to [0, 1].
A lane of fewer than 2^23 pieces cannot leave the signed range, even if all are the same; sums of distinct pieces leave it only
from about 10^13 pieces on. Beyond either, likeness means nothing.

Defined cases: a null text is the empty text, without pieces (fingerprint all zero); two empty
texts have likeness 1; rows with a null id come last in descending order; rows that share an id, or have none, are ordered by a hash of their text, then the text; a single
row is its own neighbour; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import count_at_most, keep

LANES, MODULUS = 64, 1 << 32
#: Hexadecimal digits of a lane.
WIDTH = 8
#: Last characters of words that end a piece.
ENDS = ".,;:!?\u2026\u3002\uff01\uff1f\uff1b" + "".join(chr(c) for c in range(0x27, 0x100, 8))
_SPACE, _BREAK = r"[\x20\x09\x0B\x0C]", r"[\x0A\x0D]"
#: What parts pieces: the white space around a line's end, or after such a character.
PARTING = rf"{_SPACE}*+{_BREAK}[\x20\x09-\x0D]*+|(?={_SPACE})(?<=[{re.escape(ENDS)}]){_SPACE}++"
#: Ranges cut at quantiles of the ids; each is parted evenly between its ends as far as its rows ask for.
QUANTILES = 1024


def pieces(text: Column) -> Column:
    inner = F.btrim(text, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return F.filter(F.split(F.regexp_replace(inner, PARTING, "\n"), "\n"), lambda p: p != "")


def lanes(text: Column) -> Column:
    """The fingerprint as an array of LANES integers from 0 to MODULUS - 1.

    Eight 64-bit hashes of a piece hold eight lanes each. Lanes are summed four to a number, 16 bits apart, as bytes from 0 to 255;
    they become odd numbers about 0 when the sums are taken apart.
    """
    halves = LANES // 4
    low = 0x00FF00FF00FF00FF

    def words(piece: Column) -> list[Column]:
        hashed = [F.xxhash64(F.lit(seed), piece) for seed in range(LANES // 8)]
        return [part for h in hashed for part in (h.bitwiseAND(F.lit(low)), F.shiftrightunsigned(h, 8).bitwiseAND(F.lit(low)))]

    def spread(total: Column, j: int) -> Column:
        return F.shiftrightunsigned(total, 16 * j).bitwiseAND(F.lit(0xFFFF))

    # Blocks of 128 pieces keep four lanes (each below 2^15) inside one number; block sums then go lane by lane.
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_pieces") - 1) / 128).cast("int"))), lambda b: F.slice("_pieces", b * 128 + 1, F.lit(128)))
    zero = F.array(*[F.lit(0).cast("long")] * halves)
    packed = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda acc, p: F.array(*[acc[i] + w for i, w in enumerate(words(p))])))
    whole = F.array(*[F.lit(0).cast("long")] * LANES)
    return F.transform(
        F.aggregate(packed, whole, lambda acc, s: F.array(*[acc[4 * i + j] + spread(s[i], j) for i in range(halves) for j in range(4)])),
        lambda v: F.pmod(v * 2 - F.size("_pieces").cast("long") * 255, F.lit(MODULUS)),
    )


def with_lanes(df: DataFrame, text: Column, out: str) -> DataFrame:
    return df.withColumn("_pieces", pieces(text)).withColumn(out, lanes(text)).drop("_pieces")


def encode(vector: Column) -> Column:
    """Fixed-width lower-case hexadecimal."""
    return F.lower(F.array_join(F.transform(vector, lambda v: F.lpad(F.hex(v), WIDTH, "0")), ""))


def combine(one: Column, two: Column, sign: int = 1) -> Column:
    """Insert (sign 1) or delete (-1) the pieces of ``two``."""
    return F.zip_with(one, two, lambda x, y: F.pmod(x + y * sign, F.lit(MODULUS)))


def _square(vector: Column) -> Column:
    centred = F.transform(vector, lambda v: (F.pmod(v + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2).cast("double"))
    return F.aggregate(centred, F.lit(0.0), lambda s, v: s + v * v)


def likeness(one: Column, two: Column) -> Column:
    apart, both = _square(combine(one, two, -1)), _square(one) + _square(two)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart / both))


def _ranges(docs: DataFrame, rows_per_range: int) -> DataFrame:
    """Add ``_range``, larger for rows that come earlier: quantiles of the ids, even parts of each, and for rows without an id parts of their texts' hashes."""
    total, named, low, high = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    coarse = max(1, min(QUANTILES, named // rows_per_range))
    fine = max(1, -(-named // (coarse * rows_per_range)))
    cuts = []
    if coarse > 1:
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(1, coarse)], 100 * coarse)).first()[0]))
    part = F.lit(0)
    if named:
        at = count_at_most(F.array(*[F.lit(c) for c in cuts]), F.col("doc_id"), bits=11) if cuts else F.lit(0)
        ends = F.array(*[F.lit(c).cast("double") for c in [low, *cuts, high]])
        inside = (F.col("doc_id") - F.element_at(ends, F.col("_at") + 1)) / (F.element_at(ends, F.col("_at") + 2) - F.element_at(ends, F.col("_at") + 1) + 1)
        docs = docs.withColumn("_at", at)
        part = F.col("_at") * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor(inside * fine)))
    bits = max(0, ((total - named) // rows_per_range).bit_length())
    nameless = -1 - (F.shiftright("_th", 64 - bits) + (1 << (bits - 1)) if bits else F.lit(0))
    return docs.withColumn("_range", F.when(F.col("doc_id").isNull(), nameless).otherwise(part).cast("long")).drop("_at")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2000) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's beginning.

    The next document in descending id order is found inside ranges of ids; only a range's first row crosses into its neighbour, and only ids and hashes tell which row that is. The
    text is shuffled once, by range, with its fingerprint beside it.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_th", F.xxhash64("text"))
    docs = _ranges(docs, rows_per_range)
    # The first row of each range, and the range that comes before it (the first of all follows the last).
    heads = keep(docs.groupBy("_range").agg(F.min(F.struct((-F.col("doc_id")).alias("id"), F.col("_th").alias("th"))).alias("_head")), "heads")
    down = Window.orderBy(F.col("_range").desc())  # a row a range
    before = F.coalesce(F.lag("_range").over(down), F.min("_range").over(Window.partitionBy()))
    heads = keep(heads.select("_range", before.alias("_to"), F.col("_head.th").alias("_hth"), (-F.col("_head.id")).alias("_hid")), "heads")
    first = docs.join(F.broadcast(heads) if heads.count() <= 200_000 else heads, ["_range"]).filter((F.col("_th") == F.col("_hth")) & F.col("doc_id").eqNullSafe(F.col("_hid")))
    first = first.groupBy("_to").agg(F.min("text").alias("text"))
    edge = keep(with_lanes(first, F.col("text"), "_edge_lanes").select(F.col("_to").alias("_range"), F.col("text").alias("_edge_text"), "_edge_lanes"), "edges")

    inside = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), "_th", "text")
    head = lambda c: F.lead(c).over(inside)
    found = with_lanes(docs, F.col("text"), "_lanes").withColumns({"_next_text": head("text"), "_next_lanes": head("_lanes"), "_last": F.lead(F.lit(1)).over(inside).isNull()})
    found = found.join(edge, "_range", "left")
    cut = F.floor(F.length("text") / 3).cast("int")
    following = F.when(F.col("_last"), F.col("_edge_text")).otherwise(F.col("_next_text"))
    out = found.select(
        "doc_id", "_lanes", F.length("text").cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(following, F.lit(1), cut)).alias("_edited"),
        F.when(F.col("_last"), F.col("_edge_lanes")).otherwise(F.col("_next_lanes")).alias("_follow"),
    )
    out = with_lanes(out, F.col("_edited"), "_edited_lanes")
    return out.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), encode(F.col("_lanes")).alias("fingerprint"), encode(F.col("_edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("_lanes"), F.col("_edited_lanes")).alias("near_edited"), likeness(F.col("_lanes"), F.col("_follow")).alias("near_next"),
    )
