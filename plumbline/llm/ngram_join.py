"""N-gram Jaccard join by parity sketches.

A text's set holds its distinct shingles of five words. Its sketch has C cells for its size band; every
shingle XORs its hash into one cell, so each shingle of the symmetric difference changes one cell at most, and two
sets with difference d differ in at most d cells. A link needs d <= (|A| + |B|) / 7 =: D. By the pigeonhole
principle a linked pair shares one of the first D + 1 filled cells of either side, in any cell order that both use. These
cells are the join keys; a set emits them for its size band and for the next band if partners reach into it.

Candidates are pruned by a bit sketch (parities of SKETCH_BITS hashed bits: its Hamming distance, too, is a lower bound of d) and verified
on their whole sets of shingles, told apart by a second, independent hash of 64 bits over whole words. Sets count as equal by both hashes, 128 bits.

Equal sets are collapsed first. Keys of up to ``most`` sets give all their pairs. More crowded keys are
demoted: the sets that hold them choose their D + 1 cells anew, demoted cells last, which keeps the guarantee for pairs of such sets
(a linked pair that met in a crowded key has both its sets chosen anew). What is crowded after ``levels`` rounds, groups of near copies above all, is compared
with hubs, the first set of each key: a set meets the hub that shares most of its keys. As only components are asked for, sets whose keys still hold
several components afterwards are joined once more, now on shingles instead of cells: with crowded shingles last, a linked pair A, B (|A| <= |B|)
shares one of the first |A| / 7 + 1 of A and |B| / 4 + 1 of B, and enough of both sets comes from there on. This is exact, whatever their number.

Defined cases: a null, empty or blank text has the empty set and is linked with nothing; a text of one to four
words is one shingle; rows with a null id get no component; rows that share an id are one document with the links of either; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BASES, chunks, connected_components, discard, keep, mix, plain, rolling, sequence_hash, signed, small_side, tidy, word_hashes

#: Upper bounds of size bands; the cells of a band are four times its bound.
BANDS = np.array([4, 64, 1024, 16384, 262144, 4194304, 67108864, 1073741824], np.int64)
SKETCH_BITS = 2048
#: Bits of the table of demoted keys, and the keys that go into it at most (the most crowded).
DEMOTED_BITS, DEMOTED_KEYS = 1 << 24, 1 << 20
#: References that sets are compared with at most, and their shingles in all.
FAMILIES, FAMILY_KEYS = 1 << 10, 1 << 20


def shingle_sets(texts: list[bytes], n: int, kinds: tuple[int, ...] = (0,)) -> list[tuple[np.ndarray, ...]]:
    """Distinct 64-bit shingle hashes of each text, sorted by the first kind; other kinds hash the same shingles apart from it."""
    sizes, *one, begin = word_hashes(texts, lower=True, kinds=kinds)
    windows = [rolling(h, n, BASES[k]) for h, k in zip(one, kinds, strict=True)]
    out = []
    for k, size in enumerate(sizes.tolist()):
        at = int(begin[k])
        if size >= n:
            first = windows[0][at : at + size - n + 1]
            order = np.argsort(first) if len(kinds) > 1 else None
            h = first[order] if len(kinds) > 1 else np.sort(first)
            new = np.concatenate(([True], h[1:] != h[:-1]))
            out.append((h[new], *[w[at : at + size - n + 1][order[new]] for w in windows[1:]]))
        else:
            out.append(tuple(sequence_hash(h[at : at + size], np.array([0, size]), BASES[1 - c])[: min(size, 1)] for h, c in zip(one, kinds, strict=True)))
    return out


def set_hash(h: np.ndarray) -> int:
    """64 bits of a set; with the sets of both kinds, 128."""
    return int(mix(h).sum(dtype=np.uint64).astype(np.int64))


def band_keys(h: np.ndarray, band: int) -> np.ndarray:
    """Keys of the filled cells of one sorted set, in cell order."""
    shift = np.uint64(64 - int(BANDS[band]).bit_length() - 1)
    cell = h >> shift
    begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    word = np.bitwise_xor.reduceat(h, begin)
    with np.errstate(over="ignore"):
        return mix(mix(word) ^ mix(cell[begin] * BASES[0] + np.uint64(band + 1) * BASES[1]))


def prefix_keys(h: np.ndarray, demoted: np.ndarray | None = None) -> np.ndarray:
    """The D + 1 keys of one sorted set for each band where it can have partners."""
    n = len(h)
    own = int(np.searchsorted(BANDS, n, "right"))
    out = []
    for band, most in ((own, min(int(BANDS[own]) - 1, 4 * n // 3)), (own + 1, 4 * n // 3)):
        if band > own and 3 * int(BANDS[own]) > 4 * n:
            break
        keys = band_keys(h, band)
        if demoted is not None:
            late = is_demoted(keys, demoted)
            keys = np.concatenate((keys[~late], keys[late]))
        out.append(keys[: (n + most) // 7 + 1])
    return np.concatenate(out)


def is_demoted(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = keys % np.uint64(DEMOTED_BITS)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_sketch(h: np.ndarray) -> bytes:
    odd = np.bincount((h % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def set_table(df: DataFrame, n: int, demoted: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, n_shingles, s1, s2, keys)``: size, 128-bit hash and join keys of each row's set."""
    shared = df.sparkSession.sparkContext.broadcast(demoted)  # DEMOTED_BITS or nothing

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        demoted = shared.value
        for batch in batches:
            for i, j, texts in chunks(batch.column(1)):
                both = shingle_sets(texts, n, (0, 1))
                sets, hashes = [h for h, _ in both], [(set_hash(h), set_hash(g)) for h, g in both]
                keys = [signed(prefix_keys(h, demoted)) if len(h) else np.empty(0, np.int64) for h in sets]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
                columns = [batch.column(0)[i:j], pa.array([len(h) for h in sets], pa.int64()), *[pa.array([h[c] for h in hashes], pa.int64()) for c in (0, 1)]]
                yield pa.record_batch([*columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))], ["doc_id", "n_shingles", "s1", "s2", "keys"])

    return df.mapInArrow(tidy(build), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, keys array<bigint>")


def repeated(keys: DataFrame) -> DataFrame:
    """Rows of ``(key, doc)`` whose key another row has too: one shuffle and sort, then neighbours are compared as they stream by."""

    def neighbours(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, doc, same = np.empty(0, np.int64), np.empty(0, np.int64), False
        for batch in batches:
            key, doc = np.concatenate((key, batch.column(0).to_numpy())), np.concatenate((doc, batch.column(1).to_numpy()))
            equal = np.concatenate(([same], key[1:] == key[:-1]))
            found = equal.copy()
            found[:-1] |= equal[1:]
            if found[:-1].any():
                yield pa.record_batch([pa.array(key[:-1][found[:-1]]), pa.array(doc[:-1][found[:-1]])], ["key", "doc"])
            key, doc, same = key[-1:], doc[-1:], bool(equal[-1]) if len(equal) else False
        if same and len(key):
            yield pa.record_batch([pa.array(key), pa.array(doc)], ["key", "doc"])

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(neighbours), "key bigint, doc bigint")


def candidates(df: DataFrame, n: int, whole: bool) -> DataFrame:
    """``(doc, size, data)`` of candidate documents: their bit sketch, or with ``whole`` their shingles, by the hash that keys and sketches do not use."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, j, texts in chunks(batch.column(1)):
                sets = [h for (h,) in shingle_sets(texts, n, (int(whole),))]
                if whole:
                    data = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(signed(np.concatenate(sets))))
                else:
                    data = pa.array([bit_sketch(h) for h in sets], pa.binary())
                yield pa.record_batch([batch.column(0)[i:j], pa.array([len(h) for h in sets], pa.int64()), data], ["doc", "size", "data"])

    return df.mapInArrow(tidy(build), f"doc bigint, size bigint, data {'array<bigint>' if whole else 'binary'}")


def prefixes(df: DataFrame, n: int, demoted: np.ndarray | None = None, refs: tuple | None = None) -> DataFrame:
    """``(doc, part, size, keys, ref, delta)`` of ``df(doc_id, text, part)``: all shingle hashes of each text, or with a table of demoted ones the first that a partner must share.

    With ``refs`` (see ``references``) a text gets the reference that has most of its shingles, and the shingles that only one of the two has: those of the text
    that are not demoted first. A text from which no reference differs by less than its own size gets none.
    """
    shared = df.sparkSession.sparkContext.broadcast((demoted, refs))  # DEMOTED_BITS and FAMILY_KEYS, or nothing

    def differ(h: np.ndarray) -> tuple[int | None, np.ndarray]:
        demoted, (ids, sets, owned, owner) = shared.value
        at = np.minimum(np.searchsorted(owned, h), len(owned) - 1)
        held = owner[at[owned[at] == h]]
        if not len(held):
            return None, h[:0]
        best = int(np.bincount(held).argmax())
        more, less = np.setdiff1d(h, sets[best], True), np.setdiff1d(sets[best], h, True)
        if len(more) + len(less) >= len(h):
            return None, h[:0]
        late = is_demoted(more, demoted)
        return int(ids[best]), np.concatenate((more[~late], np.sort(np.concatenate((more[late], less)))))

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def lists(of: list[np.ndarray]):
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(k) for k in of]))).astype(np.int32)), pa.array(signed(np.concatenate(of))))

        demoted, refs = shared.value
        for batch in batches:
            for i, j, texts in chunks(batch.column(1)):
                sets = [h for (h,) in shingle_sets(texts, n)]
                keys = sets
                if demoted is not None:
                    keys = []
                    for h in sets:
                        late = is_demoted(h, demoted)
                        keys.append(np.concatenate((h[~late], h[late]))[: len(h) // 4 + 1])
                apart = [differ(h) if refs else (None, h[:0]) for h in sets]
                columns = [batch.column(0)[i:j], batch.column(2)[i:j], pa.array([len(h) for h in sets], pa.int64()), lists(keys), pa.array([r for r, _ in apart], pa.int64()), lists([d for _, d in apart])]
                yield pa.record_batch(columns, ["doc", "part", "size", "keys", "ref", "delta"])

    return df.mapInArrow(tidy(build), "doc bigint, part bigint, size bigint, keys array<bigint>, ref bigint, delta array<bigint>")


def references(held: DataFrame, n: int, top: np.ndarray, often: np.ndarray, most: int) -> tuple | None:
    """``(ids, sets, owned, owner)``: documents with much in common with many others, by falling number of those, their sets, and the first of them that has a shingle.

    Each text names four of its crowded shingles ``top`` (held by ``often`` texts); of the texts that name the same the one with most crowded and fewest other shingles
    is taken. There are FAMILIES with FAMILY_KEYS shingles in all at most; which are taken changes the work, never the links.
    """
    spark = held.sparkSession
    order = np.argsort(top)
    shared = spark.sparkContext.broadcast((top[order], often[order]))  # DEMOTED_KEYS at most

    def name(batches: Iterator) -> Iterator:
        import pyarrow as pa

        top, often = shared.value
        for batch in batches:
            for i, j, texts in chunks(batch.column(1)):
                out = []
                for doc, (h,) in zip(batch.column(0)[i:j].to_pylist(), shingle_sets(texts, n), strict=True):
                    at = np.minimum(np.searchsorted(top, signed(h)), len(top) - 1)
                    at = at[top[at] == signed(h)]
                    at = at[np.lexsort((at, -often[at]))]
                    out += [(int(top[at[k]]), 8 * len(at) - 7 * len(h), doc) for k in sorted({len(at) * q // 4 for q in range(4)}) if len(at)]
                yield pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["key", "score", "doc"])

    named = held.mapInArrow(tidy(name), "key bigint, score bigint, doc bigint").groupBy("key").agg(F.count("*").alias("docs"), F.max(F.struct("score", (-F.col("doc")).alias("doc"))).alias("best"))
    hubs = named.filter(F.col("docs") > most).groupBy((-F.col("best.doc")).alias("hub")).agg(F.max("docs").alias("docs")).orderBy(F.col("docs").desc(), "hub").limit(FAMILIES).toPandas()["hub"].tolist()
    sets = prefixes(held.filter(F.col("doc_id").isin(hubs)), n).select("doc", "size", "keys")
    sizes = dict(sets.select("doc", "size").collect())
    room = np.cumsum([sizes[d] for d in hubs]) <= FAMILY_KEYS
    hubs = [d for d, fits in zip(hubs, room, strict=True) if fits]
    if not hubs:
        return None
    found = {r["doc"]: np.sort(np.array(r["keys"], np.int64).view(np.uint64)) for r in sets.filter(F.col("doc").isin(hubs)).collect()}
    owned, first = np.unique(np.concatenate([found[d] for d in hubs]), return_index=True)
    return np.array(hubs), [found[d] for d in hubs], owned, np.repeat(np.arange(len(hubs)), [len(found[d]) for d in hubs])[first]


def prefix_table(docs: DataFrame, crowd: DataFrame, n: int, most: int, families: bool) -> DataFrame:
    """``prefixes`` of the documents of ``crowd(doc, part)``, shingles of more than ``most`` of them last, and ``w``: seven times the length of delta less the size."""
    held = docs.join(small_side(crowd), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "part")
    counts = prefixes(held, n).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("docs")).filter(F.col("docs") > most)
    top = counts.orderBy(F.col("docs").desc(), "key").limit(DEMOTED_KEYS).toPandas()
    keys = top["key"].to_numpy(np.int64)
    refs = references(held, n, keys, top["docs"].to_numpy(np.int64), most) if families and len(keys) else None
    return keep(prefixes(held, n, demote(keys, None), refs).withColumn("w", F.size("delta") * F.lit(7).cast("long") - F.col("size")), "prefixes")


def reference_links(table: DataFrame) -> DataFrame:
    """``(a, b)``: each document of ``prefix_table`` with the one nearest to its reference, if both are so near that they must be linked."""
    near = table.filter("ref is not null").groupBy("ref").agg(F.min(F.struct("w", "doc", "part")).alias("m"))
    both = table.join(F.broadcast(near), "ref").filter((F.col("w") + F.col("m.w") <= 0) & (F.col("part") != F.col("m.part")))
    return both.select(F.least("doc", "m.doc").alias("a"), F.greatest("doc", "m.doc").alias("b"))


def delta_pairs(table: DataFrame) -> DataFrame:
    """``(a, b)`` of documents with the same reference in different parts that may be linked, once ``reference_links`` are in one part.

    With deltas A and B to one reference the sets differ in |A| + |B| - 2 |A & B| shingles, so a link needs 14 |A & B| >= w(A) + w(B). For the nearest document m of a
    reference, all with w <= -w(m) are in its part, so that the sum is positive for any other pair, and it must share one of the first shingles of its deltas.
    """
    near = table.filter("ref is not null").groupBy("ref").agg(F.min(F.struct("w", "doc", "part")).alias("m"))
    far = table.join(F.broadcast(near), "ref").withColumn("far", F.col("part") != F.col("m.part"))
    least = far.filter("far").groupBy("ref").agg(F.min("w").alias("least"))
    bound = F.col("w") + F.when(F.col("far"), F.col("m.w")).otherwise(F.col("least"))
    reach = F.greatest(F.lit(0), F.size("delta") - F.ceil(bound / 14) + 1).cast("int")
    rows = far.join(F.broadcast(least), "ref").withColumn("delta_size", F.size("delta")).withColumn("first", F.slice("delta", F.lit(1), F.least(reach, F.size("delta"))))
    rows = keep(rows.select("ref", "far", "doc", "part", "w", "delta_size", F.posexplode("first").alias("at", "key")), "deltas")
    left, right = (rows.select("ref", "key", "far", F.struct("doc", "part", "w", (F.col("delta_size") - F.col("at")).alias("rest")).alias(c)) for c in "ab")
    room = F.least("a.rest", "b.rest") * 14 >= F.col("a.w") + F.col("b.w")
    both = left.filter("far").drop("far").join(right.drop("far"), ["ref", "key"]).filter(room & (F.col("a.part") != F.col("b.part")))
    return both.select(F.least("a.doc", "b.doc").alias("a"), F.greatest("a.doc", "b.doc").alias("b"))


def prefix_pairs(docs: DataFrame, crowd: DataFrame, n: int, most: int, table: DataFrame | None = None) -> DataFrame:
    """``(a, b)`` of documents of ``crowd(doc, part)`` in different parts that may be linked; with a ``table`` that has references, those with the same are left to ``delta_pairs``."""
    table = prefix_table(docs, crowd, n, most, families=False) if table is None else table
    rows = keep(table.select("doc", "part", "size", "ref", F.posexplode("keys").alias("at", "key")), "prefixes")
    # The documents of a key's most frequent reference are never compared with each other, so keys that no others hold go.
    held = rows.groupBy("key", "ref").agg(F.count("*").alias("_n")).groupBy("key")
    held = held.agg(F.sum("_n").alias("_all"), F.max(F.when(F.col("ref").isNotNull(), F.struct("_n", "ref"))).alias("_most"))
    held = held.filter((F.col("_all") > 1) & (F.col("_all") > F.coalesce("_most._n", F.lit(0)))).select("key", F.col("_most.ref").alias("_major"))
    rows = rows.join(held, "key").withColumn("stray", ~F.coalesce(F.col("ref") == F.col("_major"), F.lit(False)))
    left, right = (rows.select("key", "stray", F.struct("doc", "part", "size", "at", "ref").alias(c)) for c in "ab")
    left, stray = left.filter("a.at <= a.size div 7"), right.filter("stray").drop("stray")
    ordered = (F.col("a.size") < F.col("b.size")) | (F.col("a.size") == F.col("b.size")) & (F.col("a.doc") < F.col("b.doc"))
    # From the first shared shingle on, both must hold 3 / 7 of the sum of sizes.
    room = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) * 7 >= (F.col("a.size") + F.col("b.size")) * 3
    open_ = (F.col("a.part") != F.col("b.part")) & F.coalesce(F.col("a.ref") != F.col("b.ref"), F.lit(True))
    both = left.filter("stray").drop("stray").join(right.drop("stray"), "key").filter(ordered & room & open_)
    both = both.unionByName(left.filter("not stray").drop("stray").join(stray, "key").filter(ordered & room & open_))
    return both.select(F.least("a.doc", "b.doc").alias("a"), F.greatest("a.doc", "b.doc").alias("b"))


def nearest_hub(met: DataFrame) -> DataFrame:
    """``(a, b)``: each doc of ``met(doc, hub)`` with the hub that it meets in most keys, the smallest of equals."""
    often = met.groupBy("doc", "hub").agg(F.count("*").alias("_n"))
    best = often.groupBy("doc").agg(F.max(F.struct("_n", (-F.col("hub")).alias("_hub"))).alias("_best"))
    hub = -F.col("_best._hub")
    return best.select(F.least("doc", hub).alias("a"), F.greatest("doc", hub).alias("b")).distinct()


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.greatest(a, b) * 3 <= F.least(a, b) * 4


def verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The linked among ``pairs(a, b)``: sizes and sketches first, then shingles, of the documents in pairs."""

    used = []

    def beside(pairs: DataFrame, whole: bool) -> DataFrame:
        """``(a, b, a_data, b_data, a_size, b_size)``, with sizes that a link allows."""
        ends = keep(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "ends")
        held = keep(candidates(docs.join(small_side(ends), F.col("doc_id") == F.col("doc"), "left_semi"), n, whole), "candidates")
        used.extend((ends, held))
        side = lambda c: held.select(F.col("doc").alias(c), F.col("data").alias(f"{c}_data"), F.col("size").alias(f"{c}_size"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_sizes_fit(F.col("a_size"), F.col("b_size")))
        return both.select("a", "b", "a_data", "b_data", "a_size", "b_size")

    def close(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            b = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            # |A ∆ B| <= (1 - p) / (1 + p) (|A| + |B|) for a similarity of p
            yield batch.select([0, 1]).filter(pa.array(apart * (100 + percent) <= (100 - percent) * total))

    near = keep(beside(pairs, whole=False).mapInArrow(tidy(close), "a bigint, b bigint").distinct(), "near")
    # 100 |A ∩ B| >= p |A ∪ B|, one pair of sets at a time
    common = F.size(F.array_intersect("a_data", "b_data"))
    same = beside(near, whole=True).filter((common > 0) & (common * (100 + percent) >= (F.col("a_size") + F.col("b_size")) * percent))
    links = keep(same.select("a", "b").distinct(), "links")
    for table in (*used, near):
        discard(table)
    return links


def demote(keys: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    table = np.zeros(DEMOTED_BITS // 8, np.uint8) if table is None else table.copy()
    at = keys.view(np.uint64) % np.uint64(DEMOTED_BITS)
    np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return table


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, most: int = 8, levels: int = 2, rounds: int = 2) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``df``."""
    if percent != 75:
        raise ValueError("bands and prefixes are laid out for a similarity of 75 %")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = keep(set_table(docs, n), "sets")
    sets = keep(table.select("doc_id", "n_shingles", "s1", "s2"), "sets")
    filled = sets.filter("n_shingles > 0 and doc_id is not null")
    first = filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = keep(filled.join(first, ["s1", "s2"]).filter("doc_id <> first").select("doc_id", "s1", "first").distinct(), "later")
    links = later.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))

    def rows_of(sets: DataFrame) -> DataFrame:
        """Repeated ``(key, doc)`` of sets with keys, but for later copies of equal sets."""
        alone = sets.filter("n_shingles > 0 and doc_id is not null").join(small_side(later.select("doc_id", "s1")), ["doc_id", "s1"], "left_anti")
        return keep(repeated(alone.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"))).distinct(), "keys")

    def across(rows: DataFrame) -> DataFrame:
        left, right = (rows.select("key", F.col("doc").alias(c)) for c in "ab")
        return left.join(right, "key").filter("a < b").select("a", "b")

    rows, demoted, pairs, level = rows_of(table), None, None, 0
    discard(table)  # its keys are most of what is kept
    levels_kept = [rows]
    while True:
        counts = keep(rows.groupBy("key").agg(F.count("*").alias("docs")).filter("docs > 1"), "counts")
        levels_kept.append(counts)
        few = across(rows.join(counts.filter(F.col("docs") <= most), "key").select("key", "doc"))
        pairs = few if pairs is None else pairs.unionByName(few)
        crowded = counts.filter(F.col("docs") > most)
        top = crowded.orderBy(F.col("docs").desc(), "key").limit(DEMOTED_KEYS).select("key").toPandas()["key"].to_numpy(np.int64) if level < levels else []
        if not len(top):
            break
        level += 1
        demoted = demote(top, demoted)
        again = keep(rows.join(crowded, "key", "left_semi").select("doc").distinct(), "crowded")
        rows = rows_of(set_table(docs.join(small_side(again), F.col("doc_id") == F.col("doc"), "left_semi"), n, demoted))
        levels_kept.extend((again, rows))
    # Keys of the same documents, such as those of a passage, say the same: one of each kind stays.
    kinds = rows.join(crowded, "key", "left_semi").groupBy("key").agg(*[F.bit_xor(F.xxhash64(F.lit(i), "doc")).alias(f"_x{i}") for i in (0, 1)], F.count("*").alias("_n"))
    kinds = kinds.groupBy("_x0", "_x1", "_n").agg(F.min("key").alias("key")).select("key")
    rows = keep(rows.join(kinds, "key", "left_semi"), "crowd")  # groups of near copies, and sets made of little else than shared passages
    hubs = rows.groupBy("key").agg(F.min("doc").alias("hub"))
    pairs = pairs.unionByName(nearest_hub(rows.join(hubs, "key").filter("doc <> hub").select("doc", "hub")))
    pairs = keep(pairs.distinct(), "pairs")
    for kept in levels_kept:
        discard(kept)
    links = links.unionByName(verify(pairs, docs, n, percent))
    found, before = keep(connected_components(links), "parts"), None
    for turn in range(rounds + 1):
        rest = rows.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("part"))
        apart = rest.groupBy("key", "part").agg(F.count("*").alias("_n")).groupBy("key").agg(F.count("*").alias("_parts")).filter("_parts > 1").select("key")
        rest = keep(rest.join(apart, "key", "left_semi"), "open")
        held = rest.count()
        if not held:
            break
        last = turn == rounds or before is not None and held > 0.8 * before
        before = held
        if last:
            crowd = keep(rest.select("doc", "part").distinct(), "crowd")
            near = prefix_table(docs, crowd, n, most, families=True)
            more = keep(reference_links(near).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
            new = verify(more, docs, n, percent)
            if new.limit(1).count():
                links, pairs = links.unionByName(new), pairs.unionByName(more)
                found = keep(connected_components(links), "parts")
                near = near.drop("part").join(found, F.col("doc") == F.col("node"), "left").withColumn("part", F.coalesce("component", "doc")).drop("node", "component")
            more = prefix_pairs(docs, crowd, n, most, near).unionByName(delta_pairs(near))
        else:  # another hub of each key, from a component drawn by hash
            hubs = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "part").alias("h"), "part", "doc")).alias("hub"))
            more = nearest_hub(rest.join(hubs, "key").filter(F.col("part") != F.col("hub.part")).select("doc", F.col("hub.doc").alias("hub")))
        more = keep(more.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        new = verify(more, docs, n, percent)
        if new.limit(1).count():
            links, pairs = links.unionByName(new), pairs.unionByName(more)
            found = keep(connected_components(links), "parts")
        if last:
            break
    out = sets.join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` without the documents whose component has a smaller id; rows without an id stay."""
    rows, (doc, text) = plain(df, id_col, text_col)
    found = link(rows, doc, text, **how)
    gone = keep(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return rows.join(small_side(gone), F.col(doc) == F.col("gone"), "left_anti").toDF(*df.columns)
