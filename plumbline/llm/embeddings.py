"""Embedding near-dedup with spherical-cap filters.

A filter is a direction made of one code vector for each half of the dimensions (a random product code), so the
products of a vector with all K^2 directions are sums of 2 K products. Each vector is decoded to the list of
filters that it exceeds: only code vectors good enough to be part of one are combined, never all K^2. The bound rises with K so that a vector exceeds FILTERS of them on average,
wherever it lies, and K rises with the number of vectors so that a filter holds about ROWS_A_FILTER of them; at least a vector's ``least`` best filters count. Vectors are joined on (label, filter) and verified in
double precision; a pair counts at the smallest filter it shares. Equal vectors are collapsed first and count with their number.

A crowded filter's vectors are cut into blocks that meet two at a time, so that no task holds a whole filter; a pair of blocks gives one
row of counts a vector and a spanning forest of its links, never a row a pair. Vectors travel once, in their own precision, with each of their filters.

Recall is not 1: at a cosine of exactly 0.98, the bound, no pair of 15,000 was missed in 64 and 384 dimensions at K from 32 to 512, and one of 600 at K = 2048 (64 dimensions, 14 least filters, that is some 80 million vectors); closer pairs are safer. All pairs found are exact.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null label or id link with
nothing; vectors of different lengths do not link; rows that share an id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import connected_components, discard, keep, small_side, tidy

#: Filters of a vector on average, and vectors of a filter, where vectors lie evenly.
FILTERS, ROWS_A_FILTER = 20, 400
#: Rows of a block at most, and numbers of its vectors.
BLOCK_ROWS, BLOCK_NUMBERS = 4000, 1 << 22
#: Rows of one block that are compared with the other at a time.
TILE = 500


def code_size(vectors: int) -> int:
    """K, so that K^2 filters of ROWS_A_FILTER rows hold FILTERS copies of the vectors."""
    return max(32, int(np.ceil(np.sqrt(vectors * FILTERS / ROWS_A_FILTER))))


def codes(dimensions: int, size: int, seed: int) -> list[np.ndarray]:
    """Distinct unit code vectors of both halves of the dimensions (fewer than ``size`` where there is one dimension or none)."""
    rng = np.random.default_rng([seed, dimensions])
    half = dimensions // 2
    out = [rng.normal(size=(size, n)) for n in (half, dimensions - half)]
    return [np.unique(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300), axis=0) if c.shape[1] else c[:1] for c in out]


def decode(unit: np.ndarray, size: int, seed: int, filters: float = FILTERS, least: int = 18) -> list[np.ndarray]:
    """Sorted filter numbers of each row of unit vectors."""
    one, two = codes(unit.shape[1], size, seed)
    half, wide = one.shape[1], len(two)
    a, b = unit[:, :half] @ one.T, unit[:, half:] @ two.T
    top = lambda x: -np.sort(-x, 1)[:, :least]
    # The sum of two halves varies by 2 / dimensions; the least best sums are among sums of the best of both halves.
    bound = NormalDist().inv_cdf(1 - min(0.5, filters / (len(one) * wide))) * np.sqrt(2 / unit.shape[1])
    best = (top(a)[:, :, None] + top(b)[:, None, :]).reshape(len(unit), -1)
    best.sort(1)
    bound = np.minimum(bound, best[:, -min(least, best.shape[1])])
    out = []
    for x, y, t in zip(a, b, bound, strict=True):
        i, j = np.flatnonzero(x + y.max() >= t), np.flatnonzero(y + x.max() >= t)
        k, m = np.nonzero(x[i][:, None] + y[j] >= t)
        out.append(i[k] * wide + j[m])
    return out


def unit_rows(exact: np.ndarray) -> np.ndarray:
    scaled = exact / np.abs(exact).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _filters(vectors: DataFrame, size: int, seed: int, slim: bool) -> DataFrame:
    """``(label, dims, filter, node, copies, vector, filters)``, a row for each filter of a vector; ``slim`` leaves out what follows the filter."""
    wide = vectors.schema["vector"].dataType.elementType.simpleString() != "float"

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            label, node, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            raw = [np.asarray(v, np.float64) for v in batch.column(3).to_pylist()]
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by_size.setdefault(len(v), []).append(i)
            for dims, rows in by_size.items():
                for part in np.array_split(np.array(rows), -(-len(rows) * max(dims, size) // (1 << 19))):
                    exact = np.stack([raw[i] for i in part])
                    found = decode(unit_rows(exact), size, seed)
                    again = np.repeat(np.arange(len(part)), [len(f) for f in found])
                    columns = [pa.array(label[part][again]), pa.array(np.full(len(again), dims, np.int32)), pa.array(np.concatenate(found).astype(np.int64))]
                    if not slim:
                        packed, lists = [v.astype(np.float64 if wide else np.float32).tobytes() for v in exact], [f.astype(np.int64).tobytes() for f in found]
                        columns += [pa.array(node[part][again]), pa.array(copies[part][again]), pa.array([packed[i] for i in again], pa.binary()), pa.array([lists[i] for i in again], pa.binary())]
                    yield pa.record_batch(columns, ["label", "dims", "filter", "node", "copies", "vector", "filters"][: len(columns)])

    schema = f"label {vectors.schema['label'].dataType.simpleString()}, dims int, filter bigint" + ("" if slim else ", node bigint, copies bigint, vector binary, filters binary")
    return vectors.select("label", "node", "copies", "vector").mapInArrow(tidy(build), schema)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable over edges."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _pair_block(block: dict[str, list], threshold: float, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(node, links counted here, a node it is tied to)`` of one pair of blocks of one filter."""
    unit = unit_rows(np.frombuffer(b"".join(block["vector"]), np.float64 if wide else np.float32).reshape(len(block["vector"]), -1).astype(np.float64))
    node, copies, side = (np.array(block[c]) for c in ("node", "copies", "side"))
    lists, here = [np.frombuffer(f, np.int64) for f in block["filters"]], block["filter"][0]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(node)),) * 2
    links, ends = np.zeros(len(node), np.int64), ([], [])
    for at in range(0, len(left), TILE):
        rows = left[at : at + TILE]
        close = unit[rows] @ unit[right].T >= threshold
        if left is right:
            close &= rows[:, None] < right
        i, j = close.any(1), close.any(0)
        if not i.any():
            continue
        rows, columns, close = rows[i], right[j], close[i][:, j]
        # A pair that shares a smaller filter is counted there.
        earlier = [[lists[x][lists[x] < here] for x in half] for half in (rows, columns)]
        known = np.intersect1d(np.concatenate(earlier[0]), np.concatenate(earlier[1]))
        for part in np.array_split(known, -(-len(known) // 1024)) if len(known) else ():
            held = []
            for side_lists in earlier:
                owner, value = np.repeat(np.arange(len(side_lists)), [len(f) for f in side_lists]), np.concatenate(side_lists)
                place = np.minimum(np.searchsorted(part, value), len(part) - 1)
                ok = part[place] == value
                has = np.zeros((len(side_lists), len(part)), np.float32)
                has[owner[ok], place[ok]] = 1
                held.append(has)
            close &= held[0] @ held[1].T == 0
        links[rows] += (close @ copies[columns].astype(float)).astype(np.int64)
        links[columns] += (copies[rows].astype(float) @ close).astype(np.int64)
        # A forest of the tile: the least row of each column, and the least column of each row.
        some = close.any(0)
        ends[0].append(rows[close.argmax(0)[some]])
        ends[1].append(columns[some])
        some = close.any(1)
        ends[0].append(rows[some])
        ends[1].append(columns[close.argmax(1)[some]])
        rest = close & (np.arange(len(rows))[:, None] != close.argmax(0)) & (np.arange(len(columns)) != close.argmax(1)[:, None])
        tied = _roots(np.concatenate(ends[0]), np.concatenate(ends[1]), len(node))
        k, m = np.nonzero(rest & (tied[rows][:, None] != tied[columns]))  # links that the forest does not hold yet
        ends[0].append(rows[k])
        ends[1].append(columns[m])
    root = _roots(*[np.concatenate(e) if e else np.empty(0, np.int64) for e in ends], len(node))
    used = (links > 0) | (root != np.arange(len(node)))
    return node[used], links[used], node[root[used]]


def _join(vectors: DataFrame, size: int, seed: int, threshold: float) -> DataFrame:
    """``(node, links, tied)`` over all filters; rows of a pair of blocks stream by in sorted order."""
    own = ["label", "dims", "filter"]
    rows_a_block = F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dims")) + 1)
    sizes = _filters(vectors, size, seed, slim=True).groupBy(*own).agg(F.count("*").alias("_n"))
    crowded = keep(sizes.withColumn("_blocks", F.ceil(F.col("_n") / rows_a_block).cast("int")).filter("_blocks > 1").drop("_n"), "crowded")
    cut = _filters(vectors, size, seed, slim=False).join(small_side(crowded), own, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cut = cut.withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other")).withColumn("side", F.when((F.col("low") != F.col("high")) & (F.col("_own") == F.col("high")), 1).otherwise(0))
    keys = [*own, "low", "high"]
    cut = cut.select(*keys, "node", "copies", "vector", "filters", "side").repartition(*keys).sortWithinPartitions(*keys)
    wide = vectors.schema["vector"].dataType.elementType.simpleString() != "float"

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, held_key = None, None

        def done(block):
            node, links, tied = _pair_block(block, threshold, wide)
            return pa.record_batch([pa.array(node), pa.array(links), pa.array(tied)], ["node", "links", "tied"])

        for batch in batches:
            rows = batch.to_pydict()
            names = list(zip(*[rows[k] for k in keys], strict=True))
            at = 0
            while at < len(names):
                upto = at + 1
                while upto < len(names) and names[upto] == names[at]:
                    upto += 1
                part = {k: v[at:upto] for k, v in rows.items()}
                if held is not None and names[at] == held_key:
                    held = {k: held[k] + part[k] for k in held}
                else:
                    if held is not None and len(held["node"]) > 1:
                        yield done(held)
                    held, held_key = part, names[at]
                at = upto
        if held is not None and len(held["node"]) > 1:
            yield done(held)

    return cut.mapInArrow(tidy(meet), "node bigint, links bigint, tied bigint")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, seed: int = 5) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    number = F.size("vector") > 0
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & number & finite)
    good = good.withColumn("v1", F.xxhash64("vector")).withColumn("v2", F.xxhash64(F.lit(1), "vector", F.lit(2)))
    nodes = keep(good.groupBy("label", "v1", "v2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.min("vector").alias("vector")), "nodes")
    met = keep(_join(nodes, code_size(nodes.count()), seed, threshold), "met")
    counts = met.groupBy("node").agg(F.sum("links").alias("_links"))
    found = connected_components(met.select(F.col("node").alias("a"), F.col("tied").alias("b")))
    whole = nodes.join(counts, "node", "left").join(found, "node", "left")
    whole = whole.select("label", "v1", "v2", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = good.select("vec_id", "label", "v1", "v2").join(whole, ["label", "v1", "v2"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
