"""Correlations with controls, resampling and false-discovery control.

Degenerate inputs give 0, as closed forms under a guard: no variance, no correlation. Resampling expands rows by replicate
and aggregates by replicate; draws and permutations come from md5 of (seed, replicate, index), so they are the same everywhere.
Inputs are narrow analysis tables, a row an item; each is written down once and read from there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import replicates as carried
from plumbline.operators.ranks import _beside, average_rank, numbered, with_ranks
from plumbline.sources.kept import keep


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pearson(x: Column | str, y: Column | str) -> Column:
    x, y = _c(x).cast("double"), _c(y).cast("double")
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(scale > 0, F.covar_pop(x, y) / F.when(scale > 0, scale)).otherwise(F.lit(0.0))


def partial(rxy: Column, rxz: Column, ryz: Column) -> Column:
    scale = F.sqrt(F.greatest(F.lit(0.0), (1 - rxz * rxz) * (1 - ryz * ryz)))
    return F.when(scale > 0, (rxy - rxz * ryz) / F.when(scale > 0, scale)).otherwise(F.lit(0.0))


def semipartial(rxy: Column, rxz: Column, ryz: Column) -> Column:
    scale = F.sqrt(F.greatest(F.lit(0.0), 1 - rxz * rxz))
    return F.when(scale > 0, (rxy - rxz * ryz) / F.when(scale > 0, scale)).otherwise(F.lit(0.0))


def partial_of(x: str, y: str, z: str) -> Column:
    """Partial correlation of x and y given z, of columns that are ranks already."""
    return partial(pearson(x, y), pearson(x, z), pearson(y, z))


def correlations(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: Pearson, Spearman, partial and semipartial Spearman given z, variance inflation and condition number of (x, z)."""
    ranked = with_ranks(keep(df.select(x, y, z), "analysis"), [x, y, z])
    one = ranked.agg(pearson(x, y).alias("pearson"), pearson(f"r_{x}", f"r_{y}").alias("spearman"), pearson(f"r_{x}", f"r_{z}").alias("rxz"), pearson(f"r_{y}", f"r_{z}").alias("ryz"), pearson(x, z).alias("pxz"))
    r, a = F.col("pxz"), F.abs("pxz")
    return one.select(
        "pearson", "spearman", partial(F.col("spearman"), F.col("rxz"), F.col("ryz")).alias("partial"), semipartial(F.col("spearman"), F.col("rxz"), F.col("ryz")).alias("semipartial"),
        F.when(a < 1, 1 / (1 - r * r)).alias("vif"), F.when(a < 1, F.sqrt((1 + a) / (1 - a))).alias("condition"),
    )


def balance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Concordant minus discordant pairs of weighted points, ties counting for nothing: halves in order of x are compared by binary search in y."""
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order].astype(float)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1, [len(x)]))

    def part(low: int, high: int) -> float:
        """Of the distinct x values from ``low`` to ``high``."""
        if high - low < 2:
            return 0.0
        middle = (low + high) // 2
        a, b, c = edges[low], edges[middle], edges[high]
        at = np.argsort(y[a:b], kind="stable")
        left, weight = y[a:b][at], np.concatenate(([0.0], np.cumsum(n[a:b][at])))
        below, upto = weight[np.searchsorted(left, y[b:c], "left")], weight[np.searchsorted(left, y[b:c], "right")]
        return part(low, middle) + part(middle, high) + float(n[b:c] @ (below - (weight[-1] - upto)))

    return part(0, len(edges) - 1)


def concordance(cells: DataFrame, by: list[str] | None = None, cells_a_range: int = 20_000) -> DataFrame:
    """``(by..., s)``: concordant minus discordant pairs of a kept table ``(by..., x, y, n)`` of distinct points and their numbers, without a join of points with points.

    Both axes are cut into ranges. Pairs that differ in both ranges are counted on the grid of ranges, which is small; pairs inside
    a strip of one x range or one y range are counted by merging, a strip a task, and those inside a box of both ranges are taken off once.
    """
    by = by or []
    largest = cells.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, min(1000, -(-largest // cells_a_range)))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = cells.groupBy(*by).agg(*[F.percentile_approx(c, shares, 10 * len(shares)).alias(f"_{c}") for c in "xy"])
    at = lambda c: F.size(F.filter(f"_{c}", lambda cut: cut < F.col(c))) if parts > 1 else F.lit(0)
    ranged = keep(_beside(cells, cuts, by, small=not by).select(*by, "x", "y", "n", at("x").alias("xr"), at("y").alias("yr")), "ranged")

    def within(*strip: str) -> DataFrame:
        merge = lambda p: p.iloc[:1][by].assign(s=balance(p["x"].to_numpy(), p["y"].to_numpy(), p["n"].to_numpy()))
        schema = ", ".join([*[f"{b} {cells.schema[b].dataType.simpleString()}" for b in by], "s double"])
        return ranged.groupBy(*by, *strip).applyInPandas(merge, schema)

    sums = within("xr")
    if parts > 1:
        grids: dict[tuple, np.ndarray] = {}
        for r in ranged.groupBy(*by, "xr", "yr").agg(F.sum("n")).collect():  # parts x parts a group at most
            grids.setdefault(tuple(r[: len(by)]), np.zeros((parts, parts)))[r[-3], r[-2]] = r[-1]
        rows = []
        for group, grid in grids.items():
            upto = np.zeros((parts + 1, parts + 1))
            upto[1:, 1:] = grid.cumsum(0).cumsum(1)
            rows.append((*group, float((grid * (upto[:-1, :-1] - (upto[:-1, -1:] - upto[:-1, 1:]))).sum())))
        across = cells.sparkSession.createDataFrame(rows, sums.schema)
        sums = sums.unionByName(across).unionByName(within("yr")).unionByName(within("xr", "yr").withColumn("s", -F.col("s")))
    return sums.groupBy(*by).agg(F.sum("s").alias("s"))


def _cells(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    held = df.filter(_c(x).isNotNull() & _c(y).isNotNull())
    return keep(held.groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n")), "cells")


def kendall(df: DataFrame, id_col: str, x: str, y: str, cells_a_range: int = 20_000) -> DataFrame:
    """``tau`` (b, tie-corrected)."""
    cells = _cells(df, x, y, [])
    ties = lambda c: cells.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"))
    one = cells.agg(F.sum("n").alias("m")).select((F.col("m") * (F.col("m") - 1) / 2).alias("all")).crossJoin(ties("x")).crossJoin(ties("y")).crossJoin(concordance(cells, None, cells_a_range))
    scale = F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty")))
    return one.select(F.when(scale > 0, F.coalesce("s", F.lit(0.0)) / F.when(scale > 0, scale)).otherwise(F.lit(0.0)).alias("tau"))


def ordered_pairs(df: DataFrame, id_col: str, y: str, by: list[str]) -> DataFrame:
    """``(by..., pairs, rising)``: pairs of rows in order of a numeric, unique id inside ``by``, and those whose y rises; no pair is made."""
    cells = _cells(df, id_col, y, by)
    ties = cells.groupBy(*by, "y").agg(F.sum("n").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("_tied"), F.sum("t").alias("_m"))
    one = _beside(ties, concordance(cells, by), by)
    pairs = F.col("_m") * (F.col("_m") - 1) / 2
    return one.select(*by, pairs.cast("long").alias("pairs"), ((pairs - F.col("_tied") + F.col("s")) / 2).cast("long").alias("rising"))


def benjamini_hochberg(df: DataFrame, p: str, name: str, alpha: float = 0.05) -> DataFrame:
    """Add ``q`` and ``reject``; tests are few, one row each."""
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(p, name))
    raw = df.withColumn("_raw", F.col(p) * F.count("*").over(every) / rank)
    back = Window.orderBy(F.col(p).desc(), F.col(name).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min("_raw").over(back)))).withColumn("reject", F.col("q") <= alpha).drop("_raw")


def bins(df: DataFrame, value: str, out: str = "bin", n: int = 10) -> DataFrame:
    """Bins of equal count by average rank: quantile edges of the ranks, so ties stay together."""
    ranked = keep(average_rank(df, value, "_rank"), "binned")
    edges = ranked.agg(F.percentile("_rank", [i / n for i in range(1, n)]).alias("_edges"))
    return ranked.crossJoin(F.broadcast(edges)).withColumn(out, F.size(F.filter("_edges", lambda e: e <= F.col("_rank")))).drop("_rank", "_edges")


def stratified_spearman(df: DataFrame, x: str, y: str, bin_col: str = "bin", least: int = 3) -> DataFrame:
    """Size-weighted mean of Spearman inside bins; small and constant bins do not count."""
    inside = with_ranks(df, [x, y], [bin_col]).groupBy(bin_col).agg(F.count("*").alias("n"), pearson(f"r_{x}", f"r_{y}").alias("rho"), (F.stddev_pop(F.col(f"r_{x}")) * F.stddev_pop(F.col(f"r_{y}"))).alias("_v"))
    good = inside.filter((F.col("n") >= least) & (F.col("_v") > 0))
    return good.agg(F.coalesce(F.sum(F.col("n") * F.col("rho")) / F.sum("n"), F.lit(0.0)).alias("rho"))


def _powers(z: Column) -> list[Column]:
    return [F.lit(1.0), z, z * z, z * z * z]


def cubic_residuals(df: DataFrame, ys: list[str], c: str, outs: list[str], by: list[str] | None = None) -> DataFrame:
    """Residuals of each y on 1, z, z^2, z^3 with z the standardised c (inside ``by``): two aggregates, then a projection.

    The 4 by 4 normal equations of each group are solved on the driver (groups are replicates, so their number is a parameter); directions that the data lack
    (constant c, few distinct values) count for nothing.
    """
    by = by or []
    df = keep(df, "fitted")
    moments = df.groupBy(*by).agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"))
    scaled = _beside(df, moments, by, small=True).withColumn("_z", (F.col(c) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))).drop("_m", "_s")
    powers = _powers(F.col("_z"))
    sums = [F.sum(p).alias(f"_z{k}") for k, p in enumerate([*powers, *[powers[3] * p for p in powers[1:]]])]
    got = scaled.groupBy(*by).agg(*sums, *[F.sum(p * F.col(y)).alias(f"_{k}_{j}") for k, y in enumerate(ys) for j, p in enumerate(powers)]).collect()
    rows = []
    for r in got:
        normal = np.array([[r[f"_z{i + j}"] or 0.0 for j in range(4)] for i in range(4)])
        inverse = np.linalg.pinv(normal, rcond=1e-12, hermitian=True)
        rows.append((*[r[b] for b in by], *[[float(v) for v in inverse @ np.array([r[f"_{k}_{j}"] or 0.0 for j in range(4)])] for k in range(len(ys))]))
    fields = [*[f"{b} {df.schema[b].dataType.simpleString()}" for b in by], *[f"_beta{k} array<double>" for k in range(len(ys))]]
    fits = df.sparkSession.createDataFrame(rows, ", ".join(fields))
    out = _beside(scaled, fits, by, small=True)
    fit = lambda k: sum((p * F.col(f"_beta{k}")[j] for j, p in enumerate(powers)), F.lit(0.0))
    return out.withColumns({o: F.col(y).cast("double") - fit(k) for k, (y, o) in enumerate(zip(ys, outs, strict=True))}).drop("_z", *[f"_beta{k}" for k in range(len(ys))])


def cubic_spearman(df: DataFrame, x: str, y: str, c: str, by: list[str] | None = None, digits: tuple[int, int] = (9, 9)) -> DataFrame:
    """``(by..., value)``: Spearman of the residuals of x and y on a cubic of c; residuals are rounded to ``digits`` before they are ranked, so that equal ones tie."""
    by = by or []
    e = cubic_residuals(df, [x, y], c, ["_e1", "_e2"], by).withColumns({f"_e{k}": F.round(f"_e{k}", d) for k, d in zip((1, 2), digits, strict=True)})
    return with_ranks(keep(e.select(*by, "_e1", "_e2"), "residuals"), ["_e1", "_e2"], by).groupBy(*by).agg(pearson("r__e1", "r__e2").alias("value"))


def mediation(df: DataFrame, d: str, m: str, y: str) -> DataFrame:
    """``(a, b, direct, indirect, total, prop_mediated)`` on ranks, from three correlations."""
    r = with_ranks(keep(df.select(d, m, y), "analysis"), [d, m, y]).agg(pearson(f"r_{d}", f"r_{m}").alias("a"), pearson(f"r_{d}", f"r_{y}").alias("dy"), pearson(f"r_{m}", f"r_{y}").alias("my"))
    a, dy, my = F.col("a"), F.col("dy"), F.col("my")
    free = 1 - a * a
    singular = free <= 1e-12
    direct = F.when(singular, dy / 2).otherwise((dy - a * my) / F.when(singular, F.lit(1.0)).otherwise(free))
    b = F.when(singular, dy / 2 * F.signum(a)).otherwise((my - a * dy) / F.when(singular, F.lit(1.0)).otherwise(free))
    one = r.select("a", b.alias("b"), direct.alias("direct"))
    one = one.withColumn("indirect", F.col("a") * F.col("b")).withColumn("total", F.col("direct") + F.col("indirect"))
    return one.withColumn("prop_mediated", F.when(F.abs("total") > 1e-9, F.col("indirect") / F.when(F.abs("total") > 1e-9, F.col("total"))).otherwise(F.lit(float("nan"))))


def indexed(df: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """Add ``i`` from 0 in the order of a numeric column, and write the table down: draws and permutations refer to it."""
    return keep(numbered(keep(df, "items"), order, "i", by), "indexed")


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def permuted(df: DataFrame, columns: str | list[str], replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """``df`` (with ``i``) for each replicate ``r``, ``columns`` permuted together (inside ``by``).

    A row takes the place of its hash among its replicate's; places are counted by the hash's first two digits first and inside them then, so a replicate is never in one task.
    """
    by, columns = by or [], [columns] if isinstance(columns, str) else columns
    own = numbered(df, "i", "_at", by) if by else df.withColumn("_at", F.col("i").cast("long"))
    many = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    right = df.select(*by, "i", *columns, many.alias("r")).withColumn("_h", _hash(seed, F.col("r"), F.col("i"))).withColumn("_two", F.substring("_h", 1, 2))
    before = Window.partitionBy("r", *by).orderBy("_two").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    base = right.groupBy("r", *by, "_two").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("r", *by, "_two").orderBy("_h", "i")) - 1
    right = _beside(right.withColumn("_inside", inside), base, ["r", *by, "_two"]).select("r", *by, *columns, (F.col("_base") + F.col("_inside")).alias("_at"))
    return own.drop(*columns).join(right, [*by, "_at"]).drop("_at")


def resampled(df: DataFrame, replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Rows drawn with replacement, as many as there are (inside ``by``), for each replicate ``r``; ``df`` has ``i`` from 0 inside ``by``."""
    by = by or []
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    own = df.select(*by, F.col("i").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))  # draw j of a replicate is made where row j lies
    draws = _beside(own, sizes, by, small=True)
    pick = F.conv(F.substring(_hash(seed, *[F.col(b) for b in by], F.col("r"), F.col("_j")), 1, 8), 16, 10).cast("long") % F.col("_n")
    return draws.select("r", *by, pick.alias("i")).join(df, [*by, "i"])


def interval(stats: DataFrame, value: str, level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """Percentile interval over replicates."""
    tail = (1 - level) / 2
    return stats.groupBy(*(by or [])).agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def p_value(observed: DataFrame, null: DataFrame, value: str, two_sided: bool = True, tolerance: float = 1e-12, by: list[str] | None = None) -> DataFrame:
    """``(by..., observed, p)``: one row each side; the observed value counts as one replicate."""
    by = by or []
    one = _beside(null, observed.select(*by, F.col(value).alias("_seen")), by, small=True)
    as_far = (F.abs(value) >= F.abs("_seen") - tolerance) if two_sided else (F.col(value) >= F.col("_seen") - tolerance)
    return one.groupBy(*by).agg(F.first("_seen").alias("observed"), ((1 + F.sum(as_far.cast("int"))) / (F.count("*") + 1)).alias("p"))


def bootstrap(df: DataFrame, stat: Callable[[DataFrame], DataFrame], replicates: int, seed: int, by: list[str] | None = None, order: str | None = None, measure: Callable | None = None) -> DataFrame:
    """Interval of any statistic: ``stat`` maps rows with ``r`` to ``(r, value)``; ``measure`` is the same of arrays, for items that a task can hold."""
    items, columns = indexed(df, order or df.columns[0], by), [c for c in df.columns if c != order]
    if measure is not None and len(by or []) < 2 and carried.fits(items, columns, by[0] if by else None):
        return interval(carried.draws(items, columns, replicates, seed, measure, [()], by=by[0] if by else None), "value")
    return interval(stat(keep(resampled(items, replicates, seed, by), "resampled")), "value")


def null_of(items: DataFrame, column: str, columns: list[str], stat: Callable[[DataFrame], DataFrame], measure: Callable, replicates: int, seed: int, by: str | None = None) -> DataFrame:
    """``(r, value)`` under permutations of a column of an indexed table, by arrays where a task can hold ``columns``, else by joins."""
    if carried.fits(items, [column, *columns], by):
        return carried.permutations(items, column, columns, replicates, seed, measure, [()], by=by)
    return stat(permuted(items, column, replicates, seed, [by] if by else None))


def cubic_permutation(df: DataFrame, x: str, y: str, c: str, replicates: int, seed: int, order: str, digits: tuple[int, int] = (9, 9)) -> DataFrame:
    """``(observed, p)`` of ``cubic_spearman``: y is permuted over the items, and its cubic is fitted again, for every replicate."""
    a = indexed(df.select(order, x, y, c), order)
    null = null_of(a, y, [x, c], lambda rows: cubic_spearman(rows, x, y, c, ["r"], digits), carried.permuted_cubic([x], c, digits), replicates, seed)
    return p_value(cubic_spearman(a, x, y, c, None, digits), null, "value")
