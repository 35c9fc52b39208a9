"""Average ranks, ROC curves and what follows from them, without a window over all rows.

Rows are first counted by distinct value, and the counts are written down: ranking a column reads its table once, and several
columns are ranked from one pass. Running counts over the values are built in two levels, also inside each group: values are cut into
ranges at approximate quantiles, ranges are summed, and each range runs its own window. Only the ranges' totals of a group meet in one task
(or all of a group that has few distinct values by count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.kept import keep

#: Distinct values of a group up to which they are one window, and the ranges that those of larger groups are cut into.
ONE_WINDOW, RANGES = 10_000, 64


def _beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal ``by``, where null equals null; the columns of ``left``, then the others of ``right``."""
    other = right.withColumnsRenamed({b: f"_of_{b}" for b in by})
    if small:
        other = F.broadcast(other)
    if not by:
        return left.crossJoin(other)
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    return left.join(other, same, how).drop(*[f"_of_{b}" for b in by])


def running(counts: DataFrame, value: str, sums: list[str], by: list[str], descending: bool = False) -> DataFrame:
    """Add ``<sum>_upto``: sums over this and all values before it, of rows with the same ``by``; ``counts`` has a row a distinct number."""
    counts = keep(counts, "counts")
    largest = counts.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= ONE_WINDOW:
        whole = Window.partitionBy(*by).orderBy(F.col(value).desc() if descending else F.col(value).asc()).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({f"{s}_upto": F.sum(s).over(whole) for s in sums})
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts"))
    at = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ranged = keep(_beside(counts, cuts, by, small=not by).withColumn("_range", at).drop("_cuts"), "ranged")
    total = ranged.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    before = Window.partitionBy(*by).orderBy(F.col("_range").desc() if descending else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(*by, "_range", *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_base") for s in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(F.col(value).desc() if descending else F.col(value).asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = _beside(ranged, base, [*by, "_range"], small=not by)
    return out.withColumns({f"{s}_upto": F.sum(s).over(inside) + F.col(f"_{s}_base") for s in sums}).select(*counts.columns, *[f"{s}_upto" for s in sums])


def ranks_of(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., name, value, rank)``: 1-based ranks of the distinct values of each column, all counted in one pass; ties share their mean. Nulls have no rank."""
    by = by or []
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(*by, pairs.alias("p")).select(*by, "p.*").filter("value is not null").groupBy(*by, "name", "value").agg(F.count("*").alias("_n"))
    run = running(counts, "value", ["_n"], [*by, "name"])
    return run.select(*by, "name", "value", (F.col("_n_upto") - (F.col("_n") - 1) / 2).alias("rank"))


def with_ranks(df: DataFrame, columns: list[str], by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Add ``r_<column>`` (or ``names``) for each numeric column, ranked inside ``by``. ``df`` is read twice, however many columns there are."""
    by, names = by or [], names or [f"r_{c}" for c in columns]
    table = keep(ranks_of(df, columns, by), "ranks")
    for c, out in zip(columns, names, strict=True):
        one = table.filter(F.col("name") == c).select(*[F.col(b).alias(f"_b_{b}") for b in by], F.col("value").alias("_v"), F.col("rank").alias(out))
        same = F.col(c).cast("double") == F.col("_v")
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
        df = df.join(one, same, "left").drop("_v", *[f"_b_{b}" for b in by])
    return df


def average_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Add 1-based ranks; ties share their mean."""
    return with_ranks(df, [value], by, [out]).filter(F.col(out).isNotNull())


def numbered(df: DataFrame, order: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Add ``out``, counting from 0 in the order of a numeric column (inside ``by``); rows that tie have numbers of their own, in any order."""
    by = by or []
    first = running(df.groupBy(*by, order).agg(F.count("*").alias("_n")), order, ["_n"], by).select(*by, order, (F.col("_n_upto") - F.col("_n")).alias("_first"))
    tied = F.row_number().over(Window.partitionBy(*by, order).orderBy(F.lit(0))) - 1
    return _beside(df.withColumn("_tied", tied), first, [*by, order]).withColumn(out, (F.col("_first") + F.col("_tied")).cast("long")).drop("_first", "_tied")


def _class_counts(df: DataFrame, score: str, label: str, by: list[str], out: str) -> DataFrame:
    return df.groupBy(*by, F.col(score).alias(out)).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))


def roc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """``(threshold, tp, fp, tpr, fpr)`` at each distinct score from above, and the point (0, 0) at infinity."""
    return _roc(keep(_class_counts(df, score, label, by or [], "threshold"), "classes"), by or [])


def _roc(counts: DataFrame, by: list[str]) -> DataFrame:
    total = counts.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    run = _beside(running(counts, "threshold", ["p", "n"], by, descending=True), total, by, small=not by)
    curve = run.select(*by, "threshold", F.col("p_upto").alias("tp"), F.col("n_upto").alias("fp"), "pos", "neg")
    start = total.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "pos", "neg")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return curve.unionByName(start).select(*by, F.col("threshold").cast("double").alias("threshold"), "tp", "fp", ratio("tp", "pos").alias("tpr"), ratio("fp", "neg").alias("fpr"))


def report(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """``(auc, tpr_at_0p1, tpr_at_1, n_pos, n_neg)``; null where a class is absent."""
    by = by or []
    classes = keep(_class_counts(df, score, label, by, "threshold"), "classes")
    counts = running(classes, "threshold", ["n"], by)
    # Mann-Whitney: negatives below a positive count 1, tied ones one half.
    auc = counts.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("n_upto") - F.col("n") / 2)).alias("_u"))
    auc = auc.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg")))).drop("_u")
    at = _roc(classes, by).groupBy(*by).agg(tpr_at(0.001).alias("tpr_at_0p1"), tpr_at(0.01).alias("tpr_at_1"))
    return _beside(auc, at, by, small=not by).select(*by, "auc", "tpr_at_0p1", "tpr_at_1", "n_pos", "n_neg")


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """``(by..., auc)`` alone."""
    counts = running(_class_counts(df, score, label, by, "threshold"), "threshold", ["n"], by)
    one = counts.groupBy(*by).agg(F.sum("p").alias("_p"), F.sum("n").alias("_m"), F.sum(F.col("p") * (F.col("n_upto") - F.col("n") / 2)).alias("_u"))
    return one.select(*by, F.when((F.col("_p") > 0) & (F.col("_m") > 0), F.col("_u") / (F.col("_p") * F.col("_m"))).alias("auc"))


def tpr_at(most: float) -> Column:
    """Largest true-positive rate of a curve where the false-positive rate is at most ``most``."""
    return F.coalesce(F.max(F.when(F.col("fpr") <= most + 1e-12, F.col("tpr"))), F.lit(0.0))


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """``(bin, n, low, density)`` of equal bins from least to largest value, the last one closed; with ``by``, counts and densities of each group in common bins."""
    by = by or []
    ends = df.agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    width = F.when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) / bins).otherwise(F.lit(1.0))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_low")) / F.col("_width")).cast("int"))
    rows = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("_width", width).withColumn("bin", at)
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.first(F.col("_low") + F.col("bin") * F.col("_width")).alias("low"), F.first("_width").alias("_width"))
    whole = F.sum("n").over(Window.partitionBy(*by))  # at most ``bins`` rows a group
    return counts.withColumn("density", F.col("n") / (whole * F.col("_width"))).drop("_width")


def roc_points(curve: DataFrame, floor: float = 1e-3) -> DataFrame:
    """``(x, y)``: points of a ROC curve for logarithmic axes, rates below ``floor`` drawn at it, each x with its highest y."""
    clipped = curve.select(F.greatest("fpr", F.lit(floor)).alias("x"), F.greatest("tpr", F.lit(floor)).alias("y"))
    return clipped.groupBy("x").agg(F.max("y").alias("y"))
