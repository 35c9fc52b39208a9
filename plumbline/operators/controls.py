"""Report-level tables: detectors against an extraction outcome, with intervals, permutations and controls, and readings of two arms.

Every function takes a narrow table with one row an item: ``order`` is its numeric id, detectors and outcomes are number columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import replicates as carried
from plumbline.operators import stats
from plumbline.operators.ranks import average_rank, with_ranks
from plumbline.sources.kept import keep


def _by_name(df: DataFrame, by: list[str], values: dict[str, Column], name: str = "detector") -> DataFrame:
    """``(by..., name, value)``: one aggregate over ``df``, a row a value."""
    one = df.groupBy(*by).agg(F.array(*[F.struct(F.lit(k).alias(name), v.alias("value")) for k, v in values.items()]).alias("_v"))
    return one.select(*by, F.explode("_v").alias("_v")).select(*by, "_v.*")


def spearmans(df: DataFrame, xs: list[str], y: str, by: list[str] | None = None, name: str = "detector") -> DataFrame:
    """``(by..., detector, value)``: Spearman of each x with y."""
    return _by_name(with_ranks(df, [*xs, y], by), by or [], {x: stats.pearson(f"r_{x}", f"r_{y}") for x in xs}, name)


def partials(df: DataFrame, xs: list[str], y: str, z: str, by: list[str] | None = None) -> DataFrame:
    return _by_name(with_ranks(df, [*xs, y, z], by), by or [], {x: stats.partial_of(f"r_{x}", f"r_{y}", f"r_{z}") for x in xs})


def _drawn(items: DataFrame, replicates: int, seed: int) -> DataFrame:
    return keep(stats.resampled(items, replicates, seed).drop("i"), "resampled")


def _drawn_correlations(items: DataFrame, xs: list[str], y: str, z: str | None, replicates: int, seed: int) -> DataFrame:
    """``(r, detector, value)``: Spearman of each x with y (given z) in each bootstrap replicate."""
    columns = [*dict.fromkeys([*xs, y, *([z] if z else [])])]
    if carried.fits(items, columns):
        return carried.draws(items, columns, replicates, seed, carried.rank_correlations(xs, y, z), [(x,) for x in xs], "detector string")
    drawn = _drawn(items, replicates, seed)
    return spearmans(drawn, xs, y, ["r"]) if z is None else partials(drawn, xs, y, z, ["r"])


def _permuted_correlations(ranked: DataFrame, xs: list[str], y: str, z: str | None, replicates: int, seed: int) -> DataFrame:
    """``(r, detector, value)``: the same of columns that are ranks already, y being permuted."""
    r = lambda x: f"r_{x}"
    columns = [r(c) for c in dict.fromkeys([*xs, *([z] if z else [])])]
    if carried.fits(ranked, [r(y), *columns]):
        of = carried.correlations([r(x) for x in xs], r(z) if z else None)
        return carried.permutations(ranked, r(y), columns, replicates, seed, of, [(x,) for x in xs], "detector string")
    each = {x: stats.pearson(r(x), r(y)) if z is None else stats.partial_of(r(x), r(y), r(z)) for x in xs}
    return _by_name(stats.permuted(ranked, r(y), replicates, seed), ["r"], each)


def raw_table(df: DataFrame, detectors: list[str], outcome: str, order: str, replicates: int, seed: int) -> DataFrame:
    """``(detector, rho, low, high, tau, p)``: Spearman with its paired bootstrap interval, Kendall's tau and the permutation p."""
    items = stats.indexed(df.select(order, *detectors, outcome), order)
    rho = keep(spearmans(items, detectors, outcome), "rho")
    ends = stats.interval(_drawn_correlations(items, detectors, outcome, None, replicates, seed), "value", by=["detector"])
    ranked = keep(with_ranks(items, [*detectors, outcome]), "ranked")
    p = stats.p_value(rho, _permuted_correlations(ranked, detectors, outcome, None, replicates, seed), "value", by=["detector"]).drop("observed")
    tau = reduce(DataFrame.unionByName, [stats.kendall(items, order, d, outcome).withColumn("detector", F.lit(d)) for d in detectors])
    return rho.withColumnRenamed("value", "rho").join(ends, "detector").join(tau, "detector").join(p, "detector").select("detector", "rho", "low", "high", "tau", "p")


def partial_family(df: DataFrame, detectors: list[str], outcome: str, control: str, order: str, replicates: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """``(detector, partial, low, high, p, semipartial, q, reject)``: each detector's rank correlation given the control, one family of tests."""
    items = stats.indexed(df.select(order, *detectors, outcome, control), order)
    ranked = keep(with_ranks(items, [*detectors, outcome, control]), "ranked")
    r = lambda x: f"r_{x}"
    part = {d: stats.partial_of(r(d), r(outcome), r(control)) for d in detectors}
    seen = _by_name(ranked, [], part)
    semi = _by_name(ranked, [], {d: stats.semipartial(stats.pearson(r(d), r(outcome)), stats.pearson(r(d), r(control)), stats.pearson(r(outcome), r(control))) for d in detectors})
    ends = stats.interval(_drawn_correlations(items, detectors, outcome, control, replicates, seed), "value", by=["detector"])
    p = stats.p_value(seen, _permuted_correlations(ranked, detectors, outcome, control, replicates, seed), "value", by=["detector"]).withColumnRenamed("observed", "partial")
    table = p.join(ends, "detector").join(semi.withColumnRenamed("value", "semipartial"), "detector")
    return stats.benjamini_hochberg(table, "p", "detector", alpha).select("detector", "partial", "low", "high", "p", "semipartial", "q", "reject")


def prefix_control(df: DataFrame, detectors: list[str], outcome: str, prefix: str = "prefix_", loss: str = "loss") -> DataFrame:
    """``(detector, rho_full, rho_prefix, change, partial_given_prefix_loss)``: the same detector on whole texts and on prefixes that end before the outcome; none given itself."""
    pre = [f"{prefix}{d}" for d in detectors]
    ranked = keep(with_ranks(df.select(*detectors, *pre, outcome), [*detectors, *pre, outcome]), "ranked")
    y, z = f"r_{outcome}", f"r_{prefix}{loss}"
    one = [
        F.struct(F.lit(d).alias("detector"), stats.pearson(f"r_{d}", y).alias("rho_full"), stats.pearson(f"r_{p}", y).alias("rho_prefix"), (stats.partial_of(f"r_{p}", y, z) if d != loss else F.lit(None).cast("double")).alias("partial_given_prefix_loss"))
        for d, p in zip(detectors, pre, strict=True)
    ]
    out = ranked.agg(F.array(*one).alias("_v")).select(F.explode("_v").alias("_v")).select("_v.*")
    return out.select("detector", "rho_full", "rho_prefix", (F.col("rho_prefix") - F.col("rho_full")).alias("change"), "partial_given_prefix_loss")


def headline(df: DataFrame, detectors: list[str], outcome: str, extracted: str, order: str, replicates: int, seed: int) -> DataFrame:
    """``(detector, rho, low, high, rho_extracted, excludes_zero)``; the flag is whether the interval leaves out 0."""
    items = stats.indexed(df.select(order, *detectors, outcome, extracted), order)
    rho, whole = spearmans(items, detectors, outcome), spearmans(items, detectors, extracted)
    ends = stats.interval(_drawn_correlations(items, detectors, outcome, None, replicates, seed), "value", by=["detector"])
    table = rho.withColumnRenamed("value", "rho").join(ends, "detector").join(whole.withColumnRenamed("value", "rho_extracted"), "detector")
    return table.withColumn("excludes_zero", ~((F.col("low") <= 0) & (F.col("high") >= 0))).select("detector", "rho", "low", "high", "rho_extracted", "excludes_zero")


def _long(df: DataFrame, detectors: list[str]) -> DataFrame:
    """A row a detector, its score as ``_x``."""
    rest = [c for c in df.columns if c not in detectors]
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), F.col(d).cast("double").alias("_x")) for d in detectors]))
    return df.select(*rest, each.alias("_d")).select(*rest, "_d.*")


def hardening(df: DataFrame, detectors: list[str], outcome: str, control: str, order: str, replicates: int, seed: int, digits: tuple[int, int] = (9, 9), alpha: float = 0.05) -> DataFrame:
    """``(detector, rho, low, high, p, q, revived)``: rank correlation of what a cubic of the control leaves; revived if the interval lies above 0 and q below ``alpha``."""
    items = stats.indexed(df.select(order, *detectors, outcome, control), order)
    rho = lambda rows, by: stats.cubic_spearman(_long(rows, detectors), "_x", outcome, control, ["detector", *by], digits)
    columns, names = [*dict.fromkeys([*detectors, outcome, control])], [(d,) for d in detectors]
    if carried.fits(items, columns):
        null = carried.permutations(items, outcome, [*detectors, control], replicates, seed, carried.permuted_cubic(detectors, control, digits), names, "detector string")
        drawn = carried.draws(items, columns, replicates, seed, carried.drawn_cubic(detectors, outcome, control, digits), names, "detector string")
    else:
        null, drawn = rho(stats.permuted(items, outcome, replicates, seed), ["r"]), rho(_drawn(items, replicates, seed), ["r"])
    test, ends = stats.p_value(rho(items, []), null, "value", by=["detector"]), stats.interval(drawn, "value", by=["detector"])
    table = stats.benjamini_hochberg(keep(test.withColumnRenamed("observed", "rho").join(ends, "detector"), "hardening"), "p", "detector", alpha)
    return table.select("detector", "rho", "low", "high", "p", "q", ((F.col("low") > 0) & (F.col("q") < alpha)).alias("revived"))


#: Readings by (members differ, others differ) (fixed values).
READINGS = {(True, True): "PREDICTABILITY (both arms)", (True, False): "members only -> possible memorization", (False, True): "non-members only", (False, False): "no effect"}


def two_arm_reading(df: DataFrame, features: list[str], outcome: str, member: str, order: str, replicates: int, seed: int, alpha: float = 0.05, digits: int = 12) -> DataFrame:
    """``(feature, members_rho, members_p, others_rho, others_p, reading)``: which features go with the outcome in either arm, by permutation inside the arm.

    A permutation counts if its correlation is at least the observed one, without a tolerance; both are compared after rounding to ``digits``.
    """
    items = stats.indexed(df.select(order, member, *features, outcome), order)
    ranked = keep(with_ranks(items, [*features, outcome], [member]), "ranked")
    each = {f: F.round(stats.pearson(f"r_{f}", f"r_{outcome}"), digits) for f in features}
    seen = _by_name(ranked, [member], each, "feature")
    if carried.fits(ranked, [f"r_{c}" for c in (*features, outcome)], member):
        of, names = carried.group_correlations([f"r_{f}" for f in features], member, [1, 0], digits), [(k, f) for k in (1, 0) for f in features]
        null = carried.permutations(ranked, f"r_{outcome}", [f"r_{f}" for f in features], replicates, seed, of, names, f"{member} long, feature string", member)
    else:
        null = _by_name(stats.permuted(ranked, f"r_{outcome}", replicates, seed, [member]), ["r", member], each, "feature")
    tests = keep(stats.p_value(seen, null, "value", tolerance=0.0, by=[member, "feature"]), "tests")
    one, two = (tests.filter(F.col(member) == k).select("feature", F.col("observed").alias(f"{a}_rho"), F.col("p").alias(f"{a}_p")) for k, a in ((1, "members"), (0, "others")))
    reading = F.lit(None).cast("string")
    for (m, o), said in READINGS.items():
        reading = F.when(((F.col("members_p") < alpha) == m) & ((F.col("others_p") < alpha) == o), F.lit(said)).otherwise(reading)
    return one.join(two, "feature").withColumn("reading", reading)


def rank_difference(df: DataFrame, value: str, member: str, order: str, replicates: int, seed: int) -> DataFrame:
    """``(observed, p)``: mean rank of members minus that of others, and the one-sided p of members ranking higher."""
    a = stats.indexed(average_rank(df, value, "_rk").select(order, member, "_rk"), order)
    apart = (F.avg(F.when(F.col(member) == 1, F.col("_rk"))) - F.avg(F.when(F.col(member) == 0, F.col("_rk")))).alias("value")
    if carried.fits(a, [member, "_rk"]):
        null = carried.permutations(a, member, ["_rk"], replicates, seed, carried.mean_difference("_rk"), [()])
    else:
        null = stats.permuted(a, member, replicates, seed).groupBy("r").agg(apart)
    return stats.p_value(a.agg(apart), null, "value", two_sided=False, tolerance=0.0)


def domain_delta(df: DataFrame, domain: str, value: str, member: str, least: int = 8) -> DataFrame:
    """``(domain, n_members, member_mean, other_mean, delta)`` of domains in both arms with enough members, the largest first."""
    one, zero = F.when(F.col(member) == 1, F.col(value)), F.when(F.col(member) == 0, F.col(value))
    table = df.groupBy(domain).agg(F.count(one).alias("n_members"), F.avg(one).alias("member_mean"), F.avg(zero).alias("other_mean"))
    table = table.filter((F.col("n_members") >= least) & F.col("other_mean").isNotNull()).withColumn("delta", F.col("member_mean") - F.col("other_mean"))
    return table.orderBy(F.col("n_members").desc(), domain)
