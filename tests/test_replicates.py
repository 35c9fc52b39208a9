"""Replicates by arrays: the same draws, permutations and results as the joins of ``stats``, without a row a replicate."""

import hashlib

import numpy as np
import pytest

from plumbline.operators import controls, ranks, replicates, stats

N, TIMES, SEED = 90, 20, 7


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(11)
    loss, group = rng.normal(size=N).round(2), rng.integers(0, 3, N)
    rows = [(int(3 * i), float(loss[i]), float(round(loss[i] + rng.normal(), 1)), float(rng.integers(0, 6) / 5), int(group[i] > 0), int(group[i])) for i in range(N)]
    return spark.createDataFrame(rows, "id long, loss double, one double, frac double, member int, g int").repartition(3)


def test_hashes_are_md5():
    for prefix, n in (("7|3|", 40_000), ("7|1|199|", 101), ("x" * 54, 12)):
        for low, h in replicates.hashes(prefix, n):
            for k in {0, h.shape[1] // 2, h.shape[1] - 1}:
                assert "".join(f"{int(x):08x}" for x in h[:, k]) == hashlib.md5(f"{prefix}{low + k}".encode()).hexdigest()


TABLES = {
    "raw": lambda df: controls.raw_table(df, ["loss", "one"], "frac", "id", TIMES, SEED),
    "partial": lambda df: controls.partial_family(df, ["one"], "frac", "loss", "id", TIMES, SEED),
    "hardening": lambda df: controls.hardening(df, ["one"], "frac", "loss", "id", TIMES, SEED, (6, 6)),
    "two arms": lambda df: controls.two_arm_reading(df, ["loss", "one"], "frac", "member", "id", TIMES, SEED),
    "difference": lambda df: controls.rank_difference(df, "one", "member", "id", TIMES, SEED),
    "cubic": lambda df: stats.cubic_permutation(df, "one", "frac", "loss", TIMES, SEED, "id"),
    "auc": lambda df: stats.bootstrap(df.select("id", "member", "one"), lambda rows: ranks.auc(rows, "one", "member", ["r"]).withColumnRenamed("auc", "value"), TIMES, SEED, ["member"], "id", replicates.auc("one", "member")),
}


@pytest.mark.parametrize("name", TABLES)
def test_arrays_and_joins_agree(items, monkeypatch, name):
    def rows():
        return sorted(([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in TABLES[name](items).collect()]), key=str)

    by_arrays = rows()
    monkeypatch.setattr(replicates, "NUMBERS", 0)
    assert by_arrays == rows() and by_arrays


def test_strata_and_nulls(items, spark):
    a = stats.indexed(stats.with_ranks(items, ["one", "frac"], ["g"]).select("id", "g", "r_one", "r_frac"), "id")
    held = {r["i"]: r for r in a.collect()}
    got = {r["r"]: r["value"] for r in replicates.permutations(a, "r_frac", ["r_one"], TIMES, SEED, replicates.stratified("r_one", "g", 3), [()], by="g").collect()}
    for r in range(TIMES):
        total = 0.0
        for g in range(3):
            own = [i for i in sorted(held) if held[i]["g"] == g]
            order = sorted(own, key=lambda i: hashlib.md5(f"{SEED}|{r}|{i}".encode()).hexdigest())
            total += len(own) * np.corrcoef([held[i]["r_one"] for i in own], [held[i]["r_frac"] for i in order])[0, 1]
        assert got[r] == pytest.approx(total / N)
    assert not replicates.fits(spark.createDataFrame([(1.0,), (None,)], "x double"), ["x"]) and not replicates.fits(spark.createDataFrame([("a", 1.0)], "g string, x double"), ["x"], "g")


def test_no_row_a_replicate(items):
    a = stats.indexed(items.select("id", "one", "frac"), "id")
    null = stats.null_of(a, "frac", ["one"], lambda rows: rows.groupBy("r").agg(stats.pearson("one", "frac").alias("value")), replicates.correlations(["one"]), TIMES, SEED)
    plan = null._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and null.count() == TIMES
