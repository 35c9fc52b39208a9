"""Ranks, resampling and report tables against plain NumPy versions of themselves."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import pii, text
from plumbline.operators import controls, extraction, ranks, registry, sampling, scoring, stats
from plumbline.plans import queries
from plumbline.sources import readers


def rank(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def corr(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    scale = x.std() * y.std()
    return float(((x - x.mean()) * (y - y.mean())).mean() / scale) if scale > 0 else 0.0


def spearman(x, y):
    return corr(rank(x), rank(y))


def partial(x, y, z):
    a, b, c = spearman(x, y), spearman(x, z), spearman(y, z)
    return (a - b * c) / math.sqrt((1 - b * b) * (1 - c * c))


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def order_of(r, rows, seed):
    return sorted(rows, key=lambda i: (md5(seed, r, i), i))


def draws(r, n, seed):
    return [int(md5(seed, r, j)[:8], 16) % n for j in range(n)]


def residuals(v, c):
    v, c = np.asarray(v, float), np.asarray(c, float)
    z = (c - c.mean()) / (c.std() or 1)
    x = np.vander(z, 4, increasing=True)
    return v - x @ np.linalg.lstsq(x, v, rcond=None)[0]


def cubic(x, y, c):
    return spearman(np.round(residuals(x, c), 9), np.round(residuals(y, c), 9))


def p_of(seen, null, tolerance=1e-12):
    return (1 + sum(abs(v) >= abs(seen) - tolerance for v in null)) / (len(null) + 1)


def ends(values):
    return np.quantile(values, 0.025), np.quantile(values, 0.975)


N, REPLICATES, SEED = 70, 30, 7


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(4)
    loss = rng.normal(size=N).round(3)
    one = (loss + rng.normal(size=N)).round(1)
    two = (loss**3 - loss + 0.3 * rng.normal(size=N)).round(3)
    frac = np.clip(np.round(0.5 + 0.2 * one + 0.1 * rng.normal(size=N), 1), 0, 1)
    member = (rng.random(N) < 0.5).astype(int)
    rows = [(int(i * 3 + 5), float(loss[i]), float(one[i]), float(two[i]), float(frac[i]), int(frac[i] >= 0.8), int(member[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, loss double, one double, two double, frac double, whole int, member int")
    return df.repartition(3), {"loss": loss, "one": one, "two": two, "frac": frac, "whole": (frac >= 0.8).astype(int), "member": member}


def table(df, key="detector"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("one_window", [10_000, 20])
def test_grouped_ranks_cross_ranges(spark, monkeypatch, one_window):
    monkeypatch.setattr(ranks, "ONE_WINDOW", one_window)
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 900), rng.integers(0, 200, 900))] + [(None, 1.0), (None, 2.0), (1, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = sorted((r["g"] is None, r["g"] or 0, r["v"], r["r_v"]) for r in ranks.with_ranks(df, ["v"], ["g"]).filter("v is not null").collect())
    want = []
    for g in {g for g, _ in rows}:
        held = [v for h, v in rows if h == g and v is not None]
        want += [(g is None, g or 0, v, r) for v, r in zip(held, rank(held))]
    assert got == sorted(want) and ranks.with_ranks(df, ["v"], ["g"]).count() == len(rows)
    auc = {r["g"]: r["auc"] for r in ranks.report(df.filter("v is not null and g is not null").withColumn("y", (F.col("v") > 90).cast("long")), "v", "y", ["g"]).collect()}
    assert auc == {0: 1.0, 1: 1.0, 2: 1.0}


def test_numbers_and_places(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ONE_WINDOW", 50)
    df = spark.createDataFrame([(i * 2, "x") for i in range(200)] + [(10, "again"), (10, "more")], "id long, t string").repartition(5)
    rows = sorted(stats.indexed(df, "id").collect(), key=lambda r: r["i"])
    assert [r["i"] for r in rows] == list(range(202)) and all(a["id"] <= b["id"] for a, b in zip(rows, rows[1:]))
    placed = {r["id"]: r["place"] for r in sampling.places(spark.range(300), 7, "id").collect()}
    assert [i for i, _ in sorted(placed.items(), key=lambda t: t[1])] == sorted(range(300), key=lambda i: (md5(7, i), i)) and set(placed.values()) == set(range(1, 301))


def test_concordance_without_pairs(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 40, 500), rng.integers(0, 60, 500)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x long, y long")
    s = float((np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / 2)
    tied = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    tau = s / math.sqrt((500 * 499 / 2 - tied(x)) * (500 * 499 / 2 - tied(y)))
    for cells in (20_000, 90, 7):
        assert stats.kendall(df, "id", "x", "y", cells).first()["tau"] == pytest.approx(tau, abs=1e-12)
    grouped = df.withColumn("g", F.col("id") % 3)
    got = {r["g"]: (r["pairs"], r["rising"]) for r in stats.ordered_pairs(grouped, "id", "y", ["g"]).collect()}
    assert got == {g: (len(v) * (len(v) - 1) // 2, int((np.triu(v[None, :] > v[:, None], 1)).sum())) for g in range(3) for v in [y[g::3]]}
    assert stats.kendall(df.limit(0), "id", "x", "y").first()["tau"] == 0


def test_permutations(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(40)], "i long, g long, v double")
    got = {}
    for r in stats.permuted(df, "v", 5, 7).collect():
        got.setdefault(r["r"], {})[r["i"]] = r["v"]
    assert got == {r: dict(enumerate(map(float, order_of(r, range(40), 7)))) for r in range(5)}
    for r in stats.permuted(df, "v", 5, 7, ["g"]).collect():
        assert r["v"] == order_of(r["r"], range(r["g"], 40, 2), 7)[r["i"] // 2]


def test_raw_table_and_headline(items):
    df, v = items
    got = table(controls.raw_table(df, ["loss", "one"], "frac", "id", REPLICATES, SEED))
    head = table(controls.headline(df, ["loss", "one"], "frac", "whole", "id", REPLICATES, SEED))
    for d in ("loss", "one"):
        boot = [spearman(v[d][b], v["frac"][b]) for r in range(REPLICATES) for b in [draws(r, N, SEED)]]
        null = [spearman(v[d], v["frac"][order_of(r, range(N), SEED)]) for r in range(REPLICATES)]
        low, high = ends(boot)
        assert got[d]["rho"] == pytest.approx(spearman(v[d], v["frac"])) and (got[d]["low"], got[d]["high"]) == pytest.approx((low, high))
        assert got[d]["p"] == pytest.approx(p_of(got[d]["rho"], null)) and head[d]["rho_extracted"] == pytest.approx(spearman(v[d], v["whole"]))
        assert head[d]["excludes_zero"] == (not low <= 0 <= high)


def test_partial_family(items):
    df, v = items
    got = table(controls.partial_family(df, ["one", "two"], "frac", "loss", "id", REPLICATES, SEED))
    ps = {}
    for d in ("one", "two"):
        boot = [partial(v[d][b], v["frac"][b], v["loss"][b]) for r in range(REPLICATES) for b in [draws(r, N, SEED)]]
        null = [partial(v[d], v["frac"][order_of(r, range(N), SEED)], v["loss"]) for r in range(REPLICATES)]
        assert got[d]["partial"] == pytest.approx(partial(v[d], v["frac"], v["loss"])) and (got[d]["low"], got[d]["high"]) == pytest.approx(ends(boot))
        a, b, c = spearman(v[d], v["frac"]), spearman(v[d], v["loss"]), spearman(v["frac"], v["loss"])
        assert got[d]["semipartial"] == pytest.approx((a - b * c) / math.sqrt(1 - b * b))
        ps[d] = got[d]["p"]
        assert ps[d] == pytest.approx(p_of(got[d]["partial"], null))
    low, high = sorted(ps, key=lambda d: (ps[d], d))
    assert got[high]["q"] == pytest.approx(ps[high]) and got[low]["q"] == pytest.approx(min(2 * ps[low], ps[high]))


def test_cubic_permutation_fits_the_permuted_outcome(items):
    df, v = items
    got = stats.cubic_permutation(df, "one", "frac", "loss", REPLICATES, SEED, "id").first()
    null = [cubic(v["one"], v["frac"][order_of(r, range(N), SEED)], v["loss"]) for r in range(REPLICATES)]
    assert got["observed"] == pytest.approx(cubic(v["one"], v["frac"], v["loss"])) and got["p"] == pytest.approx(p_of(got["observed"], null))


def test_hardening_decision(items):
    df, v = items
    got = table(controls.hardening(df, ["one", "two"], "frac", "loss", "id", REPLICATES, SEED))
    for d in ("one", "two"):
        boot = [cubic(v[d][b], v["frac"][b], v["loss"][b]) for r in range(REPLICATES) for b in [draws(r, N, SEED)]]
        assert (got[d]["low"], got[d]["high"]) == pytest.approx(ends(boot), abs=1e-9) and got[d]["revived"] == (got[d]["low"] > 0 and got[d]["q"] < 0.05)


def test_cubic_of_a_constant_control_is_plain_spearman(items):
    df, v = items
    assert stats.cubic_spearman(df.withColumn("k", F.lit(2.0)), "one", "frac", "k").first()["value"] == pytest.approx(spearman(v["one"], v["frac"]))


def test_prefix_control(items):
    df, v = items
    rows = df.select("*", F.col("loss").alias("prefix_loss"), F.col("two").alias("prefix_one"))
    got = table(controls.prefix_control(rows, ["loss", "one"], "frac"))
    assert got["loss"]["partial_given_prefix_loss"] is None and got["loss"]["change"] == 0
    assert got["one"]["rho_full"] == pytest.approx(spearman(v["one"], v["frac"])) and got["one"]["rho_prefix"] == pytest.approx(spearman(v["two"], v["frac"]))
    assert got["one"]["partial_given_prefix_loss"] == pytest.approx(partial(v["two"], v["frac"], v["loss"]))


def test_two_arm_reading(items):
    df, v = items
    got = table(controls.two_arm_reading(df, ["loss", "one"], "frac", "member", "id", REPLICATES, SEED), "feature")
    for f in ("loss", "one"):
        ps = []
        for arm, k in (("members", 1), ("others", 0)):
            at = np.flatnonzero(v["member"] == k)
            seen = round(spearman(v[f][at], v["frac"][at]), 12)
            null = [round(spearman(v[f][at], v["frac"][order_of(r, at.tolist(), SEED)]), 12) for r in range(REPLICATES)]
            assert got[f][f"{arm}_rho"] == pytest.approx(seen) and got[f][f"{arm}_p"] == pytest.approx(p_of(seen, null, 0.0))
            ps.append(got[f][f"{arm}_p"] < 0.05)
        assert got[f]["reading"] == controls.READINGS[tuple(ps)]


def test_rank_difference_and_domains(items, spark):
    df, v = items
    got = controls.rank_difference(df, "one", "member", "id", REPLICATES, SEED).first()
    r, m = rank(v["one"]), v["member"]
    seen = r[m == 1].mean() - r[m == 0].mean()
    null = [r[p == 1].mean() - r[p == 0].mean() for k in range(REPLICATES) for p in [m[order_of(k, range(N), SEED)]]]
    assert got["observed"] == pytest.approx(seen) and got["p"] == pytest.approx((1 + sum(x >= seen - 1e-9 for x in null)) / (REPLICATES + 1))
    rows = [("a", 1, 2.0)] * 9 + [("a", 0, 1.0)] + [("b", 1, 1.0)] * 9 + [("c", 1, 1.0)] * 3 + [("c", 0, 1.0)]
    assert [tuple(r) for r in controls.domain_delta(spark.createDataFrame(rows, "d string, m int, x double"), "d", "x", "m").collect()] == [("a", 9, 2.0, 1.0, 1.0)]


def test_synthetic_scores_are_the_published_ones(spark):
    # fixed values: (loss, min_20_prob, min_20_plusplus, zlib_ratio)
    published = {
        "m0": (-0.29971882058843957, -2.0917081890069347, 3.455261983277494, -0.028382464070874962),
        "n0": (-2.2423481095433817, -4.485783571831282, 2.6507428556346966, -0.17091067908105043),
        "m1": (-0.7088706048716655, -2.7711347676833613, 3.3645665124145543, -0.06712789818860469),
        "n1": (-2.05670023508462, -4.520260472369136, 2.6377876734061236, -0.15676068864974238),
    }
    got = {r["item_id"]: r for r in queries.t3_mock_scores(spark, "").collect()}
    assert len(got) == 100
    for k, want in published.items():
        assert tuple(got[k][c] for c in ("loss", "min_20_prob", "min_20_plusplus", "zlib_ratio")) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("name", ["c1_c3_c19_correlations", "c5_permutation_partial", "c12_cubic_residual_spearman", "m4_m6_membership_report", "e1_score_report"])
def test_plans_read_few_tables(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 16 and plan.count("Join") <= 20


def test_array_detectors_agree_with_columns(spark):
    rows = [(i, "".join("ab cd"[(i * k + k // 3) % 5] for k in range(5 + 7 * i))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = scoring.BigramModel.train(df)
    names = ("loss", "perplexity", "min_20_prob", "min_10_prob", "min_20_plusplus")
    by_column = {r["doc_id"]: r for r in model.stats(df).select("doc_id", *[scoring.detector(n).alias(n) for n in names]).collect()}
    for r in model.scores(df, names).collect():
        assert [r[n] for n in names] == pytest.approx([by_column[r["doc_id"]][n] for n in names], rel=1e-6)
    with pytest.raises(ValueError):
        scoring.scores(df, ("loss",))


def test_corpus_tests_by_name():
    assert set(registry.CORPUS_TESTS) == {"ngram_overlap", "oren_permutation"} and registry.corpus_test("ngram_overlap")
    with pytest.raises(ValueError):
        registry.corpus_test("loss")


def test_leaks(spark):
    df = spark.createDataFrame([("call 555-123-4567 a@b.org", "x a@b.org"), ("a@b.org", "c@d.org"), ("id 123-45-6789", "123-45-6789 z"), ("none", "none"), (None, "a@b.org")], "t string, g string")
    assert [r[0] for r in df.select(pii.leaked(F.col("t"), F.col("g"))).collect()] == [True, False, True, False, False]


def test_resumable_extraction(spark, tmp_path):
    table = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "prev string, next string")
    items = spark.createDataFrame([(1, ["a"], ["b", "c"]), (2, ["b"], ["c", "x"])], "id long, prefix array<string>, suffix array<string>")
    calls = []

    def generator():
        calls.append(1)
        return lambda df: extraction.generate(df, table, 2)

    path = f"{tmp_path}/run"
    first = extraction.resumable(items.filter("id = 1"), path, generator, "id")
    assert [(r["id"], r["matched_tokens"], r["extracted"]) for r in first.collect()] == [(1, 2, True)]
    both = extraction.resumable(items, path, generator, "id")
    assert sorted((r["id"], r["matched_tokens"]) for r in both.collect()) == [(1, 2), (2, 1)] and len(calls) == 2
    extraction.resumable(items, path, generator, "id")
    assert len(calls) == 2  # nothing left: no generator
    assert extraction.resumable(items, path, generator, "id", restart=True).count() == 2 and len(calls) == 3


def test_cached_selection(spark, tmp_path):
    made = []

    def select():
        made.append(1)
        return spark.range(3)

    for n in (5, 5, 6):
        assert extraction.cached_selection(spark, str(tmp_path), {"n": n, "seed": 0, "source": "a/b"}, select).count() == 3
    assert len(made) == 2


def test_settings_and_results(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# run\nprefix-len: 32\nname: 'run''s'\nrate: 0.5\nfast: true\nnone: ~\nsizes: [1, 2]\nplain: text here # note\n")
    got = readers.settings(str(tmp_path / "a.yaml"), {"prefix_len": 1, "other": 2})
    assert got == {"prefix_len": 32, "other": 2, "name": "run's", "rate": 0.5, "fast": True, "none": None, "sizes": [1, 2], "plain": "text here"}
    assert readers._flat_yaml("a: 1\nb: x") == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        readers._flat_yaml("a:\n  b: 1")
    (tmp_path / "r.json").write_text('{"n": 3,\n "rows": [1, 2]}')
    assert readers.json_results(spark, str(tmp_path / "r.json")) == {"n": 3, "rows": [1, 2]}


def test_tokens_and_back(spark):
    df = spark.createDataFrame([("a  b c",), (None,)], "t string")
    assert [r[0] for r in df.select(text.detokenise(text.words(F.col("t")))).collect()] == ["a b c", None]
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    encode, decode = text.subwords(str(vocabulary))
    back = spark.createDataFrame([("the cat sat",), (None,), ("",)], "t string").select(encode(F.col("t")).alias("ids")).select("ids", decode(F.col("ids")).alias("t")).collect()
    assert back[0]["t"].replace("</w>", "").split() == ["the", "cat", "sat"] and back[1]["ids"] is None and back[2]["ids"] == []


def test_roc_points_and_density(spark):
    df = spark.createDataFrame([(float(i), i % 2, i // 50) for i in range(100)], "s double, y long, g long")
    points = {r["x"]: r["y"] for r in ranks.roc_points(ranks.roc(df, "s", "y"), 0.1).collect()}
    assert min(points) == 0.1 and points[1.0] == 1.0
    bars = ranks.histogram(df, "s", 10, ["g"]).collect()
    assert {g: pytest.approx(1.0) for g in (0, 1)} == {g: sum(r["density"] * 9.9 for r in bars if r["g"] == g) for g in (0, 1)}
