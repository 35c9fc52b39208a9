"""Closed-form cases of the analytics operators."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import pii, text
from plumbline.operators import contamination, extraction, order_test, ranks, scoring, stats


def one(df):
    return df.first().asDict()


def test_overlap(spark):
    corpus = spark.createDataFrame([("the cat sat on the mat",), ("a dog ran home",)], "text string")
    items = spark.createDataFrame([(1, "cat sat on the"), (2, "x y z w"), (3, "cat sat on fire"), (4, "cat"), (5, "")], "item_id int, text string")
    got = {r["item_id"]: r["score"] for r in contamination.overlap(items, corpus, 3).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.5, 4: 0.0, 5: 0.0}


def test_index_is_additive(spark):
    a, b = (spark.createDataFrame([(t,)], "text string") for t in ("p q r", "q r s"))
    assert contamination.build_index([a, b], 2).count() == 3
    with pytest.raises(ValueError):
        contamination.build_index([], 2)


def test_character_ngrams(spark):
    df = spark.createDataFrame([(1, "abc")], "item_id int, text string")
    assert contamination.grams_of(df, "item_id", 2, tokenizer=text.characters, separator="").count() == 2


def test_words_split_unicode_white_space(spark):
    sample = "a" + "".join(chr(c) + "b" for c in (0xA0, 0x2003, 0x3000, 0x1C, 0x85, 0x0B))
    df = spark.createDataFrame([(sample,)], "t string")
    assert df.select(text.words(F.col("t"))).first()[0] == sample.split()


@pytest.mark.parametrize("scores, auc", [((0.1, 0.2, 0.9, 1.0), 1.0), ((1.0, 0.9, 0.2, 0.1), 0.0), ((0.5, 0.5, 0.5, 0.5), 0.5)])
def test_auc(spark, scores, auc):
    df = spark.createDataFrame(list(zip(scores, (0, 0, 1, 1))), "s double, y long")
    got = one(ranks.report(df, "s", "y"))
    assert got["auc"] == auc and got["n_pos"] == 2
    ends = [(r["fpr"], r["tpr"]) for r in ranks.roc(df, "s", "y").orderBy(F.desc("threshold")).collect()]
    assert ends[0] == (0, 0) and ends[-1] == (1, 1)


def test_one_class_has_no_auc(spark):
    assert one(ranks.report(spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y long"), "s", "y"))["auc"] is None


def test_average_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    assert sorted(r["r"] for r in ranks.average_rank(df, "x", "r").collect()) == [1, 2.5, 2.5, 4]


def test_bottom_k(spark):
    df = spark.createDataFrame([([5.0, 1.0, 4.0, 2.0, 3.0],)], "a array<double>")
    assert df.select(scoring.bottom(F.col("a"), 40)).first()[0] == [1, 2]
    assert df.select(F.size(scoring.bottom(F.col("a"), 1))).first()[0] == 1
    with pytest.raises(ValueError):
        scoring.bottom(F.col("a"), 0)
    with pytest.raises(ValueError):
        scoring.detector("unknown")


def test_min_k_plus_plus_depends_on_sigma(spark):
    lp, mu = [-1.0, -2.0, -3.0, -4.0], [-5.0] * 4
    df = spark.createDataFrame([(lp, mu, [1.0] * 4), (lp, mu, [2.0] * 4)], scoring.STATS)
    a, b = (r[0] for r in df.select(scoring.min_k_plus_plus()).collect())
    assert a == pytest.approx(1, abs=1e-5) and b == pytest.approx(0.5, abs=1e-5)


def test_mock_scores_separate(spark):
    rows = [(i, f"text number {i}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, text string, y long").select("i", "y", scoring.mock_stats(member_col="y", signal=2.0).alias("s")).select("i", "y", "s.*")
    assert one(ranks.report(scoring.scores(df, ("loss",), ("y",)), "loss", "y"))["auc"] > 0.75


def test_extraction(spark):
    df = spark.createDataFrame([([13, 14, 15], [13, 14, 15]), ([13, 14, 15], [1, 2, 3]), ([13, 14, 15], [13, 9, 15]), ([13, 14, 15], [13])], "suffix array<int>, generated array<int>")
    assert [r["matched_tokens"] for r in extraction.outcomes(df).collect()] == [3, 0, 1, 1]
    with pytest.raises(ValueError):
        extraction.split_at(F.col("x"), 0, 3)


def test_pii(spark):
    df = spark.createDataFrame([("mail a.b@c.org or 555-123-4567",), ("id 123-45-6789",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(pii.types(F.col("t"))).collect()] == [["email", "phone"], ["ssn"], [], []]
    spans = df.select(pii.spans(F.col("t"))).first()[0]
    assert [(s["pii_type"], s["start"], s["end"]) for s in spans] == [("email", 5, 14), ("phone", 18, 30)]


def test_kendall(spark):
    up = spark.createDataFrame([(i, float(i), 2.0 * i + 1, -float(i)) for i in range(20)], "i int, x double, y double, z double")
    assert one(stats.kendall(up, "i", "x", "y"))["tau"] == 1 and one(stats.kendall(up, "i", "x", "z"))["tau"] == -1


def test_no_variance_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(stats.pearson("x", "y")).first()[0] == 0


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.5), ("c", 0.6), ("d", 0.9)], "n string, p double")
    got = {r["n"]: (round(r["q"], 6), r["reject"]) for r in stats.benjamini_hochberg(df, "p", "n").collect()}
    assert got == {"a": (0.004, True), "b": (0.8, False), "c": (0.8, False), "d": (0.9, False)}


def test_cubic_residuals_remove_a_cubic(spark):
    df = spark.createDataFrame([(i, (i / 10) ** 3 - i, float(i), 1.0) for i in range(-20, 21)], "i int, y double, c double, k double")
    assert max(abs(r["e"]) for r in stats.cubic_residuals(df, ["y"], "c", ["e"]).collect()) < 1e-8
    assert abs(sum(r["e"] for r in stats.cubic_residuals(df, ["y"], "k", ["e"]).collect())) < 1e-6


def test_mediation(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    d = rng.normal(size=2000)
    m = d + 0.2 * rng.normal(size=2000)
    y = m + 0.2 * rng.normal(size=2000)
    got = one(stats.mediation(spark.createDataFrame(list(zip(*(v.tolist() for v in (d, m, y)))), "d double, m double, y double"), "d", "m", "y"))
    assert got["prop_mediated"] == pytest.approx(1, abs=0.1)


def test_order_test(spark):
    rows = [("g", i, f"{i}") for i in range(5)] + [("single", 0, "x")]
    df = spark.createDataFrame(rows, "g string, pos int, text string")
    favour = lambda x: x.select("key", F.when(F.col("text") == "0\n1\n2\n3\n4", 0.0).otherwise(-1.0).alias("loglik"))
    got = {r["g"]: r for r in order_test.permutation_test(df, favour, "g", "pos", permutations=50).collect()}
    assert set(got) == {"g"} and got["g"]["p_value"] < 0.1
    with pytest.raises(ValueError):
        order_test.permutation_test(df, favour, "g", "pos", permutations=0)
