"""Operators take whole texts: brute force on texts longer than any former cut."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import order_test, scoring


def prose(seed, n, letters="abcde é😀\n"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def brute_model(texts, k=0.5):
    """``pair -> (lp, mu, sigma)`` of a character bigram model with add-k smoothing."""
    c = Counter((a, b) for t in texts for a, b in zip(t or "", (t or "")[1:]))
    letters = {x for pair in c for x in pair}
    n = Counter()
    for (a, _), m in c.items():
        n[a] += m

    def score(a, b):
        if a not in n:
            return -math.log(len(letters)), -math.log(len(letters)), 0.0
        each = [math.log((c[a, x] + k) / (n[a] + k * len(letters))) for x in letters]
        mu = sum(each) / len(each)
        return math.log((c[a, b] + k) / (n[a] + k * len(letters))), mu, math.sqrt(sum((e - mu) ** 2 for e in each) / (len(each) - 1))

    return score


def lowest(values, percent=20):
    found = sorted(values)[: max(1, math.ceil(percent / 100 * len(values)))]
    return sum(found) / len(found)


#: Long texts whose ends differ from their openings.
TRAINED = [prose(1, 300) + "zzyz" * 400, prose(2, 5000), None, "", "q", "xy"]
SCORED = [*TRAINED, prose(3, 256) + "zyzz" * 500, "一二", prose(4, 300, "ab")]


def test_scores_of_whole_texts(spark):
    table = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, score = scoring.BigramModel.train(table(TRAINED)), brute_model(TRAINED)
    got = {r["doc_id"]: r for r in scoring.scores(model.stats(table(SCORED), keep=("text",)), ("loss", "perplexity", "min_20_prob", "min_20_plusplus", "zlib_ratio"), ("doc_id", "n_tokens", "mu", "sigma")).collect()}
    loglik = {r["doc_id"]: r["loglik"] for r in model.loglik(table(SCORED)).collect()}
    assert set(got) == set(loglik) == {i for i, t in enumerate(SCORED) if len(t or "") >= 2}
    for i, r in got.items():
        each = [score(a, b) for a, b in zip(SCORED[i], SCORED[i][1:])]
        lp = [e[0] for e in each]
        assert r["n_tokens"] == len(each) and loglik[i] == pytest.approx(sum(lp))
        assert r["mu"] == pytest.approx([e[1] for e in each]) and r["sigma"] == pytest.approx([e[2] for e in each], abs=1e-7)
        assert r["loss"] == pytest.approx(sum(lp) / len(lp)) and r["perplexity"] == pytest.approx(-math.exp(-sum(lp) / len(lp)))
        assert r["min_20_prob"] == pytest.approx(lowest(lp))
        if i != 7:  # an unknown context has no deviation, so z is over 1e-6
            assert r["min_20_plusplus"] == pytest.approx(lowest([(e[0] - e[1]) / (e[2] + 1e-6) for e in each]), rel=1e-5)
        assert r["zlib_ratio"] == pytest.approx(sum(lp) / bits(SCORED[i]))
    cut = {r["doc_id"]: r["n_tokens"] for r in model.stats(table(SCORED), most=32).select("doc_id", F.size("token_logprob").alias("n_tokens")).collect()}
    assert cut == {i: min(31, len(t) - 1) for i, t in enumerate(SCORED) if len(t or "") >= 2}


def bits(t):
    import zlib

    return 8 * len(zlib.compress(t.encode()))


def test_zlib_ratio_sums_the_text_it_compresses(spark, tmp_path):
    from plumbline.plans import queries

    texts = [prose(i, 200 + 150 * i) for i in range(16)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    member = {r["doc_id"] for r in queries._arms(spark, str(tmp_path)).filter("member = 1").collect()}
    score = brute_model([t for i, t in enumerate(texts) if i in member])
    got = {r["doc_id"]: r for r in queries.t9_t10_zlib_scores(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(16)) and 0 < len(member) < 16
    for i, t in enumerate(texts):
        assert got[i]["bits"] == bits(t) and got[i]["zlib_ratio"] == pytest.approx(sum(score(a, b)[0] for a, b in zip(t, t[1:])) / bits(t))


def test_order_test_of_whole_conversations(spark):
    rows = [(1, i, prose(i, 30)) for i in range(6)] + [(2, i, prose(i, 700)) for i in range(12)]  # the second is longer than 4096 characters
    rows += [(3, 0, ""), (3, 1, prose(7, 20)), (3, 2, ""), (3, 3, ""), (3, 4, "q"), (3, 5, None), (4, 0, ""), (4, 1, ""), (5, 0, "alone"), (6, 0, ""), (6, 1, ""), (6, 2, ""), (7, 0, "x"), (7, 1, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate([prose(1, 3000), "ab\n\ncd\n" * 30])], "doc_id long, text string")
    model = scoring.BigramModel.train(corpus)
    scorer = lambda df: model.loglik(df, "key", "text").withColumn("loglik", F.round("loglik", 6))
    want = {r["conv_id"]: r for r in order_test.permutation_test(turns, scorer, "conv_id", "turn", permutations=60, seed=7).collect()}
    got = {r["conv_id"]: r for r in order_test.bigram_permutation_test(turns, model, "conv_id", "turn", permutations=60, seed=7).collect()}
    assert set(got) == set(want) == {1, 2, 3, 6}
    for g, r in got.items():
        for c in ("p_value", "canonical_loglik", "null_mean", "null_std"):
            assert r[c] == pytest.approx(want[g][c], abs=1e-5), (g, c)
    score, whole = brute_model([prose(1, 3000), "ab\n\ncd\n" * 30]), "\n".join(t for g, _, t in rows if g == 2)
    assert len(whole) > 4096 and got[2]["canonical_loglik"] == pytest.approx(sum(score(a, b)[0] for a, b in zip(whole, whole[1:])))


def test_registered_order_test_can_fall_below_five_per_cent():
    from plumbline.plans import queries

    assert queries.ORDER_PERMUTATIONS >= 500


def test_registered_replicates_are_those_of_driver_queries():
    from plumbline.plans import queries

    assert queries.REPLICATES >= 200


def test_line_scan_returns_every_line(spark, tmp_path):
    from plumbline.plans import queries

    texts = ["\n".join("" if j % 5 == 0 else "  " if j % 7 == 0 else f"{i} {j}" for j in range(90)) for i in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, j + 1, line) for i, t in enumerate(texts) for j, line in enumerate(t.split("\n")) if line.strip(" ")}
    got = [tuple(r) for r in queries.s7_line_scan(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) > 500 and set(got) == want
