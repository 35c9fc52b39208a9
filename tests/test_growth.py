"""Steps whose shuffles grew much faster than the result: n-grams, word shares and continuations, against plain Python."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import contamination, extraction
from plumbline.plans import queries

TEXTS = ["a b c a b c a b", "a  b c\x1cd\n", None, "", "x y", "c a b c a", "a b c a b c a b", "déjà vu a b c"]


def exchanges(df, what):
    """Exchanges of the plan whose rows hold ``what``."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and what in x]


def test_grams_are_counted_where_the_text_lies(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string").repartition(3)
    grams = lambda t: [" ".join(w[i : i + 3]) for w in [(t or "").split()] for i in range(len(w) - 2)]
    want = {(i, len(grams(t)), len(set(grams(t)))) for i, t in enumerate(TEXTS) if grams(t)}
    got = contamination.gram_counts(df, "id", 3)
    assert {tuple(r) for r in got.collect()} == want and not exchanges(got, "gram")
    # rows that share an id, or have none, are one row of the result
    both = spark.createDataFrame([(1, TEXTS[0]), (1, TEXTS[5]), (2, TEXTS[1]), (None, TEXTS[0]), (None, TEXTS[7])], "id long, text string")
    each = defaultdict(list)
    for i, t in ((1, TEXTS[0]), (1, TEXTS[5]), (2, TEXTS[1]), (None, TEXTS[0]), (None, TEXTS[7])):
        each[i] += grams(t)
    assert {tuple(r) for r in contamination.gram_counts(both, "id", 3).collect()} == {(i, len(g), len(set(g))) for i, g in each.items()}


@pytest.mark.parametrize("run", [1 << 19, 5])
def test_index_size_packs_hashes(spark, monkeypatch, run):
    monkeypatch.setattr(text, "_WORDS", run)
    df = spark.createDataFrame([(t,) for t in TEXTS * 3] + [(" ".join(f"w{i * k % 97}" for i in range(400)),) for k in range(1, 30)], "text string").repartition(4)
    for n in (1, 3, 13):
        want = {tuple(w[i : i + n]) for (t,) in df.collect() for w in [(t or "").split()] for i in range(len(w) - n + 1)}
        assert contamination.index_size(df, n).first()["n_grams"] == len(want)
    assert contamination.index_size(df.limit(0), 3).first()["n_grams"] == 0
    assert exchanges(contamination.index_size(df, 13), "part") and not exchanges(contamination.index_size(df, 13), "hashpartitioning(a")


@pytest.mark.parametrize("frequent", [200_000, 3, 0])
def test_commonness_of_frequent_and_other_words(spark, monkeypatch, frequent):
    monkeypatch.setattr(queries, "_FREQUENT", frequent)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    pooled = Counter(w for t in TEXTS for w in (t or "").split())
    total = sum(pooled.values())
    share = lambda w: sum(math.log(pooled[x] / total) for x in w) / len(w) if w else 0.0
    out = queries._commonness(df, text.words(F.col("text")))
    assert {r["doc_id"]: r["commonness"] for r in out.collect()} == {i: pytest.approx(share((t or "").split())) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_each_last_word_is_continued_once(spark, monkeypatch, broadcast):
    monkeypatch.setattr(extraction, "BROADCAST_WORDS", broadcast)
    corpus = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    follow = defaultdict(Counter)
    for t in TEXTS:
        w = (t or "").split()
        for a, b in zip(w, w[1:]):
            follow[a][b] += 1
    best = {a: min(c, key=lambda b: (-c[b], b)) for a, c in follow.items()}
    table = extraction.most_likely_next(corpus)
    assert {tuple(r) for r in table.collect()} == set(best.items())
    df = spark.createDataFrame([(i, ["z", w]) for i, w in enumerate(["a", "b", "x", "y", "d", "a", "none", "vu"] * 3)], "id long, prefix array<string>")
    made = extraction.generate(df, table, 5)
    for r in made.collect():
        want, at = [], r["prefix"][-1]
        while at in best and len(want) < 5:
            at = best[at]
            want.append(at)
        assert r["generated"] == want
    assert made.count() == 24
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # whatever the number of steps
    items = extraction.items(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string"), 2, 2, 3, ("id",))
    assert {(r["id"], tuple(r["prefix"]), tuple(r["suffix"])) for r in items.collect()} == {(i, tuple(w[:2]), tuple(w[2:4])) for i, t in enumerate(TEXTS) for w in [(t or "").split()] if len(w) >= 3}


def test_features_in_one_pass_are_those_of_the_columns(spark):
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u2028", "\u2029", "\xa0", "\t", "\u3000", "\u200b", "\u180e"]
    texts = [None, "", " ", "a\n\na\n", *[f"a {e}b{e} a{e}a {e}{e} b\u2003{e}" for e in ends], *[f"x{a}{b}x{a} {b}y" for a in ends for b in ends]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    t = F.col("text")
    want = df.select("id", F.size(text.words(t)).cast("long").alias("n"), text.type_token_ratio(t), text.repeated_lines(t), text.compressibility(t))
    got = text.with_word_counts(df, ["id"], lines=True, compressed=True)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [tuple(r) for r in want.orderBy("id").collect()]
