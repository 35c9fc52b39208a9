"""Hash collisions, clashing names, long texts, ties and repeats; operators against plain Python versions of their own method."""

import math
import os
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, embeddings, fingerprints, language, lines, mixing, ngram_join, packing, quality, sharding, substrings
from plumbline.llm.queries import QUERIES, vocabulary

from test_llm import jaccard_parts, words

REPO = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the hash so far as its seed; nulls leave it as it is. Plain ints are longs, ``("int", v)`` are ints."""
    h = 42
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool):
            data = struct.pack("<i", int(v))
        elif isinstance(v, tuple):
            data = struct.pack("<i", v[1])
        elif isinstance(v, int):
            data = struct.pack("<q", v)
        else:
            data = v.encode()
        h = xxhash.xxh64_intdigest(data, h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, n))


@pytest.mark.parametrize("size", [64, 128, 192])
def test_words_made_of_the_same_stretches(spark, size):
    x, y = "x" * size, "y" * size
    one, two = x + y + y + x, y + x + x + y
    sizes, a, b, _ = common.word_hashes([f"{one} {two}".encode()], kinds=(0, 1))
    assert sizes.tolist() == [2] and a[0] != a[1] and b[0] != b[1] and a[0] != b[0]
    texts = [" ".join(one if k == 13 else f"w{k}" for k in range(26)), " ".join(two if k == 13 else f"w{k}" for k in range(26))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.drop_repeats(df).collect()] == [0, 0]
    long = spark.createDataFrame([(0, f"{one} a"), (1, f"{two} a")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.link(long).collect()} == {0: 0, 1: 1}
    assert len(set(quality.features([one.encode()])[1]) & set(quality.features([two.encode()])[1])) == 0


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice([9, 32, *range(97, 105), 200], int(n)).astype(np.uint8)) for n in rng.integers(0, 400, 300)]
    seen = {}
    sizes, a, b, begin = common.word_hashes(texts, kinds=(0, 1))
    at = 0
    for t, n, start in zip(texts, sizes.tolist(), begin[:-1].tolist()):
        assert start == at and n == len(t.split())
        for w in t.split():
            assert seen.setdefault(w, (a[at], b[at])) == (a[at], b[at])
            at += 1
    assert len({v[0] for v in seen.values()}) == len({v[1] for v in seen.values()}) == len(seen)


def test_workers_need_no_package(tmp_path):
    """A driver that alone has the package on its path."""
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from plumbline.llm import embeddings, language, ngram_join, packing, quality, substrings
from plumbline.llm.queries import vocabulary
df = spark.createDataFrame([(i, " ".join(f"w{{k * (i // 2 + 1)}}" for k in range(40)), "en", i % 2) for i in range(6)], "doc_id long, text string, lang string, quality int").repartition(2)
print("GOT", sum(r["n_removed"] for r in substrings.drop_repeats(df).collect()), len({{r["component_id"] for r in ngram_join.link(df).collect()}}),
      packing.pack(df, vocabulary()).count(), {{r["lang_pred"] for r in language.identify(df, language.train(df)).collect()}},
      quality.score(df, quality.fit(quality.sample_labelled(df.select("doc_id", "text"), df.select("doc_id", "quality")))).count(),
      embeddings.near_duplicates(spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(4)], "vec_id long, embedding array<double>, label int")).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    env["PYTHONPATH"] = ":".join(p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != REPO)
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT 120 3 6 {'en'} 6 4" in said.stdout, said.stdout[-500:] + said.stderr[-2000:]


#: Names that operators use inside, and names of their results.
NAMES = """_kept n_dropped _lines _host _row _position _text_hash _id lang_pred score found _gone gone _h _bucket _value _base _b _inside doc key text_key label dims filter node copies c0 c1 c2 c3 _range _at
_th _lanes _pieces _edited _last _next_text size shard slot grown_shard _region _rack text_hash first_position _k0 _k1 _nth _lists _positions _salt _page_salt total host line lines spans dealt seed path
piece start length ids_crc32 _rank _runs _length component_id n_shingles component part hub a b _large _salts _source target taken vector v1 v2 features _text held_out""".split()


@pytest.fixture
def crowded(documents):
    docs = documents.withColumn("vec_id", F.col("doc_id"))
    return docs, docs.select("*", *[F.lit("mine").alias(n) for n in NAMES if n not in docs.columns])


def same(one, two):
    return Counter(map(str, one.collect())) == Counter(map(str, two.collect()))


@pytest.mark.parametrize(
    "of",
    [
        lambda df: sharding.shard(df, sharding.base_tree(8)), mixing.mixed, lambda df: packing.pack(df, vocabulary(), 256).select("doc_id", "piece", "start", "length", "ids_crc32"), substrings.drop_repeats, ngram_join.link,
        lambda df: language.identify(df, language.train(df)), fingerprints.fingerprint_edits, lambda df: quality.score(df, quality.Model(np.zeros(1 << 20, np.float32), np.zeros(1 << 20, np.float32), 0.0, 1.0, 0.0)),
    ],
    ids=["op1", "op2", "op4", "op5", "op7", "op9", "op10", "op8"],
)
def test_other_columns_do_not_matter(crowded, of):
    plain, wide = crowded
    assert same(of(plain), of(wide))


def test_other_columns_pass_through(crowded):
    plain, wide = crowded
    extra = [n for n in wide.columns if n not in plain.columns]
    for of in (lambda df: lines.drop_boilerplate(df, "source", ratio=0.2, min_pages=2), lambda df: lines.drop_boilerplate(df, "source", ratio=0.2, min_pages=2, broadcast_lines=-1, pages_a_salt=2), ngram_join.first_of_each, mixing.mixed_documents):
        got, want = of(wide), of(plain)
        assert got.columns[: len(wide.columns)] == wide.columns and len(set(map(str.lower, got.columns))) == len(got.columns)
        assert {tuple(r) for r in got.select(*extra).distinct().collect()} <= {("mine",) * len(extra)}
        assert same(got.select(*plain.columns), want.select(*plain.columns))
    dropped = lines.drop_boilerplate(wide, "source", ratio=0.2, min_pages=2)
    assert dropped.columns[-1] == "n_dropped_" and lines.drop_boilerplate(plain, "source").columns[-1] == "n_dropped"


def test_vectors_beside_other_columns(spark):
    rows = [(i, [1.0, i / 100, 0.5], 1) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wide = df.select("*", *[F.lit("mine").alias(n) for n in NAMES if n != "label"])
    assert same(embeddings.near_duplicates(df), embeddings.near_duplicates(wide))


def test_stages_keep_other_columns(spark, crowded):
    import corpus_pipeline

    plain, wide = (df.filter("doc_id is not null").dropDuplicates(["doc_id"]).drop("vec_id") for df in crowded)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, wide, ""), stage(spark, plain, "")
        assert got.columns == wide.columns and same(got.select(*plain.columns), want), name


def test_empty_tables(spark, empty):
    import corpus_pipeline

    assert lines.drop_boilerplate(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0 and ngram_join.first_of_each(empty).count() == 0
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = common.keep(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_texts_longer_than_a_chunk(spark):
    whole = prose(1, 60_000)
    assert len(whole) > common.CHUNK_BYTES
    near = " ".join("changed" if k % 4000 == 0 else w for k, w in enumerate(whole.split()))
    word = "é" * (common.CHUNK_BYTES + 5)
    rows = [(1, whole), (2, near), (3, word), (4, prose(2, 30)), (5, f"{word} {prose(3, 25)}"), (6, f"x {prose(3, 25)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = jaccard_parts(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect()} == parts and parts[2][1] == 1
    seen, gone = set(), Counter()
    for i, t in rows:
        w, mine = words(t), set()
        for k in range(len(w) - 19):
            gram = tuple(w[k : k + 20])
            mine |= set(range(k, k + 20)) if gram in seen else set()
            seen.add(gram)
        gone[i] = len(mine)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.drop_repeats(df).collect()} == {i: gone[i] for i, _ in rows} and gone[2] > 50_000
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(vocabulary()).encode(whole, add_special_tokens=False).ids, 0], "<u4")
    got = sorted((r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(df.filter("doc_id = 1"), vocabulary()).collect())
    assert got == [(k, min(2048, len(ids) - k), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    trained = spark.createDataFrame([(whole, "aa"), ("的是不了人我在有他这 " * 9, "zz")], "text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, language.train(trained)).collect()}
    assert found[1] == found[2] == "aa"
    model = quality.fit(quality.sample_labelled(df, spark.createDataFrame([(1, 1), (4, 0), (6, 0), (2, 1)], "doc_id long, quality int")))
    assert {r["doc_id"] for r in quality.score(df, model).filter("score between 0 and 1").collect()} == set(range(1, 7))
    assert fingerprints.fingerprint_edits(df).count() == 6


def test_rows_without_ids(spark):
    """Different texts that share the null id, or one id, are texts of their own."""
    passage = prose(9, 30)
    rows = [(None, f"{prose(k, 10)} {passage} {prose(k + 50, 5)}") for k in range(3)] + [(7, f"{passage} z"), (7, prose(70, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in substrings.drop_repeats(df).collect())
    assert got == [(False, 31, 0), (False, 40, 0), *[(True, 45, 30)] * 3]


def test_frequent_seeds_are_dealt():
    seeds = np.array([5] * 100 + list(range(10, 40)) + [5] * 7 + [10] * 3, np.uint64)
    dealt = substrings.deal(seeds)
    assert ((dealt == 0) & (seeds == 5)).sum() == 2 and not dealt[seeds != 5].any() and len(set(dealt[seeds == 5].tolist())) == 106


def test_a_span_that_differs_at_its_source_stays(spark, monkeypatch):
    """With hashes that cannot tell words apart, the comparison at source coordinates does."""
    real = substrings.word_hashes
    monkeypatch.setattr(substrings, "word_hashes", lambda texts, kinds=(0,): (lambda got: (got[0], *[np.zeros_like(h) for h in got[1:-1]], got[-1]))(real(texts, kinds=kinds)))
    df = spark.createDataFrame([(1, prose(1, 30)), (2, prose(2, 30))], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.drop_repeats(df).collect()] == [0, 0]


def descend_tree(key, tree):
    def draw(level, parent, weights):
        best = []
        for j, w in enumerate(weights):
            h = spark_hash(key, level, ("int", parent), ("int", j))
            best.append((-math.log(((h >> 11) + 0.5) / 2**53) / w, j))
        return min(best)[1]

    r = draw("region", 0, [sum(w for rack in region for _, w in rack) for region in tree.regions])
    k = draw("rack", first := sum(map(len, tree.regions[:r])) * 0 + r, [sum(w for _, w in rack) for rack in tree.regions[r]])
    rack = sum(len(x) for x in tree.regions[:r]) + k
    return tree.regions[r][k][draw("shard", rack, [w for _, w in tree.regions[r][k]])][0]


def test_shards_by_draws_in_python(spark):
    tree = sharding.base_tree(40)
    changed = sharding.Tree((((((0, 3.0), *tree.regions[0][0][1:]), *tree.regions[0][1:]), *tree.regions[1:])))
    ids = [*range(300), -5, 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r["doc_id"]: (r["s"], r["c"]) for r in sharding.place(sharding.place(df, tree, ["doc_id"], "s"), changed, ["doc_id"], "c").collect()}
    region = {s for rack in tree.regions[0] for s, _ in rack}
    for i in ids:
        assert got[i] == (descend_tree(i, tree), descend_tree(i, changed))
        s, c = got[i]
        assert s == c or s in region or c in region
        assert not (s in region and c in region and s != c) or c in {x for x, _ in tree.regions[0][0]} or s in {x for x, _ in tree.regions[0][0]}


def mix_in_python(rows, weights=(1, 2, 3), slopes=(-1.0, 0.0, 1.0), repeats=3, seed=17):
    """Rows (id, text, source) to copies (epoch, words, position) of each, by the source's order."""
    size = [len(words(t)) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    have = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight, slope = ({s: v[k % 3] for k, s in enumerate(sources)} for v in (weights, slopes))
    target, left, free = {}, float(sum(size)), list(sources)
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > repeats * have[s]]:
        for s in over:
            target[s] = float(repeats * have[s])
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    for s in free:
        target[s] = left * weight[s] / sum(weight[x] for x in free)
    copies = [[] for _ in rows]
    for s in sources:
        order = []
        for k, (i, t, x) in enumerate(rows):
            if x == s:
                text_hash = signed(spark_hash(("int", seed), t))
                order.append((signed(spark_hash(("int", seed), i, text_hash)), (i is not None, i or 0), text_hash, k))
        begin, budget = 0, math.floor(target[s] + 0.5)
        for e in range(repeats):
            for *_, k in sorted(order):
                n = max(0, min(size[k], budget - begin))
                if n:
                    x, a, b = begin / target[s], 1 - slope[s] / 2, slope[s]
                    copies[k].append((e, n, x if b == 0 else (math.sqrt(a * a + 2 * b * x) - a) / b))
                begin += size[k]
    return size, copies


def test_mixing_in_python(documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    size, copies = mix_in_python(rows)
    want = Counter((i, n, sum(c[1] for c in got), round(min((c[2] for c in got), default=-1), 9)) for (i, _, _), n, got in zip(rows, size, copies))
    found = mixing.mixed(documents).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"], round(-1 if r["first_position"] is None else r["first_position"], 9)) for r in found) == want
    places = [r["first_position"] for r in found if r["first_position"] is not None]
    assert places == sorted(places) and sum(r["first_position"] is None for r in found[: len(places)]) == 0
    stream = Counter((i, t, s) for (i, t, s), n, got in zip(rows, size, copies) for c in got if 2 * c[1] >= n)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed_documents(documents).collect()) == stream


def pieces_in_python(text):
    out = []
    for line in re.split(r"[\n\r]", text):
        piece = []
        for word in re.findall(r"[^\x20\x09-\x0D]+[\x20\x09\x0B\x0C]*", line):
            piece.append(word)
            if word.rstrip(" \t\x0b\x0c")[-1] in fingerprints.ENDS:
                out.append("".join(piece).rstrip(" \t\x0b\x0c"))
                piece = []
        if piece:
            out.append("".join(piece).rstrip(" \t\x0b\x0c"))
    return out


def lanes_in_python(text):
    out = [0] * 64
    for piece in pieces_in_python(text or ""):
        for s in range(8):
            h = spark_hash(("int", s), piece)
            for half, value in enumerate((h, h >> 8)):
                for j in range(4):
                    out[(2 * s + half) * 4 + j] += 2 * ((value >> (16 * j)) & 0xFF) - 255
    return [v % (1 << 32) for v in out]


def test_lanes_in_python(spark, documents):
    docs = documents.filter("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for rows_per_range in (3, 2000):
        for r in fingerprints.fingerprint_edits(docs, rows_per_range=rows_per_range).collect():
            t = text[r["doc_id"]]
            after = text[max((i for i in text if i < r["doc_id"]), default=max(text))]
            edited, lanes = t[: len(t) - len(t) // 3] + after[: len(t) // 3], lambda x: "".join(f"{v:08x}" for v in lanes_in_python(x))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (lanes(t), lanes(edited))


def test_pieces_come_from_their_words(spark):
    line = prose(3, 400)
    assert " ".join(pieces_in_python(line)) == line and len(pieces_in_python(line)) > 20
    before, after = Counter(pieces_in_python(line)), Counter(pieces_in_python("new " + line))
    assert sum((before - after).values()) <= 2 and sum((after - before).values()) <= 2
    df = spark.createDataFrame([(line, "new " + line)], "a string, b string")
    both = fingerprints.with_lanes(fingerprints.with_lanes(df, F.col("a"), "va"), F.col("b"), "vb")
    assert both.select(fingerprints.likeness(F.col("va"), F.col("vb"))).first()[0] > 0.9
    text = " one two\nthree, four  five \r\n\n six\t,\tseven eight. "
    assert spark.createDataFrame([(text,)], "t string").select(fingerprints.pieces(F.col("t"))).first()[0] == pieces_in_python(text) == ["one two", "three,", "four  five", "six\t,", "seven eight."]


def test_ids_without_order_or_missing(spark):
    """Ranges of skewed ids, repeated ids and null ids give the same neighbours as one range."""
    rows = [(i**5, prose(i, 12)) for i in range(60)] + [(None, prose(100 + i, 12)) for i in range(40)] + [(32, "twin a"), (32, "twin b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [Counter(map(str, fingerprints.fingerprint_edits(df, rows_per_range=n).collect())) for n in (10_000, 4)]
    assert got[0] == got[1] and sum(got[0].values()) == len(rows)


def test_dual_descent_finds_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, int(rng.integers(2, 6)), replace=False)) for _ in range(40)]
    y = np.where(np.array([3 in r for r in rows]) ^ (rng.random(40) < 0.15), 1.0, -1.0)
    ratio, cost = rng.normal(size=12), np.full(40, 0.7)
    w, bias = quality.descend(rows, y, ratio, cost, 2000, 1)
    dense = np.zeros((40, 13))
    for k, r in enumerate(rows):
        dense[k, r] = ratio[r] / np.linalg.norm(ratio[r])
    dense[:, 12] = 1
    primal = lambda v: 0.5 * v @ v + cost @ np.maximum(0, 1 - y * (dense @ v))
    gram, alpha = (dense * y[:, None]) @ (dense * y[:, None]).T, np.zeros(40)
    for _ in range(60_000):  # projected gradient on the dual
        alpha = np.clip(alpha + 0.02 * (1 - gram @ alpha), 0, cost)
    best = alpha.sum() - 0.5 * alpha @ gram @ alpha
    assert primal(np.append(w, bias)) == pytest.approx(best, rel=2e-2) and primal(np.append(w, bias)) >= best - 1e-6


def test_sampling_ties_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "good"), (1, "good"), (2, "bad"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 5), (None, 1)], "doc_id long, quality int")
    got = sorted((r["doc_id"], r["label"]) for r in quality.sample_labelled(docs, labels).collect())
    assert got == [(1, 1), (1, 1), (2, 0)]
    first = {r["doc_id"] for r in quality.sample_labelled(docs, labels, max_rows=1).collect()}
    assert first == {min((signed(spark_hash(("int", 11), i)), i) for i in (1, 2))[1]}


def em_in_python(likelihood, counts, rounds=12):
    """Proportions by plain loops."""
    n, m = likelihood.shape
    share = [1 / m] * m
    for _ in range(rounds):
        new = [0.0] * m
        for i in range(n):
            total = sum(likelihood[i][k] * share[k] for k in range(m))
            for k in range(m):
                new[k] += counts[i] * likelihood[i][k] * share[k] / total
        new = [v / sum(counts) for v in new]
        done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
        share = new
        if done:
            break
    return share


def test_mixtures_in_python():
    rng = np.random.default_rng(5)
    for _ in range(20):
        likelihood, counts = rng.random((30, 3)) ** 3 + 1e-3, rng.integers(1, 9, 30).astype(float)
        likelihood /= likelihood.max(1, keepdims=True)
        top, score = language.infer(likelihood, counts, penalty=-1.0)  # nothing is dropped
        share = em_in_python(likelihood, counts)
        assert top == int(np.argmax(share)) and score == pytest.approx(max(share))
        top, score = language.infer(likelihood, counts, penalty=1e9)  # one language stays
        assert score == 1.0
        # The chosen set's penalised likelihood is not beaten by dropping its weakest member.
    alone = np.array([[1.0, 1e-3, 1e-3]] * 20)
    assert language.infer(alone, np.ones(20), 2.0) == (0, 1.0)
    mixed = np.array([[1.0, 1e-6, 1e-6]] * 12 + [[1e-6, 1e-6, 1.0]] * 8)
    top, score = language.infer(mixed, np.ones(20), 2.0)
    assert top == 0 and score == pytest.approx(0.6, abs=0.01)
    many = np.full((40, 200), 1e-3)
    many[:30, 7], many[30:, 150] = 1.0, 1.0
    top, score = language.infer(many, np.ones(40), 3.0)
    assert top == 7 and score == pytest.approx(0.75, abs=0.02)


@pytest.mark.parametrize("name, column, table, least", [("op8_quality_classifier", "predicted", "labels", 0.85), ("op9_language_id", "lang_pred", "documents", 0.95)])
def test_held_out_accuracy(spark, name, column, table, least):
    sf = SMALL.replace("0.001", "0.01")
    truth = "quality" if table == "labels" else "lang"
    joined = QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/{table}.parquet").select("doc_id", F.col(truth).alias("truth")).filter("truth is not null"), "doc_id")
    assert joined.agg(F.avg((F.col(column) == F.col("truth")).cast("int"))).first()[0] >= least


@pytest.mark.parametrize("size", [32, 64, 256, 1024])
def test_filters_meet_at_the_bound(size):
    rng = np.random.default_rng(size)
    one = embeddings.unit_rows(rng.normal(size=(400, 64)))
    apart = rng.normal(size=one.shape)
    apart = embeddings.unit_rows(apart - (apart * one).sum(1, keepdims=True) * one)
    pair = [embeddings.decode(v, size, 5) for v in (one, 0.98 * one + math.sqrt(1 - 0.98**2) * apart)]
    met = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(*pair)])
    assert met >= 0.99 and np.mean([len(f) for f in pair[0]]) < 40
    code = embeddings.codes(64, size, 5)
    whole = (one[:5, :32] @ code[0].T)[:, :, None] + (one[:5, 32:] @ code[1].T)[:, None, :]
    for row, found in zip(whole.reshape(5, -1), pair[0]):
        assert set(found) == set(np.flatnonzero(row >= row[found].min() - 1e-12))  # whole lists, without gaps


def test_filters_a_vector_do_not_grow():
    rng = np.random.default_rng(0)
    vectors = embeddings.unit_rows(rng.normal(size=(300, 64)))
    per = [np.mean([len(f) for f in embeddings.decode(vectors, embeddings.code_size(n), 5)]) for n in (10**4, 10**7)]
    assert per[1] <= 1.2 * per[0] and embeddings.code_size(10**7) ** 2 * embeddings.ROWS_A_FILTER >= 10**7 * embeddings.FILTERS


def test_crowded_filters_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 7)
    monkeypatch.setattr(embeddings, "TILE", 3)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 16))
    rows = [(i, [float(x) for x in base[i % 3] + 0.06 * rng.normal(size=16)], 1) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = embeddings.unit_rows(np.array([v for _, v, _ in rows]))
    links = (unit @ unit.T >= 0.98) & ~np.eye(90, dtype=bool)
    part = np.arange(90)
    for _ in range(90):
        part = np.array([min([part[i], *part[links[i]]]) for i in range(90)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (int(links[i].sum()), int(part[i])) for i in range(90)}


def best_fit(histogram, capacity):
    return sum(times for _, times in packing._carried_out(histogram, capacity, 32, []))


def test_packing_never_exceeds_best_fit():
    rng = np.random.default_rng(1)
    for mean, sigma, n in ((6, 1, 4000), (5, 1.5, 3000), (7, 0.3, 2000), (4, 0.5, 500), (6.5, 0.8, 50)):
        histogram = np.bincount(np.minimum(2048, rng.lognormal(mean, sigma, n).astype(int) + 1), minlength=2049)
        assert sum(times for _, times in packing.plan(histogram, 2048)) <= best_fit(histogram, 2048)


def lines_in_python(rows, ratio, min_pages=3):
    pages, on = Counter(s for _, _, s in rows), defaultdict(Counter)
    for _, t, s in rows:
        for line in {x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")} - {""} if t is not None else ():
            on[s][line] += 1
    gone = {s: {x for x, n in c.items() if n >= min_pages and n > ratio * pages[s]} for s, c in on.items()}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r") not in gone.get(s, ())), s) for i, t, s in rows]


def test_pipeline_in_python(spark, tmp_path):
    """run() over a written table, against plain versions of all five stages."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        text = "\n".join([*(["Subscribe to our news"] if i % 4 == 0 else []), prose(i if i % 10 else 0, int(rng.integers(20, 400)) if i % 10 else 120), f"closing line {i}"])
        rows.append((i, text, "en", f"s{i % 4}" if i % 7 else None))
    rows += [(70, None, None, "s1"), (71, "", "en", "s1"), (72, "12 34 !?", "en", "s2"), (73, "Subscribe to our news", "en", "s0"), (74, prose(3, 5000), "en", "s3")]
    spark.createDataFrame([(*r[:2], r[2], r[3], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t)]
    kept = lines_in_python(kept, corpus_pipeline.LINE_RATIO)
    parts = jaccard_parts([(i, t) for i, t, _ in kept])
    kept = [r for r in kept if parts[r[0]][1] == r[0]]
    assert 0 < len(kept) < 61 and any("Subscribe" not in t and i % 4 == 0 for i, t, _ in kept)
    size, copies = mix_in_python(kept)
    model, want = Tokenizer.from_file(vocabulary()), Counter()
    for (i, t, _), n, got in zip(kept, size, copies):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for c in got:
            if 2 * c[1] >= n:
                want.update((i, k // 2048, k, min(2048, len(ids) - k), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(held)]])
        assert [o for o, _ in sorted(held)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_a_shared_folder_must_be_named(spark, monkeypatch):
    from plumbline.sources import kept

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        kept.work_dir(Session())
    assert re.search("plumbline|checkpoint|tmp", kept.work_dir(spark))
