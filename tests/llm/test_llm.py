"""Operators against brute force, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, embeddings, fingerprints, language, lines, mixing, ngram_join, packing, quality, sharding, substrings
from plumbline.llm.queries import vocabulary

WHITE = " \t\n\x0b\x0c\r"


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (None, 2)], "a long, b long")
    assert dict(map(tuple, common.connected_components(edges).collect())) == {5: 1, 4: 1, 3: 1, 1: 1, 9: 8, 8: 8}


def test_sharding(documents, empty):
    tree = sharding.base_tree(40)
    rows = sharding.shard(documents, tree).collect()
    assert len(rows) == documents.count() and sharding.shard(empty, tree).count() == 0
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    texts = [r["text"] for r in documents.collect()]
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)


def test_sharding_shares(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    counts = sharding.place(sharding.place(ids, sharding.base_tree(40), ["doc_id"], "s"), sharding.grow(sharding.base_tree(40)), ["doc_id"], "g")
    per = [r["count"] for r in counts.groupBy("s").count().collect()]
    moved = counts.filter("s <> g").count()
    assert len(per) == 40 and min(per) > 400 and max(per) < 600 and 380 < moved < 600


def test_mixing(documents, empty):
    rows = mixing.mixed(documents).collect()
    assert len(rows) == documents.count() and mixing.mixed(empty).count() == 0
    plan = mixing.plan_mix(documents).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in plan:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += sum(c["words"] for c in r["copies"])
        target[r["source"]] = r["target"]
        assert sum(c["words"] for c in r["copies"]) <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    left, free, want = sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (1, 2, 3, 1))), {}
    while over := [s for s in free if left * free[s] / sum(free.values()) > 3 * sizes[s]]:
        for s in over:
            want[s] = 3 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    want |= {s: left * w / sum(free.values()) for s, w in free.items()}
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in want.items()}
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in mixing.mixed(documents).collect()}
    assert mixing.mixed_documents(documents).columns == documents.columns


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    rows, n = [], 0
    for v in base:
        for k in range(int(rng.integers(1, 5))):
            rows.append((n, [float(x) for x in (v + 0.02 * k * rng.normal(size=64)).astype(np.float32)], int(n % 2) if k == 0 else 1))
            n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, rows[0][1], None), (n + 4, rows[0][1], rows[0][2]), (n + 5, [1.0, None], 1), (n + 6, [2.0, 0.0], 1), (n + 7, [4.0, 0.0], 1), (n + 8, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: (np.array(v, np.float32).astype(float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {(i, j) for i, (v, y) in good.items() for j, (u, z) in good.items() if i != j and y == z and len(u) == len(v) and v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.98}
    part = {i: i for i, _, _ in rows}
    for _ in part:
        for i, j in links:
            part[i] = part[j] = min(part[i], part[j])
    want = {i: (sum(1 for a, _ in links if a == i), part[i], part[i] == i) for i in part}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()} == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_word_ids():
    """Every word alone and whole texts give the tokenizer's own ids, in and outside settled scripts."""
    import random

    words = packing.WordIds(vocabulary())
    draw = random.Random(5)
    letters = "abcdeisthn'19.,-!é\u0301ÉßİΣσжЖ\u00a0日本ๆ\u2003"
    texts = ["".join(draw.choice(letters + " \n") for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["don't STOP", "a<|endoftext|>b <|END", "x" * 5000, "é" * 3000, "\x1c a\x1db \x85c", *[w.removesuffix("</w>") for w in words.model.get_vocab()]]
    got = words.encode([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert list(np.frombuffer(ids, "<u4")) == words.model.encode(text, add_special_tokens=False).ids, text


def test_packing(documents, empty):
    from tokenizers import Tokenizer

    capacity = 256
    rows = packing.pack(documents, vocabulary(), capacity).collect()
    model = Tokenizer.from_file(vocabulary())
    want = []
    for r in documents.collect():
        ids = np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want += [(r["doc_id"], k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity))]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.1 * sum(w[3] for w in want) / capacity + 1
    assert packing.pack(empty, vocabulary()).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(0)
    histogram = np.zeros(2049, np.int64)
    for n in np.minimum(2048, rng.lognormal(6, 1, 5000).astype(int) + 1):
        histogram[n] += 1
    used = np.zeros_like(histogram)
    for chosen, times in packing.plan(histogram, 2048):
        assert sum(chosen) <= 2048
        for n in chosen:
            used[n] += times
    assert (used == histogram).all()
    a = rng.random((8, 20))
    x = packing.nnls(a, a @ np.maximum(rng.normal(size=20), 0))
    assert (x >= 0).all() and sum(t for _, t in packing.plan(histogram, 2048)) <= 1.02 * (histogram @ np.arange(2049)) / 2048 + 2


def test_substrings(documents, empty):
    rows = [r for r in documents.filter("doc_id is not null").dropDuplicates().collect()]
    seen, gone = {}, defaultdict(set)
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        w = words(r["text"])
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (r["doc_id"], i)) != (r["doc_id"], i):
                gone[r["doc_id"]] |= set(range(i, i + 20))
    want = {r["doc_id"]: (len(words(r["text"])), len(gone[r["doc_id"]]), " ".join(w for i, w in enumerate(words(r["text"])) if i not in gone[r["doc_id"]])) for r in rows}
    got = substrings.drop_repeats(documents).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got if r["doc_id"] is not None} == want
    assert len(got) == documents.count() and substrings.drop_repeats(empty).count() == 0


def test_periodic_text(spark):
    df = spark.createDataFrame([(1, "a b " * 40), (2, "a b " * 12)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.drop_repeats(df).collect()}
    assert got == {1: 78, 2: 24}


def test_lines(spark):
    rows = [(i, "h", f"nav\nunique {i}\n{'rare' if i < 2 else 'x' + str(i)}") for i in range(6)] + [(9, None, "nav\nother"), (10, "h", None), (11, "h", ""), (11, "h", "")]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    got = {r["page_id"]: (r["text"], r["n_dropped"]) for r in lines.drop_boilerplate(df, "host", ratio=0.3, min_pages=3).collect()}
    assert got[0] == ("unique 0\nrare", 1) and got[9] == ("nav\nother", 0) and got[10] == (None, 0) and got[11] == ("", 0)
    salted = lines.drop_boilerplate(df, "host", ratio=0.3, min_pages=3, broadcast_lines=-1, pages_a_salt=2)
    assert sorted(map(str, salted.collect())) == sorted(map(str, lines.drop_boilerplate(df, "host", ratio=0.3, min_pages=3).collect()))


def jaccard_parts(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in part:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    return {i: (len(sets[i]), part[i]) for i in sets}


def test_ngram_join(documents, empty):
    want = jaccard_parts([(r["doc_id"], r["text"]) for r in documents.filter("doc_id is not null").collect()])
    got = ngram_join.link(documents).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert len(got) == documents.count() and ngram_join.link(empty).count() == 0


def test_ngram_join_of_a_crowd(spark):
    """A family of near copies larger than a key may hold, and many texts that share a passage."""
    rng = np.random.default_rng(1)
    base, passage = [f"b{i}" for i in range(80)], " ".join(f"p{i}" for i in range(25))
    rows = []
    for i in range(40):
        w = list(base)
        for k in rng.integers(0, 80, size=int(rng.integers(1, 5))):
            w[k] = f"e{i}-{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{i}-{k}" for k in range(30)) + " " + passage) for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_parts(rows)


def test_ngram_join_on_prefixes(spark):
    """Every key crowded, no hubs after the first: all links between parts come from shingle prefixes, sizes and likeness around the bound."""
    rng = np.random.default_rng(2)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(90):
        w = base[: int(rng.integers(80, 121))] if i % 3 else base[int(rng.integers(0, 60)) :]
        for k in rng.integers(0, len(w), size=int(rng.integers(0, 6))):
            w = [*w[:k], f"e{i % 7}-{k}", *w[k + 1 :]]
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), most=1, levels=0, rounds=0).collect()}
    want = jaccard_parts(rows)
    assert got == want and 1 < len({c for _, c in want.values()}) < 90


def test_prefix_pairs(spark):
    """No linked pair of different parts is missing from the prefix pairs."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"b{j}" if rng.random() > 0.03 else f"e{i}-{j}" for j in range(int(rng.integers(60, 90))))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in ngram_join.prefix_pairs(docs, common.keep(docs.selectExpr("doc_id AS doc", "doc_id AS part"), "crowd"), 5, 8).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked and linked <= got


def test_pairs_of_near_copies_grow_with_the_documents(spark, monkeypatch):
    """Families of near copies around the bound, many of them linked with none: components as by brute force, from few candidates a document."""
    rng = np.random.default_rng(4)
    rows = []
    for family, (share, n) in enumerate([(0.02, 150), (0.035, 250), (0.05, 100)]):
        for _ in range(n):
            rows.append(" ".join(f"f{family}-{k}" if rng.random() > share else f"e{rng.integers(5000)}" for k in range(150)))
    rows += [" ".join([*(f"f1-{k}" for k in range(40)), *(f"u{i}-{k}" for k in range(8 + i % 9))]) for i in range(60)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]
    made, verify = [], ngram_join.verify
    monkeypatch.setattr(ngram_join, "verify", lambda pairs, *more: (made.append(pairs.count()), verify(pairs, *more))[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parts = jaccard_parts(rows)
    assert got == parts and 100 < len({c for _, c in parts.values()}) < 500
    assert sum(made) < 8 * len(rows), made


def test_delta_pairs(spark):
    """No linked pair of different parts is missing from links to references, delta pairs and pairs across references; one id may stand for two texts."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"b{i % 2}-{j}" if rng.random() > 0.03 else f"e{rng.integers(40)}" for j in range(int(rng.integers(60, 90))))) for i in range(80)]
    rows += [(200 + i, " ".join([*(f"b0-{j}" for j in range(45)), *(f"b1-{j}" for j in range(i))])) for i in range(0, 21, 3)] + [(0, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    crowd = common.keep(docs.selectExpr("doc_id AS doc", "doc_id AS part").distinct(), "crowd")
    table = ngram_join.prefix_table(docs, crowd, 5, 8, families=True)
    assert table.filter("ref is not null").count() > 40
    near = {tuple(r) for r in ngram_join.reference_links(table).collect()}
    part = {i: i for i, _ in rows}
    for _ in part:
        for a, b in near:
            part[a] = part[b] = min(part[a], part[b])
    table = table.drop("part").join(spark.createDataFrame(list(part.items()), "doc long, part long"), "doc")
    got = {tuple(r) for r in ngram_join.delta_pairs(table).unionByName(ngram_join.prefix_pairs(docs, crowd, 5, 8, table)).collect()}
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for i, t in rows]
    linked = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 75 * len(x | y)}
    assert near and near <= linked and {(a, b) for a, b in linked if part[a] != part[b]} <= got


def test_quality(spark, empty):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["good", "fine", "well"] if i % 2 else ["bad", "poor", "junk"], 5)) + f" t{i} of the", i % 2) for i in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.fit(quality.sample_labelled(docs, labels.filter("doc_id < 200")))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.unionByName(spark.createDataFrame([(999, None)], "doc_id long, text string")), model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in range(200, 300)]) > 0.95
    plain = quality.fit(quality.sample_labelled(docs, labels.limit(0)))
    assert quality.score(docs, plain).select("score").distinct().first()[0] == 0.5 and quality.score(empty, plain).count() == 0


def test_language(spark, empty):
    one, two = "the cat and the dog of this house with them ", "der hund und die katze von diesem haus mit "
    rows = [(i, (one if i % 2 else two) * (1 + i % 3), "en" if i % 2 else "de") for i in range(40)] + [(50, None, None), (51, "12 34 !!", "en"), (52, one * 6 + two, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    assert all(got[i] == ("en" if i % 2 else "de") for i in range(40)) and got[50] == got[51] == "und" and got[52] == "en"
    assert language.identify(empty, model).count() == 0 and language.train(empty)[0] == []


def brute_lanes(spark, text):
    return fingerprints.with_lanes(spark.createDataFrame([(text,)], "t string"), F.col("t"), "v").first()["v"]


def test_fingerprints(spark, documents, empty):
    rows = documents.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.desc("doc_id")).collect()
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(documents.filter("doc_id is not null").dropDuplicates(["doc_id"]), rows_per_range=3).collect()}
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, u = r["text"] or "", after["text"] or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert (got[r["doc_id"]]["n_chars"], got[r["doc_id"]]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[r["doc_id"]]["near_edited"] <= 1 and 0 <= got[r["doc_id"]]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[2]["fingerprint"] != got[1]["fingerprint"] and got[7]["near_edited"] > 0.4
    assert fingerprints.fingerprint_edits(documents).count() == documents.count() and fingerprints.fingerprint_edits(empty).count() == 0
    whole, a, b = (np.array(brute_lanes(spark, t)) for t in ("x y\nz", "x y", "z"))
    assert ((a + b) % fingerprints.MODULUS == whole).all()  # pieces of lines add up, in any order


def test_pipeline(spark, documents):
    import corpus_pipeline

    docs = documents.filter("doc_id is not null").dropDuplicates(["doc_id"])
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.keep(stage(spark, kept, ""), name)
        assert kept.columns == docs.columns, name
        if name == "language_id":
            assert {r[0] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in before.collect() if any(c.isalpha() for c in r["text"] or "")}
        if name == "ngram_jaccard_join":
            parts = jaccard_parts([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, (_, c) in parts.items() if i == c}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert packed.filter("piece = 0").count() == kept.count()


def test_likeness_of_long_texts(spark):
    whole = "\n".join(f"line {i}" for i in range(40_000))
    third = "\n".join(f"line {i}" if i >= 13_333 else f"other {i}" for i in range(40_000))
    apart = "\n".join(f"else {i}" for i in range(40_000))
    again = "the same line\n" * 2_000
    rows = spark.createDataFrame([(whole, third, apart, again, "the same line\n" * 1_000)], "a string, b string, c string, d string, e string")
    for c in "abcde":
        rows = fingerprints.with_lanes(rows, F.col(c), f"v{c}")
    like = lambda x, y: fingerprints.likeness(F.col(f"v{x}"), F.col(f"v{y}"))
    got = rows.select(like("a", "b").alias("third"), like("a", "c").alias("apart"), like("d", "e").alias("half"), fingerprints.encode(F.col("va")).alias("hex"), "va").first()
    assert abs(got["third"] - 2 / 3) < 0.2 and got["apart"] < 0.4
    assert got["half"] == pytest.approx(1 - 1 / 5)  # one piece n or n / 2 times: 1 - (n / 2)^2 / (n^2 + (n / 2)^2)
    assert [int(got["hex"][i : i + 8], 16) for i in range(0, 512, 8)] == got["va"] and len(got["hex"]) == 512
