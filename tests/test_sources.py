"""Readers, writers and the streaming scan."""

import json

import pytest

from plumbline.functions.text import characters
from plumbline.operators import contamination
from plumbline.sources import readers, writers
from plumbline.streaming import contamination as streaming


def test_json_lines_drop_torn_rows_and_keep_the_last(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"item_id": 1, "v": 1}\n\n{"item_id": 2, "v": 5}\n{"item_id": 1, "v": 2}\n{"item_id": 3, "v"')
    got = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "item_id long, v long", "item_id")
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 5)]


def test_fallback(spark):
    name, df = readers.first_of([("bad", lambda: spark.read.parquet("/no/such")), ("good", lambda: spark.range(3))])
    assert name == "good" and df.count() == 3
    with pytest.raises(RuntimeError):
        readers.first_of([("bad", lambda: spark.read.parquet("/no/such"))])


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "out")
    assert writers.append_new(spark.range(5), path, "id") == 5
    assert writers.append_new(spark.range(8), path, "id") == 3
    assert spark.read.parquet(path).count() == 8


def test_stream_equals_batch(spark, tmp_path):
    corpus = spark.createDataFrame([("the cat sat on the mat",), ("a dog ran home",)], "text string")
    items = spark.createDataFrame([(1, "cat sat on fire"), (2, "x y z")], "item_id int, text string")
    corpus.write.parquet(str(tmp_path / "in"))
    streaming.run(spark, str(tmp_path / "in"), "text string", items, 3, str(tmp_path / "index"), str(tmp_path / "state"))
    got = sorted(map(tuple, streaming.scores(spark, items, 3, str(tmp_path / "index")).collect()))
    assert got == sorted(map(tuple, contamination.overlap(items, corpus, 3).collect()))


def test_scores_are_overwritten_and_summed_up(spark, tmp_path):
    path = str(tmp_path / "scores")
    for n in (5, 3):
        writers.write_scores(spark.range(n).selectExpr("id AS item_id", "id / 2 AS loss"), path)
    got = readers.json_lines(spark, path, "item_id long, loss double")
    assert sorted(map(tuple, got.collect())) == [(0, 0.0), (1, 0.5), (2, 1.0)]
    assert json.loads(writers.summary(spark.range(2))) == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError):
        writers.summary(spark.range(6), most=5)


def test_text_lines_are_not_blank(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  \ntwo words \n")
    assert sorted(r["text"] for r in readers.text_lines(spark, str(tmp_path / "a.txt")).collect()) == ["one", "two words "]


def test_small_scans_are_dealt_over_all_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    df = readers.table(spark, str(tmp_path), "t")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 100
    wide = spark.range(0, 100, 1, 64)
    assert readers.spread(wide) is wide


def test_separators_reach_every_index(spark):
    corpus, items = spark.createDataFrame([("abc",)], "text string"), spark.createDataFrame([(1, "bcx")], "item_id int, text string")
    assert contamination.overlap(items, corpus, 2, tokenizer=characters, separator="").first()["score"] == 0.5
    assert contamination.build_index(corpus, 2, tokenizer=characters, separator="-").filter("gram = 'a-b'").count() == 1
    assert contamination.index_size(corpus, 2, tokenizer=characters).first()[0] == 2
