"""Incremental contamination: corpus files arrive as a stream and item n-grams found so far accumulate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import ngrams, words
from plumbline.operators.contamination import grams_of


def found_grams(stream: DataFrame, items: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """The item n-grams in arriving documents: a stream-static semi join, no state."""
    wanted = grams_of(items, "item_id", n).select("gram").distinct()
    return stream.select(F.explode(ngrams(words(F.col(text_col)), n)).alias("gram")).join(wanted, "gram", "left_semi")


def run(spark: SparkSession, source: str, schema: str, items: DataFrame, n: int, index: str, checkpoint: str) -> None:
    """Process what has arrived; each batch adds its distinct hits to the index files. Restarting repeats at most a batch, which ``scores`` absorbs."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = found_grams(stream, items, n).writeStream.foreachBatch(lambda df, _: df.distinct().write.mode("append").parquet(index)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def scores(spark: SparkSession, items: DataFrame, n: int, index: str) -> DataFrame:
    hits = spark.read.schema("gram string").parquet(index).distinct().withColumn("_hit", F.lit(1))
    score = grams_of(items, "item_id", n).join(hits, "gram", "left").groupBy("item_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("score"))
    return items.select("item_id").join(score, "item_id", "left").select("item_id", F.coalesce("score", F.lit(0.0)).alias("score"))
