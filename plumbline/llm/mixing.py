"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target in words: its weight's share of the budget, capped at ``most_repeats``
times the words it has, the excess going to the other sources by weight until none is above.
Inside a source, documents follow a seeded hash order, again for each repeat, until the target is
reached; the copy that crosses it is taken in part. The source's weight changes over training time t in
[0, 1] as ``a + b t`` with integral 1; its integral times the target is the cumulative demand, and
the inverse of that demand at a copy's first word is the copy's training position. Documents
are range-sorted by position.

Defined cases: a null or blank text has size 0, is taken 0 times and has no position; the null
source is a source of its own, last in order; repeated rows count as often as they stand; an empty
table gives an empty result. Ties of the hash are ordered by id, then text. Other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, hash_bits, keep, plain, running_offset


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_repeats: int = 3, slopes: tuple[float, ...] = (-1.0, 0.0, 1.0)) -> DataFrame:
    """``(source, source_size)`` to targets and schedules; one row a source.

    The cap level is found by sorting sources by cap / weight: with the k tightest capped, the rest share
    what is left. Sources are few (one row each), so their order is one window.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("_n") % len(values) + 1).cast("int"))
    out = sizes.withColumn("_n", order).withColumn("weight", pick(weights)).withColumn("slope", pick(slopes))
    out = out.withColumn("_cap", F.col("source_size") * F.lit(float(most_repeats)))
    tight = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_n"))
    before, total = tight.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(total) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("_level", left / free)  # the level if all tighter sources are capped and none from here on
    met = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("weight")).alias("order"), F.col("_n"), F.col("_level")))
    out = out.withColumn("_final", F.min(met).over(total)["_level"])  # the first in order that fits
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("weight"), F.col("_cap")))
    return out.select("source", "source_size", "weight", "slope", target.alias("target"))


def position(words: Column, target: Column, slope: Column) -> Column:
    """Training time at which the cumulative demand ``target * (a t + b t^2 / 2)`` reaches ``words``; a = 1 - b/2."""
    x, a = words / target, F.lit(1.0) - slope / 2
    return F.when(slope == 0, x).otherwise((F.sqrt(a * a + slope * x * 2) - a) / slope)


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, most_repeats: int = 3, **targets) -> DataFrame:
    """``(doc_id, source, size, text_hash, source_size, target, copies)``; copies: array of (epoch, words, position)."""
    slim = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(text_col)).alias("text_hash"),
    )
    slim = keep(slim.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_hash")), "mix")
    sizes = keep(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    bits = hash_bits(sizes.agg(F.max("rows")).first()[0] or 0)
    goals = source_targets(sizes.select("source", "source_size"), most_repeats=most_repeats, **targets)
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target", "slope")
    placed = running_offset(slim, ["source"], "_h", ["doc_id", "text_hash"], F.col("size"), "_before", bits)
    placed = placed.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.round("target").cast("long")
    copies = []
    for e in range(most_repeats):
        begin = F.col("source_size") * e + F.col("_before")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - begin))
        copies.append(F.struct(F.lit(e).alias("epoch"), words.alias("words"), position(begin.cast("double"), F.col("target"), F.col("slope")).alias("position")))
    taken = F.filter(F.array(*copies), lambda c: c["words"] > 0)
    return placed.select("doc_id", "source", "size", "text_hash", "source_size", "target", F.when(F.col("target") > 0, taken).otherwise(F.array().cast("array<struct<epoch:int,words:bigint,position:double>>")).alias("copies"))


def mixed(df: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per document with the words taken of it, range-sorted by its first training position."""
    plan = plan_mix(df, id_col, **how)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    out = plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("copies").alias("n_copies"), F.array_min(F.transform("copies", lambda c: c["position"])).alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The training stream with ``df``'s columns: whole documents, one row for each copy, sorted by position.

    The copy that crosses its source's target stays if at least half of it is inside. Rows that
    agree in id, text and source are one row of the plan repeated; each stands as often as it was planned. Texts are shuffled twice:
    to their row of the plan, which also numbers repeated rows, and into order.
    """
    rows, (doc, text, source) = plain(df, id_col, text_col, source_col)
    plan = plan_mix(rows, doc, text, source, **how)
    key = [F.xxhash64(F.lit(i), "doc_id", "text_hash", F.col("source").isNull(), "source").alias(f"_k{i}") for i in (0, 1)]
    whole = F.transform(F.filter("copies", lambda c: c["words"] * 2 >= F.col("size")), lambda c: c["position"])
    chosen = plan.select(*key, whole.alias("_positions")).groupBy("_k0", "_k1").agg(F.collect_list("_positions").alias("_lists"))
    hashed = rows.withColumns({"doc_id": F.col(doc), "text_hash": F.xxhash64(F.lit(how.get("seed", 17)), F.col(text)), "source": F.col(source)}).select(*rows.columns, *key)
    nth = F.row_number().over(Window.partitionBy("_k0", "_k1").orderBy(F.lit(0)))
    placed = hashed.withColumn("_nth", nth).join(chosen, ["_k0", "_k1"]).select(*rows.columns, F.explode(F.get("_lists", F.col("_nth") - 1)).alias("_position"))
    return placed.orderBy("_position", doc).select(*rows.columns).toDF(*df.columns)
