"""Deterministic samples, quotas, set operations and row compaction.

Random order is the order of ``md5(seed | id)``, the same on any engine and at any number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def bounded(df: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows by an explicit order: a top-k, not a sort of everything."""
    return df.orderBy(order).limit(most)


def sample(df: DataFrame, most: int, seed: int, id_col: str) -> DataFrame:
    """``most`` rows without replacement."""
    return df.orderBy(shuffled(seed, id_col), id_col).limit(most)


def places(df: DataFrame, seed: int, id_col: str, out: str = "place") -> DataFrame:
    """Add each row's place, from 1, in a seeded shuffle: counted by the hash's first two digits, then inside them."""
    hashed = df.withColumn("_h", shuffled(seed, id_col)).withColumn("_two", F.substring("_h", 1, 2))
    before = Window.orderBy("_two").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    base = hashed.groupBy("_two").agg(F.count("*").alias("_n")).select("_two", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_two").orderBy("_h", id_col))
    return hashed.withColumn("_inside", inside).join(F.broadcast(base), "_two").withColumn(out, (F.col("_base") + F.col("_inside")).cast("long")).drop("_h", "_two", "_inside", "_base")


def split(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """Add ``member``: 1 for about half of the rows, by hash."""
    first = F.conv(F.substring(shuffled(seed, id_col), 1, 1), 16, 10).cast("int")
    return df.withColumn("member", F.when(first < 8, 1).otherwise(0))


def quotas(df: DataFrame, domain: str) -> DataFrame:
    return df.groupBy(domain).agg(F.count("*").alias("quota"))


def ranked(df: DataFrame, domain: list[str], order: list[Column | str], out: str = "rank") -> DataFrame:
    """Row number inside each domain; with a filter on it Spark keeps only the first rows of each task."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*domain).orderBy(*order)))


def by_quota(pool: DataFrame, quota: DataFrame, domain: str, seed: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``(sample, shortfall)``: each domain's quota of rows in hash order; domains that have fewer."""
    taken = ranked(pool, [domain], [shuffled(seed, id_col), id_col]).join(quota, domain).filter("rank <= quota").drop("rank", "quota")
    got = taken.groupBy(domain).agg(F.count("*").alias("got"))
    short = quota.join(got, domain, "left").select(domain, F.col("quota").alias("wanted"), F.coalesce("got", F.lit(0)).cast("long").alias("got")).filter("got < wanted")
    return taken, short


def two_arms(df: DataFrame, domain: str, total: int, seed: int, id_col: str) -> DataFrame:
    """Equal numbers of members and non-members from every domain that both arms have."""
    counts = df.groupBy(domain).agg(F.sum("member").alias("m"), F.sum(1 - F.col("member")).alias("n")).filter("m > 0 and n > 0")
    each = F.greatest(F.lit(1).cast("double"), F.floor(F.lit(total) / F.count("*").over(Window.partitionBy())).cast("double"))
    each = counts.withColumn("_k", F.least(each, F.col("m").cast("double"), F.col("n").cast("double"))).select(domain, "_k")
    return ranked(df, [domain, "member"], [shuffled(seed, id_col), id_col]).join(each, domain).filter("rank <= _k").drop("rank", "_k")


def with_top_up(pool: DataFrame, domain: str, each: int, total: int, seed: int, id_col: str) -> DataFrame:
    """``each`` rows of every domain, topped up from the rest to ``total``, in hash order."""
    first = ranked(pool, [domain], [shuffled(seed, id_col), id_col]).filter(F.col("rank") <= each).drop("rank")
    rest = pool.join(first.select(id_col), id_col, "left_anti").select(*pool.columns)
    both = first.withColumn("_late", F.lit(0)).unionByName(rest.withColumn("_late", F.lit(1)))
    return both.orderBy("_late", shuffled(seed, id_col), id_col).limit(total).drop("_late")


def not_done(df: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    return df.join(done, id_col, "left_anti")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the largest ``order`` of each key: one aggregate with map-side combine."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def shared_domains(df: DataFrame, domain: str) -> DataFrame:
    return df.filter("member = 1").select(domain).intersect(df.filter("member = 0").select(domain))


def labelled_union(members: DataFrame, others: DataFrame) -> DataFrame:
    return members.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0)))
