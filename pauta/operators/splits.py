"""Deterministic samples and splits: the order in a group is that of an MD5 of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = 4096


def _order(key: str, seed: int) -> tuple[Column, Column]:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), F.col(key)


def per_label_sample(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` records a label: the sampling operator of balanced subsets."""
    w = W.partitionBy(label).orderBy(*_order(key, seed))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: of every label the share goes to test. Labels may hold a third of
    all rows, so ranks come from bucket sums and short windows, not from one sort a label."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), 1, 3), 16, 10).cast("int")
    b = df.withColumn("__b", bucket).withColumn("__o", _order(key, seed)[0])
    sums = b.groupBy(label, "__b").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy(label).orderBy("__b")) - F.col("n")).withColumn("total", F.sum("n").over(W.partitionBy(label))).drop("n")
    joined = b.join(before.withColumnRenamed(label, "__l"), F.col(label).eqNullSafe(F.col("__l")) & (b["__b"] == before["__b"])).drop("__l", before["__b"])
    rank = F.row_number().over(W.partitionBy(label, "__b").orderBy("__o", key)) + F.col("before")
    return joined.withColumn("part", F.when(rank <= F.ceil(F.lit(test_share) * F.col("total")), "test").otherwise("train")).drop("__b", "__o", "before", "total")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0..k-1, even within every label to chance."""
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(label), F.lit("")), F.lit("-"), F.col(key).cast("string"), F.lit(f"-{seed}"))), 1, 7), 16, 10).cast("int")
    return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))


def group_split(df: DataFrame, group: str, shares: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """``df`` with ``part``: all rows of a group get the same part, drawn by the group's hash."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(group).cast("string"), F.lit(f"-{seed}"))), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))
    edge, part = 0.0, F.lit(shares[-1][0])
    cuts = []
    for name, share in shares[:-1]:
        edge += share
        cuts.append((name, edge))
    for name, e in reversed(cuts):
        part = F.when(h < e, name).otherwise(part)
    return df.withColumn("part", part)


def sequential_split(df: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """``df`` with ``part``: of n rows the first floor(n * share) by the whole number ``order`` are train, the rest test.

    Places come from counts of ranges of ``RANGE`` numbers and short windows inside them; only
    the counts (one row a range that has rows) are put in one order. Nulls come last.
    """
    at = F.coalesce(F.floor(F.col(order) / RANGE), F.lit(2**62))
    b = df.withColumn("__range", at)
    counts = b.groupBy("__range").agg(F.count("*").alias("__n"))
    whole = W.orderBy("__range")
    before = counts.select("__range", (F.sum("__n").over(whole) - F.col("__n")).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("__all"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(F.col(order).asc_nulls_last())) + F.col("__before")
    out = b.join(before, "__range").withColumn("part", F.when(place <= F.floor(F.lit(share) * F.col("__all")), "train").otherwise("test"))
    return out.drop("__range", "__before", "__all")
