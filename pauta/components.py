"""Connected components of an edge table, by contraction rounds with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pauta.cluster import cut_lineage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, group_id) for every id in ``edges (a, b)``; group_id is the component's smallest id.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which end after
    O(log^2 n) rounds and never gather a component in one task: every step is a group
    minimum (combined on the map side) and an equi-join. Null ends are ignored.
    """
    e = edges.select("a", "b").where("a <> b")
    e = cut_lineage(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        # large star: all larger neighbours of u go to the smallest of u and its neighbours
        both = e.select("u", "v").union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = cut_lineage(small)
        print_of = small.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
        e = small
        if print_of == before:
            break
        before = print_of
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("group_id")).union(e.select(F.col("v").alias("id"), F.col("v").alias("group_id"))).distinct()
