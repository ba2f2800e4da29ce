"""Near-duplicate records with small edits: a prefix-tree join of n-gram sets.

The nodes of the tree are keys of a shuffle, so they are met in parallel; see
:mod:`pauta.llm.setjoin` for the stages and bounds.

Copies equal in every character are one member of the join, whatever their number. Two forms
of the result, the same for classes of every size:

* :func:`near_duplicate_links` (pairs of class representatives) with
  :func:`near_duplicate_groups` (every record's class): linear in the copies;
* :func:`near_duplicate_pairs`: every pair of ids, by its definition quadratic in the copies.

Defined results: null fields count as empty texts; texts below ``min_words`` words take no
part; repeated rows of one record count once; an id under several texts counts with each; an
empty table gives no rows; other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pauta.cluster import cut_lineage
from pauta.components import components
from pauta.llm.setjoin import Wanted, keyed, long_copies, only, similar_texts

MIN_WORDS = 30
LEAST = 0.5
FIELDS = ("subject", "body")


def _texts(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])
    return keyed(df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.lit(0).cast("tinyint").alias("side"), text.alias("text")))


def linked_texts(df: DataFrame, key: str, fields: tuple[str, ...], min_words: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verified pairs of texts, members (key, check, id), texts of several ids that are long enough)."""
    texts = _texts(df, key, fields)
    members = texts.select("key", "check", "id").distinct()
    return similar_texts(texts, Wanted(least), min_words=min_words), members, cut_lineage(long_copies(texts, members, min_words))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key"), F.col("a_check").alias("check")).union(pairs.select("b", "b_check"))


def named(members: DataFrame, end: str, id_column: Column) -> DataFrame:
    """``members`` with its columns named for one end of a pair."""
    return members.select(F.col("key").alias(end), F.col("check").alias(f"{end}_check"), id_column.alias(f"id_{end}"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def near_duplicate_pairs(df: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS, *, min_words: int = MIN_WORDS, least: float = LEAST) -> DataFrame:
    """Distinct pairs (id_a, id_b), id_a < id_b, of records whose texts' resemblance is at least ``least``."""
    pairs, members, copies = linked_texts(df, key, fields, min_words, least)
    mine = cut_lineage(only(members, "key", _ends(pairs).union(copies).select("key").distinct()))
    between = pairs.join(named(mine, "a", F.col("id")), ["a", "a_check"]).join(named(mine, "b", F.col("id")), ["b", "b_check"]).select("id_a", "id_b")
    equal = mine.join(copies, ["key", "check"], "left_semi")
    inside = equal.withColumnRenamed("id", "id_a").join(equal.withColumnRenamed("id", "id_b"), ["key", "check"]).where("id_a < id_b").select("id_a", "id_b")
    return ordered(between.union(inside))


def _classes(members: DataFrame, pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, check, id, class_id) of the records with a link or a copy; class_id is the smallest id of the text."""
    mine = cut_lineage(only(members, "key", _ends(pairs).union(copies).select("key").distinct()))
    return mine.join(mine.groupBy("key", "check").agg(F.min("id").alias("class_id")), ["key", "check"])


def near_duplicate_links(df: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS, *, min_words: int = MIN_WORDS, least: float = LEAST) -> DataFrame:
    """Pairs of different texts by their smallest ids: (class_a, class_b, resemblance), class_a < class_b."""
    pairs, members, copies = linked_texts(df, key, fields, min_words, least)
    heads = _classes(members, pairs, copies).select("key", "check", "class_id").distinct()
    both = pairs.join(named(heads, "a", F.col("class_id")), ["a", "a_check"]).join(named(heads, "b", F.col("class_id")), ["b", "b_check"]).where("id_a <> id_b")
    share = F.round(F.max(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))), 6)
    return both.groupBy(F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b")).agg(share.alias("resemblance"))


def near_duplicate_groups(df: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS, *, min_words: int = MIN_WORDS, least: float = LEAST) -> DataFrame:
    """One row a record with a link or a copy: (id, class_id, group_id, links).

    ``class_id`` is the smallest id of an equal text, ``group_id`` the smallest id that the
    record is linked to, directly or through others, ``links`` the number of linked other
    texts (of an id with several texts, of the one with most).
    """
    pairs, members, copies = linked_texts(df, key, fields, min_words, least)
    classes = cut_lineage(_classes(members, pairs, copies))
    heads = classes.select("key", "check", "class_id").distinct()
    both = pairs.join(named(heads, "a", F.col("class_id")), ["a", "a_check"]).join(named(heads, "b", F.col("class_id")), ["b", "b_check"])
    # copies need no edges of their own; an id under several texts links their classes
    several = classes.groupBy("id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low <> high")
    across = classes.join(several, "id").where("class_id <> low").select("class_id", "low")
    edges = both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).union(across)
    links = _ends(pairs).groupBy("key", "check").agg(F.count("*").alias("links"))
    own = classes.join(links, ["key", "check"], "left").groupBy("id").agg(F.min("class_id").alias("class_id"), F.coalesce(F.max("links"), F.lit(0)).alias("links"))
    groups = components(edges.where("a <> b")).withColumnRenamed("id", "class_id")
    return own.join(groups, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), "links")
