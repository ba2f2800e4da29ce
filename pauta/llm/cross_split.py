"""Same or near-same records across splits.

The word n-grams of the evaluation records decide what takes part: the buckets in which they
have grams are broadcast (an array of fixed size), and of a training record only grams in
such buckets are looked up. The hits meet partitioned by gram; each (training, evaluation)
pair with enough hits is checked exactly. Two questions are asked this way:

* resemblance of at least ``LEAST`` (``cross_split_pairs``, ``cross_split_links``);
* containment: the share of the evaluation record's grams that one training record holds,
  whatever its length, of at least ``CONTAINED`` (``containments``). There an evaluation
  record looks up its rarest grams (the prefix that the share allows), a training record all.

Defined results: split names are compared without case and outer blanks, records with a
null or another split take no part; null, empty and short bodies (below ``min_words``
words) take no part; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pauta.cluster import cut_lineage
from pauta.llm.near_duplicates import named, ordered
from pauta.llm.setjoin import Wanted, keyed, only, similar_texts

MIN_WORDS = 15
LEAST = 0.5
CONTAINED = 0.8


def split_name(c: str = "split"):
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def _texts(df: DataFrame) -> DataFrame:
    s = split_name()
    side = F.when(s == "train", 0).when(s.isin("dev", "holdout"), 1).cast("tinyint")
    return keyed(df.select(F.col("id").cast("string").alias("id"), side.alias("side"), F.coalesce("body", F.lit("")).alias("text")).where("id is not null and side is not null"))


def _linked(df: DataFrame, wanted: Wanted, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(verified pairs of texts: a of train, b of an evaluation split; members (key, check, id) of those texts)."""
    texts = _texts(df)
    pairs = similar_texts(texts, wanted, min_words=min_words, sides=True)
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    return pairs, cut_lineage(only(texts.select("key", "check", "id"), "key", keys).distinct())


def _join(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    return pairs.join(a, ["a", "a_check"]).join(b, ["b", "b_check"])


def cross_split_pairs(df: DataFrame, *, min_words: int = MIN_WORDS, least: float = LEAST) -> DataFrame:
    """Distinct (id_a, id_b), id_a < id_b: one of train, one of dev or holdout, resemblance at least ``least``."""
    pairs, members = _linked(df, Wanted(least), min_words)
    return ordered(_join(pairs, named(members, "a", F.col("id")), named(members, "b", F.col("id"))).select("id_a", "id_b"))


def cross_split_links(df: DataFrame, *, min_words: int = MIN_WORDS, least: float = LEAST) -> DataFrame:
    """The same linear in the copies: one row a pair of different texts or of a text on both sides.

    (train_id, eval_id, train_records, eval_records, resemblance, containment): ids are the
    smallest of their text and side, records the number of ids that share the text.
    """
    pairs, members = _linked(df, Wanted(least), min_words)
    heads = members.groupBy("key", "check").agg(F.min("id").alias("id"), F.count("*").alias("records"))
    end = lambda x, name: heads.select(F.col("key").alias(x), F.col("check").alias(f"{x}_check"), F.col("id").alias(f"{name}_id"), F.col("records").alias(f"{name}_records"))
    common, a, b = F.col("common"), F.col("size_a"), F.col("size_b")
    return _join(pairs, end("a", "train"), end("b", "eval")).select(
        "train_id", "eval_id", "train_records", "eval_records", F.round(common / (a + b - common), 6).alias("resemblance"), F.round(common / b, 6).alias("containment")
    )


def _found_evaluations(df: DataFrame, wanted: Wanted, min_words: int, value: str) -> DataFrame:
    """(id, value) of the evaluation records with a pair; value is the largest containment."""
    pairs, members = _linked(df, wanted, min_words)
    best = pairs.groupBy(F.col("b").alias("key"), F.col("b_check").alias("check")).agg(F.max(F.col("common") / F.col("size_b")).alias(value))
    return members.join(best, ["key", "check"]).groupBy("id").agg(F.max(value).alias(value))


def containments(df: DataFrame, *, min_words: int = MIN_WORDS, contained: float = CONTAINED) -> DataFrame:
    """(id, containment) of the evaluation records of which one training record holds at least that share."""
    return _found_evaluations(df, Wanted(contained, contained=True), min_words, "containment")


def cross_split_report(df: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, near-same in train, contained in train, mean containment of those."""
    near = _found_evaluations(df, Wanted(LEAST), MIN_WORDS, "near")
    held = containments(df)
    records = df.where(split_name().isin("dev", "holdout") & F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), split_name().alias("split"), "source").distinct()
    return (
        records.join(near, "id", "left")
        .join(held, "id", "left")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("records"),
            F.count("near").alias("leaked"),
            F.count("containment").alias("contained"),
            F.round(F.avg("containment"), 6).alias("mean_containment"),
        )
    )
