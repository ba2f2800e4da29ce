"""Records of extraction errors, their summary, and metrics by match type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pauta.operators.metrics import pair_spans, prf, ratio


def paired(rows: DataFrame) -> DataFrame:
    """From (id, kind, gold, predicted) arrays: one row a pair or unmatched value, in order."""
    empty = F.array().cast("array<string>")
    clean = lambda c: F.filter(F.coalesce(c, empty), lambda x: x.isNotNull())
    pairs = pair_spans(clean(F.col("gold")), clean(F.col("predicted")))
    return rows.select("id", "kind", F.posexplode(pairs).alias("pos", "x")).select("id", "kind", "pos", "x.gold", "x.predicted", "x.match")


def error_records(pairs: DataFrame) -> DataFrame:
    """Missed values, spurious values, then partial matches; fuzzy matches are no errors."""
    kind = F.when(F.col("predicted").isNull(), "false_negative").when(F.col("gold").isNull(), "false_positive").when(F.col("match") == "partial", "partial_match")
    return pairs.withColumn("error", kind).where("error is not null").select("id", "kind", "error", "gold", "predicted", "pos")


def error_summary(errors: DataFrame, examples: int = 3) -> DataFrame:
    """(kind, error, n, examples): the first few values by id and place. Examples are the feature."""
    w = W.partitionBy("kind", "error").orderBy("id", "pos", "gold", "predicted")
    ranked = errors.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples)
    shown = ranked.groupBy("kind", "error").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("gold", "predicted").alias("v")))), lambda x: x["v"]), " | ").alias("examples"))
    return errors.groupBy("kind", "error").agg(F.count("*").alias("n")).join(shown, ["kind", "error"])


def by_match_type(pairs: DataFrame) -> DataFrame:
    """(mode, precision, recall, f1): exact only, partial only, and all matches."""
    p, r, matched = F.count("predicted"), F.count("gold"), F.col("gold").isNotNull() & F.col("predicted").isNotNull()
    hits = {"exact": F.count_if(matched & (F.col("match") == "exact")), "partial": F.count_if(matched & (F.col("match") == "partial")), "all": F.count_if(matched & (F.col("match") != "none"))}
    one = pairs.agg(p.alias("p"), r.alias("r"), *[h.alias(k) for k, h in hits.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), F.col(k).alias("tp")) for k in hits])).alias("x")
    t = one.select("p", "r", rows).select("x.mode", "x.tp", (F.col("p") - F.col("x.tp")).alias("fp"), (F.col("r") - F.col("x.tp")).alias("fn"))
    a, b, c = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return t.select("mode", a.alias("precision"), b.alias("recall"), c.alias("f1"))


def best_and_worst(scores: DataFrame, key: str, score: str) -> DataFrame:
    """One row: the keys with the highest and lowest score, ties by key."""
    return scores.agg(F.min_by(key, F.struct(-F.col(score), F.col(key))).alias("best"), F.min_by(key, F.struct(F.col(score), F.col(key))).alias("worst"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, share) of array columns that aren't empty."""
    n = F.count("*")
    one = df.agg(n.alias("n"), *[F.count_if(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(columns)])).alias("x")
    return one.select("n", rows).select("x.column", "x.filled", F.round(ratio(F.col("x.filled"), F.col("n")), 6).alias("share"))


def worst_answers(answers: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` answers (id, category, predicted, reference, f1) without exact match that have the lowest F1; ties by id and category."""
    return answers.where("exact = 0").orderBy("f1", "id", "category").limit(n)
