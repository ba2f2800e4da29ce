"""Metrics of classification, span extraction, answers and topics.

Every metric is a long table built from counts that combine on the map side. Empty
denominators give 0. Rows with a null true label take no part in classification metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pauta.functions.text import answer_text, squeeze, strip, tokens


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * tp, 2 * tp + fp + fn)


def pair_counts(df: DataFrame, true: str = "true_label", pred: str = "predicted_label", weight: str | None = None) -> DataFrame:
    """(t, p, n); ``weight`` names a column of counts where the rows are counted already."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.where(F.col(true).isNotNull()).groupBy(F.col(true).alias("t"), F.coalesce(F.col(pred), F.lit("")).alias("p")).agg(n.alias("n"))


def class_metrics(df: DataFrame, true: str = "true_label", pred: str = "predicted_label", *, weight: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) for every label seen on either side.

    ``labels`` (a model's classes) that stand on neither side are rows of zeros.
    """
    c = pair_counts(df, true, pred, weight)
    if labels:
        unseen = df.sparkSession.createDataFrame([(x, x, 0) for x in labels], "t string, p string, n bigint")
        c = c.union(unseen)
    side = c.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("x"), "t", "p", "n")
    g = side.groupBy("x.label").agg(
        F.sum(F.when((F.col("x.side") == "t") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("x.side") == "p") & (F.col("t") != F.col("p")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("x.side") == "t") & (F.col("t") != F.col("p")), F.col("n")).otherwise(0)).alias("fn"),
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), p.alias("precision"), r.alias("recall"), f.alias("f1"))


def summary_metrics(df: DataFrame, true: str = "true_label", pred: str = "predicted_label", *, weight: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """One row: rows, accuracy, macro and support-weighted precision, recall and F1."""
    m = class_metrics(df, true, pred, weight=weight, labels=labels)
    s = F.sum("support")
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), s).alias(f"weighted_{c}")
    return m.agg(F.coalesce(s, F.lit(0)).alias("rows"), ratio(F.sum("tp"), s).alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c) for c in ("precision", "recall", "f1")])


def confusion(df: DataFrame, true: str = "true_label", pred: str = "predicted_label", labels: list[str] | None = None) -> DataFrame:
    """Dense (true_label, predicted_label, n) over all labels seen and given; the label set is small."""
    c = pair_counts(df, true, pred)
    if labels:
        c = c.union(df.sparkSession.createDataFrame([(x, x, 0) for x in labels], "t string, p string, n bigint")).groupBy("t", "p").agg(F.sum("n").alias("n"))
    labels = c.select(F.col("t").alias("label")).union(c.select("p")).distinct()
    grid = labels.select(F.col("label").alias("t"), F.lit(1).alias("k")).join(labels.select(F.col("label").alias("p"), F.lit(1).alias("k")), "k").drop("k")
    return grid.join(c, ["t", "p"], "left").select(F.col("t").alias("true_label"), F.col("p").alias("predicted_label"), F.coalesce("n", F.lit(0)).alias("n"))


def error_analysis(df: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """(kind, key, n) of the errors by true label, predicted label and pair, and in total."""
    c = pair_counts(df, true, pred).where("t <> p")
    g = c.groupingSets([["t"], ["p"], ["t", "p"]], "t", "p").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "true").when(F.col("g") == 2, "predicted").otherwise("pair")
    key = F.when(F.col("g") == 1, F.col("t")).when(F.col("g") == 2, F.col("p")).otherwise(F.concat("t", F.lit(" -> "), "p"))
    total = c.agg(F.lit("total").alias("kind"), F.lit("").alias("key"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return g.select(kind.alias("kind"), key.alias("key"), "n").union(total)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent)."""
    total = F.sum("n").over(W.partitionBy())
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("percent", F.round(100 * F.col("n") / total, 4))


def vote(*votes: str) -> Column:
    """Majority of three votes; without a majority the first."""
    a, b, c = (F.col(v) for v in votes)
    return F.when(b.eqNullSafe(c), b).otherwise(a)


def set_counts(gold: Column, predicted: Column) -> Column:
    """``struct<tp, fp, fn>`` of two arrays as sets of trimmed values."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    g, p = clean(gold), clean(predicted)
    both = F.size(F.array_intersect(g, p))
    return F.struct(both.alias("tp"), (F.size(p) - both).alias("fp"), (F.size(g) - both).alias("fn"))


def aggregate_counts(df: DataFrame, by: str) -> DataFrame:
    """From (by, tp, fp, fn): one row a value and rows ``MICRO``, ``MACRO``, ``WEIGHTED``."""
    g = df.groupBy(F.col(by).alias("scope")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    per = g.select("scope", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))
    total = g.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    micro = total.select(F.lit("MICRO").alias("scope"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    macro = per.agg(*sums, *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("MACRO").alias("scope"), "tp", "fp", "fn", "precision", "recall", "f1")
    w = F.col("tp") + F.col("fn")
    weighted = per.agg(*sums, *[ratio(F.sum(F.col(c) * w), F.sum(w)).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("WEIGHTED").alias("scope"), "tp", "fp", "fn", "precision", "recall", "f1")
    return per.unionByName(micro).unionByName(macro).unionByName(weighted)


def token_scores(predicted: Column, reference: Column) -> Column:
    """``struct<exact, precision, recall, f1>`` on sets of lower-case tokens; both empty is 1."""
    p, r = (F.array_distinct(tokens(F.lower(F.coalesce(c, F.lit(""))))) for c in (predicted, reference))
    common = F.size(F.array_intersect(p, r))
    both, one = (F.size(p) == 0) & (F.size(r) == 0), (F.size(p) == 0) | (F.size(r) == 0)
    score = lambda v: F.when(both, 1.0).when(one, 0.0).otherwise(v)
    exact = (answer_text(predicted, lowercase=True) == answer_text(reference, lowercase=True)).cast("double")
    return F.struct(exact.alias("exact"), score(ratio(common, F.size(p))).alias("precision"), score(ratio(common, F.size(r))).alias("recall"), score(ratio(2 * common, F.size(p) + F.size(r))).alias("f1"))


def best_reference(predicted: Column, references: Column) -> Column:
    """``struct<reference, exact, precision, recall, f1>`` of the reference that fits best: by exact match, F1, recall, the first of equals.

    Without references the answer is compared with an empty text.
    """
    some = F.when(F.size(F.coalesce(references, F.array().cast("array<string>"))) > 0, references).otherwise(F.array(F.lit("")))

    def scored(r: Column, i: Column) -> Column:
        s = token_scores(predicted, r)
        return F.struct(s["exact"].alias("exact"), s["f1"].alias("f1"), s["recall"].alias("recall"), (-i).alias("first"), s["precision"].alias("precision"), r.alias("reference"))

    best = F.array_max(F.transform(some, scored))
    return F.struct(*[best[k].alias(k) for k in ("reference", "exact", "precision", "recall", "f1")])


def category_answer(spans: Column) -> Column:
    """``struct<answer, confidence, valid>`` of spans: their texts joined, the mean of their confidences."""
    kept = F.filter(spans, lambda x: strip(F.coalesce(x["text"], F.lit(""))) != "")
    n = F.size(kept)
    mean = ratio(F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.coalesce(x["confidence"], F.lit(0.0))), n)
    return F.struct(F.when(n > 0, F.array_join(F.transform(kept, lambda x: strip(x["text"])), "; ")).alias("answer"), F.when(n > 0, mean).otherwise(0.0).alias("confidence"), (n > 0).alias("valid"))


def multiset_scores(predicted: Column, reference: Column) -> Column:
    """``struct<precision, recall, f1>`` on multisets of tokens given as arrays."""
    common = F.aggregate(
        F.array_distinct(F.array_intersect(predicted, reference)), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(predicted, lambda x: x == w)), F.size(F.filter(reference, lambda x: x == w)))
    )
    both, one = (F.size(predicted) == 0) & (F.size(reference) == 0), (F.size(predicted) == 0) | (F.size(reference) == 0)
    score = lambda v: F.when(both, 1.0).when(one, 0.0).otherwise(v)
    return F.struct(score(ratio(common, F.size(predicted))).alias("precision"), score(ratio(common, F.size(reference))).alias("recall"), score(ratio(2 * common, F.size(predicted) + F.size(reference))).alias("f1"))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character sets; both empty is 1."""
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda s: s != "")) for c in (a, b))
    return F.when((a == "") & (b == ""), 1.0).otherwise(ratio(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of places with the same character, over the longer text."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x.isNotNull() & y.isNotNull() & (x == y) & (x != "")).cast("int")), F.lit(0), lambda acc, v: acc + v)
    return F.when((a == "") & (b == ""), 1.0).otherwise(ratio(same, F.greatest(F.length(a), F.length(b))))


def match_type(gold: Column, predicted: Column) -> Column:
    """exact, partial (character Jaccard 0.7), fuzzy (0.6) or none, on normalised texts."""
    a, b = (strip(squeeze(F.lower(c))) for c in (gold, predicted))
    j = char_jaccard(a, b)
    return F.when(a == b, "exact").when(j >= 0.7, "partial").when(j >= 0.6, "fuzzy").otherwise("none")


def pair_spans(gold: Column, predicted: Column, least: float = 0.6) -> Column:
    """Greedy one-to-one pairing in the order of the predictions.

    Array of ``struct<gold, predicted, match>``: each prediction takes the best unused gold
    value; unmatched values stand alone with ``match = none``.
    """
    kind = "struct<used:array<int>,out:array<struct<gold:string,predicted:string,match:string>>>"
    start = F.expr(f"cast(struct(array(), array()) as {kind})")
    g = F.transform(gold, lambda x, i: F.struct(x.alias("v"), i.alias("i")))

    def take(acc, p):
        free = F.filter(g, lambda x: ~F.array_contains(acc["used"], x["i"]))
        scored = F.transform(free, lambda x: F.struct(F.when(F.lower(strip(x["v"])) == F.lower(strip(p)), 2.0).otherwise(char_jaccard(F.lower(strip(x["v"])), F.lower(strip(p)))).alias("s"), (-x["i"]).alias("k"), x["v"].alias("v"), x["i"].alias("i")))
        best = F.array_max(scored)
        ok = best.isNotNull() & (best["s"] >= least)
        row = F.when(ok, F.struct(best["v"].alias("gold"), p.alias("predicted"), match_type(best["v"], p).alias("match"))).otherwise(F.struct(F.lit(None).cast("string").alias("gold"), p.alias("predicted"), F.lit("none").alias("match")))
        return F.struct(F.when(ok, F.concat(acc["used"], F.array(best["i"]))).otherwise(acc["used"]).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    def finish(acc):
        missed = F.transform(F.filter(g, lambda x: ~F.array_contains(acc["used"], x["i"])), lambda x: F.struct(x["v"].alias("gold"), F.lit(None).cast("string").alias("predicted"), F.lit("none").alias("match")))
        return F.concat(acc["out"], missed)

    return F.aggregate(predicted, start, take, finish)


def answer_error(predicted: Column, reference: Column, confidence: Column, context: Column) -> Column:
    """The error type of an answer, tests in a fixed order."""
    p, r = F.coalesce(predicted, F.lit("")), F.coalesce(reference, F.lit(""))
    low_p, low_r = F.lower(p), F.lower(r)
    shared = F.size(F.array_intersect(tokens(low_p), tokens(low_r))) > 0
    return (
        F.when((strip(p) == "") & (confidence < 0.5), "LOW_CONFIDENCE")
        .when(strip(p) == "", "EMPTY_ANSWER")
        .when(answer_text(low_p) == answer_text(low_r), "EXACT_MATCH")
        .when(~F.contains(context, p) & ~F.contains(F.lower(context), low_p), "HALLUCINATION")
        .when(F.contains(low_r, low_p) | F.contains(low_p, low_r), "TRUNCATION")
        .when(shared, "PARTIAL_MATCH")
        .otherwise("WRONG_ANSWER")
    )


def answer_summary(df: DataFrame) -> DataFrame:
    """From (category, exact, precision, recall, f1, confidence): means by category and over all."""
    aggs = [F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("exact", "precision", "recall", "f1", "confidence")]]
    g = df.groupingSets([["category"], []], "category").agg(*aggs, F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce("category", F.lit(""))).alias("category"), "n", "exact", "precision", "recall", "f1", "confidence")


def compare_methods(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full join of two answer summaries with differences and the winner by F1."""
    x, y = (d.select("category", F.col("exact").alias(f"exact_{k}"), F.col("f1").alias(f"f1_{k}")) for d, k in ((a, "a"), (b, "b")))
    d = F.coalesce("f1_b", F.lit(0.0)) - F.coalesce("f1_a", F.lit(0.0))
    return x.join(y, "category", "full").select("category", "exact_a", "exact_b", "f1_a", "f1_b", d.alias("f1_delta"), F.when(F.abs(d) < 1e-12, "tie").when(d > 0, "b").otherwise("a").alias("winner"))


def score_stats(df: DataFrame, model: str, score: str) -> DataFrame:
    """best, worst, mean, median, sample and population deviation of the models' scores."""
    tie = lambda worst: F.struct(F.col(score) if worst else -F.col(score), F.col(model))
    return df.agg(
        F.min_by(model, tie(False)).alias("best"), F.min_by(model, tie(True)).alias("worst"), F.avg(score).alias("mean"), F.percentile(score, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("stddev"), F.stddev_pop(score).alias("stddev_pop")
    )


def topic_metrics(df: DataFrame) -> DataFrame:
    """From (gold, predicted) topic texts: exact match, token scores on positives, detection and counts."""
    from pauta.functions.text import topic_tokens

    g, p = topic_tokens(F.coalesce("gold", F.lit(""))), topic_tokens(F.coalesce("predicted", F.lit("")))
    base = df.select(g.alias("g"), p.alias("p"))
    t = base.select((F.size("g") > 0).alias("pos"), (F.size("p") > 0).alias("said"), (F.col("g") == F.col("p")).alias("same"), multiset_scores(F.col("p"), F.col("g")).alias("s"))
    tp, fp, fn = F.count_if(F.col("pos") & F.col("said")), F.count_if(~F.col("pos") & F.col("said")), F.count_if(F.col("pos") & ~F.col("said"))
    mean = lambda c, where: F.coalesce(F.avg(F.when(where, c)), F.lit(0.0))
    num = lambda c: c.cast("double")
    dp, dr, df1 = prf(tp, fp, fn)
    return t.agg(
        F.count("*").alias("cases"), mean(num(F.col("same")), F.lit(True)).alias("exact"), mean(num(F.col("same")), F.col("pos")).alias("exact_positive"),
        *[mean(F.col(f"s.{k}"), F.col("pos")).alias(f"token_{k}") for k in ("precision", "recall", "f1")],
        mean(num(~F.col("said")), ~F.col("pos")).alias("negative_accuracy"), ratio(fp, F.count_if(~F.col("pos"))).alias("false_positive_rate"), ratio(tp, F.count_if(F.col("pos"))).alias("coverage"),
        dp.alias("detection_precision"), dr.alias("detection_recall"), df1.alias("detection_f1"), fn.alias("missed"), fp.alias("spurious"), F.count_if(F.col("pos") & F.col("said") & ~F.col("same")).alias("different"),
    )
