"""Intent models: TF-IDF, multinomial naive Bayes as tables, and Spark ML pipelines.

Vocabulary, document counts and class weights run over all labelled rows. Only the Spark ML
classifiers may be fitted on a bounded sample: ``FIT_ROWS`` labelled rows by hash order, a
documented parameter; a class that the sample would miss gives its first rows of that order.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pauta.cluster import cut_lineage
from pauta.functions.text import fingerprint, let
from pauta.operators.metrics import summary_metrics, vote
from pauta.operators.splits import folds

VOCABULARY = 5000
FIT_ROWS = 200_000
MOST_LABELS = 100_000


def terms(text: Column) -> Column:
    """Lower-case words of two letters or more and their pairs."""

    def with_pairs(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(words, F.filter(pairs, lambda x: x.isNotNull()))

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), with_pairs)


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) in long form."""
    return df.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """The ``size`` most frequent terms (ties by term) with document frequency: (term, total, df)."""
    return counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(size)


def tfidf(df: DataFrame, key: str, text: str, size: int = VOCABULARY) -> DataFrame:
    """(key, term, weight): smooth idf, rows of unit length. The vocabulary is broadcast (``size`` rows)."""
    counts = term_counts(df, key, text)
    n = df.count()
    idf = F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1
    w = counts.join(F.broadcast(vocabulary(counts, size).select("term", idf.alias("idf"))), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def naive_bayes_table(df: DataFrame, key: str, text: str, label: str, size: int = VOCABULARY, alpha: float = 1.0) -> DataFrame:
    """(label, term, log_prob) of a multinomial model on term counts, unsmoothed priors apart."""
    counts = term_counts(df, key, text)
    voc = F.broadcast(vocabulary(counts, size).select("term"))
    labels = df.select(key, label)
    by_class = counts.join(voc, "term").join(labels, key).groupBy(F.col(label).alias("label"), "term").agg(F.sum("tf").alias("n"))
    totals = by_class.groupBy("label").agg(F.sum("n").alias("total"))
    grid = F.broadcast(totals).join(voc)  # labels times vocabulary: both bounded
    full = grid.join(by_class, ["label", "term"], "left")
    return full.select("label", "term", F.log((F.coalesce("n", F.lit(0)) + alpha) / (F.col("total") + alpha * size)).alias("log_prob"))


def top_terms(table: DataFrame, n: int = 10, by: str = "log_prob") -> DataFrame:
    w = W.partitionBy("label").orderBy(F.desc(by), "term")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def features(size: int = VOCABULARY, min_df: float = 1.0) -> list:
    """Stages from column ``terms`` to ``features``: counts, idf, unit length."""
    counted = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=size, minDF=min_df)
    return [counted, IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features", p=2.0)]


def classifier(kind: str):
    if kind == "logistic_regression":
        return LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", maxIter=50, tol=1e-4, regParam=1e-4, standardization=False)
    if kind == "naive_bayes":
        return NaiveBayes(labelCol="y", modelType="multinomial", smoothing=1.0)
    if kind == "decision_tree":
        return DecisionTreeClassifier(labelCol="y", maxDepth=30, impurity="gini", seed=42, maxMemoryInMB=512)  # Spark's largest depth
    raise ValueError(f"unknown model {kind}")


def fit_all(df: DataFrame, kinds: list[str], text: str = "text", label: str = "label", fit_rows: int = FIT_ROWS, size: int = VOCABULARY, options: dict | None = None) -> dict[str, PipelineModel]:
    """A pipeline model of each kind on labelled rows; classes are weighted to balance.

    The feature stages are fitted once and shared by the models. ``options`` are parameters
    of the classifiers by their Spark names; those that a kind doesn't have are left out.
    """
    rows = df.where(F.col(label).isNotNull() & (F.col(label) != "")).select(F.col(text).alias("text"), F.col(label).alias("label"))
    order = F.pmod(F.xxhash64("text", "label"), F.lit(1 << 20))
    sizes = rows.groupBy("label").agg(F.count("*").alias("c"), F.min(order).alias("low"))
    n, k = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if n == 0:
        raise ValueError("no labelled rows")
    cut = (1 << 20) if n <= fit_rows else int((1 << 20) * fit_rows / n)
    weighted = rows.join(F.broadcast(sizes) if k <= MOST_LABELS else sizes, "label").select(
        "label", (F.lit(float(n)) / (k * F.col("c"))).alias("weight"), terms(F.col("text")).alias("terms"),
        ((order < cut) | ((F.col("low") >= cut) & (order == F.col("low")))).alias("chosen"),
    )
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")
    if n <= fit_rows:
        weighted.persist()  # read once by each stage; bounded by ``fit_rows``
    try:
        shared = Pipeline(stages=[index, *features(size)]).fit(weighted)
        ready = shared.transform(weighted.where("chosen")).select("y", "weight", "features").persist()
        try:
            return {kind: PipelineModel(stages=[*shared.stages, _with_options(classifier(kind), options or {}).fit(ready)]) for kind in kinds}
        finally:
            ready.unpersist()
    finally:
        weighted.unpersist()


def _with_options(estimator, options: dict):
    for name, value in options.items():
        if estimator.hasParam(name):
            estimator.set(estimator.getParam(name), value)
    return estimator


def fit(df: DataFrame, kind: str, text: str = "text", label: str = "label", fit_rows: int = FIT_ROWS, size: int = VOCABULARY, options: dict | None = None) -> PipelineModel:
    """The pipeline model of one kind, see :func:`fit_all`."""
    return fit_all(df, [kind], text, label, fit_rows, size, options)[kind]


def predict_all(models: dict[str, PipelineModel], df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, one struct column a model: predicted_label, confidence, probabilities), for models of one :func:`fit_all`.

    Terms and features of a row are computed once; the classifiers score it one after another.
    """
    first = next(iter(models.values()))
    names = first.stages[0].labels
    labels = F.array(*[F.lit(x) for x in names])
    scored = PipelineModel(stages=first.stages[1:-1]).transform(df.select(key, terms(F.col(text)).alias("terms"))).select(key, "features")
    # the classifiers' columns are named apart; the models themselves stay as they are
    for name, model in models.items():
        one = model.stages[-1].copy()
        for column in ("probability", "rawPrediction", "prediction"):
            one.set(one.getParam(f"{column}Col"), f"__{column}_{name}")
        scored = one.transform(scored).drop(f"__rawPrediction_{name}", f"__prediction_{name}")
    arrays = scored.select(key, *[F.slice(vector_to_array(f"__probability_{name}"), 1, len(names)).alias(name) for name in models])

    def said(p: str) -> Column:
        best = F.element_at(labels, F.array_position(p, F.array_max(p)).cast("int"))
        return F.struct(best.alias("predicted_label"), F.array_max(p).alias("confidence"), F.map_from_arrays(labels, F.col(p)).alias("probabilities"))

    return arrays.select(key, *[said(name).alias(name) for name in models])


def predict(model: PipelineModel, df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, predicted_label, confidence, probabilities) for every row; an empty text is predicted too."""
    return predict_all({"model": model}, df, key, text).select(key, "model.*")


def top_labels(predictions: DataFrame, key: str, n: int = 3) -> DataFrame:
    """(key, rank, label, probability): the ``n`` most probable labels of every row, ties by label."""
    entries = F.transform(F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("label")))
    best = F.slice(F.array_sort(entries), 1, n)
    return predictions.select(key, F.posexplode(best).alias("at", "e")).select(key, (F.col("at") + 1).alias("rank"), "e.label", (-F.col("e.minus")).alias("probability"))


def feature_importance(model: PipelineModel, n: int = 20, spark=None) -> DataFrame:
    """(rank, term, importance): the terms that a decision tree splits by, the most important first."""
    from pyspark.sql import SparkSession

    weights = model.stages[-1].featureImportances
    vocabulary_ = model.stages[1].vocabulary  # at most ``VOCABULARY`` terms
    top = sorted(((float(w), vocabulary_[int(i)]) for i, w in zip(weights.indices, weights.values)), key=lambda x: (-x[0], x[1]))[:n]
    spark = spark or SparkSession.active()
    return spark.createDataFrame([(k + 1, t, w) for k, (w, t) in enumerate(top)], "rank int, term string, importance double")


def consensus(predictions: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, one column a model, intent): the majority of three models, else the first."""
    names = list(predictions)
    out = None
    for name, p in predictions.items():
        one = p.select(key, F.col("predicted_label").alias(name))
        out = one if out is None else out.join(one, key)
    return out.withColumn("intent", vote(*names))


def consensus_of(models: dict[str, PipelineModel], df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same from models of one :func:`fit_all`, without a join."""
    p = predict_all(models, df, key, text)
    return p.select(key, *[F.col(f"{name}.predicted_label").alias(name) for name in models]).withColumn("intent", vote(*models))


def evaluate(models: dict[str, PipelineModel], test: DataFrame, key: str, text: str = "text", label: str = "label") -> DataFrame:
    """(model, rows, accuracy, macro and weighted precision, recall and F1): one pass of prediction, counts a model."""
    p = predict_all(models, test.select(key, text, label), key, text).join(test.select(key, F.col(label).alias("true_label")), key)
    said = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"{name}.predicted_label").alias("predicted_label")) for name in models])).alias("x")
    counts = cut_lineage(p.select("true_label", said).groupBy("x.model", "true_label", "x.predicted_label").agg(F.count("*").alias("n")))
    out = None
    for name in models:
        one = summary_metrics(counts.where(F.col("model") == name), weight="n").withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("model", *[c for c in out.columns if c != "model"])


FOLD_METRICS = ("accuracy", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")


def cross_validate(df: DataFrame, kind: str, key: str, text: str = "text", label: str = "label", k: int = 5, options: dict | None = None) -> DataFrame:
    """(fold, five metrics): vectoriser and model are fitted anew in each fold."""
    parts = folds(df.where(F.col(label).isNotNull()), key, label, k)
    out = None
    for i in range(k):
        models = fit_all(parts.where(F.col("fold") != i), [kind], text, label, options=options)
        one = evaluate(models, parts.where(F.col("fold") == i), key, text, label).select(F.lit(i).alias("fold"), *FOLD_METRICS)
        out = one if out is None else out.union(one)
    return out


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """(metric, mean, std) over the folds; the deviation is that of the population, 0 for one fold."""
    long = per_fold.select(F.explode(F.create_map(*[x for m in FOLD_METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"))


def choose_folds(df: DataFrame, label: str, wanted: int) -> int:
    """As many folds as wanted, but no more than the smallest class has rows; 0 without rows."""
    least = df.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.min("count")).first()[0]
    return max(0, min(wanted, least or 0))


def grid_search(df: DataFrame, kind: str, key: str, grid: list[dict], text: str = "text", label: str = "label", k: int = 3) -> DataFrame:
    """(rank, options, mean, std) of the weighted F1 over ``k`` folds of every combination of ``grid``; the best first."""
    out = None
    for options in grid:
        f1 = fold_summary(cross_validate(df, kind, key, text, label, k, options)).where("metric = 'weighted_f1'")
        one = f1.select(F.lit(json.dumps(options, sort_keys=True)).alias("options"), "mean", "std")
        out = one if out is None else out.union(one)
    w = W.orderBy(F.desc("mean"), "options")  # one row a combination
    return out.select(F.row_number().over(w).alias("rank"), "options", "mean", "std")


def leaked_texts(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints that stand in both: the guard against evaluating on training texts."""
    a, b = (d.select(fingerprint(F.col(text)).alias("fingerprint")).where("fingerprint is not null") for d in (train, test))
    return a.intersect(b)


__all__ = ["choose_folds", "classifier", "consensus", "consensus_of", "cross_validate", "evaluate", "feature_importance", "features", "fit", "fit_all", "fold_summary", "grid_search", "leaked_texts", "naive_bayes_table", "predict", "predict_all", "term_counts", "terms", "tfidf", "top_labels", "top_terms", "vocabulary"]
