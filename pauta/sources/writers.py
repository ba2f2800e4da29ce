"""Writers of results: partitioned files for data, single files for small reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 100_000


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def pretty_array(df: DataFrame, path: str) -> int:
    """One indented JSON array; for reports of up to ``SMALL`` rows (more raise)."""
    if df.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"more than {SMALL} rows; write JSON lines")
    rows = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return len(rows)


def confusion_wide(confusion: DataFrame) -> DataFrame:
    """The confusion matrix with a column a predicted label and the corner cell ``true\\predicted``."""
    return confusion.groupBy(F.col("true_label").alias("true\\predicted")).pivot("predicted_label").agg(F.sum("n")).na.fill(0).orderBy("true\\predicted")


def flat(df: DataFrame, joiner: str = "_") -> DataFrame:
    """Nested structs as columns with joined names."""
    out, pending = df, True
    while pending:
        pending = [f.name for f in out.schema.fields if f.dataType.typeName() == "struct"]
        cols = []
        for f in out.schema.fields:
            if f.name in pending:
                cols += [F.col(f"`{f.name}`")[s.name].alias(f"{f.name}{joiner}{s.name}") for s in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        out = out.select(*cols)
    return out


def error_rows(predictions: DataFrame) -> DataFrame:
    """The rows whose prediction differs from the true label, with the report's columns."""
    return predictions.where(~F.col("true_label").eqNullSafe(F.col("predicted_label"))).select("id", "subject", "true_label", "predicted_label", "confidence", F.substring("text", 1, 120).alias("preview"))


def markdown(df: DataFrame) -> str:
    """A small table as Markdown."""
    head = "| " + " | ".join(df.columns) + " |\n" + "|" + " --- |" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in df.limit(SMALL).toLocalIterator())


#: The columns of the reports' files.
SUMMARY_COLUMNS = ["model", "accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted", "cv_f1_macro_mean", "cv_f1_macro_std", "cv_accuracy_mean", "cv_accuracy_std", "train_seconds", "predict_seconds"]
CLASSIC_COLUMNS = ["email_id", "subject", "participants", "time", "location", "topic"]
COMPARISON_COLUMNS = ["category", "exact_a", "exact_b", "f1_a", "f1_b", "f1_delta", "winner"]


def summary_rows(evaluation: DataFrame, folds: DataFrame | None = None, seconds: DataFrame | None = None) -> DataFrame:
    """The models' summary with its fixed columns.

    ``evaluation`` is of ``ml.evaluate``, ``folds`` has (model, metric, mean, std), ``seconds``
    (model, train_seconds, predict_seconds); what is missing stays null. One row a model.
    """
    out = evaluation.select("model", "accuracy", *[F.col(f"macro_{a}").alias(f"{a}_macro") for a in ("precision", "recall", "f1")], F.col("weighted_f1").alias("f1_weighted"))
    if folds is not None:
        value = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
        named = [(m, c, f"cv_{n}_{c}") for m, n in (("macro_f1", "f1_macro"), ("accuracy", "accuracy")) for c in ("mean", "std")]
        out = out.join(folds.groupBy("model").agg(*[value(m, c).alias(n) for m, c, n in named]), "model", "left")
    if seconds is not None:
        out = out.join(seconds, "model", "left")
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in SUMMARY_COLUMNS])


def classic_rows(answers: DataFrame) -> DataFrame:
    """One row a mail from (id, subject, and a struct with ``answer`` a category): null answers are empty texts."""
    return answers.select(F.col("id").alias("email_id"), F.coalesce("subject", F.lit("")).alias("subject"), *[F.coalesce(F.col(f"{c}.answer"), F.lit("")).alias(c) for c in CLASSIC_COLUMNS[2:]])


def latex(df: DataFrame) -> str:
    """A small table as LaTeX."""
    sign = str.maketrans({c: "\\" + c for c in "&%$#_{}"})
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).translate(sign)
    lines = [" & ".join(cell(v) for v in r) + r" \\" for r in [df.columns, *df.limit(SMALL).toLocalIterator()]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}", ""])


def report_errors(errors: DataFrame, most: int = 100) -> DataFrame:
    """The report's error list: missed values by id, values found wrongly only where none is missed; at most ``most``."""
    missed = errors.where("error = 'false_negative'")
    return (missed if missed.limit(1).count() else errors.where("error = 'false_positive'")).orderBy("id", "pos").limit(most)
