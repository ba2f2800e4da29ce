"""Validation of annotations, predictions and labelled mails as rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pauta.functions.text import clean_list, strip
from pauta.operators.triggers import PHRASES

MEETING = ["agendamento_reuniao", "cancelamento_reuniao", "reuniao_confirmada"]
ALL_LABELS = [*MEETING, "nao_reuniao"]
KINDS = ["participants", "time", "location", "topic"]


def findings(df: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, level, rule) for each rule (level, condition) that holds."""
    rows = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"))) for name, (level, c) in rules.items()]))
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.level", "x.rule")


def annotation_rules() -> dict[str, tuple[str, Column]]:
    rules = {
        "missing_text": ("error", strip(F.coalesce("text", F.lit(""))) == ""),
        "missing_intent": ("error", F.coalesce("intent", F.lit("")) == ""),
        "unknown_intent": ("error", ~F.col("intent").isin(MEETING) & (F.col("intent") != "")),
        "missing_arguments": ("error", F.col("arguments").isNull()),
        "empty_trigger": ("warning", F.coalesce(F.size("trigger"), F.lit(0)) <= 0),
    }
    for k in KINDS:
        rules[f"no_{k}"] = ("warning", F.col("arguments").isNotNull() & F.col(f"arguments.{k}").isNull())
        rules[f"blank_{k}"] = ("error", F.exists(f"arguments.{k}", lambda x: x.isNull() | (strip(x) == "")))
    return rules


def validate_annotations(gold: DataFrame) -> DataFrame:
    """Findings of every annotation, and ids that stand in more than one distinct row."""
    rows = findings(gold, "id", annotation_rules())
    key = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("intent", F.lit("")), F.to_json("arguments"), F.coalesce(F.array_join("trigger", "|"), F.lit("")))
    twice = gold.select("id", key.alias("k")).distinct().groupBy("id").count().where("count > 1").select("id", F.lit("error").alias("level"), F.lit("duplicate_id").alias("rule"))
    return rows.union(twice).distinct()


def normalize_annotation(gold: DataFrame) -> DataFrame:
    """Missing parts filled and values trimmed: trigger and argument arrays never null."""
    empty = F.array().cast("array<string>")
    fields = [clean_list(F.coalesce(F.col(f"arguments.{k}"), empty)).alias(k) for k in KINDS]
    return gold.withColumns({"text": strip(F.coalesce("text", F.lit(""))), "intent": strip(F.coalesce("intent", F.lit(""))), "trigger": clean_list(F.coalesce("trigger", empty)), "arguments": F.struct(*fields)})


def trigger_mismatch(gold: DataFrame) -> DataFrame:
    """(id) of annotations whose triggers are none of their intent's phrases."""
    allowed = F.create_map(*[x for k, v in PHRASES.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    low = F.transform("trigger", lambda x: F.lower(strip(x)))
    return gold.where((F.size("trigger") > 0) & F.col("intent").isin(ALL_LABELS)).where(~F.arrays_overlap(low, F.element_at(allowed, F.col("intent")))).select("id").distinct()


def dataset_report(mails: DataFrame) -> DataFrame:
    """One row: records, missing labels, empty bodies, empty mails, unknown labels."""
    body, subject, label = (strip(F.coalesce(c, F.lit(""))) for c in ("body", "subject", "label"))
    return mails.agg(
        F.count("*").alias("records"), F.count_if(label == "").alias("missing_label"), F.count_if(body == "").alias("empty_body"), F.count_if((body == "") & (subject == "")).alias("empty_mail"), F.count_if((label != "") & ~label.isin(ALL_LABELS)).alias("unknown_label")
    )


def missing_labels(labels: DataFrame) -> DataFrame:
    """Expected labels that never occur in ``labels (label)``."""
    spark = labels.sparkSession
    return spark.createDataFrame([(x,) for x in ALL_LABELS], "label string").exceptAll(labels.select("label").distinct())


def require_labels(labels: DataFrame) -> None:
    lost = [r["label"] for r in missing_labels(labels).collect()]
    if lost:
        raise ValueError(f"labels without examples: {', '.join(sorted(lost))}")


def intent_of(predicted: Column, label: Column) -> Column:
    """The predicted intent, else the label, else an empty text; empty texts count as missing."""
    return F.coalesce(F.when(predicted != "", predicted), label, F.lit(""))


def without_class(df: DataFrame, label: str, dropped: str) -> DataFrame:
    """``df`` without the rows of one class; rows without a label stay."""
    return df.where(~F.col(label).eqNullSafe(F.lit(dropped)))
