"""Readers of mail data sets into typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAIL = "id bigint, subject string, body string, label string, sender string, sender_email string, recipient string, recipient_email string, sent_datetime string, topic string, location string, time_expression string, participants array<string>"
CASE = "struct<id:string,split:string,subject:string,body:string,label:string,gold_topic:string>"
GOLD = "id bigint, text string, intent string, trigger array<string>, arguments struct<participants:array<string>,time:array<string>,location:array<string>,topic:array<string>>, confidence map<string,double>, metadata struct<created_at:string,validated:boolean,version:string>"


def json_array(spark: SparkSession, path: str, schema: str = MAIL) -> DataFrame:
    """A JSON array of records, or one object as one row; unreadable records are dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def strict_array(spark: SparkSession, path: str, schema: str = MAIL) -> DataFrame:
    """A JSON array; another root raises."""
    heads = spark.read.option("wholetext", True).text(path).where(~F.ltrim("value").startswith("["))
    if heads.limit(1).count():
        raise ValueError("the root must be a list")
    return json_array(spark, path, schema)


def topic_cases(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Cases under the root key ``cases``; duplicate ids, missing keys and an empty result raise."""
    cases = spark.read.schema(f"description string, cases array<{CASE}>").option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    if cases.where("id is null or subject is null or body is null or label is null or gold_topic is null").limit(1).count():
        raise ValueError("a case lacks a key")
    if cases.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate case ids")
    out = cases.where(F.col("split") == split) if split else cases
    if not out.limit(1).count():
        raise ValueError("no cases")
    return out


def keyed_predictions(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Predictions in an object keyed by id: (id, value); keys that are no number are skipped."""
    whole = spark.read.option("wholetext", True).text(path)
    entries = whole.select(F.explode(F.map_entries(F.from_json("value", f"map<string,{value}>"))).alias("e"))
    return entries.select(F.col("e.key").try_cast("bigint").alias("id"), F.col("e.value").alias("value")).where("id is not null")


def gold_list(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, GOLD)


def valid_mails(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rows without label, or with both subject and body empty, are rejected."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = blank(F.col("label")) | (blank(F.col("subject")) & blank(F.col("body")))
    return df.where(~bad), df.where(bad)


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows by ``order``, in order: the limit is the feature (newest messages)."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def is_json_object(c):
    """Whether a text is a JSON object."""
    return F.json_object_keys(c).isNotNull()
