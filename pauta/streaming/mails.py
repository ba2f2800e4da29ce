"""The row-local operators over a stream of mails (an extension: the batch rules, continuously)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pauta.timestamps import with_seconds


def read(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_each(mails: DataFrame, key: str = "email_id", at: str = "imported_at", delay: str = "1 day") -> DataFrame:
    """Deliveries that repeat a key within the watermark come out once."""
    return mails.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def hourly_counts(mails: DataFrame, at: str = "imported_at", delay: str = "1 day") -> DataFrame:
    """(hour, mails) in append mode; rows later than the delay are dropped by the watermark."""
    return mails.withWatermark(at, delay).groupBy(F.window(at, "1 hour").alias("w")).agg(F.count("*").alias("mails")).select(F.col("w.start").alias("hour"), "mails")


def delays(mails: DataFrame) -> DataFrame:
    """Stateless: seconds between the sent instant and the import."""
    out = with_seconds(mails, "sent_datetime", "sent_seconds")
    return out.withColumn("delay_seconds", F.unix_seconds("imported_at") - F.col("sent_seconds"))
