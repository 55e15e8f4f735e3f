"""Contacts as a stream: the activity report and the first contact of each key, kept up to date under a watermark.

contacts has an event time column ts. State is bounded by the watermark, not by the length of the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qsolake.sources.logs import cabrillo_contacts


def log_folder(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Cabrillo logs that are dropped into a folder, as contacts with ts."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_at_once).load(path)
    rows = cabrillo_contacts(files.select(F.col("_metadata.file_path").alias("log"), F.col("value").alias("text")))
    return rows.withColumn("ts", F.try_to_timestamp(F.concat_ws(" ", "QSO_DATE", "TIME_ON"), F.lit("yyyy-MM-dd HHmm")))


def activity(contacts: DataFrame, minutes: int, by: list[str | Column], late: str = "1 hour") -> DataFrame:
    """Contacts for each window of so many minutes and each value of by."""
    size = f"{max(1, min(1440, minutes))} minutes"
    windows = contacts.withWatermark("ts", late).groupBy(F.window("ts", size), *by)
    return windows.agg(F.count(F.lit(1)).alias("contacts")).withColumn("bucket", F.col("window.start")).drop("window")


def first_contacts(contacts: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Contacts without those whose keys were seen before, within the watermark."""
    return contacts.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
