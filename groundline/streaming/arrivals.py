"""Checking reports as they arrive in a folder: a stateless stream, one result a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..check import check_reports


def checked_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming frame of ``check_reports`` over the HTML files that come into ``folder``, graphs embedded."""
    pages = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.html").load(folder)
    path = F.col("_metadata.file_path")
    return check_reports(pages.select(path.alias("report_id"), F.element_at(F.split(path, "/"), -1).alias("report"), F.col("value").alias("html"), F.lit(None).cast("string").alias("sidecar")))
