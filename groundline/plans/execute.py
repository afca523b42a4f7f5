"""Running a composed script on Spark: the warehouse is the session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .compose import SPARK, compose


def run_script(spark: SparkSession, script: str) -> DataFrame:
    """A script of the Spark dialect as a frame; Catalyst prunes and merges what its parts share."""
    return spark.sql(script)


def run_report(spark: SparkSession, graph: dict, report: str = "report", node_id: str | None = None) -> DataFrame:
    """(figure, label, value) of a report, or the rows of one source or view."""
    return run_script(spark, compose(graph, report, node_id, SPARK))
