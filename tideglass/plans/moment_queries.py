"""Named queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import moments
from tideglass.plans.tables import table


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.resolve(moments.workspace_values(table(spark, sf_dir, "job_item"), table(spark, sf_dir, "job_verification")), table(spark, sf_dir, "job_source"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("field", "row_id", "utc_us")


def p2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field and notation were read, chosen or left ambiguous."""
    return _resolved(spark, sf_dir).groupBy("field", "family", "status").agg(F.count(F.lit(1)).alias("n_values"))


def p2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated day-first share of each source and notation."""
    values = moments.workspace_values(table(spark, sf_dir, "job_item"), table(spark, sf_dir, "job_verification"))
    return moments.estimate(moments.read_all(values, table(spark, sf_dir, "job_source")))


QUERIES = {"p2_found": p2_found, "p2_status": p2_status, "p2_mixture": p2_mixture}
