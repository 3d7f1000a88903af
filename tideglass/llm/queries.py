"""Named queries of the problems in this subpackage; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import canonical, encoding, history, mainbody, matching, mixing, residue, sentences
from tideglass.plans.tables import table


def _load(spark: SparkSession, sf_dir: str):
    return lambda name: table(spark, sf_dir, name)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.workspace(spark, _load(spark, sf_dir)).select("field", "row_id", "ref_id")


def p1_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched values with the number of rows that hold each."""
    return canonical.workspace(spark, _load(spark, sf_dir)).where("ref_id = 0").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = _load(spark, sf_dir)
    return history.found(load("seen_jobs"), load("seen_batch"), load("ref_location"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.boilerplate(mainbody.workspace_pages(_load(spark, sf_dir)))


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered main body of every page text, HTML descriptions included."""
    load = _load(spark, sf_dir)
    html = load("ashby_job").select(F.lit("ashby_job.description_html").alias("field"), F.col("ashby_row").alias("row_id"), F.col("description_html").alias("text"))
    return mainbody.bodies(mainbody.workspace_pages(load).unionByName(html))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = _load(spark, sf_dir)
    return matching.match(load("job_item"), load("ref_location")).select("ord_a", "ord_b")


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched pairs with score and confidence."""
    load = _load(spark, sf_dir)
    return matching.match(load("job_item"), load("ref_location"))


def p5_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reliability table of the confidences."""
    load = _load(spark, sf_dir)
    return matching.reliability_table(load("job_item"), load("ref_location"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.flag(table(spark, sf_dir, "job_item")).select("ord", "field")


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged fields with what was found in each."""
    return residue.flag(table(spark, sf_dir, "job_item"))


def p6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the snippets of each source follow its template, as induced from the values of their records."""
    return residue.templates(table(spark, sf_dir, "job_item"))[0]


def p6_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields found by alignment and counts alone, without any list of phrases."""
    return residue.flag(table(spark, sf_dir, "job_item"), lists=False)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with the number of copies of each."""
    return mixing.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, and which sources miss."""
    return mixing.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_misses, p3_found, p4_found, p4_bodies, p5_found, p5_confidence, p5_reliability, p6_found, p6_reasons, p6_templates, p6_induced, p7_ids, p8_mix, p8_shares, p9_found)}
ORACLE_SQL: dict[str, str] = {}
