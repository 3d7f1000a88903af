"""Sinks: versioned tables, content-addressed blobs, files replaced as a whole, reports."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_file(path: str, text: str) -> None:
    """A local file written beside its place and moved there, so that readers see the old or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def read_blobs(spark, path: str, most_bytes: int) -> DataFrame:
    """(path, length, digest, content) of the files below a folder that are not too long."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most_bytes)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"), "content")


def new_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each content that is not stored yet."""
    first = Window.partitionBy("digest").orderBy("path")
    return blobs.join(stored.select("digest").distinct(), "digest", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def write_version(df: DataFrame, root: str, version: int) -> str:
    """A state table as a new version; the version before stays readable until it is removed."""
    path = f"{root}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def append_new(df: DataFrame, stored: DataFrame | None, key: str, path: str) -> DataFrame:
    """Rows with unknown keys appended to a table; gives the rows that were new, so a repeat appends nothing."""
    fresh = df.dropDuplicates([key]) if stored is None else df.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def digest_lines(scored: DataFrame, minimum: int, title: str, most: int) -> DataFrame:
    """(line_no, line) of a report: a head with counts, then leads of enough points, best first, numbered before the filter."""
    order = Window.orderBy(F.col("score").desc(), F.col("ord"))
    best = scored.orderBy(F.col("score").desc(), F.col("ord")).limit(most).withColumn("n", F.row_number().over(order))
    leads = best.where(F.col("score") >= minimum).select((F.col("n") + 1).alias("line_no"), F.format_string("%d. %s - %s (%s) score %d %s", "n", "title", "company", "location", "score", "url").alias("line"))
    head = scored.agg(F.format_string(f"# {title}: %d postings, %d leads", F.count(F.lit(1)), F.count_if(F.col("score") >= minimum)).alias("line")).select(F.lit(1).alias("line_no"), "line")
    return head.unionByName(leads)


def task_line(company, role, url, priority):
    """One task of a Markdown list; special characters are escaped, parentheses in addresses are encoded."""
    from tideglass.functions.text import markdown_escape

    safe = F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return F.concat(F.lit("- [ ] "), priority, F.lit(" **"), markdown_escape(company), F.lit("｜"), markdown_escape(role), F.lit("** · [Official job]("), safe, F.lit(")"))


def table_line(*cells):
    """One row of a Markdown table; pipes in cells are escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, before, after) of whole rows as JSON: the plan of a change, to be checked before it is applied."""
    b = before.select(key, F.to_json(F.struct(*before.columns)).alias("before"))
    a = after.select(key, F.to_json(F.struct(*after.columns)).alias("after"))
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return b.join(a, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select(key, change.alias("change"), "before", "after")


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order: the version that a plan was made for."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    n, total = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).collect()[0]
    return f"{n}:{total or 0}"
