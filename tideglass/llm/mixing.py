"""Mixing sources to target weights (problem 8).

Method: capped water-filling. Each source wants its weight of the total; a source that would need
more than its maximum of repetitions is clamped there, and what it leaves is given to the others in
proportion to their weights until nothing is clamped any more. A source's allocation is then a whole
number of repetitions of all its documents and a fractional one, for which documents are taken in a
seeded hash order until the fraction's tokens are reached. That order is cut by a histogram of hash
buckets, so that no source is ever sorted in one task: only the bucket in which the cut falls is.

Defined cases: documents of a null source or of one without a target are not used, though their
tokens count towards the total; a target without documents, or with documents of no tokens, gets
nothing and misses; a null weight counts as 0, a null maximum as 1; weights that do not sum to 1 are
scaled; repeated rows are separate documents; no targets give an empty selection.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from tideglass.llm.encoding import TOKENIZERS, tokenizer
from tideglass.plans.tables import bounded_rows, cut

MAX_SOURCES = 10_000
BUCKETS = 4096
SEED = 8
TOLERANCE = 0.005


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, source, tokens), written out once because two passes read it."""

    def count(texts: pd.Series) -> pd.Series:
        distinct = {t: 0 for t in texts if t}
        for text, e in zip(distinct, tokenizer(path).encode_batch(list(distinct), add_special_tokens=False), strict=True):
            distinct[text] = len(e.ids)
        return pd.Series([distinct[t] if t else 0 for t in texts], dtype="int64")

    return cut(documents.select("doc_id", "source", pandas_udf(count, LongType())("text").alias("tokens")))


def water_fill(total: float, weights: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """The allocation of each source: proportional to the weights, none above its cap, all of ``total`` where the caps allow it."""
    allocation, active, rest = dict.fromkeys(weights, 0.0), {s for s in weights if weights[s] > 0 and caps[s] > 0}, float(total)
    while active:
        share = rest / sum(weights[s] for s in active)
        full = {s for s in active if share * weights[s] >= caps[s]}
        if not full:
            for s in active:
                allocation[s] = share * weights[s]
            break
        for s in full:
            allocation[s] = caps[s]
            rest -= caps[s]
        active -= full
    return allocation


def plan(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One record for each target: size, allocation, whole repetitions and the tokens of the fractional one."""
    rows = bounded_rows(targets.select("source", "weight", "max_repeats"), MAX_SOURCES, "mix_target")
    rows = list({r.source: r for r in rows if r.source is not None}.values())
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = by_source.agg(F.sum("tokens")).collect()[0][0] or 0
    names = targets.select("source").where("source is not null").distinct()
    have = {r.source: r.tokens for r in bounded_rows(by_source.join(names, "source", "left_semi"), MAX_SOURCES, "sizes of the targets")}
    scale = sum(max(r.weight or 0.0, 0.0) for r in rows) or 1.0
    weights = {r.source: max(r.weight or 0.0, 0.0) / scale for r in rows}
    repeats = {r.source: max(1 if r.max_repeats is None else r.max_repeats, 0) for r in rows}
    caps = {s: float(repeats[s] * have.get(s, 0)) for s in weights}
    allocation = water_fill(total, weights, caps)
    out = []
    for s in weights:
        size = have.get(s, 0)
        whole = min(int(allocation[s] / size + 1e-9), repeats[s]) if size else 0
        out.append({"source": s, "weight": weights[s], "max_repeats": repeats[s], "size": size, "total": total, "allocated": allocation[s], "whole": whole, "part": max(allocation[s] - whole * size, 0.0) if whole < repeats[s] else 0.0})
    return out


_PLAN = "source string, weight double, max_repeats int, size long, total long, allocated double, whole int, part double"


def select(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(the selection: doc_id, source, tokens, n_copies; the report: one row for each target)."""
    spark = documents.sparkSession
    sizes = token_counts(documents)
    planned = spark.createDataFrame(plan(sizes, targets), _PLAN)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS))
    rows = sizes.join(F.broadcast(planned.select("source", "whole", "part")), "source").withColumn("bucket", bucket).withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id"))
    histogram = rows.groupBy("source", "bucket", "part").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy("source").orderBy("bucket")
    histogram = histogram.withColumn("after", F.sum("tokens").over(upto)).withColumn("before", F.col("after") - F.col("tokens"))
    whole_bucket, split_bucket = F.col("after") <= F.col("part"), (F.col("before") < F.col("part")) & (F.col("after") > F.col("part"))
    # one row for each target: sums only grow, so the buckets up to ``upto`` are taken as a whole and ``split`` in part
    limits = histogram.groupBy("source").agg(F.max(F.when(whole_bucket, F.col("bucket"))).alias("upto"), F.max(F.when(split_bucket, F.col("bucket"))).alias("split"), F.max(F.when(split_bucket, F.col("before"))).alias("before"))
    limited = rows.join(F.broadcast(limits), "source")
    in_border = limited.where(F.col("bucket") == F.col("split"))
    within = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_border = in_border.withColumn("after", F.col("before") + F.sum("tokens").over(within))
    taken = (F.col("part") - (F.col("after") - F.col("tokens"))) >= F.col("tokens") / 2  # at most half a document beyond the cut
    in_border = in_border.select("doc_id", "source", "tokens", (F.col("whole") + F.when(taken, 1).otherwise(0)).alias("n_copies"))
    inside = F.coalesce(F.col("bucket") <= F.col("upto"), F.lit(False)) & (F.col("part") > 0)
    others = limited.where(~F.col("bucket").eqNullSafe(F.col("split"))).select("doc_id", "source", "tokens", (F.col("whole") + F.when(inside, 1).otherwise(0)).alias("n_copies"))
    chosen = others.unionByName(in_border).where("n_copies > 0")
    actual = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_copies")).alias("actual_tokens"), F.max("n_copies").alias("most_copies"))
    report = planned.join(actual, "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0).cast("long")))
    share = F.col("actual_tokens") / F.nullif(F.sum("actual_tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))
    report = report.withColumn("share", F.coalesce(share, F.lit(0.0)))
    return chosen, report.select(
        "source", "weight", "max_repeats", F.col("size").alias("available_tokens"), F.round(F.col("weight") * F.col("total")).cast("long").alias("target_tokens"), "actual_tokens", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round("share", 6).alias("share"),
        (F.abs(F.col("share") - F.col("weight")) > TOLERANCE).alias("misses_target"), (F.col("actual_tokens") < F.col("weight") * F.col("total") * (1 - TOLERANCE)).alias("falls_short"))
