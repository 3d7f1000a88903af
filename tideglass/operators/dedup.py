"""Removal of repeats: first wins by one key, and the greedy rule over three keys.

Ordering is always by an explicit column; ties in it go to the smaller remaining values of ``key``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.plans.tables import cut


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are one key.

    A partial aggregate: each task keeps one row of a key, so a key of any size costs one row a task. Nulls
    of the order come first; ``order`` holds plain ascending expressions (negate a number to turn it round).
    """
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])).alias("_first"))
    return first.select("_first.*")


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of a total order, as a top-k (no global sort)."""
    return rows.orderBy(*order).limit(most)


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (u, v): minimum labels with pointer jumping, cut every round.

    The number of rounds grows with the logarithm of the longest chain, not with its length.
    """
    edges = cut(pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    label = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = edges.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "node")
        stepped = label.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        up = stepped.select(F.col("node").alias("next"), F.col("next").alias("over"))
        jumped = stepped.join(up, "next", "left").select("node", F.least("next", F.coalesce("over", "next")).alias("new"), "label")
        after = cut(jumped.select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        if after.where("moved").limit(1).count() == 0:
            return after.select("node", F.col("label").alias("component"))
        label = after.select("node", "label")


def greedy(rows: DataFrame, order: str, url: str, owner: str, ident: str, fingerprint: str) -> DataFrame:
    """Rows kept by the greedy rule in the order of ``order`` (unique, a number).

    A row is dropped if its address is that of a kept row, or its owner and id are, or a kept row has its
    fingerprint while one of the two has no id or both have the same. Only kept rows register keys, so
    the rule is sequential; rows without a common key cannot touch each other, so it runs for each
    connected component of the key graph. Rows that share no key with any other are kept without that.
    Exact repeats in all keys are settled before (only their first row can be kept), so a group of
    copies of any size adds one row to its component.
    """
    keyed = rows.select(F.col(order).alias("o"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((url, "u_"), (owner, "w_"), (ident, "i_"), (fingerprint, "f_"))])
    has_any = (F.col("u_") != "") | ((F.col("w_") != "") & (F.col("i_") != "")) | (F.col("f_") != "")
    bare = keyed.where(~has_any).select("o")
    heads = first_by(keyed.where(has_any), ["u_", "w_", "i_", "f_"], [F.col("o")])
    # an id-less, address-less row of one fingerprint repeats itself; with an address or id its first row decides for all
    keys = F.array_compact(F.array(F.when(F.col("u_") != "", F.concat(F.lit("u"), "u_")), F.when((F.col("w_") != "") & (F.col("i_") != ""), F.concat(F.lit("i"), "w_", F.lit("\0"), "i_")), F.when(F.col("f_") != "", F.concat(F.lit("f"), "f_"))))
    long = heads.select("o", F.explode(keys).alias("k"))
    anchors = long.groupBy("k").agg(F.min("o").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "a")
    edges = long.join(anchors, "k").where("o <> a").select(F.col("o").alias("u"), F.col("a").alias("v"))
    parts = components(edges)
    joined = heads.join(parts, heads.o == parts.node, "left")
    alone = joined.where("component is null").select("o")

    def keep(batch: pd.DataFrame) -> pd.DataFrame:
        urls, ids, prints, out = set(), set(), {}, []
        for r in batch.sort_values("o").itertuples():
            before = prints.get(r.f_, ()) if r.f_ else ()
            same = bool(before) and (not r.i_ or "" in before or r.i_ in before)
            if (r.u_ and r.u_ in urls) or (r.w_ and r.i_ and (r.w_, r.i_) in ids) or same:
                continue
            out.append(r.o)
            if r.u_:
                urls.add(r.u_)
            if r.w_ and r.i_:
                ids.add((r.w_, r.i_))
            if r.f_:
                prints.setdefault(r.f_, set()).add(r.i_)
        return pd.DataFrame({"o": out})

    settled = joined.where("component is not null").select("component", "o", "u_", "w_", "i_", "f_").groupBy("component").applyInPandas(keep, "o long")
    kept = bare.unionByName(alone).unionByName(settled)
    return rows.join(kept.select(F.col("o").cast("long").alias("_o")), F.col(order).cast("long") == F.col("_o"), "left_semi")


def unseen(rows: DataFrame, tracked: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows whose key is not tracked yet, the first of each key: an anti join, then first wins."""
    return first_by(rows.join(tracked.select(F.col(key)).distinct(), key, "left_anti"), [key], order)
