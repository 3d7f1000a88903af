"""Hierarchical keys: paths, wildcards, longest prefixes, aliases up to a fixed point, inherited values.

A path ``a.b[0].c`` is the tokens a, b, 0, c; ``*`` in an entry stands for any number. Lookups are equi
joins on exploded prefixes, never comparisons of every reference with every entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.plans.tables import cut

_PATH = r"^[^\s.\[\]]+(?:\[(?:\d+|\*)\])*(?:\.[^\s.\[\]]+(?:\[(?:\d+|\*)\])*)*$"


def tokens(path: Column) -> Column:
    """The tokens of a path; null if it is none."""
    return F.when(path.rlike(_PATH), F.regexp_extract_all(path, F.lit(r"([^.\[\]]+)"), F.lit(1)))


def render(parts: Column) -> Column:
    """Tokens as a path: numbers and wildcards in brackets."""
    shown = F.transform(parts, lambda t, i: F.when(t.rlike(r"^(?:\d+|\*)$"), F.concat(F.lit("["), t, F.lit("]"))).when(i == 0, t).otherwise(F.concat(F.lit("."), t)))
    return F.array_join(shown, "")


def _general(parts: Column) -> Column:
    """Tokens with every number as a wildcard: the key under which wildcard entries are found."""
    return F.transform(parts, lambda t: F.when(t.rlike(r"^\d+$"), F.lit("*")).otherwise(t))


def longest_prefix(refs: DataFrame, ref: str, entries: DataFrame, entry: str) -> DataFrame:
    """Each reference with the longest entry that is a prefix of it (null if there is none); plain entries win over wildcards."""
    e = entries.select(F.col(entry).alias("entry"), tokens(F.col(entry)).alias("e")).where("e is not null")
    e = e.withColumn("k", F.concat_ws("\0", _general(F.col("e"))))
    r = refs.select(F.col(ref).alias("_ref")).distinct().withColumn("t", tokens(F.col("_ref")))
    prefixes = r.where("t is not null").withColumn("n", F.explode(F.sequence(F.lit(1), F.size("t")))).withColumn("p", F.slice("t", 1, F.col("n"))).withColumn("k", F.concat_ws("\0", _general(F.col("p"))))
    fits = F.forall(F.arrays_zip("p", "e"), lambda x: (x["p"] == x["e"]) | ((x["e"] == "*") & x["p"].rlike(r"^(?:\d+|\*)$")))
    best = prefixes.join(e, "k").where(fits).groupBy("_ref").agg(F.max_by("entry", F.struct("n", F.size(F.filter("e", lambda t: t != "*")))).alias("entry"), F.max("n").alias("depth"))
    return refs.join(best, F.col(ref) == F.col("_ref"), "left").drop("_ref")


def canonical(refs: DataFrame, ref: str, aliases: DataFrame) -> DataFrame:
    """Each reference with the path it leads to after all aliases (alias, target) and whether it runs in a circle.

    The longest alias that is a prefix of the path is replaced by its target; numbers that met a wildcard
    take the place of the target's wildcards. Repeated until nothing changes; a path that comes back, or
    that takes more steps than there are aliases (so that one is met twice), is a circle.
    """
    state = cut(refs.select(F.col(ref).alias("start")).distinct().withColumns({"path": F.col("start"), "circle": F.lit(False), "open": F.lit(True), "seen": F.array("start")}))
    done, most = None, aliases.count() + 1
    for _ in range(most):
        found = longest_prefix(state, "path", aliases, "alias").join(aliases.select(F.col("alias").alias("entry"), "target"), "entry", "left")
        t, e = tokens(F.col("path")), tokens(F.col("entry"))
        caught = F.filter(F.transform(F.arrays_zip(F.slice(t, 1, F.size(e)).alias("p"), e.alias("e")), lambda x: F.when(x["e"] == "*", x["p"])), lambda x: x.isNotNull())
        filled = F.aggregate(tokens(F.col("target")), F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("i")),
                             lambda a, x: F.when(x == "*", F.struct(F.array_append(a.out, F.coalesce(F.get(caught, a.i), x)).alias("out"), (a.i + 1).alias("i"))).otherwise(F.struct(F.array_append(a.out, x).alias("out"), a.i.alias("i"))), lambda a: a.out)
        rest = F.slice(t, F.size(e) + 1, F.greatest(F.size(t), F.lit(1)))
        moved = F.when(F.col("target").isNotNull(), render(F.concat(filled, rest)))
        step = found.withColumn("next", moved).withColumn("again", F.coalesce(F.array_contains("seen", F.col("next")), F.lit(False)))
        step = cut(step.select("start", F.coalesce("next", "path").alias("path"), F.col("again").alias("circle"), (F.col("next").isNotNull() & ~F.col("again")).alias("open"), F.array_append("seen", F.coalesce("next", "path")).alias("seen")))
        closed = step.where("not open").select("start", "path", "circle")
        done = closed if done is None else done.unionByName(closed)
        state = step.where("open")
        if state.limit(1).count() == 0:
            break
    else:
        done = done.unionByName(state.select("start", "path", F.lit(True).alias("circle")))
    return refs.join(done.select(F.col("start").alias("_s"), F.col("path").alias("canonical"), "circle"), F.col(ref) == F.col("_s"), "left").drop("_s")


def expand(refs: DataFrame, ref: str, entries: DataFrame, entry: str) -> DataFrame:
    """(ref, entry) of the entries that a reference with wildcards stands for."""
    r = refs.select(F.col(ref).alias("ref")).distinct().withColumn("t", tokens(F.col("ref"))).where("t is not null").withColumn("k", F.concat_ws("\0", _general(F.col("t"))))
    e = entries.select(F.col(entry).alias("entry")).withColumn("e", tokens(F.col("entry"))).where("e is not null").withColumn("k", F.concat_ws("\0", _general(F.col("e"))))
    return r.join(e, "k").where(F.forall(F.arrays_zip("t", "e"), lambda x: (x["t"] == "*") | (x["t"] == x["e"]))).select("ref", "entry")


def inherited(entries: DataFrame, names: list[str]) -> DataFrame:
    """(path, name, value, depth): for each path and name the value of the nearest ancestor that has it, itself first.

    ``entries`` has ``path`` and one column for each name.
    """
    t = entries.withColumn("t", tokens(F.col("path"))).where("t is not null")
    up = t.select("path", F.size("t").alias("n"), F.explode(F.transform(F.sequence(F.size("t"), F.lit(1)), lambda k: F.struct(k.alias("depth"), F.concat_ws("\0", F.slice("t", 1, k)).alias("k")))).alias("a")).select("path", "a.depth", "a.k")
    own = t.select(F.concat_ws("\0", "t").alias("k"), F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))).alias("name", "value")).where("value is not null")
    return up.join(own, "k").groupBy("path", "name").agg(F.max_by("value", "depth").alias("value"), F.max("depth").alias("depth"))


def answers(families: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(family, refs) -> (family, canonical, entry), each canonical path once for each family, in the order of refs."""
    refs = families.select("family", F.posexplode("refs").alias("p", "ref"))
    led = longest_prefix(canonical(refs, "ref", aliases), "canonical", entries, "path")
    return led.groupBy("family", "canonical", "entry").agg(F.min("p").alias("position"))


def integrity(refs: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: how many references lead to an entry, to none, or in a circle."""
    led = longest_prefix(canonical(refs.select("ref").distinct(), "ref", aliases), "canonical", entries, "path")
    return led.agg(F.count_if(F.col("entry").isNotNull() & ~F.col("circle")).alias("valid"), F.count_if(F.col("entry").isNull() & ~F.col("circle")).alias("missing"), F.count_if("circle").alias("circular"))


def context(entries: DataFrame, modules: list[str], excluded: list[str]) -> DataFrame:
    """Entries of the wanted modules without the excluded ones."""
    return entries.where(F.col("module").isin(modules) & ~F.col("module").isin(excluded) if excluded else F.col("module").isin(modules))
