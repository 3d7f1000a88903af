"""Checks of a handoff between tables and notes: dispositions, counts, pending work, ownership, places to review.

Everything that breaks a rule is a row of a violations table; nothing is changed by a check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions import text as T

# What can become of a candidate.
DISPOSITIONS = ["queued", "manual_review", "excluded", "duplicate"]
DASH = "—"


def disposition_counts(decisions: DataFrame) -> DataFrame:
    """(batch, queued, manual_review, excluded, duplicate, evaluated) of decisions (batch, ord, id, disposition); the first of an id wins, missing ones count 0."""
    first = decisions.groupBy("batch", "id").agg(F.min_by("disposition", "ord").alias("disposition"))
    return first.groupBy("batch").agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS], F.count(F.lit(1)).alias("evaluated"))


def counters(rows: DataFrame, key: str, eligible: Column, known: DataFrame) -> DataFrame:
    """One row: rows evaluated, distinct keys, eligible keys, and those of them that are not known yet."""
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(eligible, F.lit(False))).alias("eligible"))
    marked = per_key.join(known.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    return marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"), F.count(F.lit(1)).alias("unique"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("known").isNull()).alias("added"))


def summary_violations(rows: DataFrame, categories: list[str], totals: dict[str, list[str]]) -> DataFrame:
    """(category, rule) of a count summary (category, submitted, target, remaining as texts) that breaks a rule.

    Every category and total stands once; submitted is a number; target and remaining are numbers or both
    dashes, remaining is their difference; a total's target is the sum of its members' or a dash.
    """
    names = [*categories, *totals]
    number = lambda c: F.col(c).rlike(r"^-?\d+$")
    rules = {
        "unknown category": ~F.col("category").isin(names), "submitted is no number": ~F.coalesce(F.col("submitted").rlike(r"^\d+$"), F.lit(False)),
        "numeric remaining required": number("target") & ~F.coalesce(number("remaining"), F.lit(False)), "target and remaining must both be dashes": ~number("target") & ((F.col("target") != DASH) | (F.col("remaining") != DASH)),
        "remaining is not target less submitted": number("target") & number("remaining") & (F.col("remaining").try_cast("long") != F.col("target").try_cast("long") - F.col("submitted").try_cast("long")),
    }
    own = rows.select("category", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "category string")
    found = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    once = wanted.join(found, "category", "left").where("n is null or n > 1").select("category", F.when(F.col("n").isNull(), "missing").otherwise("several rows").alias("rule"))
    members = spark.createDataFrame([(t, m) for t, ms in totals.items() for m in ms], "total string, category string")
    targets = members.join(rows.select("category", "target"), "category").groupBy("total").agg(F.when(F.count_if(~number("target")) == 0, F.sum(F.col("target").try_cast("long")).cast("string")).otherwise(DASH).alias("expected"))
    conflicts = rows.join(targets, F.col("category") == F.col("total")).where("target <> expected").select("category", F.lit("target totals conflict").alias("rule"))
    return own.unionByName(once).unionByName(conflicts)


def baseline_violations(stored: DataFrame, classified: DataFrame, unclassified: int, rows: int) -> DataFrame:
    """(category, rule): stored counts (category, n) against classified ones; the sum is the rows, none known exceeds its stored count, and the rest is what could not be classified."""
    both = stored.withColumnRenamed("n", "stored").join(classified.withColumnRenamed("n", "known"), "category", "full_outer").select("category", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("known", F.lit(0)).alias("known"))
    above = both.where("known > stored").select("category", F.lit("more rows than stored").alias("rule"))
    total = both.agg(F.sum("stored").alias("s"), F.sum("known").alias("k"))
    whole = total.select(F.lit(None).cast("string").alias("category"), F.explode(F.array_compact(F.array(F.when(F.col("s") != rows, "sum is not the number of rows"), F.when(F.col("s") - F.col("k") != unclassified, "rest is not what is unclassified")))).alias("rule"))
    return above.unionByName(whole)


def with_details(items: DataFrame, details: DataFrame, keys: list[str], wanted: Column, order: list[Column], most: int) -> DataFrame:
    """Items with ``detail`` of the pages joined by ``keys``; of the wanted ones only the first ``most`` in order (the budget of page reads)."""
    chosen = items.where(wanted).orderBy(*order).limit(most).select(*keys).distinct().withColumn("_chosen", F.lit(True))
    return items.join(chosen, keys, "left").join(details, keys, "left").withColumn("detail", F.when(F.col("_chosen") & wanted, F.col("detail"))).drop("_chosen")


def ids_in_texts(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, sink) of the ids that stand in a text as a whole (letters, digits, ``_`` and ``-`` around them end it); texts are cut into tokens once, so it is an equi join."""
    tokens = texts.select("sink", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_-]+"), F.lit(0)))).alias("id"))
    return ids.select("id").distinct().join(tokens, "id").select("id", "sink").distinct()


def unnamed(names: DataFrame, name: str, text: str) -> DataFrame:
    """Names that do not stand in a note; the note is one text, so the test is a scan of the names."""
    return names.where(~F.contains(F.lower(F.lit(text)), F.lower(F.col(name))))


def handoff_violations(candidates: DataFrame, sinks: DataFrame, counts: dict[str, int], batch: str) -> DataFrame:
    """(id, rule): candidates (id, disposition) of a batch against what the sinks (sink, text) hold and the counts noted for it."""
    known = F.col("disposition").isin(DISPOSITIONS)
    wrong = candidates.where(~F.coalesce(known, F.lit(False))).select("id", F.lit("unknown disposition").alias("rule"))
    twice = candidates.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("several dispositions").alias("rule"))
    held = ids_in_texts(candidates.select("id"), sinks)
    need = candidates.where("disposition in ('queued', 'duplicate')").select("id", F.when(F.col("disposition") == "queued", "queue").otherwise("history").alias("sink"))
    absent = need.join(held, ["id", "sink"], "left_anti").select("id", F.concat(F.lit("not in "), "sink").alias("rule"))
    seen = disposition_counts(candidates.select(F.lit(batch).alias("batch"), F.lit(0).alias("ord"), "id", "disposition"))
    noted = reduce(Column.__or__, [F.col(d) != F.lit(counts.get(d, 0)) for d in DISPOSITIONS])
    return wrong.unionByName(twice).unionByName(absent).unionByName(seen.where(noted).select(F.lit(None).cast("string").alias("id"), F.lit("counts differ from the note").alias("rule")))


def owned(registered: DataFrame, live: DataFrame, key: str, url: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(owned rows, rows whose address is another now, registered rows that are gone) of registered and live watches."""
    joined = registered.join(live.select(key, F.col(url).alias("_now")), key)
    same = F.col(url).eqNullSafe(F.col("_now"))
    return joined.where(same).drop("_now"), joined.where(~same).withColumnRenamed("_now", "live_url"), registered.join(live.select(key), key, "left_anti")


def pending(intents: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Creations that were noted before they were tried and never confirmed: while there is one, nothing new may be tried."""
    return intents.join(done.select(key), key, "left_anti")


def coverage(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, finding): what one of two sets has and the other lacks; no rows where the sets are equal."""
    both = found.select(key).distinct().withColumn("_f", F.lit(1)).join(wanted.select(key).distinct().withColumn("_w", F.lit(1)), key, "full_outer")
    return both.where("_f is null or _w is null").select(key, F.when(F.col("_f").isNull(), "missing").otherwise("unexpected").alias("finding"))


def review_places(lines: DataFrame, names: list[str], structured: Column) -> DataFrame:
    """Lines (note, line, value) that name one of the targets outside of structured rows."""
    form = T.squeezed_match_form(F.col("value"))
    return lines.where(T.any_term(form, names) & ~F.coalesce(structured, F.lit(False)))


def field_violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule (name -> condition of a good row) that a row breaks; an unknown condition counts as broken."""
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))).alias("rule"))


def render_funnel(counts: DataFrame) -> DataFrame:
    """One text from the counts of ``ledger.funnel``."""
    say = lambda words, *names: F.concat(*[x for w, n in zip(words, names, strict=True) for x in (F.lit(w), F.col(n).cast("string"))])
    return counts.select(F.concat_ws("\n", say(["current: ", ", p0: ", ", p1: ", ", p2: "], "current_count", "p0_count", "p1_count", "p2_count"), say(["last 7 days: ", ", stale: "], "recent_count", "stale_count"),
                                     say(["urgent: ", ", expired: "], "urgent_count", "expired_count"), say(["unknown queued: ", ", unknown deadline: "], "unknown_queued", "unknown_deadline")).alias("text"))


def append_between(text: str, lines: list[str], start: str, end: str) -> str:
    """``text`` with lines added before the end marker; all other bytes stay, line ends are those of the text."""
    if text.count(start) != 1 or text.count(end) != 1 or text.index(start) > text.index(end):
        raise ValueError("both markers are required once, in order")
    if not lines:
        return text
    newline = next((n for n in ("\r\n", "\n", "\r") if n in text), "\n")
    head, rest = text[: text.index(start) + len(start)], text[text.index(start) + len(start) :]
    body, tail = rest[: rest.index(end)], rest[rest.index(end) :]
    kept = [body.strip()] if body.strip() else []
    return head + newline + (newline * 2).join([*kept, newline.join(x.replace("\n", newline) for x in lines)]) + newline + tail


def append_to_file(path: str, seen: str, lines: list[str], start: str, end: str) -> int:
    """Adds lines to a note if it is still what was read (``seen``); the number of lines added."""
    from tideglass.sources.sinks import replace_file

    with open(path, encoding="utf-8", newline="") as f:
        if f.read() != seen:
            raise ValueError("the note changed since it was read")
    if lines:
        replace_file(path, append_between(seen, lines, start, end))
    return len(lines)
