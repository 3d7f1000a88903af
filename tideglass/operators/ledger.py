"""Counts with subtotals, comparison of stored and recomputed values, identity joins and date-based overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions import text as T
from tideglass.functions import urls as U
from tideglass.plans.tables import bounded_rows

# Terms of the two kinds of employment that hold beside a ledger's own labels.
INTERNSHIP_TERMS = r"实习|\bintern(?:ship)?\b|byteintern"
FULL_TIME_TERMS = r"全职|full[ -]?time|\bpermanent\b|\bgraduate\b|校招|校园招聘"
MAX_REGIONS = 1_000


def filled_counts(rows: DataFrame, dims: DataFrame, keys: list[str], name: str = "n_rows") -> DataFrame:
    """Counts for every combination in ``dims`` (bounded by its owner); combinations without rows count 0."""
    return dims.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def subtotals(rows: DataFrame, category: str, member: Column) -> DataFrame:
    """(level, category, n_rows): each category, the subtotal of the member categories, and the total, in one pass."""
    cells = rows.groupBy(category, member.alias("_m")).agg(F.count(F.lit(1)).alias("n"))
    g = cells.groupingSets([[category], ["_m"], []], category, "_m").agg(F.sum("n").alias("n_rows"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "members").otherwise("all")
    return g.where((F.col("_g") != 2) | F.col("_m")).select(level.alias("level"), F.col(category).alias("category"), "n_rows")


def total_target(target: Column) -> Column:
    """The sum of targets if all of them are set, else null."""
    return F.when(F.count(target) == F.count(F.lit(1)), F.sum(target))


def remaining(counts: DataFrame) -> DataFrame:
    return counts.withColumn("remaining", F.col("target") - F.col("submitted"))


def mismatches(stored: DataFrame, computed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose stored value is not the computed one, or that only one side has."""
    s, c = stored.select(*keys, F.col(value).alias("stored")), computed.select(*keys, F.col(value).alias("computed"))
    return s.join(c, keys, "full_outer").where(~F.col("stored").eqNullSafe(F.col("computed")))


def classify(rows: DataFrame, text: str, aliases: DataFrame, internship: list[str], full_time: list[str]) -> DataFrame:
    """Rows with ``region`` and ``employment``, or with ``issue``: what is named by no or several labels is not guessed.

    ``aliases`` (region, alias) is a bounded table; an alias of two regions is an issue of its rows.
    """
    form = T.ledger_form(F.col(text))
    names = bounded_rows(aliases.groupBy("region").agg(F.collect_list("alias").alias("names")), MAX_REGIONS, "regions")
    region_hits = F.array_compact(F.array(*[F.when(_labels(form, r.names), F.lit(r.region)) for r in names]))
    before = F.regexp_extract(form, r"^([^（(]*)", 1)
    region_before = F.array_compact(F.array(*[F.when(_labels(before, r.names), F.lit(r.region)) for r in names]))
    regions = F.when((F.size(region_hits) > 1) & (before != form), region_before).otherwise(region_hits)
    intern, full = _labels(form, internship) | form.rlike(INTERNSHIP_TERMS), _labels(form, full_time) | form.rlike(FULL_TIME_TERMS)
    clear = (intern != full) & (F.size(regions) == 1)
    out = rows.withColumn("_r", regions)
    return out.withColumn("region", F.when(clear, F.element_at("_r", 1))).withColumn("employment", F.when(clear, F.when(intern, "internship").otherwise("full_time"))).withColumn("issue", F.when(~clear, "unclassified or conflicting category")).drop("_r")


def _labels(form: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        plain = " ".join(n.casefold().split())
        out = out | form.rlike(rf"(?U)(?<!\w){T.quote_regex(plain)}(?!\w)")
    return out


def identity_matches(events: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches: event_id, row_id, by; violations: event_id, rule) of events and ledger rows of the same posting.

    ``events`` (event_id, companies, ids, role, urls) and ``rows`` (row_id, company, role, ids, urls) meet
    by company name, then by a common id (of the row, its title or its addresses) or by equal role and a
    common address. Names, ids and addresses are exploded, so every step is an equi join.
    """
    e = events.select("event_id", F.explode("companies").alias("name"), "ids", "role", "urls").withColumn("owner", T.ledger_form(F.col("name"))).drop("name").dropDuplicates(["event_id", "owner"])
    r = rows.select("row_id", "company", "role", "ids", "urls").withColumn("owner", T.ledger_form(F.col("company")))
    known = F.array_union(F.coalesce("ids", F.array().cast("array<string>")), F.coalesce(T.title_ids(F.col("role")), F.array().cast("array<string>")))
    row_ids = r.select("row_id", "owner", F.explode(known).alias("id"))
    link_ids = r.select("row_id", "owner", F.explode("urls").alias("u")).select("row_id", "owner", F.explode(U.address_ids(F.col("u"))).alias("id"))
    event_ids = e.select("event_id", "owner", F.explode("ids").alias("id"))
    by_id = event_ids.join(row_ids.unionByName(link_ids).distinct(), ["owner", "id"]).select("event_id", "row_id", F.lit("id").alias("by")).distinct()
    e_url = e.select("event_id", "owner", T.ledger_form(F.col("role")).alias("r"), "ids", F.explode("urls").alias("u")).withColumn("u", U.ledger_form(F.col("u")))
    r_url = r.select("row_id", "owner", T.ledger_form(F.col("role")).alias("r"), F.col("ids").alias("row_ids"), F.explode("urls").alias("u")).withColumn("u", U.ledger_form(F.col("u")))
    joined = e_url.join(r_url, ["owner", "r", "u"]).select("event_id", "row_id", "ids", "row_ids").distinct()
    fresh = joined.join(by_id.select("event_id", "row_id"), ["event_id", "row_id"], "left_anti")
    conflict = (F.size("ids") > 0) & (F.size("row_ids") > 0) & ~F.arrays_overlap("ids", "row_ids")
    matches = by_id.unionByName(fresh.where(~conflict).select("event_id", "row_id", F.lit("address").alias("by")))
    several = matches.groupBy("event_id").agg(F.countDistinct("row_id").alias("n")).where("n > 1").select("event_id", F.lit("several rows match").alias("rule"))
    return matches, several.unionByName(fresh.where(conflict).select("event_id", F.lit("explicit ids conflict").alias("rule")).distinct())


def funnel(entries: DataFrame, as_of: Column) -> DataFrame:
    """One row of counts over (priority, queued_on, deadline): totals, last seven days, stale, urgent, expired, unknown."""
    left = F.datediff("deadline", as_of)
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return entries.agg(
        F.count(F.lit(1)).alias("current_count"),
        *[one(F.col("priority") == p).alias(f"{p.strip('#')}_count") for p in ("#p0", "#p1", "#p2")],
        one(F.col("queued_on").between(F.date_sub(as_of, 6), as_of)).alias("recent_count"),
        one(F.datediff(as_of, "queued_on") > 7).alias("stale_count"),
        one((left >= 0) & (left <= 3)).alias("urgent_count"),
        one(left < 0).alias("expired_count"),
        one(F.col("queued_on").isNull()).alias("unknown_queued"),
        one(F.col("deadline").isNull()).alias("unknown_deadline"),
    )


def tense_entries(entries: DataFrame, as_of: Column) -> DataFrame:
    """Entries that are stale, urgent or expired, with the reason; an entry may have two."""
    left = F.datediff("deadline", as_of)
    why = F.array_compact(F.array(F.when(F.datediff(as_of, "queued_on") > 7, "stale"), F.when(left < 0, "expired").when(left <= 3, "urgent")))
    return entries.withColumn("why", F.explode(why))


def orphans(manifest: DataFrame, sinks: DataFrame, key: str) -> DataFrame:
    """Manifest rows with what the sinks (key, sink) hold of them: missing, once, or in several sinks."""
    held = sinks.groupBy(key).agg(F.array_sort(F.collect_set("sink")).alias("sinks"))
    joined = manifest.join(held, key, "left").withColumn("sinks", F.coalesce("sinks", F.array().cast("array<string>")))
    return joined.withColumn("finding", F.when(F.size("sinks") == 0, "orphan").when(F.size("sinks") > 1, "duplicate").otherwise("ok"))
