"""Filters, flags and the relevance score of postings: column expressions over configurable term lists.

Empty term lists set no condition and give no points; null fields count as empty texts; a result never
depends on a table's other rows, so every function here is a map without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions import text as T


@dataclass(frozen=True)
class Terms:
    """The term lists of a search profile."""

    roles: list[str] = field(default_factory=list)
    core: list[str] = field(default_factory=list)
    preferred: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    graduate: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)
    other_places: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    generic_titles: list[str] = field(default_factory=list)


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def haystack() -> Column:
    """The searched text of a posting: the source's name is no evidence."""
    return T.search_text(*[_filled(c) for c in ("title", "snippet", "url", "company", "location", "employment_type", "position_level")])


def accepts(location_any: list[str] = (), title_any: list[str] = (), any_of: list[str] = (), title_all: list[str] = (), form=T.match_form) -> Column:
    """Whether a posting passes a source's conditions."""
    title, place = form(_filled("title")), form(_filled("location"))
    return T.any_term(place, list(location_any)) & T.any_term(title, list(title_any)) & T.any_term(form(haystack()), list(any_of)) & T.all_terms(title, list(title_all))


def score(items: DataFrame, terms: Terms, priority: str, form=T.match_form) -> DataFrame:
    """``items`` with ``score`` and ``reasons``: weighted term hits, never below 0; reasons in the order of the rules.

    The searched texts and the hits are columns of their own, so that each is computed once for a row.
    """
    kept = [F.col(c) for c in items.columns]
    young = F.concat_ws(" ", _filled("title"), _filled("employment_type"), _filled("position_level"))
    texts = items.select(*kept, F.coalesce(priority, F.lit(0)).alias("_base"), form(haystack()).alias("_hay"), form(young).alias("_young"))
    lists = {k: T.hits(F.col("_hay"), getattr(terms, k)) for k in ("roles", "core", "preferred", "domains", "places", "other_places", "companies", "negative")}
    lists |= {"graduate": T.hits(F.col("_young"), terms.graduate), "generic": F.coalesce(T.generic_title(F.col("title"), terms.generic_titles), F.array().cast("array<string>"))}
    found = texts.select(*kept, "_base", *[v.alias(f"_{k}") for k, v in lists.items()])
    n = {k: F.size(f"_{k}") for k in lists}
    some = lambda k, points: F.when(n[k] > 0, points).otherwise(0)
    base, keyword, domain, minus = F.col("_base"), F.least(F.lit(30), 5 * n["preferred"]), F.least(F.lit(12), 3 * n["domains"]), F.least(F.lit(80), 25 * n["negative"])
    away = (n["other_places"] > 0) & (n["places"] == 0)
    total = base + some("roles", 25) + some("core", 20) + keyword + domain + some("graduate", 20) + some("places", 15) + some("companies", 10) - minus - some("generic", 35) - F.when(away, 35).otherwise(0)
    first = lambda k, most: F.array_join(F.slice(f"_{k}", 1, most), ", ")
    say = lambda k, words, most: F.when(n[k] > 0, F.concat(words, first(k, most)))
    reasons = F.array_compact(
        F.array(
            F.when(base != 0, F.concat(F.lit("source +"), base.cast("string"))), say("roles", F.lit("role: "), 3), say("core", F.lit("core: "), 4),
            say("preferred", F.concat(F.lit("keywords +"), keyword.cast("string"), F.lit(": ")), 5), say("domains", F.concat(F.lit("discovery hints +"), domain.cast("string"), F.lit(": ")), 4),
            say("graduate", F.lit("fresh grad: "), 3), say("places", F.lit("location: "), 3), F.when(away, F.concat(F.lit("non-target location -35: "), first("other_places", 3))),
            say("companies", F.lit("company: "), 3), say("negative", F.concat(F.lit("negative -"), minus.cast("string"), F.lit(": ")), 4), say("generic", F.lit("generic link -35: "), 3),
        )
    )
    return found.select(*kept, F.greatest(F.lit(0), total).alias("score"), reasons.alias("reasons"))


def flags(internship: list[str], internship_places: list[str], years_allowed: list[str], blocked: list[str], other_places: list[str], as_of: Column, form=T.match_form) -> Column:
    """Reasons to look twice at a posting; rows are never dropped by them."""
    expires = F.regexp_extract(_filled("expires"), r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    raw = F.struct(haystack().alias("raw"), form(haystack()).alias("hay"), form(_filled("location")).alias("place"))

    def found(x: Column) -> Column:
        years = F.array_sort(F.array_distinct(F.regexp_extract_all(x.raw, F.lit(r"(20\d{2})\s*届"), F.lit(1))))
        named = F.transform(F.filter(years, lambda y: ~y.isin(years_allowed)), lambda y: F.concat(F.lit("graduation year "), y)) if years_allowed else F.array().cast("array<string>")
        rules = [(T.any_term(x.hay, internship) & T.any_term(x.place, internship_places), "internship outside its places")] * bool(internship and internship_places)
        rules += [(T.any_term(x.hay, blocked), "blocked keyword")] * bool(blocked) + [(T.any_term(x.place, other_places), "other place")] * bool(other_places) + [(expires < as_of, "expired")]
        return F.concat(named, F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, w in rules])))

    return T.let(raw, found)


def needs_detail(minimum: int) -> Column:
    """Postings whose page is worth reading: no own description, a readable source, enough points."""
    return (_filled("jd") == "") & (_filled("requirements") == "") & ~F.col("source_type").isin("portal", "wechat_search", "wechat") & (F.col("score") >= minimum)


def item_key(form_of_url) -> Column:
    """The state key: of company (or source) and id, else of the fingerprint, else of the address."""
    owner = F.coalesce(F.nullif(_filled("company"), F.lit("")), _filled("source"))
    by_id = F.sha2(F.concat(F.lit("id:"), owner, F.lit("\0"), F.col("job_id")), 256)
    print_ = T.fingerprint(_filled("company"), _filled("title"), _filled("location"))
    return F.when(_filled("job_id") != "", by_id).when(print_ != "", F.sha2(print_, 256)).otherwise(F.sha2(form_of_url(_filled("url")), 256))


def detail(pages: DataFrame, jd_headings: list[str], requirement_headings: list[str], stop_headings: list[str]) -> DataFrame:
    """(url, title, company, location, page) -> the page's apply link, sections and whether it fits the posting."""
    from tideglass.functions import urls

    embedded = F.regexp_extract("page", r'"descriptionHtml"\s*:\s*"((?:\\.|[^"\\])*)"', 1)
    described = F.when(embedded != "", F.get_json_object(F.concat(F.lit('{"d":"'), embedded, F.lit('"}')), "$.d"))
    body = pages.withColumn("body", T.markup_text(F.coalesce(described, F.col("page")))).withColumn("apply_link", urls.apply_link(F.col("url"), F.col("page")))
    jd = T.section(F.col("body"), jd_headings, requirement_headings + stop_headings)
    requirements = T.section(F.col("body"), requirement_headings, stop_headings)
    return body.select(
        "url", F.coalesce(F.nullif("apply_link", F.lit("")), F.col("url")).alias("apply_url"),
        T.excerpt(F.when(jd != "", jd).otherwise(T.excerpt(F.col("body"), 700)), 900).alias("jd"),
        T.excerpt(F.when(requirements != "", requirements).otherwise(T.requirement_sentences(F.col("body"))), 700).alias("requirements"),
        T.title_on_page(F.col("title"), _filled("company"), _filled("location"), F.col("body")).alias("title_matches"),
        ((F.col("apply_link") != "") | urls.direct_application(F.col("url"))).alias("apply_action_found"),
    )
