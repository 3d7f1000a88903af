"""Feeds of postings: a table of payloads (source, payload) to one schema of postings.

Each builder takes the sources of its type with their payloads and gives postings and, apart, the
payloads it could not read. JSON and XML are read by Spark's own functions with explicit schemas;
anchors in HTML need an Arrow-batched parser, as their text may hold other tags.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions import text as T
from tideglass.functions import urls as U

SCHEMA = (
    "ord long, title string, url string, source string, snippet string, published string, company string, location string, employment_type string, position_level string,"
    " minimum_years_experience int, expires string, jd string, requirements string, job_id string, source_type string, role_level boolean"
)
FIELDS = [f.strip().split()[0] for f in SCHEMA.split(",")]
SOURCE = "name string, type string, url string, company string, location string, employment_type string, enabled boolean, priority int, query string, require_location_any array<string>, require_title_any array<string>, require_title_all array<string>, require_any array<string>"


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _postings(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Postings of one type: the given columns, others empty; rows without a title are left out."""
    given = {"source": F.col("s.name"), "company": F.coalesce("s.company", F.lit("")), "location": F.coalesce("s.location", F.lit("")), "employment_type": F.coalesce("s.employment_type", F.lit("")), "source_type": F.lit(kind), "role_level": F.lit(True)} | columns
    types = dict(f.strip().split() for f in SCHEMA.split(","))
    empty = {"int": F.lit(None).cast("int"), "long": F.lit(0).cast("long"), "boolean": F.lit(False), "string": F.lit("")}
    out = rows.select("source_ord", "item_ord", "s", *[given.get(n, empty[t]).cast(t).alias(n) for n, t in types.items() if n != "ord"])
    return out.where("title <> ''")


def _described(description: Column) -> dict[str, Column]:
    return {"minimum_years_experience": T.minimum_years(description), "jd": T.excerpt(description, 1800), "requirements": T.excerpt(T.requirement_sentences(description), 1000)}


def _date_part(text: Column) -> Column:
    clean = T.squeeze(F.coalesce(text, F.lit("")))
    found = F.regexp_extract(clean, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found).otherwise(clean)


def _first(*columns: Column) -> Column:
    return T.clean(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit("")))


def _rows(feeds: DataFrame, parsed: Column, path: str) -> DataFrame:
    return feeds.withColumn("p", parsed).select("source_ord", "s", F.posexplode(path).alias("item_ord", "r"))


def ashby(feeds: DataFrame) -> DataFrame:
    schema = "struct<jobs: array<struct<id: string, title: string, location: string, employmentType: string, jobUrl: string, applyUrl: string, descriptionHtml: string, description: string, publishedAt: string>>>"
    rows = _rows(feeds, F.from_json("payload", schema), "p.jobs").withColumn("d", T.markup_text(F.coalesce(F.nullif("r.descriptionHtml", F.lit("")), "r.description", F.lit(""))))
    place, employment = T.clean(F.coalesce("r.location", F.lit(""))), T.clean(F.coalesce("r.employmentType", F.lit("")))
    return _postings(rows, "ashby", title=T.clean(F.coalesce("r.title", F.lit(""))), url=_first(F.col("r.applyUrl"), F.col("r.jobUrl"), F.col("s.url")), snippet=T.snippet(F.col("s.company"), place, employment, F.col("d")), published=_date_part(F.col("r.publishedAt")),
                     location=place, employment_type=employment, job_id=_first(F.col("r.id"), U.job_id(F.coalesce(F.nullif("r.jobUrl", F.lit("")), "r.applyUrl"))), **_described(F.col("d")))


def greenhouse(feeds: DataFrame) -> DataFrame:
    schema = "struct<jobs: array<struct<id: string, title: string, location: struct<name: string>, absolute_url: string, content: string, updated_at: string>>>"
    rows = _rows(feeds, F.from_json("payload", schema), "p.jobs").withColumn("d", T.markup_text(F.coalesce("r.content", F.lit(""))))
    place = T.clean(F.coalesce("r.location.name", F.lit("")))
    return _postings(rows, "greenhouse", title=T.clean(F.coalesce("r.title", F.lit(""))), url=_first(F.col("r.absolute_url"), F.col("s.url")), snippet=T.snippet(F.col("s.company"), place, F.col("s.employment_type"), F.col("d")),
                     published=_date_part(F.col("r.updated_at")), location=place, job_id=_first(F.col("r.id")), **_described(F.col("d")))


def lever(feeds: DataFrame) -> DataFrame:
    row = "struct<id: string, text: string, categories: struct<location: string, commitment: string>, hostedUrl: string, applyUrl: string, descriptionPlain: string, additionalPlain: string, lists: array<struct<text: string, content: string>>, createdAt: string>"
    bare, wrapped = F.from_json("payload", f"array<{row}>"), F.from_json("payload", f"struct<postings: array<{row}>>")["postings"]
    listed = F.when(F.ltrim("payload").startswith("["), bare).otherwise(wrapped)
    rows = feeds.withColumn("p", listed).select("source_ord", "s", F.posexplode("p").alias("item_ord", "r"))
    lists = F.array_join(F.transform(F.coalesce("r.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda e: T.strip_tags(F.concat_ws("\n", e.text, e.content))), "\n")
    rows = rows.withColumn("d", T.clean(F.concat_ws("\n", F.nullif("r.descriptionPlain", F.lit("")), F.nullif(T.tidy_lines(T.unescape(lists)), F.lit("")), F.nullif("r.additionalPlain", F.lit("")))))
    place, employment = T.clean(F.coalesce("r.categories.location", F.lit(""))), T.clean(F.coalesce("r.categories.commitment", F.lit("")))
    day = F.coalesce(F.date_format(F.timestamp_millis(F.col("r.createdAt").try_cast("long")), "yyyy-MM-dd"), F.lit(""))
    return _postings(rows, "lever", title=T.clean(F.coalesce("r.text", F.lit(""))), url=_first(F.col("r.hostedUrl"), F.col("r.applyUrl"), F.col("s.url")), snippet=T.snippet(F.col("s.company"), place, employment, F.col("d")), published=day,
                     location=place, employment_type=employment, job_id=_first(F.col("r.id"), U.job_id(F.coalesce(F.nullif("r.hostedUrl", F.lit("")), "r.applyUrl"))), **_described(F.col("d")))


def mycareersfuture(feeds: DataFrame) -> DataFrame:
    schema = ("struct<results: array<struct<uuid: string, title: string, postedCompany: struct<name: string>, employmentTypes: array<struct<employmentType: string>>, positionLevels: array<struct<position: string>>, skills: array<struct<skill: string>>,"
              " minimumYearsExperience: string, description: string, metadata: struct<jobDetailsUrl: string, newPostingDate: string, expiryDate: string>>>>")  # fmt: skip
    rows = _rows(feeds, F.from_json("payload", schema), "p.results").withColumn("d", T.markup_text(F.coalesce("r.description", F.lit(""))))
    names = lambda c, f: F.coalesce(F.array_join(F.filter(F.transform(F.col(c), lambda x: T.squeeze(F.coalesce(x[f], F.lit("")))), lambda x: x != ""), ", "), F.lit(""))
    employment, levels, skills = names("r.employmentTypes", "employmentType"), names("r.positionLevels", "position"), names("r.skills", "skill")
    company, place, years = T.clean(F.coalesce("r.postedCompany.name", F.lit(""))), F.coalesce("s.location", F.lit("Singapore")), F.col("r.minimumYearsExperience").try_cast("int")
    parts = F.array(company, place, employment, levels, F.coalesce(F.concat(F.lit("minimum experience: "), years.cast("string"), F.lit(" years")), F.lit("")), F.when(skills != "", F.concat(F.lit("skills: "), skills)).otherwise(""), T.excerpt(F.col("d"), 1200))
    return _postings(rows, "mycareersfuture", title=T.clean(F.coalesce("r.title", F.lit(""))), url=_first(F.col("r.metadata.jobDetailsUrl"), F.col("s.url")), snippet=T.squeeze(F.array_join(F.filter(parts, lambda p: p != ""), "; ")), company=company, location=place,
                     published=_first(F.col("r.metadata.newPostingDate")), expires=_first(F.col("r.metadata.expiryDate")), employment_type=employment, position_level=levels, job_id=_first(F.col("r.uuid")), **(_described(F.col("d")) | {"minimum_years_experience": years}))


def rss(feeds: DataFrame) -> DataFrame:
    """RSS items, then Atom entries; a missing link is the source's own address."""
    schema = ("struct<channel: struct<item: array<struct<title: string, link: string, description: string, pubDate: string>>>, item: array<struct<title: string, link: string, description: string, pubDate: string>>,"
              " entry: array<struct<title: string, summary: string, updated: string, link: array<struct<_href: string>>>>>")  # fmt: skip
    p = F.from_xml("payload", schema, {"mode": "PERMISSIVE"})
    item = "array<struct<title:string,link:string,snippet:string,published:string>>"
    items = lambda c: F.coalesce(F.transform(F.col(c), lambda i: F.struct(i.title, i.link, i.description, i.pubDate)).cast(item), F.array().cast(item))
    entries = F.coalesce(F.transform(F.col("p.entry"), lambda e: F.struct(e.title, F.element_at(F.filter(e.link["_href"], lambda h: F.coalesce(h, F.lit("")) != ""), 1), e.summary, e.updated)).cast(item), F.array().cast(item))
    rows = feeds.withColumn("p", p).withColumn("all", F.concat(items("p.channel.item"), items("p.item"), entries)).select("source_ord", "s", F.posexplode("all").alias("item_ord", "r"))
    url = _first(F.col("r.link"), F.col("s.url"))
    return _postings(rows, "rss", title=T.clean(F.coalesce("r.title", F.lit(""))), url=url, snippet=T.clean(F.coalesce("r.snippet", F.lit(""))), published=_first(F.col("r.published")), job_id=U.job_id(url), role_level=U.direct_role(url))


class _Anchors(HTMLParser):
    """(text, href) of every anchor, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self._open: str | None = None
        self._text: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href") if tag == "a" else None
        if href:
            self._open, self._text = href, []

    def handle_data(self, data):
        if self._open:
            self._text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self._open:
            self.found.append((" ".join(html.unescape(" ".join(self._text)).split()), self._open))
            self._open = None


def anchors(page: str, base: str) -> list[tuple[str, str]]:
    reader = _Anchors()
    reader.feed(page)
    reader.close()
    return [(text, urljoin(base, href)) for text, href in reader.found if text]


def links(pages: DataFrame) -> DataFrame:
    """(key, base, payload) -> (key, item_ord, title, url) of the anchors that look like recruiting, each pair once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, t, u) for k, base, page in zip(b["key"], b["base"], b["payload"], strict=True) for i, (t, u) in enumerate(anchors(page or "", base or ""))]
            yield pd.DataFrame(out, columns=["key", "item_ord", "title", "url"])

    found = pages.select("key", "base", "payload").mapInPandas(run, "key string, item_ord int, title string, url string").where(T.likely_link(F.col("title"), F.col("url")))
    return found.groupBy("key", "title", "url").agg(F.min("item_ord").alias("item_ord"))


def page_list(feeds: DataFrame) -> DataFrame:
    found = links(feeds.select(F.col("source_ord").cast("string").alias("key"), F.coalesce("s.url", F.lit("")).alias("base"), "payload"))
    rows = feeds.select("source_ord", "s").join(found, F.col("source_ord").cast("string") == F.col("key")).withColumnsRenamed({"title": "t", "url": "u"})
    return _postings(rows, "html", title=F.col("t"), url=F.col("u"), job_id=U.job_id(F.col("u")), role_level=U.direct_role(F.col("u")))


def search_result(feeds: DataFrame) -> DataFrame:
    """Result pages of a search engine for articles: title, summary and account by pattern."""
    pattern = r'(?is)<div class="txt-box">\s*<h3>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>.*?<p class="txt-info"[^>]*>(.*?)</p>(.*?)</div>'
    parts = F.arrays_zip(*[F.regexp_extract_all("payload", F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("href", "title", "summary", "tail"), 1)])
    rows = feeds.withColumn("m", parts).select("source_ord", "s", F.posexplode("m").alias("item_ord", "r"))
    account = T.markup_text(F.regexp_extract(F.col("r.tail"), r'(?is)<span class="all-time-y2">(.*?)</span>', 1))
    rows = rows.select("source_ord", "item_ord", "s", T.markup_text(F.col("r.title")).alias("t"), T.markup_text(F.col("r.summary")).alias("sm"), account.alias("ac"), U.quoted(U.joined(F.lit("https://weixin.sogou.com/weixin"), T.unescape(F.col("r.href")))).alias("u"))
    rows = rows.where(T.likely_title(F.col("t"))).withColumn("_n", F.row_number().over(Window.partitionBy("source_ord", "t", "u").orderBy("item_ord"))).where("_n = 1").drop("_n")
    told = F.concat_ws("；", F.nullif("sm", F.lit("")), F.when(F.col("ac") != "", F.concat(F.lit("公众号："), "ac")))
    return _postings(rows, "wechat_search", title=F.col("t"), url=F.col("u"), snippet=T.squeeze(told), role_level=F.lit(False))


def embedded_list(feeds: DataFrame) -> DataFrame:
    """The JSON list behind a marker in a page; text after the list's end is ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for o, page in zip(b["source_ord"], b["payload"], strict=True):
                at = (page or "").find('"listDetailData":')
                start = page.find("[", at) if at >= 0 else -1
                if start < 0:
                    continue
                try:
                    rows, _ = json.JSONDecoder().raw_decode(page[start:])
                except ValueError:
                    continue
                for i, r in enumerate(rows if isinstance(rows, list) else []):
                    if isinstance(r, dict):
                        one = lambda *keys: next((x for x in (_text(r.get(k)) for k in keys) if x), "")  # noqa: B023, E731
                        out.append((o, i, one("workPlaceName", "workPlace", "workplace", "location", "workCity"), one("name", "postName"), one("workContent", "description"), one("serviceCondition", "qualification"), one("jobId", "postId"), one("updateDate", "publishDate")))
            yield pd.DataFrame(out, columns=["source_ord", "item_ord", "place", "t", "work", "needs", "id", "day"])

    found = feeds.select("source_ord", "payload").mapInPandas(run, "source_ord int, item_ord int, place string, t string, work string, needs string, id string, day string")
    rows = found.join(feeds.select("source_ord", "s"), "source_ord")
    escaped = U.search_address("", F.col("id"))
    url = F.when(F.col("id") != "", F.concat(F.coalesce("s.url", F.lit("")), F.lit("#"), escaped)).otherwise(F.coalesce("s.url", F.lit("")))
    company = F.coalesce("s.company", F.lit("百度"))
    return _postings(rows, "baidu_campus", title=F.col("t"), url=url, company=company, location=F.col("place"), snippet=T.snippet(company, F.col("place"), F.col("s.employment_type"), F.concat_ws(" ", "work", "needs")), published=F.col("day"),
                     jd=T.excerpt(F.col("work"), 1800), requirements=T.excerpt(F.col("needs"), 1000), job_id=F.col("id"), role_level=F.col("id") != "")


def _text(value: object) -> str:
    """A text of a value that may be a text, a number, a named object or a list of these."""
    if isinstance(value, list):
        return ", ".join(x for x in map(_text, value) if x)
    if isinstance(value, dict):
        value = value.get("name") or value.get("label") or ""
    return " ".join(html.unescape(str(value)).split()) if value else ""


def portal(feeds: DataFrame) -> DataFrame:
    """Sources that are one posting themselves; the payload is a JSON object with its fields."""
    rows = feeds.withColumn("r", F.from_json("payload", "struct<title: string, snippet: string, jd: string, requirements: string, job_id: string>")).withColumn("item_ord", F.lit(0))
    part = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit(""))
    return _postings(rows, "portal", title=part("title"), url=F.coalesce("s.url", F.lit("")), snippet=part("snippet"), jd=part("jd"), requirements=part("requirements"), job_id=part("job_id"))


BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"html": page_list, "rss": rss, "ashby": ashby, "greenhouse": greenhouse, "lever": lever, "mycareersfuture": mycareersfuture, "baidu_campus": embedded_list, "wechat_search": search_result, "portal": portal}


def _accepted(rows: DataFrame) -> DataFrame:
    """Postings that pass the conditions of their own source; the lists differ by row."""
    forms = {"told": T.match_form(F.concat_ws(" ", "title", "snippet")), "title": T.match_form(F.col("title")), "place": T.match_form(F.col("location")), "all": T.match_form(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("title", "snippet", "url", "company", "location", "employment_type", "position_level")]))}
    rows = rows.withColumns({f"_{k}": v for k, v in forms.items()})

    def meets(form: str, terms: str, every: bool = False) -> Column:
        def one(t: Column) -> Column:
            plain = T.squeezed_match_form(t)
            quoted = F.regexp_replace(plain, r"([^\w])", r"\\$1")
            whole = F.regexp_like(F.col(form), F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))
            return F.when(plain.rlike(r"^[a-z0-9][a-z0-9 +.,/-]*$"), whole).otherwise(F.contains(F.col(form), plain))

        found = F.forall(terms, one) if every else F.exists(terms, one)
        return F.coalesce((F.size(terms) <= 0) | found, F.lit(True))

    kept = rows.where(meets("_place", "s.require_location_any") & meets("_title", "s.require_title_any") & meets("_all", "s.require_any") & meets("_title", "s.require_title_all", every=True))
    # an article must be told of by its title and summary, not by its address or its source's own fields
    kept = kept.where((F.col("source_type") != "wechat_search") | meets("_told", "s.require_any"))
    return kept.drop("_told", "_title", "_place", "_all")


def collect(sources: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings in SCHEMA, errors: source and message, counts: source and n_items with zeros).

    ``sources`` has the columns of SOURCE and ``source_ord``, ``payloads`` (source, payload). Disabled and
    manual sources give nothing; a source without payload, or of an unknown type, or with broken JSON, is an
    error and does not stop the others. ``ord`` numbers postings by source, then place in the payload.
    """
    active = sources.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("type", F.lit("html")) != "manual"))
    struct = F.struct(*[F.col(x.strip().split()[0]) for x in SOURCE.split(", ")])
    feeds = active.join(payloads.select(F.col("source").alias("name"), "payload"), "name", "left").select("source_ord", struct.alias("s"), F.coalesce("type", F.lit("html")).alias("kind"), "payload")
    is_json = F.col("kind").isin("ashby", "greenhouse", "lever", "mycareersfuture", "portal")
    broken = F.when(F.col("payload").isNull(), "no payload").when(~F.col("kind").isin(list(BUILDERS)), "unsupported type").when(is_json & F.try_parse_json("payload").isNull(), "payload is no JSON")
    errors = feeds.withColumn("message", broken).where("message is not null").select(F.col("s.name").alias("source"), "message")
    good = feeds.where(broken.isNull())
    found = reduce(DataFrame.unionByName, [build(good.where(F.col("kind") == kind)) for kind, build in BUILDERS.items()])
    kept = _accepted(found)
    order = F.col("source_ord").cast("long") * (1 << 32) + F.col("item_ord")
    postings = kept.withColumn("ord", order).select(*FIELDS)
    counts = active.select("name").join(postings.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n_items")), "name", "left").select(F.col("name").alias("source"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))
    return postings, errors, counts


def monitorable(sources: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """Sources whose page can be watched: enabled, not manual, portal or search; one for each address, the first wins."""
    ok = F.coalesce("enabled", F.lit(True)) & ~F.coalesce("type", F.lit("html")).isin("manual", "portal", "wechat_search") & (F.coalesce("url", F.lit("")) != "") & ~F.col("url").contains("feishu.cn/base/")
    kept = sources.where(ok & ~F.col("name").isin(list(excluded)) if excluded else ok).withColumn("address", U.normal_form(F.col("url")))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("address").orderBy("source_ord"))).where("_n = 1").drop("_n")
