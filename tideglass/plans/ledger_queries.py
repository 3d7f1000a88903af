"""More named queries over the workspace tables: feeds, forms of texts and addresses, notes, checks and hand-offs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import dates as D
from tideglass.functions import text as T
from tideglass.functions import urls as U
from tideglass.operators import audit, handoff, ledger, state
from tideglass.plans.reference_queries import _ENTRIES, _KINDS, _SEGMENTS, AS_OF, _entries, _feed, e, mf, sq
from tideglass.plans.tables import table
from tideglass.sources import feeds, markdown, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def holds(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_PATH = "regexp_extract({0}, '^(?:[a-zA-Z][a-zA-Z0-9_+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


# --- feeds -------------------------------------------------------------------------------------------------
@query(
    f"""SELECT ord AS source_ord, {sq(e('title'))} AS title, coalesce(nullif(trim(url), ''), 'https://feed.example') AS url, {sq(e('location'))} AS location, coalesce(nullif(trim(job_id), ''), '') AS job_id,
    CASE WHEN regexp_matches({sq(e('published'))}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN left({sq(e('published'))}, 10) ELSE {sq(e('published'))} END AS published FROM job_item WHERE {sq(e('title'))} <> ''"""
)
def feed_greenhouse(spark: SparkSession, d: str) -> DataFrame:
    job = F.struct(F.col("job_id").alias("id"), "title", F.struct(F.col("location").alias("name")).alias("location"), F.col("url").alias("absolute_url"), F.col("snippet").alias("content"), F.col("published").alias("updated_at"))
    found = feeds.greenhouse(_feed(table(spark, d, "job_item"), "ord", F.to_json(F.struct(F.array(job).alias("jobs")))))
    return found.select("source_ord", "title", "url", "location", "job_id", "published")


@query(
    f"""SELECT ord AS source_ord, {sq(e('title'))} AS title, {sq(e('company'))} AS company, {sq(e('employment_type'))} AS employment_type, {sq(e('position_level'))} AS position_level, {sq(e('expires'))} AS expires, minimum_years_experience FROM job_item WHERE {sq(e('title'))} <> ''"""
)
def feed_mycareersfuture(spark: SparkSession, d: str) -> DataFrame:
    job = F.struct(F.col("job_id").alias("uuid"), "title", F.struct(F.col("company").alias("name")).alias("postedCompany"), F.array(F.struct(F.col("employment_type").alias("employmentType"))).alias("employmentTypes"),
                   F.array(F.struct(F.col("position_level").alias("position"))).alias("positionLevels"), F.col("minimum_years_experience").cast("string").alias("minimumYearsExperience"), F.col("snippet").alias("description"),
                   F.struct(F.col("url").alias("jobDetailsUrl"), F.col("published").alias("newPostingDate"), F.col("expires").alias("expiryDate")).alias("metadata"))
    found = feeds.mycareersfuture(_feed(table(spark, d, "job_item"), "ord", F.to_json(F.struct(F.array(job).alias("results")))))
    return found.select("source_ord", "title", "company", "employment_type", "position_level", "expires", "minimum_years_experience")


@query("SELECT ord AS source_ord, coalesce(title, '') AS title, coalesce(jd, '') AS jd, coalesce(requirements, '') AS requirements, coalesce(job_id, '') AS job_id FROM job_item WHERE coalesce(title, '') <> ''")
def feed_portal(spark: SparkSession, d: str) -> DataFrame:
    found = feeds.portal(_feed(table(spark, d, "job_item"), "ord", F.to_json(F.struct("title", "snippet", "jd", "requirements", "job_id"))))
    return found.select("source_ord", "title", "jd", "requirements", "job_id")


@query(f"SELECT source, count(*) AS n_items, count(*) FILTER (WHERE {holds(mf('concat_ws(chr(32), title, ' + _PATH.format('url') + ')'), T.LINK_SIGNALS)}) AS n_likely, count(*) FILTER (WHERE {holds(mf(e('title')), T.TITLE_SIGNALS)}) AS n_titles FROM job_item GROUP BY 1")
def recruiting_signals(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "job_item").select("source", "title", "url")
    return items.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(T.likely_link(F.col("title"), F.col("url"))).alias("n_likely"), F.count_if(T.likely_title(F.coalesce("title", F.lit("")))).alias("n_titles"))


@query(
    """SELECT arg_min(name, name) AS name, rtrim(lower(regexp_extract(url, '^([^/?#]+//[^/?#]*)', 1)) || regexp_extract(url, '^[^/?#]+//[^/?#]*(.*)$', 1), '/') AS address FROM job_source
    WHERE coalesce(enabled, true) AND coalesce(source_type, 'html') NOT IN ('manual', 'portal', 'wechat_search') AND coalesce(url, '') <> '' AND NOT contains(url, 'feishu.cn/base/') GROUP BY 2"""
)
def monitorable_sources(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "job_source").select("name", F.col("source_type").alias("type"), "url", "enabled", F.col("name").alias("source_ord"))
    return feeds.monitorable(sources).select("name", "address")


# --- texts -------------------------------------------------------------------------------------------------
@query("SELECT doc_kind, count(*) AS n_docs, count(*) FILTER (WHERE regexp_matches(text, '(^|[^A-Za-z0-9_-])' || regexp_escape(job_id) || '([^A-Za-z0-9_-]|$)')) AS n_named FROM documents GROUP BY 1")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(T.holds_id(F.col("text"), F.col("job_id"))).alias("n_named"))


@query("SELECT p_partkey, regexp_matches(lower(p_name), '(^|[^a-z0-9_])ring([^a-z0-9_]|$)') AS is_ring, regexp_matches(lower(p_type), '(^|[^a-z0-9_])economy([^a-z0-9_]|$)') AS is_economy, lower(trim(p_name)) AS form FROM part")
def named_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.holds_label(F.col("p_name"), "Ring").alias("is_ring"), T.holds_label(F.col("p_type"), "ECONOMY").alias("is_economy"), T.compat_form(F.col("p_name")).alias("form"))


@query("SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS owner, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || chr(0) || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) || 'desk' || chr(0) || 'region' || n_regionkey::VARCHAR AS print FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def semantic_prints(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    company, place = F.concat("s_name", F.lit(" Ltd.")), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))
    return rows.select("s_suppkey", T.company_form(company).alias("owner"), T.fingerprint(company, F.concat("n_name", F.lit(" Desk, "), place), place).alias("print"))


_YEARS = "list_concat(" + ", list_concat(".join(f"regexp_extract_all(s, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in T.YEARS_PATTERNS[:-1]) + f", regexp_extract_all(s, '{T.YEARS_PATTERNS[-1]}', 1)" + ")" * (len(T.YEARS_PATTERNS) - 1)


@query(
    f"""WITH seg AS (SELECT detail_id, unnest({_SEGMENTS}) AS p FROM (SELECT detail_id, coalesce(requirements, '') AS x FROM job_detail)), low AS (SELECT detail_id, {mf("regexp_replace(p, '^[-*• ]+', '')")} AS s FROM seg),
    kept AS (SELECT detail_id, list_min(list_transform({_YEARS}, lambda n: try_cast(n AS INTEGER))) AS y FROM low WHERE NOT {_KINDS['nice_to_have']} AND NOT {_KINDS['preferred']})
    SELECT d.detail_id, m.years FROM job_detail d LEFT JOIN (SELECT detail_id, min(y) AS years FROM kept GROUP BY 1) m ON d.detail_id = m.detail_id"""
)
def minimum_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_detail").select("detail_id", T.minimum_years(F.col("requirements")).alias("years"))


@query(f"SELECT ord, regexp_replace({sq('title')}, '([\\\\`*_{{}}\\[\\]<>()#+!|])', '\\\\\\1', 'g') AS shown, list_distinct(list_filter(regexp_extract_all(title, '[（(]`?([A-Za-z0-9][A-Za-z0-9_-]*)`?[）)]', 1), lambda x: regexp_matches(x, '[0-9]') AND (regexp_matches(x, '[A-Za-z]') OR length(x) >= 5))).list_sort()::VARCHAR AS ids FROM job_item")
def titles_shown(spark: SparkSession, d: str) -> DataFrame:
    ids = F.concat(F.lit("["), F.array_join(F.array_sort(T.title_ids(F.col("title"))), ", "), F.lit("]"))
    return table(spark, d, "job_item").select("ord", T.markdown_escape(F.col("title")).alias("shown"), ids.alias("ids"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '(?i)(?:^|[；;]\\s*)(?:(?:job|req(?:uisition)?)\\s*id|编号|岗位编号)\\s*[:：]?\\s*`?([A-Za-z0-9][A-Za-z0-9_-]*)', 1))) AS n_ids FROM documents WHERE text IS NOT NULL")
def labelled_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.labelled_ids(F.col("text"))).cast("long").alias("n_ids"))


@query("SELECT name, len(list_filter([name, url, zone, date_order], lambda x: x IS NOT NULL)) AS n_texts, array_to_string(list_filter([name, url, zone, date_order], lambda x: x IS NOT NULL), '|') AS texts FROM job_source")
def leaf_texts(spark: SparkSession, d: str) -> DataFrame:
    nested = F.to_json(F.struct("name", F.struct(F.array("url").alias("in"), F.struct("zone", "priority").alias("more")).alias("deep"), "date_order"))
    return table(spark, d, "job_source").select("name", D.leaf_texts(nested).alias("t")).select("name", F.size("t").cast("long").alias("n_texts"), F.array_join("t", "|").alias("texts"))


# --- addresses ---------------------------------------------------------------------------------------------
_HOST = "lower(regexp_extract(url, '^([^/?#]+//[^/?#]*)', 1))"
_REST = "regexp_extract(url, '^[^/?#]+//[^/?#]*([^?#]*)', 1)"
_QUERY = "CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) ELSE '' END"
_FRAGMENT = "CASE WHEN regexp_extract(url, '#(.*)$', 1) <> '' THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END"


@query(f"SELECT ord, {_HOST} || rtrim({_REST}, '/') || {_QUERY} || {_FRAGMENT} AS address FROM job_item")
def url_ledger_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_item").select("ord", U.ledger_form(F.col("url")).alias("address"))


_SECRET_KEY = "[?&](?:[a-zA-Z0-9_-]*(?:token|secret|password|passwd|api_?key|signature|session|auth)[a-zA-Z0-9_-]*)="


@query(
    f"""SELECT source, count(*) AS n_items, count(*) FILTER (WHERE regexp_matches(url, '^https?://[^/?#@\\s<>|]+(?:[/?#][^\\s<>|]*)?$') AND NOT regexp_matches(url, '(?i){_SECRET_KEY}')) AS n_safe,
    count(*) FILTER (WHERE list_has_any(string_split(url, '/'), ['tests', 'test', 'fixtures', 'examples']) OR contains(lower(string_split(url, '/')[-1]), '.example.') OR ends_with(lower(string_split(url, '/')[-1]), '.example') OR starts_with(lower(string_split(url, '/')[-1]), 'example.')) AS n_examples FROM job_item GROUP BY 1"""
)
def safe_addresses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_item").groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(U.safe_web_address(F.col("url"))).alias("n_safe"), F.count_if(audit.is_example(F.col("url"))).alias("n_examples"))


@query(
    """WITH x AS (SELECT ord, url, regexp_extract(job_id, '([0-9]+)', 1) AS id FROM job_item), p AS (SELECT *, list_filter(string_split(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9_+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) || '/' || regexp_extract(url, '#(.*)$', 1), '/'), lambda v: v <> '') AS parts FROM x)
    SELECT ord, coalesce(id <> '' AND (list_contains(parts, id) OR len(list_filter(parts, lambda v: ends_with(v, '_' || id) OR regexp_extract(v, '^([0-9]+)-', 1) = id)) > 0
    OR list_contains(regexp_extract_all(url, '(?i)[?&](?:job_?id|jobAdId|id|positionId|positionIntentionId|advertisementId|req(?:uisition)?_?id|gh_jid|jobCode)=([^&#]+)', 1), id)), false) AS has_id FROM p"""
)
def address_has_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_item").select("ord", U.has_id(F.col("url"), F.regexp_extract("job_id", "([0-9]+)", 1)).alias("has_id"))


# --- dates and numbers -------------------------------------------------------------------------------------
@query(
    """SELECT ord, CASE WHEN regexp_matches(published, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_cast(published AS DATE) END AS day, CASE WHEN regexp_matches(trim(published), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN left(trim(published), 10) ELSE trim(published) END AS shown,
    CASE WHEN regexp_matches(trim(job_id), '^[0-9]+$') THEN try_cast(trim(job_id) AS INTEGER) END AS number FROM job_item"""
)
def strict_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_item").select("ord", D.strict_date(F.col("published")).alias("day"), D.date_or_text(F.col("published")).alias("shown"), D.lenient_int(F.col("job_id")).alias("number"))


@query("SELECT seen_id, epoch_us(CASE WHEN regexp_matches(first_seen, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}.*(?:Z|[+-][0-9]{2}:?[0-9]{2})$') THEN try_cast(first_seen AS TIMESTAMPTZ) END) AS us FROM seen_jobs")
def zoned_moments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seen_jobs").select("seen_id", F.unix_micros(D.zoned_time(F.col("first_seen"))).alias("us"))


# --- lines of notes ----------------------------------------------------------------------------------------
def _note_lines(spark: SparkSession, d: str) -> DataFrame:
    day = F.substring("first_seen", 1, 10)
    value = F.when(F.col("seen_id") % 5 == 0, F.concat(F.lit("### "), day)).when(F.col("seen_id") % 11 == 0, F.lit("#### no date")).when(F.col("seen_id") % 7 == 0, F.lit("```")).otherwise(F.coalesce("title", F.lit("")))
    return table(spark, d, "seen_jobs").select(F.col("source").alias("note"), F.col("seen_id").alias("line"), value.alias("value"))


_LINES = "(SELECT source AS note, seen_id AS line, CASE WHEN seen_id % 5 = 0 THEN '### ' || left(first_seen, 10) WHEN seen_id % 11 = 0 THEN '#### no date' WHEN seen_id % 7 = 0 THEN '```' ELSE coalesce(title, '') END AS value FROM seen_jobs)"


@query(
    f"""WITH m AS (SELECT *, regexp_matches(value, '^#{{3,6}}\\s+') AS is_h FROM {_LINES}), g AS (SELECT *, sum(is_h::INTEGER) OVER (PARTITION BY note ORDER BY line ROWS UNBOUNDED PRECEDING) AS h FROM m)
    SELECT note, line, max(CASE WHEN is_h THEN nullif(regexp_extract(value, '^#{{3,6}}\\s+(\\d{{4}}-\\d{{2}}-\\d{{2}})(?:[：:\\s]|$)', 1), '') END) OVER (PARTITION BY note, h) AS heading_date FROM g"""
)
def dated_lines(spark: SparkSession, d: str) -> DataFrame:
    return markdown.with_heading_date(_note_lines(spark, d)).select("note", "line", "heading_date")


@query(f"SELECT note, line FROM (SELECT *, regexp_matches(value, '^\\s*(?:```|~~~)') AS f, sum(regexp_matches(value, '^\\s*(?:```|~~~)')::INTEGER) OVER (PARTITION BY note ORDER BY line ROWS UNBOUNDED PRECEDING) AS n FROM {_LINES}) WHERE n % 2 = 0 AND NOT f")
def unfenced_lines(spark: SparkSession, d: str) -> DataFrame:
    return markdown.outside_fences(_note_lines(spark, d)).select("note", "line")


@query(f"SELECT note, line FROM {_LINES} WHERE regexp_matches({mf('value')}, '(^|[^a-z0-9])(engineer|analyst)([^a-z0-9]|$)') AND NOT starts_with(value, '#')")
def review_places(spark: SparkSession, d: str) -> DataFrame:
    return handoff.review_places(_note_lines(spark, d), ["engineer", "analyst"], F.col("value").startswith("#")).select("note", "line")


# --- state over runs ---------------------------------------------------------------------------------------
@query(
    """WITH m AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM events)
    SELECT event_id, sum(failed::INTEGER) OVER (PARTITION BY user_id, ok ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INTEGER AS streak FROM m"""
)
def run_streaks(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select("event_id", F.col("user_id").alias("name"), F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return state.run_streaks(runs).select("event_id", F.col("streak").cast("int").alias("streak"))


@query("SELECT r.key, CASE WHEN l.key IS NULL THEN 'gone' WHEN r.url IS NOT DISTINCT FROM l.url THEN 'owned' ELSE 'moved' END AS finding FROM seen_jobs r LEFT JOIN (SELECT key, min(url) AS url FROM seen_batch GROUP BY 1) l ON r.key = l.key")
def owned_watches(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "seen_batch").groupBy("key").agg(F.min("url").alias("url"))
    found = handoff.owned(table(spark, d, "seen_jobs").select("key", "url"), live, "key", "url")
    return found[0].select("key", F.lit("owned").alias("finding")).unionByName(found[1].select("key", F.lit("moved").alias("finding"))).unionByName(found[2].select("key", F.lit("gone").alias("finding")))


@query("SELECT seen_id FROM seen_batch b WHERE NOT EXISTS (SELECT 1 FROM seen_jobs s WHERE s.key = b.key)")
def pending_creations(spark: SparkSession, d: str) -> DataFrame:
    return handoff.pending(table(spark, d, "seen_batch").select("seen_id", "key"), table(spark, d, "seen_jobs"), "key").select("seen_id")


@query("WITH i AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), w AS (SELECT DISTINCT source FROM mix_target) SELECT coalesce(i.source, w.source) AS source, CASE WHEN i.source IS NULL THEN 'missing' ELSE 'unexpected' END AS finding FROM i FULL OUTER JOIN w ON i.source = w.source WHERE i.source IS NULL OR w.source IS NULL")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return handoff.coverage(table(spark, d, "documents").where("source is not null"), table(spark, d, "mix_target"), "source")


# --- hand-off ----------------------------------------------------------------------------------------------
_STATUS = "CASE status WHEN 'PASS' THEN 'queued' WHEN 'PARTIAL' THEN 'manual_review' WHEN 'FAIL' THEN 'excluded' ELSE 'duplicate' END"


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    fate = F.when(F.col("status") == "PASS", "queued").when(F.col("status") == "PARTIAL", "manual_review").when(F.col("status") == "FAIL", "excluded").otherwise("duplicate")
    return table(spark, d, "job_verification").select(F.col("source").alias("batch"), F.col("verification_id").alias("ord"), F.col("ord").alias("id"), fate.alias("disposition"))


@query(
    f"""WITH f AS (SELECT source AS batch, ord, arg_min({_STATUS}, verification_id) AS x FROM job_verification GROUP BY 1, 2)
    SELECT batch, count(*) FILTER (WHERE x = 'queued') AS queued, count(*) FILTER (WHERE x = 'manual_review') AS manual_review, count(*) FILTER (WHERE x = 'excluded') AS excluded, count(*) FILTER (WHERE x = 'duplicate') AS duplicate, count(*) AS evaluated FROM f GROUP BY 1"""
)
def disposition_counts(spark: SparkSession, d: str) -> DataFrame:
    return handoff.disposition_counts(_decisions(spark, d))


@query("WITH k AS (SELECT key, count(*) AS n, bool_or(coalesce(score >= 40, false)) AS el FROM seen_batch GROUP BY 1) SELECT sum(n)::BIGINT AS evaluated, count(*) AS \"unique\", count(*) FILTER (WHERE el) AS eligible, count(*) FILTER (WHERE el AND key NOT IN (SELECT key FROM seen_jobs)) AS added FROM k")
def batch_counters(spark: SparkSession, d: str) -> DataFrame:
    return handoff.counters(table(spark, d, "seen_batch"), "key", F.col("score") >= 40, table(spark, d, "seen_jobs"))


@query(
    """WITH t AS (SELECT p_brand AS category, count(*)::VARCHAR AS submitted, CASE WHEN min(p_size) = 1 THEN (count(*) + 5)::VARCHAR ELSE '—' END AS target, CASE WHEN max(p_size) = 50 THEN '5' ELSE '—' END AS remaining FROM part GROUP BY 1)
    SELECT category, 'numeric remaining required' AS rule FROM t WHERE target <> '—' AND remaining = '—' UNION ALL SELECT category, 'target and remaining must both be dashes' FROM t WHERE target = '—' AND remaining <> '—' UNION ALL SELECT 'all', 'missing'"""
)
def summary_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("a"), F.max("p_size").alias("b"))
    rows = rows.select("category", F.col("n").cast("string").alias("submitted"), F.when(F.col("a") == 1, (F.col("n") + 5).cast("string")).otherwise("—").alias("target"), F.when(F.col("b") == 50, "5").otherwise("—").alias("remaining"))
    names = [r[0] for r in rows.select("category").orderBy("category").limit(1000).collect()]  # brands, a fixed list
    return handoff.summary_violations(rows, names, {"all": names})


@query(
    """WITH s AS (SELECT o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT o_orderstatus AS category, count(*) AS n FROM orders WHERE o_totalprice > 100000 OR o_orderstatus = 'F' GROUP BY 1)
    SELECT NULL AS category, 'rest is not what is unclassified' AS rule FROM (SELECT (SELECT sum(n) FROM s) - (SELECT sum(n) FROM k) AS rest) WHERE rest <> 0 UNION ALL SELECT k.category, 'more rows than stored' FROM k JOIN s ON k.category = s.category WHERE k.n > s.n"""
)
def baseline_rules(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    one = lambda rows: rows.groupBy(F.col("o_orderstatus").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return handoff.baseline_violations(one(orders), one(orders.where("o_totalprice > 100000 or o_orderstatus = 'F'")), 0, orders.count())


@query(
    """WITH c AS (SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY minimum_years_experience DESC NULLS LAST, ord) AS n FROM job_item WHERE coalesce(jd, '') = '') WHERE n <= 100), p AS (SELECT ord, min(status) AS detail FROM job_detail GROUP BY 1)
    SELECT i.ord, CASE WHEN c.ord IS NOT NULL THEN p.detail END AS detail FROM job_item i LEFT JOIN c ON i.ord = c.ord LEFT JOIN p ON i.ord = p.ord"""
)
def detail_budget(spark: SparkSession, d: str) -> DataFrame:
    """The budget of 100 pages is the feature."""
    details = table(spark, d, "job_detail").groupBy("ord").agg(F.min("status").alias("detail"))
    items = table(spark, d, "job_item").select("ord", "jd", "minimum_years_experience")
    return handoff.with_details(items, details, ["ord"], F.coalesce("jd", F.lit("")) == "", [F.col("minimum_years_experience").desc_nulls_last(), F.col("ord")], 100).select("ord", "detail")


@query(
    """WITH i AS (SELECT DISTINCT regexp_extract(company, '^([A-Za-z]+) ', 1) AS id FROM job_item WHERE regexp_matches(company, '^[A-Za-z]+ ')), t AS (SELECT DISTINCT source AS sink, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS id FROM documents) SELECT DISTINCT i.id, t.sink FROM i JOIN t ON i.id = t.id"""
)
def ids_in_texts(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "job_item").where(F.col("company").rlike("^[A-Za-z]+ ")).select(F.regexp_extract("company", "^([A-Za-z]+) ", 1).alias("id"))
    return handoff.ids_in_texts(ids, table(spark, d, "documents").select(F.col("source").alias("sink"), "text"))


@query(
    """SELECT verification_id, unnest(list_filter([CASE WHEN NOT coalesce(status IN ('PASS', 'PARTIAL', 'FAIL'), false) THEN 'known status' END, CASE WHEN NOT coalesce(regexp_matches(checked_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}.*(?:Z|[+-][0-9]{2}:[0-9]{2})$'), false) THEN 'time with a zone' END,
    CASE WHEN NOT coalesce(len(reasons) BETWEEN 1 AND 20, false) THEN '1 to 20 reasons' END, CASE WHEN NOT coalesce(trim(evaluator) <> '', false) THEN 'evaluator named' END], lambda x: x IS NOT NULL)) AS rule FROM job_verification"""
)
def record_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = {"known status": F.col("status").isin("PASS", "PARTIAL", "FAIL"), "time with a zone": F.col("checked_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}.*(?:Z|[+-]\d{2}:\d{2})$"), "1 to 20 reasons": F.size("reasons").between(1, 20), "evaluator named": F.trim("evaluator") != ""}
    return handoff.field_violations(table(spark, d, "job_verification"), "verification_id", rules)


@query(
    f"""SELECT 'current: ' || count(*) || ', p0: ' || count(*) FILTER (WHERE priority = '#p0') || ', p1: ' || count(*) FILTER (WHERE priority = '#p1') || ', p2: ' || count(*) FILTER (WHERE priority = '#p2') || '\n' || 'last 7 days: ' || count(*) FILTER (WHERE q BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}') || ', stale: ' || count(*) FILTER (WHERE DATE '{AS_OF}' - q > 7)
    || '\n' || 'urgent: ' || count(*) FILTER (WHERE dl - DATE '{AS_OF}' BETWEEN 0 AND 3) || ', expired: ' || count(*) FILTER (WHERE dl < DATE '{AS_OF}') || '\n' || 'unknown queued: ' || count(*) FILTER (WHERE q IS NULL) || ', unknown deadline: ' || count(*) FILTER (WHERE dl IS NULL) AS text FROM {_ENTRIES}"""
)
def funnel_text(spark: SparkSession, d: str) -> DataFrame:
    return handoff.render_funnel(ledger.funnel(_entries(spark, d), F.lit(AS_OF).cast("date")))


@query(
    f"""WITH b AS (SELECT *, row_number() OVER (ORDER BY score DESC, seen_id) AS n FROM (SELECT * FROM seen_jobs WHERE score IS NOT NULL)), k AS (SELECT * FROM b WHERE n <= 40)
    SELECT 1 AS line_no, '# Jobs: ' || (SELECT count(*) FROM b) || ' postings, ' || (SELECT count(*) FILTER (WHERE score >= 60) FROM b) || ' leads' AS line UNION ALL SELECT (n + 1)::INTEGER, n || '. ' || title || ' - ' || source || ' (' || key || ') score ' || score || ' ' || url FROM k WHERE score >= 60"""
)
def digest_report(spark: SparkSession, d: str) -> DataFrame:
    """The limit of 40 leads is the feature."""
    rows = table(spark, d, "seen_jobs").where("score is not null").select(F.col("seen_id").alias("ord"), "title", F.col("source").alias("company"), F.col("key").alias("location"), "score", "url")
    return sinks.digest_lines(rows, 60, "Jobs", 40)


@query(f"SELECT seen_id, '- [ ] #p1 **' || regexp_replace({sq('source')}, '([\\\\`*_{{}}\\[\\]<>()#+!|])', '\\\\\\1', 'g') || '｜' || regexp_replace({sq('title')}, '([\\\\`*_{{}}\\[\\]<>()#+!|])', '\\\\\\1', 'g') || '** · [Official job](' || replace(replace(url, '(', '%28'), ')', '%29') || ')' AS line FROM seen_jobs")
def task_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seen_jobs").select("seen_id", sinks.task_line(F.col("source"), F.col("title"), F.col("url"), F.lit("#p1")).alias("line"))


@query("SELECT coalesce(b.ord, a.ord) AS ord, CASE WHEN b.ord IS NULL THEN 'insert' WHEN a.ord IS NULL THEN 'delete' ELSE 'update' END AS change FROM (SELECT ord, min(status) AS s FROM job_detail GROUP BY 1) b FULL OUTER JOIN (SELECT ord, min(status) AS s FROM job_verification GROUP BY 1) a ON a.ord = b.ord WHERE a.ord IS NULL OR b.ord IS NULL OR a.s IS DISTINCT FROM b.s")
def change_plan(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name: table(spark, d, name).groupBy("ord").agg(F.min("status").alias("s"))
    return sinks.before_after(one("job_detail"), one("job_verification"), "ord").select("ord", "change")


@query(
    """WITH l AS (SELECT d.detail_id, d.url AS path, regexp_replace(d.apply_url, '/+$', '') AS t FROM job_detail d), f AS (SELECT DISTINCT url AS path FROM job_item WHERE url IS NOT NULL), n AS (SELECT string_split(path, '/')[-1] AS t FROM f GROUP BY 1 HAVING count(*) = 1),
    d AS (SELECT DISTINCT array_to_string(parts[1:k - 1], '/') AS t FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT string_split(path, '/') AS parts FROM f))), k AS (SELECT path AS t FROM f UNION SELECT left(path, length(path) - 3) FROM f WHERE ends_with(path, '.md') UNION SELECT t FROM d WHERE t <> '' UNION SELECT t FROM n)
    SELECT detail_id FROM l WHERE t IS NULL OR t NOT IN (SELECT t FROM k)"""
)
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "job_detail").select("detail_id", F.col("url").alias("path"), F.col("apply_url").alias("target"))
    return audit.broken_links(links, table(spark, d, "job_item").select(F.col("url").alias("path")).where("path is not null").distinct()).select("detail_id")


@query(
    """WITH g AS (SELECT source_type, count(*) AS n, CASE WHEN count(minimum_years_experience) > 0 THEN sum(minimum_years_experience) END AS target, count(*) FILTER (WHERE minimum_years_experience IS NULL) AS unset FROM job_item GROUP BY 1)
    SELECT source_type, CASE WHEN unset = 0 THEN target END::BIGINT AS target, (CASE WHEN unset = 0 THEN target END - n)::BIGINT AS remaining FROM g"""
)
def subtotal_targets(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "job_item").groupBy("source_type").agg(ledger.total_target(F.col("minimum_years_experience")).cast("long").alias("target"), F.count(F.lit(1)).alias("submitted"))
    return ledger.remaining(counts).select("source_type", "target", "remaining")
