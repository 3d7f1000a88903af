"""Named queries of the library's own operators over the workspace tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import dates as D
from tideglass.functions import text as T
from tideglass.functions import urls as U
from tideglass.operators import audit, dedup, ledger, postings, profile, state
from tideglass.plans.tables import table
from tideglass.sources import feeds, markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TERMS = postings.Terms(
    roles=["engineer", "developer"], core=["python", "sql"], preferred=["kotlin", "rust", "scala", "linux", "kafka", "excel", "tableau"], domains=["energy", "robotics", "health", "optics", "foods"], graduate=["junior", "intern", "graduate"],
    places=["canada", "germany"], other_places=["brazil", "remote"], companies=["analytics"], negative=["senior", "principal", "lead", "budget"], generic_titles=["careers", "undefined", "null"],
)
AS_OF = "2026-08-05"
SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def cl(x: str) -> str:
    """References resolved (those that occur) before white space is squeezed."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def mf(x: str) -> str:
    x = cl(x)
    return f"lower(translate({sq(x)}, '’‘“”–—', '''''\"\"--'))"


def e(x: str) -> str:
    return f"coalesce({x}, '')"


def has(x: str, term: str) -> str:
    return f"regexp_matches({x}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def n_hits(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {has(x, t)} THEN 1 ELSE 0 END" for t in terms) + ")"


def any_hit(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(has(x, t) for t in terms) + ")"


HAY = "concat_ws(' ', nullif(title, ''), nullif(snippet, ''), nullif(url, ''), nullif(company, ''), nullif(location, ''), nullif(employment_type, ''), nullif(position_level, ''))"
ACCEPT = {"location_any": ["canada", "germany", "japan"], "title_any": ["engineer", "developer", "analyst"]}


@query(f"SELECT ord FROM job_item WHERE {any_hit(mf(e('location')), ACCEPT['location_any'])} AND {any_hit(mf(e('title')), ACCEPT['title_any'])}")
def source_accept(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_item").where(postings.accepts(**ACCEPT)).select("ord")


_GENERIC = f"CASE WHEN contains(t, '{{{{') OR contains(t, '}}}}') OR t IN ('careers', 'undefined', 'null') THEN 35 ELSE 0 END"


@query(
    f"""WITH x AS (SELECT i.ord, coalesce(priority, 0) AS base, {mf(HAY)} AS h, {mf("title")} AS t, {mf("concat_ws(' ', coalesce(title, ''), coalesce(employment_type, ''), coalesce(position_level, ''))")} AS y FROM job_item i LEFT JOIN (SELECT name AS source_name, priority FROM job_source) s ON i.source = s.source_name)
    SELECT ord, greatest(0, base + CASE WHEN {any_hit('h', TERMS.roles)} THEN 25 ELSE 0 END + CASE WHEN {any_hit('h', TERMS.core)} THEN 20 ELSE 0 END + least(30, 5 * {n_hits('h', TERMS.preferred)}) + least(12, 3 * {n_hits('h', TERMS.domains)})
    + CASE WHEN {any_hit('y', TERMS.graduate)} THEN 20 ELSE 0 END + CASE WHEN {any_hit('h', TERMS.places)} THEN 15 ELSE 0 END - CASE WHEN {any_hit('h', TERMS.other_places)} AND NOT {any_hit('h', TERMS.places)} THEN 35 ELSE 0 END
    + CASE WHEN {any_hit('h', TERMS.companies)} THEN 10 ELSE 0 END - least(80, 25 * {n_hits('h', TERMS.negative)}) - coalesce({_GENERIC}, 0))::INTEGER AS score FROM x"""
)
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "job_source").select(F.col("name").alias("source"), "priority")
    items = table(spark, d, "job_item").select("ord", "title", "snippet", "url", "company", "location", "employment_type", "position_level", "source")
    return postings.score(items.join(sources, "source", "left"), TERMS, "priority").select("ord", F.col("score").cast("int").alias("score"))


_SEGMENTS = f"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(translate(x, '’‘“”–—', '''''\"\"--'), '(?i)\\b((?:minimum|required|preferred|nice to have|nice-to-have|bonus){SPACE}+(?:qualifications?|requirements?)\\b)', '\n\\1', 'g'),
    '([.;。；]){SPACE}+', '\\1\n', 'g'), '[\n\r]+'), lambda p: {sq('p')}), lambda p: p <> '')"""
_KINDS = {k: "(" + " OR ".join(has("s", t) if t.isascii() else f"contains(s, '{t}')" for t in ts) + ")" for k, ts in T.KIND_TERMS.items()}


@query(
    f"""WITH seg AS (SELECT detail_id, unnest({_SEGMENTS}) AS p FROM (SELECT detail_id, coalesce(requirements, '') AS x FROM job_detail)), low AS (SELECT detail_id, {mf("regexp_replace(p, '^[-*• ]+', '')")} AS s FROM seg)
    SELECT CASE WHEN {_KINDS['nice_to_have']} THEN 'nice_to_have' WHEN {_KINDS['preferred']} THEN 'preferred' WHEN {_KINDS['required']} THEN 'required' ELSE 'unclassified' END AS kind, count(*) AS n_segments, count(DISTINCT detail_id) AS n_details FROM low GROUP BY 1"""
)
def requirement_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "job_detail").select("detail_id", F.explode(T.segments(F.col("requirements"))).alias("s"))
    return found.groupBy(T.kind(F.col("s")).alias("kind")).agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("detail_id").alias("n_details"))


def ex(x: str, n: int) -> str:
    return f"CASE WHEN length({sq(x)}) <= {n} THEN {sq(x)} ELSE rtrim(substr({sq(x)}, 1, {n - 3})) || '...' END"


@query(f"SELECT ord, {sq('array_to_string(list_filter([' + ', '.join(e(sq(c)) for c in ('company', 'location', 'employment_type')) + ', ' + e(ex('snippet', 120)) + '], lambda p: p <> ' + chr(39) * 2 + '), ' + chr(39) + '; ' + chr(39) + ')')} AS text FROM job_item")
def excerpt_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_item").select("ord", T.snippet(F.col("company"), F.col("location"), F.col("employment_type"), F.col("snippet"), 120).alias("text"))


_STAND_IN = audit.STAND_IN.replace("'", "''")
_DIGITS = "list_transform(regexp_extract_all(x, '(?i)(?:phone|mobile|telephone|手机号|电话)[\"'']?\\s*[:=：]\\s*[\"'']?(\\+?[\\d ()-]{7,20})', 1), lambda v: regexp_replace(v, '[^0-9]', '', 'g'))"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n')) AS x FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, x, 'email-address' AS category FROM l WHERE regexp_matches(x, '(^|[^a-zA-Z0-9_.-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}([^a-zA-Z0-9_.-]|$)')
    UNION ALL SELECT doc_id, x, 'bearer-credential' FROM l WHERE regexp_matches(x, '(?i)\\bBearer\\s+[A-Za-z0-9._~-]{{16,}}')
    UNION ALL SELECT doc_id, x, 'identity-card-number' FROM l WHERE regexp_matches(x, '(^|[^0-9])[1-9][0-9]{{5}}(19|20)[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{{3}}[0-9Xx]([^0-9]|$)')
    UNION ALL SELECT doc_id, x, 'secret-token' FROM l WHERE regexp_matches(x, '{audit.TOKEN}')
    UNION ALL SELECT doc_id, x, 'credential-assignment' FROM l WHERE len(list_filter(regexp_extract_all(x, '{audit.ASSIGNMENT.replace("'", "''")}', 1), lambda v: length(v) >= 6 AND NOT regexp_matches(v, '{_STAND_IN}'))) > 0
    UNION ALL SELECT doc_id, x, 'phone-number' FROM l WHERE regexp_matches(x, '(^|[^0-9])((\\+?86[- ]?)?1[3-9][0-9]{{9}})([^0-9]|$)') OR regexp_matches(x, '(^|[^0-9])(\\+65[- ]?[689][0-9]{{3}}[- ]?[0-9]{{4}})([^0-9]|$)') OR len(list_filter({_DIGITS}, lambda v: length(v) >= 7)) > 0)
    SELECT category, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM c GROUP BY 1"""
)
def sensitive_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    rows = markdown.lines(docs, "doc_id").select("doc_id", F.explode(audit.sensitive(F.col("value"), F.lit(False))).alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


_FLAGS = {"internship": ["intern", "internship"], "internship_places": ["japan", "china"], "blocked": ["commission", "unpaid"], "other_places": ["brazil", "anywhere"]}


@query(
    f"""WITH x AS (SELECT ord, {mf(HAY)} AS h, {mf(e('location'))} AS p, try_cast(nullif(regexp_extract({e('expires')}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS DATE) AS ex FROM job_item)
    SELECT ord, (CASE WHEN {any_hit('h', _FLAGS['internship'])} AND {any_hit('p', _FLAGS['internship_places'])} THEN 1 ELSE 0 END + CASE WHEN {any_hit('h', _FLAGS['blocked'])} THEN 1 ELSE 0 END + CASE WHEN {any_hit('p', _FLAGS['other_places'])} THEN 1 ELSE 0 END
    + CASE WHEN coalesce(ex < DATE '{AS_OF}', false) THEN 1 ELSE 0 END)::INTEGER AS n_flags FROM x"""
)
def flagged_items(spark: SparkSession, d: str) -> DataFrame:
    found = postings.flags(**_FLAGS, years_allowed=[], as_of=F.lit(AS_OF).cast("date"))
    return table(spark, d, "job_item").select("ord", F.size(found).alias("n_flags"))


_TRACK = "list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: NOT regexp_matches(lower(split_part(q, '=', 1)), '^(utm_.*|spm|from|source)$'))"


@query(
    f"""SELECT ord, lower(regexp_extract(url, '^([^/?#]+//[^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[^/?#]+//[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN array_to_string({_TRACK}, '&') <> '' THEN '?' || array_to_string({_TRACK}, '&') ELSE '' END
    || CASE WHEN regexp_extract(url, '#(.*)$', 1) <> '' THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END AS address FROM job_item"""
)
def url_normal_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_item").select("ord", U.normal_form(F.col("url")).alias("address"))


_KEYS = ", ".join(f"nullif(trim(regexp_extract(u, '^[^?#]*\\?(?:[^#]*&)?{k}=([^&#]*)', 1)), '')" for k in U.ID_KEYS)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_JOB_ID = f"""WITH a AS (SELECT ord, url, trim(coalesce(url, '')) AS u FROM job_item), b AS (SELECT *, list_filter(string_split(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9_+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), lambda p: p <> '') AS parts, trim(regexp_extract(u, '#(.*)$', 1)) AS f FROM a),
    c AS (SELECT *, list_position(list_transform(parts, lambda p: list_contains({_LIST(U.ID_MARKERS)}, lower(p))), true) AS m FROM b), g AS (SELECT *, list_filter(CASE WHEN m > 0 THEN parts[m + 1:] ELSE [] END, lambda p: NOT list_contains({_LIST(U.ID_MARKERS + U.NO_IDS)}, lower(p))) AS named FROM c)
    SELECT ord, url, parts, coalesce({_KEYS}, CASE WHEN f <> '' AND NOT list_contains({_LIST(U.LIST_FRAGMENTS)}, lower(f)) THEN f END, named[-1], '') AS job_id FROM g"""


@query(f"SELECT ord, job_id FROM ({_JOB_ID})")
def url_job_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_item").select("ord", U.job_id(F.col("url")).alias("job_id"))


@query(
    f"""SELECT i.source, count(*) AS n_items, count(*) FILTER (WHERE coalesce(j.url <> '' AND (j.job_id <> '' OR regexp_matches(lower(regexp_extract(j.url, '^(?:[a-zA-Z][a-zA-Z0-9_+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '/(apply|application)(/|$)')
    OR regexp_matches(j.url, '(?i)^[^?#]*\\?(?:[^#]*&)?(?:gh_jid|jobid|positionid)=[^&#]')), false)) AS n_direct FROM job_item i JOIN ({_JOB_ID}) j ON i.ord = j.ord GROUP BY 1"""
)
def direct_roles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_item").groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(U.direct_role(F.col("url"))).alias("n_direct"))


@query(
    """SELECT ashby_row, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(description_html, '(?i)<br\\s*/?>', '\n', 'g'), '(?i)</(?:p|div|section|article|li|ul|ol|h[1-6])>', '\n', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\f\\x0b]+', ' ', 'g'), '\\n\\s+', '\n', 'g'), '^\\s+|\\s+$', '', 'g')) AS text FROM ashby_job"""
)
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ashby_job").select("ashby_row", T.markup_text(F.col("description_html")).alias("text"))


def _feed(rows: DataFrame, order: str, payload) -> DataFrame:
    names = [x.strip().split() for x in feeds.SOURCE.split(", ")]
    given = {"name": F.col("source"), "type": F.lit("feed"), "url": F.lit("https://feed.example")}
    s = F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])
    return rows.select(F.col(order).cast("long").alias("source_ord"), s.alias("s"), payload.alias("payload"))


@query(
    f"""SELECT ashby_row AS source_ord, {sq(e('title'))} AS title, coalesce(nullif(trim(apply_url), ''), nullif(trim(job_url), ''), 'https://feed.example') AS url, {sq(e('location'))} AS location, {sq(e('employment_type'))} AS employment_type, coalesce(id, '') AS job_id,
    CASE WHEN regexp_matches({sq(e('published_at'))}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN left({sq(e('published_at'))}, 10) ELSE {sq(e('published_at'))} END AS published FROM ashby_job WHERE {sq(e('title'))} <> '' """
)
def feed_ashby(spark: SparkSession, d: str) -> DataFrame:
    job = F.struct("id", "title", "location", F.col("employment_type").alias("employmentType"), F.col("job_url").alias("jobUrl"), F.col("apply_url").alias("applyUrl"), F.col("description_html").alias("descriptionHtml"), F.col("published_at").alias("publishedAt"))
    found = feeds.ashby(_feed(table(spark, d, "ashby_job"), "ashby_row", F.to_json(F.struct(F.array(job).alias("jobs")))))
    return found.select("source_ord", "title", "url", "location", "employment_type", "job_id", "published")


@query(
    f"""SELECT lever_row AS source_ord, {sq(e('text'))} AS title, coalesce(nullif(trim(hosted_url), ''), 'https://feed.example') AS url, {sq("coalesce(categories.location, '')")} AS location, {sq("coalesce(categories.commitment, '')")} AS employment_type, coalesce(id, '') AS job_id,
    coalesce(strftime(make_timestamp(created_at * 1000), '%Y-%m-%d'), '') AS published FROM lever_posting WHERE {sq(e('text'))} <> '' """
)
def feed_lever(spark: SparkSession, d: str) -> DataFrame:
    job = F.struct("id", "text", "categories", F.col("hosted_url").alias("hostedUrl"), F.col("description_plain").alias("descriptionPlain"), F.col("created_at").cast("string").alias("createdAt"))
    found = feeds.lever(_feed(table(spark, d, "lever_posting"), "lever_row", F.to_json(F.array(job))))
    return found.select("source_ord", "title", "url", "location", "employment_type", "job_id", "published")


@query("SELECT s.name AS source, count(i.ord) AS n_items FROM job_source s LEFT JOIN job_item i ON i.source = s.name GROUP BY 1")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    dims = table(spark, d, "job_source").select(F.col("name").alias("source"))
    return ledger.filled_counts(table(spark, d, "job_item").select("source"), dims, ["source"], "n_items")


@query(
    """WITH dims AS (SELECT * FROM (SELECT DISTINCT source_type FROM job_source) CROSS JOIN (VALUES (true), (false)) v(role_level)) SELECT d.source_type, d.role_level, count(i.ord) AS n_rows FROM dims d LEFT JOIN job_item i ON i.source_type = d.source_type AND i.role_level = d.role_level GROUP BY 1, 2"""
)
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    dims = table(spark, d, "job_source").select("source_type").distinct().withColumn("role_level", F.explode(F.array(F.lit(True), F.lit(False))))
    return ledger.filled_counts(table(spark, d, "job_item"), dims, ["source_type", "role_level"])


@query(
    """WITH c AS (SELECT source_type, source_type IN ('ashby', 'greenhouse', 'lever') AS m FROM job_item) SELECT 'category' AS level, source_type AS category, count(*) AS n_rows FROM c GROUP BY 2 UNION ALL SELECT 'members', NULL, count(*) FROM c WHERE m HAVING count(*) > 0 UNION ALL SELECT 'all', NULL, count(*) FROM c"""
)
def counts_with_subtotals(spark: SparkSession, d: str) -> DataFrame:
    return ledger.subtotals(table(spark, d, "job_item"), "source_type", F.col("source_type").isin("ashby", "greenhouse", "lever"))


@query("SELECT l_orderkey, stored, computed FROM (SELECT l_orderkey, max(l_linenumber)::BIGINT AS stored, count(*) AS computed FROM lineitem GROUP BY 1) WHERE stored IS DISTINCT FROM computed")
def count_reconcile(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    stored = items.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("n"))
    return ledger.mismatches(stored, items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")), ["l_orderkey"], "n")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("score") >= 60, "#p0").when(F.col("score") >= 30, "#p1").otherwise("#p2")
    return table(spark, d, "seen_jobs").select("seen_id", rank.alias("priority"), D.leading_date(F.col("first_seen")).alias("queued_on"), D.leading_date(F.col("last_seen")).alias("deadline"))


_ENTRIES = "(SELECT seen_id, CASE WHEN score >= 60 THEN '#p0' WHEN score >= 30 THEN '#p1' ELSE '#p2' END AS priority, try_cast(nullif(regexp_extract(first_seen, '^([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE) AS q, try_cast(nullif(regexp_extract(last_seen, '^([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE) AS dl FROM seen_jobs)"


@query(
    f"""SELECT count(*) AS current_count, count(*) FILTER (WHERE priority = '#p0') AS p0_count, count(*) FILTER (WHERE priority = '#p1') AS p1_count, count(*) FILTER (WHERE priority = '#p2') AS p2_count, count(*) FILTER (WHERE q BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}') AS recent_count,
    count(*) FILTER (WHERE DATE '{AS_OF}' - q > 7) AS stale_count, count(*) FILTER (WHERE dl - DATE '{AS_OF}' BETWEEN 0 AND 3) AS urgent_count, count(*) FILTER (WHERE dl < DATE '{AS_OF}') AS expired_count, count(*) FILTER (WHERE q IS NULL) AS unknown_queued, count(*) FILTER (WHERE dl IS NULL) AS unknown_deadline FROM {_ENTRIES}"""
)
def funnel_health(spark: SparkSession, d: str) -> DataFrame:
    return ledger.funnel(_entries(spark, d), F.lit(AS_OF).cast("date"))


@query(f"SELECT seen_id, 'stale' AS why FROM {_ENTRIES} WHERE DATE '{AS_OF}' - q > 7 UNION ALL SELECT seen_id, CASE WHEN dl < DATE '{AS_OF}' THEN 'expired' ELSE 'urgent' END FROM {_ENTRIES} WHERE dl - DATE '{AS_OF}' <= 3")
def tense_entries(spark: SparkSession, d: str) -> DataFrame:
    return ledger.tense_entries(_entries(spark, d), F.lit(AS_OF).cast("date")).select("seen_id", "why")


@query("SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS digest FROM documents GROUP BY 2")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query()
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "job_item").select("ord", U.normal_form(F.col("url")).alias("address"), T.company_form(F.coalesce("company", F.lit(""))).alias("owner"), F.coalesce("job_id", F.lit("")).alias("job_id"),
                                               T.fingerprint(F.coalesce("company", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("location", F.lit(""))).alias("print"))
    return dedup.greedy(items, "ord", "address", "owner", "job_id", "print").select("ord")


@query(
    """WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen_id) AS n FROM seen_batch) WHERE n = 1),
    k AS (SELECT b.*, s.key AS old_key, s.first_seen AS old_first FROM b LEFT JOIN seen_jobs s ON s.key = b.key), free AS (SELECT url, min(key) AS key, arg_min(first_seen, key) AS first_seen FROM seen_jobs WHERE key NOT IN (SELECT old_key FROM k WHERE old_key IS NOT NULL) GROUP BY url),
    m AS (SELECT k.key, k.title, k.url, k.source, k.score, coalesce(k.old_key, f.key) AS old_key, coalesce(k.old_first, f.first_seen) AS old_first FROM k LEFT JOIN free f ON k.old_key IS NULL AND f.url = k.url)
    SELECT key, title, url, source, coalesce(old_first, '2026-08-12T00:00:00Z') AS first_seen, '2026-08-12T00:00:00Z' AS last_seen, score, coalesce(old_first IS NULL OR (try_cast(old_first AS TIMESTAMPTZ) AT TIME ZONE 'UTC')::DATE = DATE '2026-08-12', false) AS is_new FROM m UNION ALL SELECT key, title, url, source, first_seen, last_seen, score, false FROM seen_jobs WHERE key NOT IN (SELECT old_key FROM m WHERE old_key IS NOT NULL)"""
)
def seen_state(spark: SparkSession, d: str) -> DataFrame:
    batch = dedup.first_by(table(spark, d, "seen_batch"), ["key"], [F.col("seen_id")])
    now = F.lit("2026-08-12T00:00:00Z").cast("timestamp")
    return state.merge_seen(table(spark, d, "seen_jobs").select(*state.SEEN), batch, now).select(*state.SEEN, "is_new")


_RUNS = "(SELECT user_id, ts, event_id, CAST(ts AS DATE) AS day, event_type = 'error' AS failed FROM events)"


@query(
    f"""WITH m AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM {_RUNS}), g AS (SELECT user_id, ok, day FROM m WHERE failed GROUP BY 1, 2, 3),
    i AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id, ok ORDER BY day))::INTEGER AS island FROM g) SELECT user_id AS name, day, (row_number() OVER (PARTITION BY user_id, ok, island ORDER BY day))::INTEGER AS streak FROM i"""
)
def failure_streak(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("user_id").alias("name"), F.struct("ts", "event_id").alias("at"), F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("failed"))
    return state.failure_streaks(runs).select("name", "day", F.col("streak").cast("int").alias("streak"))


@query("SELECT event_id, previous FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value > previous")
def change_detect(spark: SparkSession, d: str) -> DataFrame:
    return state.changes(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "value").select("event_id", "previous")


@query(
    """WITH w AS (SELECT url, min(title) AS title, min(source) AS source FROM seen_batch GROUP BY 1), r AS (SELECT url, min(title) AS title, min(source) AS source FROM seen_jobs GROUP BY 1)
    SELECT coalesce(w.url, r.url) AS url, CASE WHEN r.url IS NULL THEN 'create' WHEN w.url IS NULL THEN 'delete' ELSE 'update' END AS action FROM w FULL OUTER JOIN r ON w.url = r.url WHERE r.url IS NULL OR w.url IS NULL OR w.title IS DISTINCT FROM r.title OR w.source IS DISTINCT FROM r.source"""
)
def watch_diff(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name: table(spark, d, name).groupBy("url").agg(F.min("title").alias("title"), F.min("source").alias("source"))
    return state.difference(one("seen_batch"), one("seen_jobs"), "url", ["title", "source"]).select("url", "action")


@query(
    """WITH s AS (SELECT DISTINCT ord, 'detail' AS sink FROM job_detail UNION ALL SELECT DISTINCT ord, 'verification' FROM job_verification), h AS (SELECT ord, count(*) AS n FROM s GROUP BY 1) SELECT i.ord, CASE WHEN h.n IS NULL THEN 'orphan' WHEN h.n > 1 THEN 'duplicate' ELSE 'ok' END AS finding FROM job_item i LEFT JOIN h ON h.ord = i.ord"""
)
def sink_orphans(spark: SparkSession, d: str) -> DataFrame:
    sinks = table(spark, d, "job_detail").select("ord", F.lit("detail").alias("sink")).unionByName(table(spark, d, "job_verification").select("ord", F.lit("verification").alias("sink")))
    return ledger.orphans(table(spark, d, "job_item").select("ord"), sinks, "ord").select("ord", "finding")


_PATHS = ["k1", "k1.n2", "k1.n2[*]", "k1.n2[3]", "k3.n1[*]", "k5.n4[0]", "k6"]
_REF = "'k' || (l_orderkey % 7)::VARCHAR || '.n' || l_linenumber::VARCHAR || '[' || (l_suppkey % 5)::VARCHAR || ']'"


@query(
    f"""WITH r AS (SELECT {_REF} AS ref, count(*) AS n_rows FROM lineitem GROUP BY 1), p(entry, rx, n, w) AS (VALUES ('k1', '^k1([.\\[]|$)', 1, 1), ('k1.n2', '^k1\\.n2(\\[|$)', 2, 2), ('k1.n2[*]', '^k1\\.n2\\[[0-9]+\\]', 3, 2), ('k1.n2[3]', '^k1\\.n2\\[3\\]', 3, 3), ('k3.n1[*]', '^k3\\.n1\\[[0-9]+\\]', 3, 2), ('k5.n4[0]', '^k5\\.n4\\[0\\]', 3, 3), ('k6', '^k6([.\\[]|$)', 1, 1)),
    j AS (SELECT r.ref, r.n_rows, p.entry, row_number() OVER (PARTITION BY r.ref ORDER BY p.n DESC NULLS LAST, p.w DESC) AS k FROM r LEFT JOIN p ON regexp_matches(r.ref, p.rx)) SELECT ref, n_rows, entry FROM j WHERE k = 1"""
)
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat(F.lit("k"), (F.col("l_orderkey") % 7).cast("string"), F.lit(".n"), F.col("l_linenumber").cast("string"), F.lit("["), (F.col("l_suppkey") % 5).cast("string"), F.lit("]"))
    refs = table(spark, d, "lineitem").groupBy(ref.alias("ref")).agg(F.count(F.lit(1)).alias("n_rows"))
    return profile.longest_prefix(refs, "ref", spark.createDataFrame([(p,) for p in _PATHS], "path string"), "path").select("ref", "n_rows", "entry")


@query(
    """WITH l AS (SELECT doc_id, i AS line, string_split_regex(text, '\\r\\n|\\n')[i] AS v FROM (SELECT doc_id, text, unnest(range(1, len(string_split_regex(text, '\\r\\n|\\n')) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT *, sum(CASE WHEN regexp_matches(v, '^(Required|Preferred|About|Why us|What you)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM l) SELECT doc_id, section::BIGINT AS section, count(*) AS n_lines FROM s GROUP BY 1, 2"""
)
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    found = markdown.with_section(markdown.lines(docs, "doc_id"), "doc_id", "^(Required|Preferred|About|Why us|What you)")
    return found.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"))


@query("SELECT seen_id, score FROM seen_jobs ORDER BY score DESC NULLS LAST, last_seen DESC, seen_id LIMIT 50")
def best_seen(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: a report of the best 50."""
    return dedup.ranked(table(spark, d, "seen_jobs"), [F.col("score").desc_nulls_last(), F.col("last_seen").desc(), F.col("seen_id")], 50).select("seen_id", "score")


@query("SELECT min(seen_id) AS seen_id, key FROM seen_batch WHERE key NOT IN (SELECT key FROM seen_jobs WHERE key IS NOT NULL) GROUP BY 2")
def unseen_items(spark: SparkSession, d: str) -> DataFrame:
    return dedup.unseen(table(spark, d, "seen_batch").select("seen_id", "key"), table(spark, d, "seen_jobs"), "key", [F.col("seen_id")]).select("seen_id", "key")


@query("SELECT coalesce(strftime(make_timestamp(created_at * 1000), '%Y-%m-%d'), '') AS day, count(*) AS n_postings FROM lever_posting GROUP BY 1")
def epoch_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lever_posting").groupBy(D.epoch_day(F.col("created_at")).alias("day")).agg(F.count(F.lit(1)).alias("n_postings"))


@query("SELECT source, count(*) AS n_docs, count(DISTINCT sha256(text)) AS n_contents FROM documents GROUP BY 1")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct(D.digest(F.col("text"))).alias("n_contents"))


_STOPS = ["Required", "Preferred", "What we offer"]


@query(
    f"""WITH a AS (SELECT detail_id, jd, lower(translate(jd, '’‘“”–—', '''''\"\"--')) AS low FROM job_detail WHERE jd IS NOT NULL), b AS (SELECT *, instr(low, 'responsibilities') AS p FROM a), c AS (SELECT *, substr(low, p + 16) AS rest FROM b),
    g AS (SELECT *, list_min(list_filter([{', '.join(f"instr(rest, '{s.lower()}')" for s in _STOPS)}], lambda x: x > 1)) AS q FROM c)
    SELECT detail_id, CASE WHEN p = 0 THEN '' ELSE regexp_replace(substr(jd, p + 16, coalesce(q - 1, 2500)), '^[ :\\-\n\t]+|[ :\\-\n\t]+$', '', 'g') END AS section FROM g"""
)
def page_section(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_detail").where("jd is not null").select("detail_id", T.section(F.col("jd"), ["Responsibilities"], _STOPS).alias("section"))


@query(
    f"""SELECT detail_id, array_to_string(list_filter(list_transform(string_split(jd, '\n'), lambda x: {sq('x')}), lambda x: length(x) >= 25 AND regexp_matches(lower(x), '{'|'.join(T.REQUIREMENT_WORDS)}'))[1:8], '\n') AS lines FROM job_detail WHERE jd IS NOT NULL"""
)
def requirement_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_detail").where("jd is not null").select("detail_id", T.requirement_sentences(F.col("jd")).alias("lines"))


_REASONS = ["title matches", "company matches"]


@query(f"SELECT verification_id, list_sort(list_distinct(list_filter(reasons, lambda x: NOT list_contains({_LIST(_REASONS)}, x)))) AS unknown FROM job_verification WHERE len(list_filter(reasons, lambda x: NOT list_contains({_LIST(_REASONS)}, x))) > 0")
def unknown_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "job_verification").select("verification_id", "reasons").where("reasons is not null")
    return audit.unknown_fields(rows, F.col("reasons"), _REASONS, []).select("verification_id", F.array_sort("unknown").alias("unknown"))


@query()
def identity_matches(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the employers' own feeds against those of boards, by company and id."""
    items = table(spark, d, "job_item").where("company is not null").select("ord", "company", F.coalesce("title", F.lit("")).alias("role"), "url", F.regexp_extract_all(F.coalesce("job_id", F.lit("")), F.lit(r"0*(\d{7,})"), F.lit(1)).alias("ids"), F.col("source_type").isin("ashby", "greenhouse", "lever", "html", "baidu_campus").alias("own"))
    events = items.where("own").select(F.col("ord").alias("event_id"), F.array("company").alias("companies"), "ids", "role", F.array_compact(F.array("url")).alias("urls"))
    rows = items.where("not own").select(F.col("ord").alias("row_id"), "company", "role", "ids", F.array_compact(F.array("url")).alias("urls"))
    return ledger.identity_matches(events, rows)[0]
