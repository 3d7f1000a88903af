import json

from tideglass.sources import feeds

PAGE = '<html><a href="/about">About us</a><a href="/jobs/42"><b>Data</b> Engineer</a><a href="/jobs/42"><b>Data</b> Engineer</a></html>'
RSS = "<rss><channel><item><title>Ops &amp; more</title><link>https://r.example/jobs/7</link><description>text</description><pubDate>Mon</pubDate></item><item><title></title></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom job</title><link href="https://r.example/jobs/8"/><summary>s</summary><updated>2026-01-01</updated></entry></feed>'
ASHBY = json.dumps({"jobs": [{"id": "a1", "title": "Same", "location": "Bern", "employmentType": "FullTime", "jobUrl": "https://j", "applyUrl": "https://a", "descriptionHtml": "<p>Required: at least 4 years of experience with tools.</p>"}, {"id": "a2", "title": "Same", "applyUrl": ""}]})
GREENHOUSE = json.dumps({"jobs": [{"id": 55, "title": "Green", "location": {"name": "Oslo"}, "absolute_url": "https://g", "content": "&lt;p&gt;x", "updated_at": "2026-01-02T03:04:05Z"}]})
LEVER = json.dumps([{"id": "l1", "text": "Lever job", "categories": {"location": "Rome", "commitment": "Full"}, "hostedUrl": "https://l", "descriptionPlain": "d", "lists": [{"text": "Need", "content": "<li>x</li>"}], "createdAt": 86400000}])
MCF = json.dumps({"results": [{"uuid": "m1", "title": "Mcf", "postedCompany": {"name": "Co"}, "employmentTypes": [{"employmentType": "Perm"}], "positionLevels": [{"position": "Junior"}], "minimumYearsExperience": 3, "description": "<p>d</p>", "metadata": {"jobDetailsUrl": "https://m", "newPostingDate": "2026-01-01"}}]})
EMBEDDED = '<script>x = {"listDetailData": [{"name": "Emb", "jobId": "b 1", "workPlaceName": [{"name": "Wuhan"}], "workContent": "w", "serviceCondition": "c"}], "other": 1}</script>'
SEARCH = '<div class="txt-box"><h3><a target="_blank" href="/link?u=1">2026 <em>校招</em></a></h3><p class="txt-info">info</p><span class="all-time-y2">acc</span></div>'
PORTAL = json.dumps({"title": "Portal row", "job_id": "p1"})


def sources(spark, rows):
    names = "name string, type string, url string, company string, location string, employment_type string, enabled boolean, priority int, query string, require_location_any array<string>, require_title_any array<string>, require_title_all array<string>, require_any array<string>"
    data = [(i, *[r.get(n.strip().split()[0]) for n in names.split(", ")]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "source_ord int, " + names)


def test_all_types(spark):
    kinds = {"html": PAGE, "rss": RSS, "atom": ATOM, "ashby": ASHBY, "greenhouse": GREENHOUSE, "lever": LEVER, "mycareersfuture": MCF, "baidu_campus": EMBEDDED, "wechat_search": SEARCH, "portal": PORTAL}
    rows = [{"name": k, "type": "rss" if k == "atom" else k, "url": f"https://{k}.example/list"} for k in kinds] + [{"name": "off", "type": "manual"}, {"name": "none", "type": "html", "enabled": False}]
    payloads = spark.createDataFrame(list(kinds.items()), "source string, payload string")
    postings, errors, counts = feeds.collect(sources(spark, rows), payloads)
    got = postings.orderBy("ord").collect()
    assert len(got) == 11 and errors.count() == 0 and sum(r.n_items for r in counts.collect()) == 11
    by = {r.source: r for r in got}
    assert (by["html"].title, by["html"].url, by["html"].job_id) == ("Data Engineer", "https://html.example/jobs/42", "42")
    assert (by["rss"].title, by["rss"].job_id, by["atom"].url, by["atom"].published) == ("Ops & more", "7", "https://r.example/jobs/8", "2026-01-01")
    ashby = [r for r in got if r.source == "ashby"]
    assert [r.job_id for r in ashby] == ["a1", "a2"] and ashby[0].minimum_years_experience == 4 and ashby[1].url == "https://ashby.example/list"
    assert (by["greenhouse"].job_id, by["greenhouse"].location, by["greenhouse"].published) == ("55", "Oslo", "2026-01-02")
    assert (by["lever"].published, by["lever"].employment_type) == ("1970-01-02", "Full") and "Need" in by["lever"].snippet
    assert by["mycareersfuture"].minimum_years_experience == 3 and by["mycareersfuture"].location == "Singapore" and "minimum experience: 3 years" in by["mycareersfuture"].snippet
    assert (by["baidu_campus"].url, by["baidu_campus"].location, by["baidu_campus"].company) == ("https://baidu_campus.example/list#b%201", "Wuhan", "百度")
    assert by["wechat_search"].title == "2026 校招" and by["wechat_search"].snippet == "info；公众号：acc"
    assert by["portal"].job_id == "p1"


def test_errors_do_not_stop_others(spark):
    rows = [{"name": "good", "type": "portal"}, {"name": "bad", "type": "ashby"}, {"name": "odd", "type": "carrier pigeon"}, {"name": "lost", "type": "html"}]
    payloads = spark.createDataFrame([("good", PORTAL), ("bad", "{nope"), ("odd", "x")], "source string, payload string")
    postings, errors, counts = feeds.collect(sources(spark, rows), payloads)
    assert [r.source for r in postings.collect()] == ["good"]
    assert {r.source for r in errors.collect()} == {"bad", "odd", "lost"}
    assert {r.source: r.n_items for r in counts.collect()} == {"good": 1, "bad": 0, "odd": 0, "lost": 0}


def test_conditions_of_a_source(spark):
    rows = [{"name": "a", "type": "ashby", "require_location_any": ["bern"]}, {"name": "b", "type": "ashby", "require_title_all": ["same", "other"]}]
    payloads = spark.createDataFrame([("a", ASHBY), ("b", ASHBY)], "source string, payload string")
    assert [r.job_id for r in feeds.collect(sources(spark, rows), payloads)[0].collect()] == ["a1"]


def test_monitorable(spark):
    rows = [{"name": "a", "type": "html", "url": "https://X.example/j/"}, {"name": "b", "type": "rss", "url": "https://x.example/j"}, {"name": "c", "type": "portal", "url": "https://y"}, {"name": "d", "type": "html", "url": ""}]
    assert [r.name for r in feeds.monitorable(sources(spark, rows)).collect()] == ["a"]
