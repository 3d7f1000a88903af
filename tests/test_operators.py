import random

from pyspark.sql import functions as F

from tideglass.functions import text as T
from tideglass.operators import audit, dedup, ledger, postings, profile, state
from tideglass.sources import markdown, sinks


def greedy_by_hand(rows):
    """The rule, row by row."""
    urls, ids, prints, kept = set(), set(), {}, []
    for o, u, w, i, f in rows:
        before = prints.get(f, []) if f else []
        if (u and u in urls) or (w and i and (w, i) in ids) or (before and (not i or "" in before or i in before)):
            continue
        kept.append(o)
        urls.add(u)
        ids.add((w, i))
        if f:
            prints.setdefault(f, []).append(i)
    return kept


def test_greedy_equals_the_sequential_rule(spark):
    rnd = random.Random(7)
    pick = lambda p, n: rnd.choice([""] * 3 + [f"{p}{k}" for k in range(n)])
    rows = [(o, pick("u", 30), pick("w", 5), pick("i", 12), pick("f", 20)) for o in range(300)] + [(300 + k, "u1", "w1", "i1", "f1") for k in range(50)]
    df = spark.createDataFrame(rows, "ord long, u string, w string, i string, f string")
    got = sorted(r.ord for r in dedup.greedy(df, "ord", "u", "w", "i", "f").collect())
    assert got == greedy_by_hand(rows)


def test_greedy_on_nothing(spark):
    df = spark.createDataFrame([], "ord long, u string, w string, i string, f string")
    assert dedup.greedy(df, "ord", "u", "w", "i", "f").count() == 0


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in dedup.components(pairs).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100


def test_score(spark):
    terms = postings.Terms(roles=["engineer"], preferred=["python"], places=["bern"], other_places=["rome"], negative=["senior"])
    rows = [("Engineer", "python", "", "", "Bern", "", ""), ("Senior engineer", "", "", "", "Rome", None, ""), ("Internal platform", "", "", "", None, "", "")]
    df = spark.createDataFrame(rows, "title string, snippet string, url string, company string, location string, employment_type string, position_level string")
    got = postings.score(df.withColumn("priority", F.lit(5)), terms, "priority").collect()
    assert [g.score for g in got] == [5 + 25 + 5 + 15, 0, 5]
    assert got[0].reasons == ["source +5", "role: engineer", "keywords +5: python", "location: bern"]


def test_empty_profile_scores_nothing(spark):
    df = spark.createDataFrame([("a", None, None, None, None, None, None)], "title string, snippet string, url string, company string, location string, employment_type string, position_level string")
    row = postings.score(df.withColumn("priority", F.lit(None).cast("int")), postings.Terms(), "priority").collect()[0]
    assert (row.score, row.reasons) == (0, [])


def test_flags(spark):
    df = spark.createDataFrame([("Intern 2026届", "", "", "", "Oslo", "", "", "2026-01-01")], "title string, snippet string, url string, company string, location string, employment_type string, position_level string, expires string")
    f = postings.flags(["intern"], ["oslo"], ["2025"], [], [], F.lit("2026-02-01").cast("date"))
    assert df.select(f.alias("f")).collect()[0].f == ["graduation year 2026", "internship outside its places", "expired"]


def seen(spark, rows):
    return spark.createDataFrame(rows, "key string, title string, url string, source string, first_seen string, last_seen string, score int")


def test_seen_state(spark):
    old = seen(spark, [("k1", "t", "u1", "s", "2026-01-01T10:00:00Z", "2026-01-01T10:00:00Z", 1), ("u2", "t", "u2", "s", "2026-01-01T10:00:00Z", "2026-01-01T10:00:00Z", 1), ("k9", "t", "u9", "s", "2025-01-01T00:00:00Z", "x", 1)])
    batch = spark.createDataFrame([("k1", "t2", "u1", "s", 2), ("k2", "t", "u2", "s", 20), ("k3", "t", "u3", "s", 3)], "key string, title string, url string, source string, score int")
    for day, new in (("2026-01-01T23:00:00Z", {"k1", "k2", "k3"}), ("2026-01-02T01:00:00Z", {"k3"})):
        got = {r.key: r for r in state.merge_seen(old, batch, F.lit(day).cast("timestamp")).collect()}
        assert set(got) == {"k1", "k2", "k3", "k9"} and {k for k, r in got.items() if r.is_new} == new
        assert got["k1"].title == "t2" and got["k2"].score == 20 and got["k2"].first_seen.startswith("2026-01-01T10")


def test_failure_days(spark):
    rows = [("a", 1, "2026-01-01", True), ("a", 2, "2026-01-01", True), ("a", 3, "2026-01-02", True), ("a", 4, "2026-01-04", True), ("b", 1, "2026-01-01", True), ("b", 2, "2026-01-01", False), ("b", 3, "2026-01-02", True)]
    runs = spark.createDataFrame(rows, "name string, at int, day string, failed boolean").withColumn("day", F.to_date("day"))
    got = {(r.name, str(r.day)[8:]): r.streak for r in state.failure_streaks(runs).collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", "01"): 1, ("a", "02"): 2, ("a", "04"): 1}
    assert got["b", "02"] == 1
    assert {r.name: r.consecutive_failures for r in state.health(runs).collect()} == {"a": 1, "b": 1}
    assert [r.streak for r in state.run_streaks(runs.where("name = 'b'")).orderBy("at").collect()] == [1, 0, 1]


def test_changes_and_difference(spark):
    v = spark.createDataFrame([("x", 1, 0), ("x", 2, 100), ("x", 3, 50), ("y", 1, 7)], "id string, at int, value int")
    assert [(r.id, r.at, r.previous) for r in state.changes(v, "id", [F.col("at")], "value").collect()] == [("x", 2, 0)]
    w = spark.createDataFrame([("a", 1, None), ("b", 2, "q"), ("c", 3, "q")], "k string, n int, t string")
    r = spark.createDataFrame([("a", 1, None), ("b", 9, "q"), ("d", 4, "q")], "k string, n int, t string")
    got = {(x.k, x.action, tuple(x.changed)) for x in state.difference(w, r, "k", ["n", "t"]).collect()}
    assert got == {("b", "update", ("n",)), ("c", "create", ()), ("d", "delete", ())}


HISTORY = r"""# Notes

## History

| Confirmed | Submitted | Company | Role | Category | Status | Link | Note |
| --- | --- | --- | --- | --- | --- | --- | --- |
| 2030-01-02 | Not recorded | Acme | A \| B | Canada internship | sent | [x](https://x.example/jobs/R-1) | Job ID R-1 |
| 2030-01-03 | 2030-01-03 | Beta | C | somewhere | sent | - | - |
| broken |

## Queue

### 2030-01-07

4 evaluated = 1 queued + 1 manual review + 1 excluded + 1 duplicate

- [ ] #p0 **Acme｜Role one** · Job ID R-7 · [Official job](https://x.example/a_(b))
  - deadline 2030-01-09

  - **编号：** Q-8
- [x] #p1 **Done｜Role**
"""
HEADERS = ["Confirmed", "Submitted", "Company", "Role", "Category", "Status", "Link", "Note"]


def test_markdown_tables(spark):
    notes = spark.createDataFrame([("n", HISTORY), ("empty", ""), ("none", None)], "note string, text string")
    rows, broken = markdown.table_rows(notes, "## History", HEADERS)
    got = rows.orderBy("line").collect()
    assert [r.cells[3] for r in got] == ["A | B", "C"]
    assert sorted((r.note, r.rule) for r in broken.collect()) == [("empty", "one section heading required"), ("n", "unsupported row"), ("none", "one section heading required")]
    found, odd = markdown.task_entries(notes, "## Queue")
    tasks = found.orderBy("line").collect()
    assert sorted(r.note for r in odd.collect()) == ["empty", "none"]
    assert [(t.done, t.priority, t.company, t.role, t.ids, t.urls) for t in tasks] == [(False, "#p0", "Acme", "Role one", ["Q-8", "R-7"], ["https://x.example/a_(b)"]), (True, "#p1", "", "", [], [])]
    assert [t.supported for t in tasks] == [True, False]
    old = spark.createDataFrame([("n", "## Queue\n- [x] #p1 **Old role** · Old Co · Job ID R-9\n\n  - 链接：[a](https://x.example/1)\n\nText\n  - no child\n## End\n- [ ] #p0 **A｜B**"), ("two", "## Queue\n## Queue")], "note string, text string")
    found, odd = markdown.task_entries(old, "## Queue")
    assert [(t.line, t.done, t.company, t.role, t.ids, t.urls, t.supported, t.block.count("\n")) for t in found.collect()] == [(2, True, "Old Co", "Old role", ["R-9"], ["https://x.example/1"], False, 2)]
    assert [r.note for r in odd.collect()] == ["two"]
    d = markdown.dispositions(markdown.lines(notes)).collect()
    assert [(r.date, r.evaluated, r.queued) for r in d] == [("2030-01-07", 4, 1)]
    deadline = spark.createDataFrame([(tasks[0].block,)], "b string").select(markdown.recorded_date(F.col("b"), "deadline").alias("d")).collect()[0].d
    assert str(deadline) == "2030-01-09"


def test_fences_and_sections(spark):
    notes = spark.createDataFrame([("n", "a\n```\nb\n```\nc\n## H\nd")], "note string, text string")
    assert [r.value for r in markdown.outside_fences(markdown.lines(notes)).orderBy("line").collect()] == ["a", "c", "## H", "d"]
    assert [r.section for r in markdown.with_section(markdown.lines(notes)).orderBy("line").collect()] == [0, 0, 0, 0, 0, 1, 1]


def test_categories_and_counts(spark):
    rows = spark.createDataFrame([("Canada internship",), ("full-time, UK",), ("Australia",), ("US intern (or UK)",), ("intern full time US",)], "c string")
    aliases = spark.createDataFrame([("ca", "Canada"), ("uk", "UK"), ("us", "US")], "region string, alias string")
    got = [(r.region, r.employment, r.issue is None) for r in ledger.classify(rows, "c", aliases, ["internship"], ["full time"]).collect()]
    assert got == [("ca", "internship", True), ("uk", "full_time", True), (None, None, False), ("us", "internship", True), (None, None, False)]
    t = spark.createDataFrame([(1, 5), (2, None)], "submitted int, target int")
    assert t.agg(ledger.total_target(F.col("target")).alias("t")).collect()[0].t is None


def test_identity(spark):
    none = F.array().cast("array<string>")
    e = spark.createDataFrame([(1, ["ACME"], ["R-1"], "Role", ["https://x.example/p"]), (2, ["Beta"], [], "Role", ["https://x.example/q/"]), (3, ["Acme"], ["Z"], "Role", ["https://x.example/q"])], "event_id int, companies array<string>, ids array<string>, role string, urls array<string>")
    r = spark.createDataFrame([(10, "Acme", "Role (R-1)", [], []), (11, "beta", "role", [], ["https://X.example/q"]), (12, "Acme", "Role", ["Y"], ["https://x.example/q"])], "row_id int, company string, role string, ids array<string>, urls array<string>")
    matches, broken = ledger.identity_matches(e, r)
    assert {(m.event_id, m.row_id, m.by) for m in matches.collect()} == {(1, 10, "id"), (2, 11, "address")}
    assert {(b.event_id, b.rule) for b in broken.collect()} == {(3, "explicit ids conflict")}
    del none


def test_funnel(spark):
    rows = [("#p0", "2029-12-25", "2030-01-09"), ("#p1", "2030-01-07", "2030-01-07"), ("#p2", None, None)]
    entries = spark.createDataFrame(rows, "priority string, queued_on string, deadline string").withColumns({"queued_on": F.to_date("queued_on"), "deadline": F.to_date("deadline")})
    r = ledger.funnel(entries, F.lit("2030-01-08").cast("date")).collect()[0]
    assert (r.p0_count, r.p1_count, r.p2_count, r.recent_count, r.stale_count, r.urgent_count, r.expired_count, r.unknown_queued, r.unknown_deadline) == (1, 1, 1, 1, 1, 1, 1, 1, 1)


def test_sensitive_lines(spark):
    rows = [("src/a.py", 1, "password = CHANGEME; api_key=abcdef123"), ("src/a.py", 2, "mail a@b.com"), ("tests/a.py", 1, "a@example.com 13800138000"), ("src/b", 1, "Authorization: Bearer abcdefghijklmnop1")]
    got = {(r.path, r.line, r.category) for r in audit.scan(spark.createDataFrame(rows, "path string, line int, text string")).collect()}
    assert got == {("src/a.py", 1, "credential-assignment"), ("src/a.py", 2, "email-address"), ("src/b", 1, "bearer-credential")}


def test_links_and_json(spark):
    links = spark.createDataFrame([("a", "docs/x"), ("a", "docs"), ("a", "y.md"), ("a", "gone")], "path string, target string")
    files = spark.createDataFrame([("docs/x.md",), ("other/y.md",)], "path string")
    assert [r.target for r in audit.broken_links(links, files).collect()] == ["gone"]
    j = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("x",)], "t string")
    assert [r.valid for r in audit.strict_json(j, "t").collect()] == [True, False, False]


def test_profile_lookups(spark):
    entries = spark.createDataFrame([("a",), ("a.b",), ("a.b[*].c",), ("a.b[1].c",), ("q.r",)], "path string")
    refs = spark.createDataFrame([("a.b[0].c.d",), ("a.b[1].c",), ("a.x",), ("zz",), ("bad..path",)], "ref string")
    got = {r.ref: r.entry for r in profile.longest_prefix(refs, "ref", entries, "path").collect()}
    assert got == {"a.b[0].c.d": "a.b[*].c", "a.b[1].c": "a.b[1].c", "a.x": "a", "zz": None, "bad..path": None}
    aliases = spark.createDataFrame([("s[*].t", "a.b[*].c"), ("u", "s[2].t"), ("x", "y"), ("y", "x")], "alias string, target string")
    led = {r.ref: (r.canonical, r.circle) for r in profile.canonical(spark.createDataFrame([("u.k",), ("x",), ("q",)], "ref string"), "ref", aliases).collect()}
    assert led["u.k"] == ("a.b[2].c.k", False) and led["q"] == ("q", False) and led["x"][1] is True
    wild = {(r.ref, r.entry) for r in profile.expand(spark.createDataFrame([("a.b[*].c",)], "ref string"), "ref", entries, "path").collect()}
    assert ("a.b[*].c", "a.b[1].c") in wild
    meta = spark.createDataFrame([("a", "x", None), ("a.b", None, "1"), ("a.b.c", None, None)], "path string, lang string, v string")
    inh = {(r.path, r.name): r.value for r in profile.inherited(meta, ["lang", "v"]).collect()}
    assert inh["a.b.c", "lang"] == "x" and inh["a.b.c", "v"] == "1"


def test_sinks(spark, tmp_path):
    sinks.replace_file(str(tmp_path / "r.txt"), "one")
    sinks.replace_file(str(tmp_path / "r.txt"), "two")
    assert (tmp_path / "r.txt").read_text() == "two"
    (tmp_path / "b").mkdir()
    for name in ("x", "y"):
        (tmp_path / "b" / name).write_bytes(b"same")
    blobs = sinks.read_blobs(spark, str(tmp_path / "b"), 100)
    stored = spark.createDataFrame([], "digest string")
    assert sinks.new_blobs(blobs, stored).count() == 1 and sinks.new_blobs(blobs, blobs.select("digest")).count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append_new(rows, None, "k", str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert sinks.append_new(rows, stored, "k", str(tmp_path / "t2")).count() == 0
    plan = {(r.k, r.change) for r in sinks.before_after(rows, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k").collect()}
    assert plan == {(1, "delete"), (2, "update"), (3, "insert")}
    assert sinks.table_digest(rows) == sinks.table_digest(rows.orderBy(F.desc("k")))


def test_report(spark):
    rows = [(1, "A", "c", "p", "u", 50), (2, "B", "c", "p", "u", 10), (3, "C", "c", "p", "u", 90)]
    got = [r.line for r in sinks.digest_lines(spark.createDataFrame(rows, "ord int, title string, company string, location string, url string, score int"), 20, "Report", 10).orderBy("line_no").collect()]
    assert got[0] == "# Report: 3 postings, 2 leads" and got[1].startswith("1. C") and len(got) == 3
    assert T is not None
