from pyspark.sql import functions as F

from tideglass.functions import dates as D
from tideglass.functions import text as T
from tideglass.functions import urls as U


def value(spark, column, **given):
    names = ", ".join(f"{k} string" for k in given) or "x string"
    return spark.createDataFrame([tuple(given.values()) or ("",)], names).select(column.alias("v")).collect()[0].v


def test_terms_are_whole_words(spark):
    assert value(spark, T.hits(F.col("x"), ["intern", "招聘"]), x="internal platform 招聘") == ["招聘"]
    assert value(spark, T.hits(F.col("x"), ["intern"]), x="an intern, please") == ["intern"]
    assert value(spark, T.any_term(F.col("x"), []), x="anything") is True


def test_normal_forms_differ(spark):
    assert value(spark, T.match_form(F.col("x")), x=" A&amp;B  “C” – d ") == 'a&b "c" - d'
    assert value(spark, T.compat_form(F.col("x")), x="ＡＢＣ &amp; ẞ") == "abc & ss"
    assert value(spark, T.ledger_form(F.col("x")), x="ＡＢＣ &amp; ẞ") == "abc &amp; ss"


def test_markup_text(spark):
    page = "<script>x<1</script><p>One<br/>two</p>\n\n\n<ul><li>a</li><li>b &lt; c</li></ul>"
    assert value(spark, T.markup_text(F.col("x")), x=page) == "One\ntwo\na\nb < c"


def test_years(spark):
    assert value(spark, T.minimum_years(F.col("x")), x="Required: 5 years of experience in design. Or 7+ years experience.") == 5
    assert value(spark, T.minimum_years(F.col("x")), x="Preferred: 5 years of experience in design.") is None


def test_kinds(spark):
    b = value(spark, T.requirement_buckets(F.col("x")), x="- Python is required.\n- Go is a plus.\n* SQL preferred; ok\nplain")
    assert (b.required, b.nice_to_have, b.unclassified) == (["Python is required."], ["Go is a plus."], ["ok", "plain"]) and b.preferred == ["SQL preferred;"]


def test_section(spark):
    text = "Intro\nResponsibilities: build things\nRequired: skill"
    assert value(spark, T.section(F.col("x"), ["Responsibilities"], ["Required"]), x=text) == "build things"
    assert value(spark, T.section(F.col("x"), ["Nothing"], ["Required"]), x=text) == ""


def test_excerpt_and_snippet(spark):
    assert value(spark, T.excerpt(F.col("x"), 10), x="abcdef ghij klm") == "abcdef..."
    assert value(spark, T.snippet(F.col("x"), F.lit(None).cast("string"), F.lit(""), F.lit("d")), x=" A  B ") == "A B; d"


def test_fingerprint(spark):
    f = T.fingerprint(F.col("c"), F.col("t"), F.col("p"))
    assert value(spark, f, c="Acme Pte Ltd", t="Acme Pte Ltd Engineer - Bern", p="Bern") == "acme\0engineer\0bern"
    assert value(spark, f, c="Acme", t="Engineer", p="") == ""


def test_link_predicates(spark):
    assert value(spark, T.likely_link(F.col("t"), F.col("u")), t="About", u="https://careers.x.example/about") is False
    assert value(spark, T.likely_link(F.col("t"), F.col("u")), t="Open", u="https://x.example/jobs/1") is True


def test_url_normal_form(spark):
    same = ["https://X.example/Jobs/a%2Fb/?utm_source=q&b=2&a=1", "https://x.example/Jobs/a%2fb?b=2&a=1"]
    got = [value(spark, U.normal_form(F.col("x")), x=s) for s in same]
    assert got[0] == got[1] == "https://x.example/Jobs/a%2Fb?b=2&a=1"
    assert value(spark, U.normal_form(F.col("x")), x="https://x.example/a%7Eb") == "https://x.example/a~b"
    assert value(spark, U.normal_form(F.col("x")), x="https://x.example/?a=1&b=2") != value(spark, U.normal_form(F.col("x")), x="https://x.example/?b=2&a=1")
    assert value(spark, U.plain_normal_form(F.col("x")), x="HTTPS://X.example/a/?spm=1&z=1#f") == "https://x.example/a?z=1#f"
    assert "utm_source" in value(spark, U.ledger_form(F.col("x")), x="https://x.example/a?utm_source=q")


def test_job_ids(spark):
    cases = {"https://x/p?jobId=77": "77", "https://x/list#R12": "R12", "https://x/list#jobs": "", "https://x/en/jobs/list/123": "123", "https://x/about": "", "": ""}
    for url, expected in cases.items():
        assert value(spark, U.job_id(F.col("x")), x=url) == expected
    assert value(spark, U.direct_role(F.col("x")), x="https://x/roles/search") is False
    assert value(spark, U.has_id(F.col("x"), F.col("i")), x="https://x/jobs/a_123", i="123") is True


def test_links_with_parentheses(spark):
    assert U.link_targets("[a](https://x/a_(b)) [c](<https://y/z>)") == ["https://x/a_(b)", "https://y/z"]
    assert value(spark, U.apply_link(F.col("b"), F.col("m")), b="https://x/y", m='<a href="/no">Home</a><a href="/go"><b>Apply</b> now</a>') == "https://x/go"


def test_safe_addresses(spark):
    for url, ok in {"https://x.example/a": True, "https://u:p@x.example/": False, "https://x.example/?api_key=1": False, "ftp://x": False}.items():
        assert value(spark, U.safe_web_address(F.col("x")), x=url) is ok


def test_ids_and_labels(spark):
    assert value(spark, T.holds_id(F.col("t"), F.col("i")), t="see R-12-3 now", i="R-12") is False
    assert value(spark, T.holds_id(F.col("t"), F.col("i")), t="see R-12.", i="R-12") is True
    assert value(spark, T.holds_label(F.col("x"), "US"), x="Australia") is False
    assert value(spark, T.title_ids(F.col("x")), x="Engineer (R12) (abc) (12345)") == ["R12", "12345"]


def test_dates(spark):
    assert value(spark, D.strict_date(F.col("x")), x="2030-02-31") is None
    assert value(spark, D.epoch_day(F.col("x")), x="0") == "1970-01-01" and value(spark, D.epoch_day(F.col("x")), x="q") == ""
    assert str(value(spark, D.local_day(F.col("x"), "Asia/Tokyo"), x="2026-01-01T20:00:00Z")) == "2026-01-02"
    assert value(spark, D.leaf_texts(F.col("x")), x='{"a": ["b", {"c": "d"}], "e": 1}') == ["b", "d"]
    assert value(spark, D.leaf_texts(F.col("x")), x="[" * 200 + "]" * 200) is None


def test_nulls_stay_null(spark):
    for f in (T.clean, T.match_form, T.markup_text, U.normal_form, U.plain_normal_form):
        assert spark.createDataFrame([(None,)], "x string").select(f(F.col("x")).alias("v")).collect()[0].v is None
