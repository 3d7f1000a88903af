import pytest

from tideglass.llm import residue as R

GOOD = "Acme Foods; Bern; Full-time; Mentoring is part of the job. "


@pytest.mark.parametrize("text", ["{{ job_title }}", "${company} Analyst", "[insert role here]", "&lt;dept&gt; Writer", "***team goes here***", "@Model.req_id", "%s at %s", "{0} ({1})", "#N/A", "[object Object]", "undefined - undefined", "test test 9", "xxxxx", GOOD + "xxxxx", "Lorem ipsum dolor sit amet consectetur", "nan; nan",
                                  "HTTP 401 - Unauthorized", "404 Not Found", "Error 502: Bad Gateway. Please try again.", "Please enable JavaScript to view this job", "We need you to activate JS in your browser!", "Page not found Reference: 9ade9b", "Bitte aktivieren Sie JavaScript Veuillez activer JavaScript", "请启用 JavaScript 后重试", GOOD + "The %location% is open.", "Dear [Candidate Name], thank you for your interest in [Company]."])
def test_residue(text):
    assert R.own_reasons(text)[0]


@pytest.mark.parametrize("text", [None, "", "  ", "JavaScript Engineer", "Developer {Rust, Go}", "404 Page Experience Designer", "Dummy Test Technician [f/m/d]", "Null Safety Compiler Engineer", "Error Analysis Scientist", "Latin Teacher (Lorem Ipsum Club)", "Sales Lead 100% remote", "Test Engineer", "Access Management Analyst",
                                  GOOD + "Must enable scripts and macros for finance users.", GOOD + "You reduce 'Access denied' tickets by better role design.", GOOD + "You maintain ${VAR} substitution in our build scripts.", GOOD + "Hands-on with <canvas> and <template> tags.", GOOD + "Experience with {{ }} style template engines is a plus.",
                                  GOOD + "The test task uses __init__ files and %s formats.", GOOD + "You replace lorem ipsum in mock-ups with real copy.", GOOD + "We test, test, and test again before each release.", GOOD + "You track undefined and null values in our event data.", GOOD + "Pay: [negotiable], bonus <9%>.", "word " * 20_000])
def test_talk_about_it(text):
    assert R.own_reasons(text)[0] == []


def test_flags(spark):
    rows = [(1, "Analyst", "Acme; Bern; x", "Acme"), (2, "{{title}}", None, "Acme"), (3, None, "", None), (4, "Ok", "Acme; {custom_field}; a b", "Acme"), (2, "{{title}}", None, "Acme")]
    rows += [(100 + k, "Fine title", "Odd page, come back soon, code 12", c) for k, c in enumerate(["Acme", "Beta", "Gamma"])]
    rows += [(200 + k, "Fine", f"Acme; {a}custom_field{b} {w}", "Acme") for k, (a, b, w) in enumerate([("{{", "}}", "p"), ("${", "}", "q"), ("[[", "]]", "r"), ("#{", "}", "s"), ("%", "%", "t"), ("{%", "%}", "u")])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "ord long, title string, snippet string, company string, field string").drop("field")
    got = {(r.ord, r.field): r.reasons for r in R.flag(df).collect()}
    assert got[2, "title"] == ["field_name"] and (1, "title") not in got and (3, "snippet") not in got
    assert got[4, "snippet"] == ["variable"] and all(got[100 + k, "snippet"] == ["repeated_page"] for k in range(3))
    assert R.flag(df.limit(0)).count() == 0


def test_aligned_slots(spark):
    towns = ["Bern", "Oslo", "Rome", "Lima", "Kyiv", "Bonn", "Graz", "Nice"]
    rows = [(k, "one", f"Acme {w}; {w}; {{{{workModel}}}}; Come to {w}.") for k, w in enumerate(towns)]
    rows += [(100 + k, "two", f"Dear ${{firstName}}, welcome to our team. Desk {w}.") for k, w in enumerate(towns)]
    rows += [(200 + k, "three", f"Acme; The pay is {p} a year, plus bonus; {w}") for k, (w, p) in enumerate(zip(towns, ["10", "much", "good", "{{salaryRange}}", "fair", "fine", "null", "low"], strict=True))]
    rows += [(300 + k, "four", f"Acme; {w}; {t}") for k, (w, t) in enumerate([*((w, f"Hiring {n} in {w}.") for w in towns for n in range(4)), *((w, "You maintain ${VAR} substitution in our scripts.") for w in towns)])]
    rows += [(400, "five", "Acme; Work model:"), *((401 + k, "five", f"Acme; Work model: {x}") for k, x in enumerate(["office", "remote", "hybrid"])), (410, "six", "Acme; Work model:")]
    df = spark.createDataFrame([(o, None, t, "Acme", s) for o, s, t in rows], "ord long, title string, snippet string, company string, source string")
    got = {r.ord: r.reasons for r in R.flag(df).collect()}
    assert set(got) == {*range(8), *range(100, 108), 203, 206, 400} and set(map(tuple, got.values())) == {("variable",)}


@pytest.mark.parametrize("text", ["Access denied. " * 40, "Access denied " * 60, "You must enable JavaScript in the settings of your browser " + "and of every other browser that you use for reading this listing " * 3, "HTTP 400 - HTTP 401 - Unauthorized Page not found", "Please try again. Bad Gateway " * 30])
def test_long_notices(text):
    assert R.own_reasons(text)[0] == ["notice"]


def test_long_texts_are_judged_quickly():
    assert not R.is_notice("You need to know JavaScript; " + "and more " * 20_000) and not R.is_notice("HTTP 400 - " * 3_000 + "x; y " * 30)


def test_pages_off_the_template(spark):
    towns = ["Bern", "Oslo", "Rome", "Lima", "Kyiv", "Bonn", "Graz", "Nice", "Cork", "Faro", "Gent", "Linz"]
    rows = [(k, "Analyst", f"Northern Foods {w}; {w}; Good pay. Come soon.", "Northern Foods", w, "one") for k, w in enumerate(towns * 5)]
    rows += [(500 + k, "Analyst", "Our kettle is not here just now. Come later", c, "Bern", "one") for k, c in enumerate(["Northern Foods", "Northern Analytics", None])]  # one beginning, two companies
    rows += [(600, "Kettle is not here", "Northern Foods; Bern; Good pay.", "Northern Foods", "Bern", "one"), (601, "Chef", "Northern Foods; Bern; Good pay. Our kettle is not here just now.", "Northern Foods", "Bern", "one")]
    rows += [(700 + k, "Cook", "No values at all here", "Acme", "Bern", "two") for k in range(3)] + [(710, "Cook", None, None, None, None), (711, None, "", "", "", "")]
    df = spark.createDataFrame(rows, "ord long, title string, snippet string, company string, location string, source string").withColumn("n_values", R.F.lit(1))
    got = {(r.ord, r.field): r.reasons for r in R.flag(df, lists=False).collect()}
    assert set(got) == {*((500 + k, "snippet") for k in range(3)), (600, "title"), (601, "snippet")}
    assert got[500, "snippet"] == ["other_page", "repeated_page"] and got[600, "title"] == ["page_text"]
    known = {r.source: r.is_template for r in R.templates(df)[0].collect()}
    assert known["one"] and not known["two"]
