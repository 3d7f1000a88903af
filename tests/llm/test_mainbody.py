from tideglass.llm import mainbody as M

PAGE = """Skip to main content
Home | Careers | About us | Contact

Help
My profile
Benefits
Acme makes compass tools for textiles teams in 8 countries.
Responsibilities
• Travel to Ilmarcombe (max. 39 days)
You build cookie consent tools that our clients trust.
Similar jobs
Lead Product Manager, Quassehausen
› Principal Technical Writer · Kelvihaven · New
Lead Engineer | Port Lornusport | 2 days ago
Required
Benefits
Home office is possible; contact with clients is daily.
本网站使用 Cookie 以改善您的体验。
接受全部 | 仅必要
Apply now  ♥ Save  ↗ Share
We value your privacy – OK, got it
Follow us for updates
Acme Labs, powered by cobalt-jobs.example
(c) 2026 Acme Labs"""


def test_flattened_page():
    assert M.hidden_lines(PAGE) == [1, 2, 4, 5, 6, 11, 12, 13, 14, 18, 19, 20, 21, 22, 23, 24]


def test_defined_cases():
    assert M.hidden_lines(None) == M.hidden_lines("") == M.hidden_lines("\n \n") == []
    assert M.hidden_lines("One plain paragraph.") == []
    assert M.hidden_lines("© 2024 A. All rights reserved.") == [1]
    assert M.main_text(None) is None and M.main_text("© 2024 A") == ""
    assert M.hidden_lines("a" * 200_000) == []


def test_html_tree():
    page = """<html><head><title>t</title><style>x</style></head><body><nav><a>Home</a></nav><h1>Role</h1><p>First<br>line<p>Second &amp; last
    <ul><li>one<li>two <b>bold</b></ul><div style="display:none">secret</div><div hidden>gone</div><table><tr><td>a<td>bb<tr><td>ccc<td>d</table>
    <div class="cookie-banner">We use cookies</div><script>if (a<b) {}</script><footer>© 2024</footer></body></html>"""
    assert M.render(M.build_html(page)) == "Role\n\nFirst\nline\n\nSecond & last\n\n• one\n• two bold\n\na    bb\nccc  d"


def test_containers_and_class_names():
    assert M.render(M.build_html('<body class="no-sidebar"><form><div class="page with-sidebar"><p>Role</p></div><input type=text></form><div class="sidebar">x</div><div id=footer>y</div></body>')) == "Role"
    assert M.render(M.build_html('<body class="footer"><p>Role<div class="cookie-banner big">c</div>')) == "Role"


def test_nested_tables():
    assert M.render(M.build_html("<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>dd</table><tr><td>e</table>")) == "a  b c dd\ne"
    assert M.render(M.build_html("<table><tr><td>" * 1200 + "x")) == "x"


def test_long_breadcrumb():
    assert M.hidden_lines("Home > " + " > ".join(["Department of compass tools"] * 9) + "\nBody text of the page.") == [1]


def test_deep_and_broken_markup():
    assert M.render(M.build_html("<div>" * 5000 + "x" + "</p></span>")) == "x"
    assert M.render(M.build_html("a < b and <unclosed")) == "a < b and <unclosed"


def test_rows(spark):
    df = spark.createDataFrame([("f", 1, PAGE, 0), ("f", 2, None, 0), ("f", 3, "", 0), ("f", 1, PAGE, 0)], "field string, row_id long, text string, line_no int")
    assert M.boilerplate(df.drop("line_no")).count() == 32
    assert {r.row_id: r.body for r in M.bodies(df.drop("line_no")).collect()}[2] is None
