import random

import pytest

from tideglass.llm import canonical as C

EMPLOYMENT = [(1, "Full-time", ["FT", "Vollzeit", "temps plein"]), (2, "Part-time", ["PT"]), (3, "Internship", ["Intern", "实习"]), (4, "Contract", ["Contractor"]), (6, "Fixed-term", ["CDD", "befristet"])]
PLACES = [(10, "Taußibach", "Niederfurt", "NF", "Germany", ["TUH"]), (11, "Rocheneuve", "Haute-Lorne", "HL", "France", []), (12, "Twin", "A", "AA", "Canada", []), (13, "Twin", "B", "BB", "United Kingdom", []), (14, "Narujima", "K", "KM", "Japan", ["鳴島"]), (15, "Ostrasport", "W", "WM", "Canada", []), (16, "Ostlasport", "W", "WM", "Canada", [])]


@pytest.fixture(scope="module")
def employment(spark):
    return C.employment_dictionary(spark.createDataFrame(EMPLOYMENT, "ref_id long, label string, aliases array<string>"))


@pytest.fixture(scope="module")
def places(spark):
    return C.location_dictionary(spark.createDataFrame(PLACES, "ref_id long, city string, region string, region_code string, country string, aliases array<string>"))


@pytest.mark.parametrize(("value", "ref"), [("FULL_TIME", 1), ("FullTime", 1), ("Fulll-time", 1), ("Flul-time", 1), ("F/T", 1), ("Regular / 实习", 3), ("实习生", 3), ("fixed term contract", 6), ("Contractors", 4), ("Ｃｏｎｔｒａｃｔ", 4), ("Pflichtpraktikum", 3), ("Hybrid", 0), ("TBC", 0), ("???", 0), ("temps plien", 1)])
def test_employment(employment, value, ref):
    assert C.match_window(value, employment)[0][0] == ref


@pytest.mark.parametrize(
    ("value", "ref"),
    [("TAUSSIBACH, NF, Germany", 10), ("Tausibach", 10), ("Taßuibach", 10), ("Remote - Taußibach", 10), ("TUH office", 10), ("Rocheneuve-les-Pins", 0), ("Greater Rocheneuve Area", 11), ("Twin, U.K.", 13), ("Canada - Twin", 12), ("鳴島（リモート可）", 14), ("Ostlasport", 16), ("Ostrasporf", 15), ("Anywhere", 0), ("5 offices", 0), ("x" * 20_000, 0)],
)
def test_places(places, value, ref):
    assert C.match_segment(value, places)[0][0] == ref


def test_near_equals_brute_force():
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 13))) for _ in range(120)})
    d = C.Dictionary([(n, i + 1) for i, n in enumerate(names)])
    for _ in range(400):
        key = "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 13)))
        got = {k for _, k in d.near(key)}
        if key in d.exact:
            assert got == {key}
            continue
        depth = C.bound(len(key) + 1)
        expected = {k for k in d.exact if depth and C.weighted_distance(key, k)[0] <= min(C.bound(len(k)), depth)}
        assert got == expected


def test_lookups_equal_scans_of_the_list():
    rnd = random.Random(4)
    cjk = sorted({"".join(rnd.choice("鳴島東京北") for _ in range(rnd.randint(1, 4))) for _ in range(40)})
    d = C.Dictionary([(n, i + 1) for i, n in enumerate([*cjk, *("".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 9))) for _ in range(60))])])
    for _ in range(300):
        text = "".join(rnd.choice("鳴島東京北ab") for _ in range(rnd.randint(0, 9)))
        inside = [k for k in d.exact if C._CJK.search(k) and k in text]
        assert [len(k) for k in d.inside(text)] == [max(map(len, inside), default=0)] * bool(inside) and set(d.inside(text)) <= set(inside)
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14)))
        assert d.ends(word) == {k for k in d.exact if len(k) >= 6 and len(k) <= len(word) <= len(k) + 8 and (word.endswith(k) or word.startswith(k))}


def test_long_names_and_long_values(employment):
    d = C.Dictionary([("one two three four five six seven", 9)])
    assert C.match_window("we say One two three-four five sixx seven today", d)[0] == [9]
    rnd = random.Random(1)
    assert C.match_window(" ".join("".join(rnd.choice("abcdefgh") for _ in range(300)) for _ in range(50)), employment)[0] == [0]


def test_frequency_settles_ties_once(spark):
    d = C.Dictionary([("Alphaville", 1), ("Alphavilla", 2)])
    rows = [("f", k, "Alphavilla") for k in range(5)] + [("f", 9, "Alphaville"), ("f", 10, "Alphavill")]
    got = {r.row_id: r.ref_id for r in C.resolve(spark.createDataFrame(rows, "field string, row_id long, value string"), d, "segment").collect()}
    assert got[10] == 2 and got[9] == 1


def test_shuffled_deletes_equal_the_broadcast(spark):
    rnd = random.Random(7)
    names = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(4, 13))).title() for _ in range(150)} | {"鳴島", "東京都", "東京"})
    rows = [(i + 1, n, ["Land" + "XYZ"[i % 3]]) for i, n in enumerate(names)]
    values = [rnd.choice(names) for _ in range(40)]
    for _ in range(120):
        n = rnd.choice(names)
        k = rnd.randrange(len(n))
        values.append(rnd.choice([n[:k] + n[k + 1 :], n[:k] + rnd.choice("abcde") + n[k:], f"Remote - {n}, Land{rnd.choice('XYZ')}", f"{n} 東京都内", "nothing"]))
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate([*values, None, " "])], "field string, row_id long, value string")
    d = C.Dictionary([(n, i) for i, n, _ in rows], {i: {k for x in c for k in C.keys_of(x)} for i, _, c in rows})
    table = spark.createDataFrame(rows, "ref_id long, name string, context array<string>")
    one, two = ({r.row_id: r.ref_id for r in x.collect()} for x in (C.resolve(df, d, "segment"), C.resolve_large(df, table)))
    differ = {k: (values[k], one[k], two[k]) for k in one if one[k] != two.get(k)}
    assert len(one) == len(two) == len(values) and not differ


def test_weights_prefer_swaps_and_doubles():
    assert C.weighted_distance("abcd", "abdc") == (1, 0.7) and C.weighted_distance("abbcd", "abcd") == (1, 0.6)
    assert C.weighted_distance("", "abc") == (3, 3.0)


def test_rows(spark, employment):
    values = spark.createDataFrame([("f", 1, "FT", 0), ("f", 1, "FT", 0), ("f", 2, None, 0), ("f", 3, "  ", 0), ("f", 4, "nothing", 0)], "field string, row_id long, value string, ref_id int")
    got = sorted((r.row_id, r.ref_id) for r in C.resolve(values.select("field", "row_id", "value"), employment, "window").collect())
    assert got == [(1, 1), (1, 1), (4, 0)]


def test_empty_list(spark):
    empty = C.employment_dictionary(spark.createDataFrame([], "ref_id long, label string, aliases array<string>"))
    assert C.match_window("Full-time", empty)[0] == [0]
