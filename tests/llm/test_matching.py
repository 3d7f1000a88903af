import random

from tideglass.llm import matching as M

PLACES = [(10, "Bern", "A", "AA", "Swiss", []), (11, "Oslo", "B", "BB", "Norway", [])]
ITEMS = "ord long, source string, title string, company string, location string, job_id string, url string, score int"


def places(spark):
    return spark.createDataFrame(PLACES, "ref_id long, city string, region string, region_code string, country string, aliases array<string>")


def items(spark, rows):
    return spark.createDataFrame([(o, s, t, c, p, j, u, 0) for o, s, t, c, p, j, u in rows], ITEMS)


def test_fields():
    assert M.title_words("Now hiring: Sr. Data Eng. - Project Iron Fox (Req 12345678) *urgent*") == ["senior", "data", "engineer", "iron", "fox"]
    assert sorted(M.title_words("Iron Fox – Senior Data Engineer [f/m/x]")) == ["data", "engineer", "fox", "iron", "senior"]
    assert {M.company_word(x) for x in ("The Acmequist Foods Group", "ACMEQUIST Foo.", "Acmequist-Foods KK", "Acmequist Foods – EMEA", "Acmequist | Hiring")} == {"acmequist"}
    assert M.number_of("REQ-1234-5678", None) == "12345678" and M.number_of("b12345", "x (#7654321)") == "7654321" and M.number_of(None, None) is None
    assert M.company_name("The Acmequist Foods Group") == M.company_name("Acmequist-Foods KK") == "acmequist foods" and M.company_name("Group") == "group" and M.company_name(None) == ""


def test_blocks_find_all_close_vectors():
    rnd = random.Random(2)
    for _ in range(300):
        t, c = rnd.getrandbits(M.TITLE_BITS), rnd.getrandbits(M.COMPANY_BITS)
        t2, c2 = t, c
        for _ in range(rnd.randint(0, M.TITLE_BLOCKS - 1)):
            t2 ^= 1 << rnd.randrange(M.TITLE_BITS)
        for _ in range(rnd.randint(0, M.COMPANY_BLOCKS - 1)):
            c2 ^= 1 << rnd.randrange(M.COMPANY_BITS)
        assert set(M.table_keys(t, c, 5)) & set(M.table_keys(t2, c2, 5))
        assert not set(M.table_keys(t, c, 5)) & set(M.table_keys(t, c, 6))


def test_match(spark):
    rows = [
        (1, "a", "Data Engineer, Iron Fox", "Acme Foods", "Bern, Swiss", "11111111", "u"), (2, "b", "Data Enginer, Iron Fox", "ACME Foods Ltd", "Remote - Bern", "1111-1111", "u"), (3, "b", "Data Enginer, Iron Fox", "ACME Foods Ltd", "Remote - Bern", "1111-1111", "u"),
        (4, "c", "Data Engineer, Iron Fox", "Acme Foods", "Oslo", "22222222", "u"), (5, "a", "Data Engineer, Iron Fox", "Acme Foods", "Bern", "11111111", "u"), (6, "d", "Data Engineer, Iron Fox", "Acme", None, "R-11111111", "u"),
        (7, "d", None, None, None, None, None), (8, None, "", "", "", "", ""), (9, "e", "Data Engineer, Iron Fox", "Acme Foods", "Bern", "33333333", "u"), (10, "f", "Data Engineer, Iron Fox", None, "Bern", "11111111", "u"),
    ]
    got = {(r.ord_a, r.ord_b): r for r in M.match(items(spark, rows), places(spark)).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 5), (3, 5), (1, 6), (2, 6), (3, 6), (5, 6), (1, 10), (2, 10), (3, 10), (5, 10), (6, 10)}
    assert all(0.5 <= r.confidence <= 1 for r in got.values()) and got[1, 2].score <= got[1, 6].score


def openings(n, first=10_000_000):
    return [(2 * k, "a", f"Data Engineer, Iron Fox{k:04d}", "Acme Foods", "Bern", str(first + k), "u") for k in range(n)] + [(2 * k + 1, "b", f"Data Engineer, Iron Fox{k:04d}", "Acme Foods", "Bern", str(first + k), "u") for k in range(n)]


def test_companies_of_one_first_word(spark):
    rows = [(1001, "c", "Clerk", "Northern Analytics", "Bern", None, None), (1002, "d", "Clerk", "Northern Foods", "Bern", None, None), (1003, "e", "Clerk", "Northern Analytisc AG", "Bern", None, None)]
    assert {(r.ord_a, r.ord_b) for r in M.match(items(spark, [*openings(30), *rows]), places(spark)).collect() if r.ord_b > 1000} == {(1001, 1003)}


def test_many_records_without_number(spark):
    rows = [(10_000 + k, f"s{k // 4}", ["Cook", "Gardener", "Violinist", "Plumber"][k % 4], "Acme Foods", "Bern", None, None) for k in range(600)]
    df = items(spark, [*openings(30), *rows])
    heads, _ = M.records(df, places(spark))
    profiles = heads.groupBy("vec", *M.PROFILE).agg(M.F.max(M.F.col("number").isNull()).alias("is_open"))
    assert M.open_pairs(profiles).count() < 100  # of profiles, whatever the number of records
    assert M.match(df, places(spark)).where("ord_a >= 10000").count() == 4 * 150 * 149 // 2


def test_large_group_loses_no_pair(spark):
    n = 300
    rows = [(k, "a", "Data Engineer", "Acme", "Bern", str(10_000_000 + k), None) for k in range(n)] + [(n + k, "b", "Data Engineer", "Acme", "Bern", str(10_000_000 + k), None) for k in range(n)]
    # look-alikes of which one in a hundred agrees are no evidence for a row without number
    rows += [(5000, "a", "Data Engineer", "Acme", None, "10000003", None), (5001, "c", "Data Engineer", "Acme", "Bern", None, None)]
    assert {(r.ord_a, r.ord_b) for r in M.match(items(spark, rows), places(spark)).collect()} == {(k, n + k) for k in range(n)} | {(n + 3, 5000)}


def test_calibration_counts_all_pairs(spark):
    n = 300
    rows = [(k, "ab"[k % 2], "Data Engineer", "Acme", "Bern", str(10_000_000 + k // 3), None) for k in range(n)] + [(n + k, "bc"[k % 2], "Data Enginer", "Acme", "Bern", str(10_000_000 + k), None) for k in range(20)]
    heads, _ = M.records(items(spark, [*rows, (999, "d", "Data Engineer", "Acme", "Bern", None, None)]), places(spark))
    vecs = heads.select("vec").distinct()
    pairs = M.scored(vecs.select(M.F.col("vec").alias("a")).join(vecs.select(M.F.col("vec").alias("b")), M.F.expr("a <= b")), heads, "vec")
    got = sorted((r.n, r.k) for r in M.counted(pairs, heads).collect())
    groups, want = {}, []
    for r in heads.where("number is not null").collect():
        groups.setdefault(r.vec, []).append((r.source, r.number))
    for v, w in [(x, y) for x in groups for y in groups if x <= y]:
        both = [(p, q) for p in groups[v] for q in groups[w] if p[0] != q[0]]
        want.append((len(both) // (1 + (v == w)), sum(p[1] == q[1] for p, q in both) // (1 + (v == w))))
    assert got == sorted(want) and max(got)[0] > 5_000
    table = M.reliability_table(items(spark, openings(30) + [(999, "d", "Data Engineer, Iron Fox0001", "Acme Foods", "Bern", None, None)]), places(spark)).collect()
    assert len(table) == 2 * M.BINS and [(r.n_pairs, r.n_agreeing) for r in table if r.same_words and r.from_score == 0.975 and r.n_agreeing] and sum(r.n_agreeing for r in table) == 1


def test_nothing_goes_through_the_driver(spark, tmp_path):
    items(spark, [*openings(30), (999, "d", "Data Engineer, Iron Fox0001", "Acme Foods", "Bern", None, None)]).write.parquet(f"{tmp_path}/items")
    df = spark.read.parquet(f"{tmp_path}/items")  # a file, so that its size is known
    heads, _ = M.records(df, places(spark))
    profiles = heads.groupBy("vec", *M.PROFILE).agg(M.F.max(M.F.col("number").isNull()).alias("is_open"))
    pairs = M.scored(M.open_pairs(profiles), heads, "vec")
    for made in (M.match(df, places(spark)), pairs, M.counted(pairs, heads)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()  # whatever their estimated sizes


def test_open_pairs_are_those_of_the_keys(spark):
    rnd, rows = random.Random(5), []
    for k in range(400):
        t, c = rnd.choice([0, 3, 1 << 127, (1 << 128) - 1]), rnd.choice([0, 5, 1 << 63])
        for _ in range(rnd.randint(0, 6)):
            t ^= 1 << rnd.randrange(M.TITLE_BITS)
        for _ in range(rnd.randint(0, 5)):
            c ^= 1 << rnd.randrange(M.COMPANY_BITS)
        rows.append((k, M.signed(t), M.signed(t >> 64), M.signed(c), "", "", rnd.choice([0, 10, 10, 11]), rnd.random() < 0.3, set(M.table_keys(t, c, 0)), set(M.wide_keys(t, c))))
    near = lambda x, y: (x[6] == y[6] > 0 and x[8] & y[8]) or (0 in (x[6], y[6]) and x[9] & y[9])
    want = sorted((x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if (x[7] or y[7]) and near(x, y)) + [(x[0], x[0]) for x in rows if x[7]]
    profiles = spark.createDataFrame([x[:8] for x in rows], "vec long, t_low long, t_high long, c long, words string, name string, place int, is_open boolean")
    got = [(r.a, r.b) for r in M.open_pairs(profiles).collect()]
    assert sorted(got) == sorted(want) and len(want) > 1000


def test_empty(spark):
    assert M.match(items(spark, [(1, "a", "t", "c", "p", "j", "u")]).limit(0), places(spark)).count() == 0
