import datetime as dt

import pytest

from tideglass.operators import moments as M

S = 10**6


def us(*parts: int) -> int:
    return int((dt.datetime(*parts) - dt.datetime(1970, 1, 1)).total_seconds() * S)


@pytest.mark.parametrize(
    ("value", "zone", "expected"),
    [
        ("2025-08-05T09:54:02Z", None, us(2025, 8, 5, 9, 54, 2)),
        ("2026-09-27 09:01:28 PDT", None, us(2026, 9, 27, 16, 1, 28)),
        ("2025-12-09 15:49:17 America/Sao_Paulo", None, us(2025, 12, 9, 18, 49, 17)),
        ("2024-10-01T02:05:40+00:00[UTC]", "Asia/Tokyo", us(2024, 10, 1, 2, 5, 40)),
        ("31. Mai 2025, 08:41 Uhr", "Europe/Berlin", us(2025, 5, 31, 6, 41)),
        ("2nd December 2026 at 4:21 p.m.", "UTC", us(2026, 12, 2, 16, 21)),
        ("August 13, 2024 12:17 a.m.", "UTC", us(2024, 8, 13, 0, 17)),
        ("2026年9月16日", "Asia/Tokyo", us(2026, 9, 15, 15)),
        ("２０２６-０８-２９T０１:３６:２５.０９３+１０:００", None, us(2026, 8, 28, 15, 36, 25) + 93000),
        ("1713203259314", None, 1713203259314 * 1000),
        ("1738330297", None, 1738330297 * S),
        ("20240812", "UTC", us(2024, 8, 12)),
        ("2024-10-27 02:30:00", "Europe/Berlin", us(2024, 10, 27, 0, 30)),  # twice: the first
        ("2025-03-30 02:30:00", "Europe/Berlin", us(2025, 3, 30, 1, 30)),  # skipped: moved on
        ("2024-01-05T02:54:13,935896789Z", None, us(2024, 1, 5, 2, 54, 13) + 935896),
        ("2026-06-15 13:04:31 -0330", None, us(2026, 6, 15, 16, 34, 31)),
    ],
)
def test_single_readings(value, zone, expected):
    assert M.read_value(value, zone)[1] == expected


@pytest.mark.parametrize("value", [None, "", "  ", "n/a", "soon", "2025-02-30", "31/31/2025", "2026-13-01T10:00:00Z", "20251345", "0000-00-00", "2025-01-01 25:00", "until filled", "12", "x" * 10_000, "9" * 10_000])
def test_no_moment(value):
    assert M.read_value(value, "UTC") == (None, None, None)


def test_two_readings():
    family, day_first, month_first = M.read_value("03/04/2025", "UTC")
    assert (family, day_first, month_first) == ("slash", us(2025, 4, 3), us(2025, 3, 4))
    assert M.read_value("17/04/2025", "UTC")[1:] == (us(2025, 4, 17), None)


def test_mixture_chooses_by_source_and_notation(spark):
    rows = [("f", i, "a", f"{13 + i % 10}/05/2025") for i in range(20)] + [("f", 100, "a", "03/04/2025")]
    rows += [("f", 200 + i, "b", f"05/{13 + i % 10}/2025") for i in range(20)] + [("f", 300, "b", "03/04/2025")]
    rows += [("f", 400, "nowhere", "03/04/2025"), ("f", 401, None, "2025-01-01"), ("f", 402, "a", None)]
    values = spark.createDataFrame(rows, "field string, row_id long, source string, value string")
    sources = spark.createDataFrame([("a", None, None), ("b", "Asia/Tokyo", "mdy")], "name string, zone string, date_order string")
    out = {r.row_id: r for r in M.resolve(values, sources).collect()}
    assert out[100].utc_us == us(2025, 4, 3) and out[100].status == "chosen"
    assert out[300].utc_us == us(2025, 3, 3, 15) and out[300].status == "chosen"
    assert out[400].status == "unresolved" and out[401].status == "single" and 402 not in out


def test_empty_tables(spark):
    values = spark.createDataFrame([], "field string, row_id long, source string, value string")
    sources = spark.createDataFrame([], "name string, zone string, date_order string")
    assert M.resolve(values, sources).count() == 0


def test_extra_columns_do_not_clash(spark):
    items = spark.createDataFrame([(1, "a", "2025-01-01", None, "x", "y", 1)], "ord long, source string, published string, expires string, zone string, field string, value int")
    checks = spark.createDataFrame([(1, "a", "2025-01-02", "z")], "verification_id long, source string, checked_at string, family string")
    sources = spark.createDataFrame([("a", "UTC", "dmy", 3)], "name string, zone string, date_order string, row_id int")
    assert M.resolve(M.workspace_values(items, checks), sources).count() == 2


def test_share_at_rest_with_many_ambiguous_values(spark):
    from pyspark.sql import functions as F

    counts = spark.createDataFrame([(1_000.0, 0.0, 1_000_000.0, 0.5)], "a double, b double, e double, p double")
    got = counts.select(M.mixture(F.col("a"), F.col("b"), F.col("p"), 4.0)).first()[0]
    p = 0.5
    for _ in range(100_000):
        p = (1_000.0 + 1_000_000.0 * p + 0.5 * 4) / (1_000.0 + 1_000_000.0 + 4)
    assert abs(got - p) < 1e-9 and got > 0.99
