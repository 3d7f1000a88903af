import pytest
from pyspark.sql import functions as F

from tideglass.operators import handoff as H


def test_dispositions_and_counters(spark):
    d = spark.createDataFrame([("b", 2, "x", "excluded"), ("b", 1, "x", "queued"), ("b", 3, "y", "duplicate"), ("c", 1, "x", None)], "batch string, ord int, id string, disposition string")
    got = {r.batch: tuple(r)[1:] for r in H.disposition_counts(d).collect()}
    assert got == {"b": (1, 0, 0, 1, 2), "c": (0, 0, 0, 0, 1)}
    rows = spark.createDataFrame([("a", 5), ("a", 1), ("b", 1), ("c", 9), (None, 9)], "key string, score int")
    assert tuple(H.counters(rows, "key", F.col("score") > 3, rows.where("key = 'c'")).first()) == (5, 4, 3, 2)
    assert tuple(H.counters(rows.limit(0), "key", F.col("score") > 3, rows).first()) == (0, 0, 0, 0)


def test_summary_and_baseline(spark):
    schema = "category string, submitted string, target string, remaining string"
    good = [("a", "3", "5", "2"), ("b", "1", "4", "3"), ("all", "4", "9", "5")]
    assert H.summary_violations(spark.createDataFrame(good, schema), ["a", "b"], {"all": ["a", "b"]}).count() == 0
    bad = [("a", "3", "5", "1"), ("a", "x", "—", "—"), ("z", "1", "2", "—"), ("all", "4", "8", "4")]
    got = {(r.category, r.rule) for r in H.summary_violations(spark.createDataFrame(bad, schema), ["a", "b"], {"all": ["a", "b"]}).collect()}
    assert got == {("a", "remaining is not target less submitted"), ("a", "submitted is no number"), ("a", "several rows"), ("b", "missing"), ("z", "unknown category"), ("z", "numeric remaining required"), ("all", "target totals conflict")}
    counts = lambda *xs: spark.createDataFrame(xs, "category string, n long")
    assert H.baseline_violations(counts(("a", 3), ("b", 2)), counts(("a", 3), ("b", 1)), 1, 5).count() == 0
    assert {r.rule for r in H.baseline_violations(counts(("a", 3)), counts(("a", 4)), 1, 5).collect()} == {"more rows than stored", "sum is not the number of rows", "rest is not what is unclassified"}


def test_handoff(spark):
    c = spark.createDataFrame([("R-1", "queued"), ("R-2", "duplicate"), ("R-3", "odd"), ("R-1", "queued"), ("R-4", "queued")], "id string, disposition string")
    sinks = spark.createDataFrame([("queue", "see R-1, not R-44"), ("history", "R-2x")], "sink string, text string")
    got = {(r.id, r.rule) for r in H.handoff_violations(c, sinks, {"queued": 2, "duplicate": 1}, "b").collect()}
    assert got == {("R-3", "unknown disposition"), ("R-1", "several dispositions"), ("R-4", "not in queue"), ("R-2", "not in history")}
    assert {r.rule for r in H.handoff_violations(c.where("id = 'R-1'"), sinks, {}, "b").collect()} == {"several dispositions", "counts differ from the note"}
    names = spark.createDataFrame([("Acme",), ("Beta",)], "company string")
    assert [r.company for r in H.unnamed(names, "company", "only ACME here").collect()] == ["Beta"]


def test_owned_pending_coverage_details(spark):
    reg = spark.createDataFrame([("k1", "u1"), ("k2", "u2"), ("k3", "u3")], "key string, url string")
    live = spark.createDataFrame([("k1", "u1"), ("k2", "ux"), ("k9", "u9")], "key string, url string")
    assert [[r.key for r in x.collect()] for x in H.owned(reg, live, "key", "url")] == [["k1"], ["k2"], ["k3"]]
    assert [r.key for r in H.pending(reg, live, "key").collect()] == ["k3"]
    assert {tuple(r) for r in H.coverage(reg, live, "key").collect()} == {("k3", "unexpected"), ("k9", "missing")} and H.coverage(reg, reg, "key").count() == 0
    got = H.with_details(reg, live.select("key", F.col("url").alias("detail")), ["key"], F.col("url") != "u3", [F.col("key").desc()], 1)
    assert {(r.key, r.detail) for r in got.collect()} == {("k1", None), ("k2", "ux"), ("k3", None)}
    assert {tuple(r) for r in H.field_violations(reg, "key", {"is u1": F.col("url") == "u1"}).collect()} == {("k2", "is u1"), ("k3", "is u1")}


def test_append_between(tmp_path):
    text = "head\r\n<!-- s -->\r\nold\r\n<!-- e -->\r\ntail \n"
    assert H.append_between(text, ["new\nline"], "<!-- s -->", "<!-- e -->") == "head\r\n<!-- s -->\r\nold\r\n\r\nnew\r\nline\r\n<!-- e -->\r\ntail \n"
    assert H.append_between(text, [], "<!-- s -->", "<!-- e -->") == text
    with pytest.raises(ValueError, match="markers"):
        H.append_between("x", ["a"], "<!-- s -->", "<!-- e -->")
    path = tmp_path / "note.md"
    path.write_bytes(text.encode())
    assert H.append_to_file(str(path), text, ["a"], "<!-- s -->", "<!-- e -->") == 1
    with pytest.raises(ValueError, match="changed"):
        H.append_to_file(str(path), text, ["a"], "<!-- s -->", "<!-- e -->")
