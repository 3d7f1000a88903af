import os
import random

import pytest

from tideglass.llm import encoding as E
from tideglass.llm import mixing as X

PATH = f"{E.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
ODD = ["", " ", "\n\n\n", "<|endoftext|> is text", "a" * 5000, "中文没有空格" * 300, "é́​\x00\x1c x\x85y", "  lead and trail  ", "don't I'll", "😀" * 200]


def in_chunks(text, bits):
    out, start = [], 0
    for end in E.cuts(text, bits):
        out.append(text[start:end])
        start = end
    assert "".join(out) == text
    return out


def test_chunks_give_the_same_ids():
    rnd = random.Random(1)
    alphabet = "ab 'st\n\t\xa0　中กé😀<|>1.,\x1c\x85​"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(400)]
    for text, ids in zip(texts, E.encode_plain(texts), strict=True):
        assert E.assemble([E.encode_parts(in_chunks(text, 3), PATH)], PATH)[0] == ids


def test_cuts_depend_on_the_content_only():
    rnd = random.Random(2)
    common = "".join(rnd.choice("abcdefgh ij") for _ in range(3000))
    a, b = set(in_chunks("x" * 40 + common, 6)), set(in_chunks("yy" * 33 + common, 6))
    assert len(a & b) > 0.8 * min(len(a), len(b))


def test_encode_rows(spark):
    texts = [*ODD, None, "shared passage " * 40, "shared passage " * 40 + "end", ODD[4]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string").drop("chunk")
    got = {r.doc_id: list(r.ids) for r in E.encode(df).collect()}
    assert got == dict(enumerate(E.encode_plain(texts)))
    assert E.encode(df.limit(0)).count() == 0


def test_water_filling():
    got = X.water_fill(100, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 20, "b": 1000, "c": 1000})
    assert got == pytest.approx({"a": 20, "b": 48, "c": 32})
    assert X.water_fill(100, {"a": 1.0}, {"a": 7}) == {"a": 7}
    assert X.water_fill(100, {"a": 0.5, "b": 0.5}, {"a": 0, "b": 500}) == {"a": 0, "b": 100}
    assert X.water_fill(0, {}, {}) == {}


def test_mixture(spark):
    docs = [(i, "big", "one two three four five six seven eight") for i in range(3000)] + [(10_000 + i, "small", "one two three four") for i in range(50)] + [(20_000, None, "lost words"), (20_001, "other", "lost words"), (20_002, "small", None)]
    targets = [("big", 0.8, 1), ("small", 0.15, 3), ("gone", 0.05, 2), (None, 0.1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame(targets, "source string, weight double, max_repeats int")
    chosen, report = X.select(d, t)
    rows = chosen.collect()
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "small", "gone"} and got["gone"].actual_tokens == 0 and got["gone"].falls_short
    assert max(r.n_copies for r in rows if r.source == "big") == 1 and {r.n_copies for r in rows if r.source == "small"} == {3}
    assert got["small"].falls_short and got["big"].actual_tokens == sum(r.tokens * r.n_copies for r in rows if r.source == "big")
    assert sum(r.share for r in got.values()) == pytest.approx(1, abs=1e-5)
    again = sorted((r.doc_id, r.n_copies) for r in X.select(d, t)[0].collect())
    assert again == sorted((r.doc_id, r.n_copies) for r in rows)


def test_fraction_is_met_closely(spark):
    docs = [(i, "a" if i % 2 else "b", "word " * (1 + i % 7)) for i in range(4000)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.7, 5), ("b", 0.3, 5)], "source string, weight double, max_repeats int")
    chosen, report = X.select(d, t)
    for r in report.collect():
        assert abs(r.actual_tokens - r.target_tokens) <= 8
    assert {r.n_copies for r in chosen.where("source = 'a'").collect()} == {1, 2}


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    chosen, report = X.select(d, t)
    assert chosen.count() == 0 and report.collect()[0].share == 0
    assert X.select(d, t.limit(0))[1].count() == 0
