import random

from pyspark.sql import functions as F

from tideglass.llm import history as H

SCHEMA = "seen_id long, key string, title string, url string, source string, first_seen string"


def rows(spark, *items):
    return spark.createDataFrame([(i, f"k{i}", t, u, "s", "2026-01-01") for i, t, u in items], SCHEMA)


def slugs(spark, *items):
    return rows(spark, *[(i, "t", f"https://x.example/roles/{s}") for i, s in items])


def pairs(df):
    return sorted((r.accepted_id, r.seen_id) for r in df.collect())


def brute(history, batches, towns=frozenset()):
    """Row after row against all identities before it."""
    known, out = {}, []
    for i, url in history:
        known.setdefault(H.identity(url, "s", "k", "t")[0] + " " + " ".join(H.identity(url, "s", "k", "t")[1]), (i, i, *H.identity(url, "s", "k", "t")))
    for i, url in sorted(batches):
        scope, words = H.identity(url, "s", "k", "t")
        key = scope + " " + " ".join(words)
        if key not in known:
            near = [(bits, first, label) for first, label, sc, ws in known.values() if sc == scope and scope.endswith("/") and (bits := H.verified(" ".join(ws), " ".join(words), towns)) is not None]
            known[key] = (i, min(near)[2] if near else i, scope, words)
        if known[key][1] < i:
            out.append((known[key][1], i))
    return sorted(out)


def test_identity():
    base = ["x.example#", ["12345678"]]
    for url in ("https://x.example/jobs/12345678", "http://WWW.X.example:443/posting?jobId=0012345678&spm=1", "https://x.example/careers/some-title-JR12345678#apply", "https://x.example/%6Aobs/12345678/"):
        assert list(H.identity(url, "s", "k", "t")) == base
    words = H.identity("https://x.example/roles/lead-quant-developer-lunar-badger-chenghu", "s", "k", "t")
    assert H.identity("https://x.example/job-board/LEAD_QUANT_DEVELOPER_LUNAR_BADGER_CHENGHU-m-f-d?utm_x=1", "s", "k", "t") == words
    assert H.identity("https://x.example/open/open-role-lead-quant-developer-lunar-badger-chenghu-reposted", "s", "k", "t") == words
    assert H.identity(None, "s", "k", None) == ("key:s", ["k"]) == H.identity("  ", "s", "k", "t")


def test_finer_keys_meet_within_one_edit():
    rnd = random.Random(1)
    for _ in range(400):
        text = "".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 3, 8, 33, 34, 35, 36, 37, 90])))
        k = rnd.randrange(len(text))
        for other in (text[:k] + "x" + text[k:], text[:k] + text[k + 1 :], text[:k] + "x" + text[k + 1 :], text[:k] + text[k : k + 2][::-1] + text[k + 2 :]):
            assert H.finer(text) & H.finer(other)
    assert len(H.finer("a" * 5_000)) == 2


HISTORY = [(1, "A", "https://x.example/jobs/12345678"), (2, "B", "https://x.example/roles/lead-quant-developer-lunar-badger-chenghu"), (3, "B", "https://x.example/roles/lead-quant-developer-lunar-badger-mingxi"), (4, "C", "https://x.example/roles/sales-engineer-iron-finch-ostrasport"), (5, "C", "https://x.example/roles/sales-engineer-iron-finch-ostlasport")]
BATCH = [
    (11, "A!", "https://x.example/posting?jobId=12345678"), (12, "A", "https://x.example/jobs/12345679"), (13, "B", "https://x.example/open/lead-quant-developper-lunar-badger-chenghu"), (14, "B", "https://x.example/roles/lead-quantdeveloper-lunar-badger-mingxi"),
    (15, "N", "https://x.example/roles/ux-researcher-calm-comet-asajima"), (16, "N", "https://x.example/roles/ux-researcher-calm-comte-asajima"), (17, "A", "https://y.example/jobs/12345678"), (18, "C", "https://x.example/roles/sales-engineer-iron-finch-ostrasport"), (19, "A", "https://x.example/jobs/12345679"),
]
FOUND = [(1, 11), (2, 13), (3, 14), (4, 18), (12, 19), (15, 16)]


def test_found_and_any_cut_into_batches(spark, tmp_path):
    places = spark.createDataFrame([("Ostrasport",), ("Ostlasport",), (None,)], "city string")
    batches = rows(spark, *BATCH).withColumn("batch_no", F.when(F.col("seen_id") < 16, F.lit(1)))
    assert pairs(H.found(rows(spark, *HISTORY), rows(spark, *BATCH), places)) == FOUND == pairs(H.found(rows(spark, *HISTORY), batches, places))
    path, got = str(tmp_path / "store"), []
    H.Store(spark, path, places).accept(rows(spark, *HISTORY))
    for part in (BATCH[:4], [], BATCH[4:5], BATCH[5:]):
        got += pairs(H.Store(spark, path, places).check(rows(spark, *part)))  # opened again each time
    assert sorted(got) == FOUND == pairs(H.Store(spark, path, places).links())


def test_accepted_rows_keep_their_labels(spark, tmp_path):
    base = "lead-quant-developer-lunar-"
    store = H.Store(spark, str(tmp_path / "store"))
    store.accept(slugs(spark, (1, base + "abcdefgh"), (2, base + "abcdezzh")))
    assert pairs(store.check(slugs(spark, (11, base + "abcdezgh"), (12, base + "abcdezzh")))) in ([(1, 11), (2, 12)], [(2, 11), (2, 12)])


def test_later_rows_change_nothing(spark):
    base = "lead-quant-developer-lunar-"
    history, batch = [(1, base + "crane")], [(11, base + "crate")]
    later = [(20 + k, f"other-role-number{k}-crate-oslo") for k in range(12)] + [(40 + k, f"other-role-number{k}-crane-oslo") for k in range(12)]
    assert (1, 11) in pairs(H.found(slugs(spark, *history), slugs(spark, *batch, *later)))


def test_short_identities(spark):
    assert pairs(H.found(slugs(spark, (1, "data-analyst"), (2, "nurse-berlin")), slugs(spark, (11, "data-analist"), (12, "nurseberlin"), (13, "nurse-berlln"), (14, "nurse-bonn")))) == [(1, 11), (2, 12), (2, 13)]


def test_store_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "GROUP", 4)
    monkeypatch.setattr(H, "ROWS_A_PART", 200)
    rnd = random.Random(5)
    words = ["red", "crane", "iron", "quill", "lamp", "oak", "delta", "fox"]

    def fresh():
        return "-".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 3, 4]))) + f"-town{rnd.randint(0, 9)}x{rnd.randint(0, 9)}"

    def typed(s):
        k = rnd.randrange(len(s))
        return rnd.choice([s[:k] + rnd.choice("abcdefghij") + s[k + 1 :], s[:k] + s[k + 1 :], s[:k] + "q" + s[k:]])

    texts = [fresh() for _ in range(60)]
    for _ in range(240):
        texts.append(rnd.choice([fresh(), typed(rnd.choice(texts)), rnd.choice(texts)]))
    items = [(i, f"https://x.example/roles/{s}") for i, s in enumerate(texts, 1)]
    as_rows = lambda part: rows(spark, *[(i, "t", u) for i, u in part])
    store, got = H.Store(spark, str(tmp_path / "store")), []
    store.accept(as_rows(items[:60]))
    for a, b in ((60, 160), (160, 170), (170, 300)):
        got += pairs(store.check(as_rows(items[a:b])))
    assert store.buckets > 1
    want = brute(items[:60], items[60:])
    assert sorted(got) == want and len(want) > 60
    assert pairs(H.found(as_rows(items[:60]), as_rows(items[60:]))) == want


def test_reading_is_bound_to_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "ROWS_A_PART", 500)
    read = []
    for n in (200, 2_000):
        store = H.Store(spark, str(tmp_path / f"store{n}"))
        store.accept(slugs(spark, *[(k, f"some-role-number{k}-word{k % 97}-town") for k in range(n)]))
        keys = H.fingerprints(spark.createDataFrame([(1, "x.example/", "some role number5 word5 twon")], "first_id long, scope string, words string"))
        read.append(store._read(1, keys).count())
    assert read[1] < 4 * read[0]


def test_empty(spark):
    none = rows(spark, (1, "a", "u")).limit(0)
    assert H.found(none, none).count() == 0
    assert pairs(H.found(none, rows(spark, *BATCH))) == [(12, 19), (15, 16)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None), (2, None, None, None, None, None), (None, "k", "t", "u", "s", "f"), (3, "k", "x" * 5000, "http://[bad", "s", "f"), (4, "k", "x" * 5000, "http://a.example/jobs", "s", "f"), (5, "k", "x" * 4999, "http://a.example/jobs", "s", "f")], SCHEMA)
    assert pairs(H.found(df.limit(0), df)) == [(1, 2), (4, 5)]
