"""New batches deduplicated against everything accepted before (problem 3).

Method: bit-difference fingerprints in rotated block tables. A row's address and title give its
identity text: the host with the requisition number where the address names one, else the host with
the words of the address's last part (title and town) without decoration. Every word gives one block
of 16 bits; the blocks in order are the fingerprint. A word written otherwise changes the bits of its
block only, so the fingerprint rotated until that block stands last matches exactly in all leading
blocks. Each fingerprint is stored once for every rotation of one block and of two neighbouring ones
(a lost or added word border); where nothing leads (one or two words) the deletes of the rest are its
keys. A new row is looked up by exact match of the leading blocks. Matches are verified by the Hamming
distance of the fingerprints (the differing blocks only) and by the text: at most one edit, and not
two different towns of the given list. Numbers match only exactly.

``Store`` keeps the tables on shared storage, split by a hash of the key. ``accept`` stores history as
it is. ``check`` takes a batch: it reads the parts of the tables that hold keys of the batch, finds for
every new identity the accepted row it repeats, and appends the new fingerprints. An identity takes one
earlier one: an equal one, else that with the fewest differing bits, else the one seen first; what was
accepted never changes its label, and nothing depends on later rows or on how rows are cut into batches.
A key that more than GROUP identities share is hot: from then on its rows are stored and looked up under
finer keys (the deletes of the last block's text, which texts within one edit share), so that a bucket
never grows beyond GROUP and no link is lost. A batch counts once its links are written; a part that was
broken off before is written anew.

Defined cases: a null or blank address falls back to source and key; null ids are no rows; repeated
rows repeat the first; an empty history or batch gives what the other has; the batch null comes last.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from urllib.parse import parse_qsl, unquote, urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tideglass.plans.tables import cut, exists, remove, shared_dir

BLOCK_BITS = 16
GROUP = 64
# The layout of a store: rows that one part of its tables shall hold, and the most parts. Results do not depend on them.
ROWS_A_PART, MOST_PARTS = 500_000, 1024
# Texts of up to SHORT letters have their deletes for finer keys, longer ones their first and last EDGE letters.
SHORT, EDGE = 35, 16

# Path parts and words of an address that do not tell postings apart.
PATH_WORDS = frozenset("jobs job careers career posting postings list apply roles role open en de fr es job-board positions position vacancies openings opening detail details view search p".split())
LEADS = (("open", "role"), ("now", "hiring"), ("job",), ("hiring",), ("new",), ("role",))
TRAILS = (("m", "f", "d"), ("m", "w", "d"), ("f", "m", "x"), ("f", "m", "d"), ("all", "genders"), ("apply", "today"), ("reposted",), ("apply",), ("urgent",), ("hybrid",), ("remote",), ("copy",))
ABBREVIATED = {"sr": "senior", "jr": "junior", "eng": "engineer", "engr": "engineer", "mgr": "manager", "dev": "developer", "admin": "administrator", "spec": "specialist", "tech": "technician"}
_NUMBER = re.compile(r"(?<![0-9])0*(\d{5,})(?![0-9])")


def slug_words(text: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    words = re.findall(r"[a-z0-9]+|[^\W_a-z0-9]+", plain)
    changed = True
    while changed:
        changed = False
        for lead in LEADS:
            if len(words) > len(lead) + 1 and tuple(words[: len(lead)]) == lead:
                words, changed = words[len(lead) :], True
        for trail in TRAILS:
            if len(words) > len(trail) + 1 and tuple(words[-len(trail) :]) == trail:
                words, changed = words[: -len(trail)], True
    return [ABBREVIATED.get(w, w) for w in words]


def identity(url: str | None, source: str | None, key: str | None, title: str | None) -> tuple[str, list[str]]:
    """(scope, words): words is one number, or the words of title and town; equal identities are one posting."""
    if url is None or not url.strip():
        return f"key:{source or ''}", [key or ""]
    try:
        parts = urlsplit(unicodedata.normalize("NFKC", url).strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return f"url:{source or ''}", [url.strip()]
    host = host[4:] if host.startswith("www.") else host
    path = unquote(parts.path)
    values = [v for k, v in parse_qsl(parts.query) if "id" in k.lower() or "job" in k.lower() or "req" in k.lower() or "pos" in k.lower()]
    for text in [*values, path]:
        numbers = _NUMBER.findall(text)
        if numbers:
            return f"{host}#", [numbers[-1] if text is not path or len(numbers) == 1 else numbers[0]]
    segments = [s for s in path.split("/") if s]
    while len(segments) > 1 and segments[-1].lower() in PATH_WORDS:
        segments.pop()
    words = slug_words(segments[-1]) if segments and segments[-1].lower() not in PATH_WORDS else []
    if len(words) < 2:
        words = [*words, *slug_words(title or ""), *sorted(v.lower() for v in values)]
    return f"{host}/", words


def block(word: str) -> int:
    return xxhash.xxh32_intdigest(word) & ((1 << BLOCK_BITS) - 1)


def _hash(text: str | bytes, seed: int = 0) -> int:
    x = xxhash.xxh64_intdigest(text, seed=seed)
    return x - (1 << 64) if x >= 1 << 63 else x


def finer(text: str) -> set[str]:
    """Keys of which texts within one edit (swaps included) share one: the deletes of a short text, the ends of a long one."""
    out = {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))} if len(text) <= SHORT else set()
    if len(text) >= SHORT - 2:
        out |= {"<" + text[:EDGE], ">" + text[-EDGE:]}
    return out


def rotations(scope: str, words: list[str]) -> list[tuple[int, str]]:
    """(key, rest) of the rotated tables: the leading blocks when one block, or two neighbours, stand last, and the text of the last.

    Scopes of numbers, keys and broken addresses have none: they match only exactly.
    """
    if not scope.endswith("/") or not words:
        return []
    blocks, base, out = [block(w) for w in words], xxhash.xxh32_intdigest(scope), {}
    for size in (1, 2):
        for r in range(len(blocks) - size + 1):
            lead, rest = blocks[:r] + [-1] + blocks[r + size :], "".join(words[r : r + size])
            if len(lead) > 1:
                out[_hash(np.array(lead, dtype=np.int32).tobytes(), base)] = rest
            else:
                out.update((_hash(f"only {x}", base), rest) for x in finer(rest))
    return list(out.items())


def hamming(a: list[int], b: list[int]) -> int:
    """Differing bits of two fingerprints; where a word border differs, the common lead and end are set against each other."""
    if len(a) == len(b):
        return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    end = 0
    while end < min(len(a), len(b)) - lead and a[-1 - end] == b[-1 - end]:
        end += 1
    return BLOCK_BITS * (max(len(a), len(b)) - lead - end)


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def verified(a: str, b: str, towns: frozenset[str] = frozenset()) -> int | None:
    """Differing bits of two similar texts; null if they are not: by the bits, by the text, by the towns named."""
    x, y = a.split(" "), b.split(" ")
    bits = hamming([block(w) for w in x], [block(w) for w in y])
    if bits > 2 * BLOCK_BITS or not one_edit("".join(x), "".join(y)):
        return None
    other = [(v, w) for v, w in zip(x, y, strict=False) if v != w]
    return None if len(x) == len(y) and other and other[0][0] in towns and other[0][1] in towns else bits


_IDENTITY = StructType([StructField("scope", StringType()), StructField("words", StringType())])


@pandas_udf(_IDENTITY)
def _identity(url: pd.Series, source: pd.Series, key: pd.Series, title: pd.Series) -> pd.DataFrame:
    rows = [identity(*r) for r in zip(url, source, key, title, strict=True)]
    return pd.DataFrame({"scope": [s for s, _ in rows], "words": [" ".join(w) for _, w in rows]})


@pandas_udf(ArrayType(LongType()))
def _finer(key: pd.Series, rest: pd.Series) -> pd.Series:
    return pd.Series([[_hash(f"{k} {x}") for x in finer(r)] for k, r in zip(key, rest, strict=True)])


def _town_words(column):
    @pandas_udf(ArrayType(StringType()))
    def run(names: pd.Series) -> pd.Series:
        return pd.Series([slug_words(n) if n else [] for n in names])

    return run(column)


def identified(rows: DataFrame) -> DataFrame:
    """(seen_id, url, source, key, title) -> (seen_id, scope, words)."""
    return rows.where("seen_id is not null").select("seen_id", _identity("url", "source", "key", "title").alias("i")).select("seen_id", "i.scope", "i.words")


def fingerprints(representatives: DataFrame) -> DataFrame:
    """(first_id, scope, words) -> (key, rest, first_id, words): the rotated block tables, one row for each rotation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [rotations(s, ws.split(" ") if ws else []) for s, ws in zip(batch["scope"], batch["words"], strict=True)]
            index = np.repeat(np.arange(len(batch)), [len(k) for k in keys])
            yield pd.DataFrame({"key": np.array([x for k in keys for x, _ in k], dtype=np.int64), "rest": [t for k in keys for _, t in k], "first_id": batch["first_id"].to_numpy()[index], "words": batch["words"].to_numpy()[index]})

    return representatives.where(F.col("scope").endswith("/")).mapInPandas(run, "key long, rest string, first_id long, words string")


def _with_towns(pairs: DataFrame, towns: DataFrame | None) -> DataFrame:
    """Pairs (xw, yw) with ``both``: the words of one place in which they differ, where both are towns.

    The list is joined, so it may be of any size; words are compared by their place in texts of equally many words.
    """
    x, y = F.split("xw", " "), F.split("yw", " ")
    differing = F.filter(F.arrays_zip(x.alias("v"), y.alias("w")), lambda p: p["v"] != p["w"])
    pairs = pairs.withColumn("_d", F.when(F.size(x) == F.size(y), F.get(differing, F.lit(0))))
    if towns is None:
        return pairs.withColumn("both", F.lit(False)).drop("_d")
    out = pairs
    for side in ("v", "w"):
        out = out.withColumn(f"_{side}", F.col(f"_d.{side}")).join(towns.select(F.col("town").alias(f"_{side}"), F.lit(True).alias(f"_t{side}")), f"_{side}", "left")
    return out.withColumn("both", F.coalesce(F.col("_tv") & F.col("_tw"), F.lit(False))).drop("_d", "_v", "_w", "_tv", "_tw")


@pandas_udf(IntegerType())
def _bits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([verified(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def best_parents(probe: DataFrame, target: DataFrame, towns: DataFrame | None) -> DataFrame:
    """(first_id, parent, label) of each probing identity with an earlier similar one; label is null where the parent is of the same batch.

    ``probe`` (key, first_id, words), ``target`` (key, first_id, words, accepted_id).
    """
    y = probe.select("key", F.col("first_id").alias("y"), F.col("words").alias("yw"))
    x = target.select("key", F.col("first_id").alias("x"), F.col("words").alias("xw"), F.col("accepted_id").alias("label"))
    text = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    near = F.abs(F.length(text("xw")) - F.length(text("yw"))) <= 1
    met = y.join(x, "key").where((F.col("label").isNotNull() | (F.col("x") < F.col("y"))) & near)
    rated = _with_towns(met.withColumn("bits", _bits("xw", "yw")).where("bits is not null"), towns).where("not both")
    return rated.groupBy(F.col("y").alias("first_id")).agg(F.min(F.struct("bits", "x", "label")).alias("p")).select("first_id", F.col("p.x").alias("parent"), F.col("p.label").alias("label"))


def settle(parents: DataFrame) -> DataFrame:
    """(first_id, accepted_id): each identity's parents followed to the first that was accepted; the rounds grow with the logarithm of the longest chain."""
    label = parents.select("first_id", F.coalesce("label", "parent").alias("accepted_id"), F.col("label").isNotNull().alias("done"))
    while not label.where("not done").isEmpty():
        over = label.select(F.col("first_id").alias("accepted_id"), F.col("accepted_id").alias("over"), F.col("done").alias("over_done"))
        label = cut(label.join(over, "accepted_id", "left").select("first_id", F.when(~F.col("done") & F.col("over").isNotNull(), F.col("over")).otherwise(F.col("accepted_id")).alias("accepted_id"), (F.col("done") | F.col("over").isNull() | F.col("over_done")).alias("done")))
    return label.select("first_id", "accepted_id")


_ROW = ["key", "scope", "words", "first_id", "accepted_id"]


class Store:
    """Identities (kind 0) and rotated block tables (kind 1) on shared storage: one part for each batch, split by a hash of the key."""

    SCHEMA = "key long, scope string, words string, first_id long, accepted_id long, part int, kind int, bucket int"
    LINKS = "accepted_id long, seen_id long"

    def __init__(self, spark, path: str, places: DataFrame | None = None):
        self.spark, self.path = spark, path
        self.towns = None if places is None else cut(places.select(F.explode(_town_words(F.col("city"))).alias("town")).distinct())
        self.parts = self.buckets = 0
        while exists(spark, f"{path}/links/part={self.parts}/_SUCCESS"):
            self.parts += 1
        if self.parts:
            self.buckets = int(spark.read.text(f"{path}/layout").first()[0])

    def _lay_out(self, rows: DataFrame) -> None:
        """The number of buckets, fixed by the first part: so many that one holds about ROWS_A_PART rows."""
        if not self.buckets:
            self.buckets = min(MOST_PARTS, 1 + 10 * rows.count() // ROWS_A_PART)
            self.spark.createDataFrame([(str(self.buckets),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/layout")

    def _bucket(self):
        return F.pmod("key", F.lit(self.buckets)).cast("int")

    def _read(self, kind: int, keys: DataFrame) -> DataFrame:
        """The rows of all parts that count in the buckets of ``keys`` (at most MOST_PARTS numbers are collected)."""
        if not self.parts:
            return self.spark.createDataFrame([], self.SCHEMA).select(*_ROW)
        found = self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.path}/tables").parquet(*[f"{self.path}/tables/part={p}" for p in range(self.parts)]).where(F.col("kind") == kind)
        if self.buckets > 1:
            found = found.where(F.col("bucket").isin([r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]))
        return found.select(*_ROW)

    def _append(self, identities: DataFrame, tables: DataFrame, links: DataFrame) -> None:
        labelled = tables.join(identities.select("first_id", "accepted_id"), "first_id", "left").withColumn("scope", F.lit(None).cast("string"))
        rows = identities.select(*_ROW, F.lit(0).alias("kind")).unionByName(labelled.select(*_ROW, F.lit(1).alias("kind"))).withColumn("bucket", self._bucket())
        rows = rows.repartition(self.buckets, "bucket") if self.buckets > 1 else rows.coalesce(1)
        rows.write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{self.path}/tables/part={self.parts}")
        links.write.mode("overwrite").parquet(f"{self.path}/links/part={self.parts}")
        self.parts += 1

    def _placed(self, keys: DataFrame, old: DataFrame) -> DataFrame:
        """``keys`` with what is known of their buckets: ``hot`` (above GROUP with the new rows, or marked before) and ``marked``."""
        before = old.groupBy("key").agg(F.count("first_id").alias("n_old"), F.max(F.col("first_id").isNull()).alias("marked"))
        load = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(before, "key", "left")
        marked = F.coalesce("marked", F.lit(False))
        load = load.select("key", marked.alias("marked"), (marked | (F.col("n") + F.coalesce("n_old", F.lit(0)) > GROUP)).alias("hot"))
        return cut(keys.join(load, "key"))

    def _rows(self, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows to store, finer keys to look up); a key that becomes hot is marked by a row without id."""
        fine = placed.where("hot").select(F.explode(_finer("key", "rest")).alias("key"), "first_id", "words")
        marks = placed.where("hot and not marked").select("key").distinct().select("key", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("words"))
        return placed.where("not hot").select("key", "first_id", "words").unionByName(fine).unionByName(marks), fine

    def accept(self, rows: DataFrame) -> None:
        """Stores accepted rows as they are; each identity is labelled by its first row."""
        groups = cut(identified(rows).groupBy("scope", "words").agg(F.min("seen_id").alias("first_id")).select(F.xxhash64("scope", "words").alias("key"), "scope", "words", "first_id", F.col("first_id").alias("accepted_id")))
        self._lay_out(groups)
        keys = cut(fingerprints(groups))
        tables, _ = self._rows(self._placed(keys, self._read(1, keys)))
        self._append(groups, tables, self.spark.createDataFrame([], self.LINKS))

    def check(self, batch: DataFrame) -> DataFrame:
        """(accepted_id, seen_id) of the batch's repeats; the new identities are appended."""
        rows = identified(batch).withColumn("key", F.xxhash64("scope", "words"))
        if not self.buckets or self.parts and self.buckets > 1:
            rows = cut(rows)
            self._lay_out(rows)
        known = self._read(0, rows).select("key", "scope", "words", F.col("accepted_id").alias("old"))
        met = cut(rows.join(known, ["key", "scope", "words"], "left"))
        fresh = met.where("old is null").groupBy("key", "scope", "words").agg(F.min("seen_id").alias("first_id"))
        keys = cut(fingerprints(fresh))
        old = self._read(1, keys)
        placed = self._placed(keys, old)
        tables, fine = self._rows(placed)
        probe = placed.select("key", "first_id", "words").unionByName(fine)
        target = old.where("first_id is not null").select("key", "first_id", "words", "accepted_id").unionByName(tables.where("first_id is not null").withColumn("accepted_id", F.lit(None).cast("long")))
        accepted = settle(cut(best_parents(probe, target, self.towns)))
        identities = fresh.join(accepted, "first_id", "left").withColumn("accepted_id", F.coalesce("accepted_id", "first_id"))
        new = met.where("old is null").join(identities.select("key", "scope", "words", "accepted_id"), ["key", "scope", "words"]).select("accepted_id", "seen_id")
        links = met.where("old is not null").select(F.col("old").alias("accepted_id"), "seen_id").unionByName(new).where("accepted_id < seen_id")
        self._append(identities, tables, links)
        return self.links(self.parts - 1)

    def links(self, part: int | None = None) -> DataFrame:
        """(accepted_id, seen_id) of one part, or of all."""
        return self.spark.read.schema(self.LINKS).parquet(*[f"{self.path}/links/part={p}" for p in (range(self.parts) if part is None else [part])])


def found(history: DataFrame, batches: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(accepted_id, seen_id) for each row of ``batches`` that repeats an earlier accepted row, one batch (``batch_no``) after the other."""
    spark = history.sparkSession
    store = Store(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", places)
    columns = ["seen_id", "url", "source", "key", "title"]
    store.accept(history.select(*columns))
    if "batch_no" in batches.columns:
        for (no,) in batches.select("batch_no").distinct().orderBy(F.col("batch_no").asc_nulls_last()).collect():  # one row for each batch
            store.check(batches.where(F.col("batch_no").eqNullSafe(F.lit(no))).select(*columns))
    else:
        store.check(batches.select(*columns))
    remove(spark, f"{store.path}/tables")  # this store serves one query; one that is kept keeps them
    return store.links()
