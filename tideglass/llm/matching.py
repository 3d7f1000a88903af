"""Records of different sources that describe the same opening, matched without a shared key (problem 5).

Method: the q-grams of title and company are set as bits of fixed vectors (order of words does not
matter, decoration is taken off first); the place is mapped to the list of places. Close pairs are
found exactly by multi-index Hamming hashing: the title vector is cut into TITLE_BLOCKS blocks and the
company vector into COMPANY_BLOCKS, so that two vectors with fewer differing bits than blocks agree
in one block at least; a table is kept for each pair of blocks within a place. Rows without a known
place are looked up in tables of whole title vectors and company blocks over all places. Records that
show a number have tables of single blocks with the number, over all places. Pairs are scored by the
field-weighted Dice coefficient, and scores become confidences by the monotone share of pairs with
agreeing numbers among all pairs that show both numbers, apart for titles of the same words but for
spelling. A confidence of DECIDED or more makes a match.
An exact check follows: openings that differ in their number, their place or in words of the company
that are no spelling of each other are different.

Equal vectors, place and company are one profile, and rows of one source and number in it one record,
until the end: tables of blocks hold profiles, so that groups of copies, and records without a number,
of any size cost one row. Where a number is shown on both sides, the tables with the number are used.

Defined cases: a null or blank title or company is an empty vector, and the score is that of the other
field (both empty: no match); a null place is an unknown one; a null source is a source of its own;
repeated rows pair like the first.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tideglass.llm.canonical import Dictionary, fold, location_dictionary, match_segment, weighted_distance
from tideglass.plans.tables import cut

TITLE_BITS, COMPANY_BITS = 128, 64
TITLE_BLOCKS, COMPANY_BLOCKS, FINE_BLOCKS = 4, 4, 8
WEIGHTS = {"title": 0.55, "company": 0.45}
THRESHOLD = 0.5
DECIDED = 0.5
BINS = 40
ROWS_A_PART, PAIRS_AT_ONCE = 500_000, 2_000_000
# Legal forms and additions that are no part of a company's name.
LEGAL_FORMS = frozenset("ltd llc inc ag gmbh corp co sa kk k s a an the pty pte plc bv group holding company limited corporation hiring careers jobs emea apac amer global recruiting".split())

# Decoration of titles and companies.
_TITLE_NOISE = re.compile(
    r"(?i)^\s*(?:now hiring|hiring|job|new|urgent|open role|we are hiring)\s*[!:–-]+\s*|\s*[-–|*(\[]+\s*(?:apply today|apply now|urgent|hybrid|remote|100% remote|(?:[mfwdx]\s*/\s*)+[mfwdx]|all genders|reposted|new)\s*[\])*]*\s*$"
    r"|\s*[(\[]\s*(?:#|req(?:uisition)?\.?|job(?: no\.?| id)?|ref\.?|id|no\.?|r-|jr)\s*[#:]?\s*0*\d{4,}\s*[)\]]|\*urgent\*"
)
_EXPAND = {"sr": "senior", "jr": "junior", "eng": "engineer", "engr": "engineer", "mgr": "manager", "dev": "developer", "admin": "administrator", "spec": "specialist", "tech": "technician", "assoc": "associate", "coord": "coordinator"}
_FORM_WORDS = frozenset(["project", "team"])
_COMPANY_NOISE = re.compile(r"(?i)\s*[|(–-]\s*(?:hiring|careers|jobs|emea|apac|amer|global|recruiting)\b.*$|,\s*an? [\w ]+ company$|\s+group$|^\s*the\s+")
_NUMBER = re.compile(r"(?<!\d)0*(\d{7,10})(?!\d)")
_WORDS = re.compile(r"[^\W_]+")


def title_words(title: str | None) -> list[str]:
    if title is None:
        return []
    text = unicodedata.normalize("NFKC", title)
    for _ in range(3):
        after = _TITLE_NOISE.sub(" ", text)
        if after == text:
            break
        text = after
    return [_EXPAND.get(w, w) for w in _WORDS.findall(fold(text)) if not _is_form_word(w)]


@lru_cache(maxsize=100_000)
def _is_form_word(word: str) -> bool:
    return word in _FORM_WORDS or any(abs(len(word) - len(f)) < 2 and weighted_distance(word, f)[0] < 2 for f in _FORM_WORDS)


@lru_cache(maxsize=100_000)
def company_word(company: str | None) -> str:
    """The first word of the name: the others are shortened or left out too often."""
    if company is None:
        return ""
    text = unicodedata.normalize("NFKC", company)
    for _ in range(2):
        text = _COMPANY_NOISE.sub("", text)
    words = _WORDS.findall(fold(text))
    return words[0] if words else ""


@lru_cache(maxsize=100_000)
def company_name(company: str | None) -> str:
    """The words of the name, each once, without legal forms and additions."""
    if company is None:
        return ""
    words = _WORDS.findall(fold(unicodedata.normalize("NFKC", company)))
    return " ".join(dict.fromkeys([w for w in words if w not in LEGAL_FORMS] or words[:1]))


@lru_cache(maxsize=100_000)
def word_bits(word: str, bits: int) -> int:
    """One bit for each bigram of a word with its ends marked."""
    marked, out = f"^{word}$", 0
    for i in range(len(marked) - 1):
        out |= 1 << (xxhash.xxh32_intdigest(marked[i : i + 2], seed=bits) % bits)
    return out


def vector(words: list[str], bits: int) -> int:
    out = 0
    for w in words:
        out |= word_bits(w, bits)
    return out


def number_of(job_id: str | None, title: str | None) -> str | None:
    """The opening's number: the employer's own, else that of the title."""
    digits = re.sub(r"[\s._-]", "", unicodedata.normalize("NFKC", job_id or ""))
    m = re.fullmatch(r"(?i)(?:req|ref|jr|r|id|no)?[#:.]*0*(\d{8,10})", digits)
    if m:
        return m[1]
    found = _NUMBER.findall(title or "")
    return found[-1] if found else None


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def cut_blocks(x: int, bits: int, blocks: int) -> list[int]:
    width = bits // blocks
    return [(x >> (k * width)) & ((1 << width) - 1) for k in range(blocks)]


def table_keys(t: int, c: int, place: int) -> list[int]:
    """Keys of a record in the tables of its place: block pairs, title blocks with the whole company, company blocks with the whole title."""
    names = [f"p{place},{i},{x},{j},{y}" for i, x in enumerate(cut_blocks(t, TITLE_BITS, TITLE_BLOCKS)) for j, y in enumerate(cut_blocks(c, COMPANY_BITS, COMPANY_BLOCKS))]
    names += [f"t{place},{i},{x},{c}" for i, x in enumerate(cut_blocks(t, TITLE_BITS, FINE_BLOCKS))]
    names += [f"c{place},{t},{j},{y}" for j, y in enumerate(cut_blocks(c, COMPANY_BITS, FINE_BLOCKS))]
    return [signed(xxhash.xxh64_intdigest(x)) for x in names]


def wide_keys(t: int, c: int) -> list[int]:
    """Keys in the tables over all places, where records of unknown place are looked up."""
    names = [f"*{t},{j},{y}" for j, y in enumerate(cut_blocks(c, COMPANY_BITS, FINE_BLOCKS))] + [f"+{i},{x},{c}" for i, x in enumerate(cut_blocks(t, TITLE_BITS, TITLE_BLOCKS))]
    return [signed(xxhash.xxh64_intdigest(x)) for x in names]


_ENCODED = StructType([StructField("t_low", LongType()), StructField("t_high", LongType()), StructField("c", LongType()), StructField("words", StringType()), StructField("name", StringType()), StructField("place", IntegerType()), StructField("number", StringType())])
PROFILE = ("t_low", "t_high", "c", "words", "name", "place")


def encoder(spark, places: Dictionary):
    shared = spark.sparkContext.broadcast(places)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        memo: dict[str | None, int] = {None: 0}
        for title, company, location, job_id in batches:
            rows = []
            for ti, co, lo, jo in zip(title, company, location, job_id, strict=True):
                words, word = title_words(ti), company_word(co)
                t = vector(words, TITLE_BITS)
                c = vector([word], COMPANY_BITS) if word else 0
                if lo not in memo:
                    memo[lo] = match_segment(lo, shared.value)[0][0] if lo.strip() else 0
                rows.append((signed(t), signed(t >> 64), signed(c), " ".join(sorted(set(words))), company_name(co), memo[lo], number_of(jo, ti)))
            yield pd.DataFrame(rows, columns=[*PROFILE, "number"])

    return pandas_udf(run, _ENCODED)


def _met(key: np.ndarray, first: np.ndarray, among: bool):
    """Chunks of positions (p, q) that hold equal keys, p being one of ``first``; pairs of two of these come once, or not at all unless ``among``."""
    order = np.lexsort((~first, key))
    k, f = key[order], first[order]
    starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(k)]])
    run = np.repeat(np.arange(len(starts)), ends - starts)
    p = np.flatnonzero(f)
    low = p + 1 if among else (starts + np.add.reduceat(f.astype(np.int64), starts))[run[p]]
    n = ends[run[p]] - low
    p, low, n = p[n > 0], low[n > 0], n[n > 0]
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS_AT_ONCE)) + 1
    for p1, low1, n1 in zip(*(np.split(x, cuts) for x in (p, low, n)), strict=True):
        if len(p1):
            at = np.arange(n1.sum()) + np.repeat(low1 - (np.cumsum(n1) - n1), n1)
            yield order[np.repeat(p1, n1)], order[at]


def _blocks(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words as rows of blocks, the lowest first; as ``cut_blocks``."""
    return np.ascontiguousarray(x, dtype="<i8").view(f"<u{width // 8}").reshape(len(x), (x.shape[1] if x.ndim > 1 else 1) * 64 // width)


def _agreeing(group: np.ndarray, blocks: np.ndarray, first: np.ndarray, among: bool = True):
    """Chunks of positions (p, q) of one group that agree in a block, each pair at its first such block."""
    for m in range(blocks.shape[1] if len(group) else 0):
        with np.errstate(over="ignore"):
            key = group + (blocks[:, m].astype(np.int64) + 1) * np.int64(-7046029254386353131)
        for p, q in _met(key, first, among):
            fit = (group[p] == group[q]) & (blocks[p, m] == blocks[q, m])
            for k in range(m):
                fit &= blocks[p, k] != blocks[q, k]
            yield p[fit], q[fit]


def _open_kernel(batches):
    """Pairs of profiles of one part that meet in a table, one of them open; no pair meets in two tables. ``kind`` says which."""
    columns = _gathered(batches)
    if columns is None:
        return
    for kind in range(8):
        at = columns["kind"] == kind
        group, vec, low, high, c, is_open, placed = (columns[x][at] for x in ("group", "vec", "t_low", "t_high", "c", "is_open", "placed"))
        t = np.stack([low, high], axis=1)
        whole = _blocks(t, TITLE_BITS // TITLE_BLOCKS)
        if kind == 0:  # one company: any fine block of the title
            met = _agreeing(group, _blocks(t, TITLE_BITS // FINE_BLOCKS), is_open)
        elif kind < 5:  # a block of the title: any block of another company
            met = _agreeing(group, _blocks(c, COMPANY_BITS // COMPANY_BLOCKS), is_open)
        elif kind < 7:  # one title: any fine block of another company
            met = _agreeing(group, _blocks(c, COMPANY_BITS // FINE_BLOCKS), is_open & ~(placed & (kind == 6)))
        else:  # one company in whatever place
            met = _agreeing(group, whole, is_open & ~placed)
        for p, q in met:
            yield from _told(p, q, _once(kind, p, q, whole, c), ab=vec)
        if kind > 5:  # places unknown on one side only, and the other side open
            some = np.flatnonzero(is_open == placed)
            blocks = _blocks(c, COMPANY_BITS // FINE_BLOCKS) if kind == 6 else whole
            for p, q in _agreeing(group[some], blocks[some], ~placed[some], among=False):
                yield from _told(some[p], some[q], _once(kind, some[p], some[q], whole, c), ab=vec)


def _once(kind: int, p: np.ndarray, q: np.ndarray, titles: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether a pair that meets in this table meets in none before it."""
    if kind in (0, 7):
        return np.ones(len(p), dtype=bool)
    out = c[p] != c[q]
    for k in range(kind - 1 if kind < 5 else 0):
        out &= titles[p, k] != titles[q, k]
    if kind == 5:
        blocks = _blocks(c, COMPANY_BITS // COMPANY_BLOCKS)
        out &= (blocks[p] != blocks[q]).all(axis=1)
    return out


def _number_kernel(batches):
    """Pairs of records of one part that agree in number and in a fine block of title or company, from different sources and no two known places."""
    columns = _gathered(batches)
    if columns is None:
        return
    group, rec, vec, source, place, c = (columns[x] for x in ("group", "rec", "vec", "source", "place", "c"))
    t = np.stack([columns["t_low"], columns["t_high"]], axis=1)
    titles, names, titled = _blocks(t, TITLE_BITS // FINE_BLOCKS), _blocks(c, COMPANY_BITS // FINE_BLOCKS), (t != 0).any(axis=1)
    other = lambda p, q: (source[p] != source[q]) & ((place[p] == place[q]) | (place[p] == 0) | (place[q] == 0))
    for some, blocks in ((np.flatnonzero(titled), titles), (np.flatnonzero(c != 0), names)):
        for p, q in _agreeing(group[some], blocks[some], np.ones(len(some), dtype=bool)):
            p, q = some[p], some[q]
            fit = other(p, q)
            if blocks is names:
                fit &= ~(titled[p] & titled[q] & (titles[p] == titles[q]).any(axis=1))
            yield from _told(p, q, fit, ab=rec, uv=vec)


def _gathered(batches) -> dict[str, np.ndarray] | None:
    tables = [pa.Table.from_batches([x]) for x in batches if x.num_rows]
    if not tables:
        return None
    whole = pa.concat_tables(tables)
    return {x: whole[x].to_numpy() for x in whole.column_names}


def _told(p: np.ndarray, q: np.ndarray, fit: np.ndarray, **ids: np.ndarray):
    """The pairs that fit, the smaller id first; ``ids`` has the ids by the names of their two columns."""
    p, q = p[fit], q[fit]
    yield pa.RecordBatch.from_pydict({name: x for names, of in ids.items() for name, x in zip(names, (np.minimum(of[p], of[q]), np.maximum(of[p], of[q])), strict=True)})


def _parted(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (about n of them) in parts that hold whole groups, small enough for a Python worker."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS_A_PART + 1), "group")


def records(items: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records: one row for each source, profile and number; membership: ord -> record)."""
    spark = items.sparkSession
    encode = encoder(spark, location_dictionary(places))
    rows = items.where("ord is not null").select("ord", F.coalesce("source", F.lit("")).alias("source"), encode("title", "company", "location", "job_id").alias("e")).select("ord", "source", "e.*")
    rows = rows.where("c <> 0 or t_low <> 0 or t_high <> 0").select("ord", F.xxhash64("source").alias("source"), *PROFILE, "number", F.xxhash64(*PROFILE).alias("vec"))
    rows = cut(rows.withColumn("rec", F.xxhash64("source", "vec", F.coalesce("number", F.lit("")))))
    heads = cut(rows.select("rec", "vec", "source", *PROFILE, "number").dropDuplicates(["rec"]))
    return heads, cut(rows.select("ord", "rec"))  # two narrow tables; where Spark cleans checkpoints, the wide one goes


def numbered_pairs(heads: DataFrame) -> DataFrame:
    """(a, b) of records of different sources that agree in number and a block, and (u, v), u <= v, of their profiles."""
    rows = heads.where("number is not null").select(F.xxhash64("number").alias("group"), "rec", "vec", "source", "place", *PROFILE[:3])
    return _parted(rows, heads.count()).mapInArrow(_number_kernel, "a long, b long, u long, v long")


def joined(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting, whatever Spark's estimates say: they know neither what Python functions give out nor how long exploded or checkpointed rows are, and let tables of many times the broadcast limit through the driver."""
    return a.join(b.hint("merge"), on, how)


def open_pairs(profiles: DataFrame) -> DataFrame:
    """(a, b), a <= b, of profiles that share a block key and of which one has records without a number.

    The pairs are those of ``table_keys`` (both of one known place) and of ``wide_keys`` (one of no known place), but a profile is sent once
    for each title, company and title block, and its keys are cut and met where it arrives: 8 rows a profile instead of 44.
    """
    low, high = F.col("t_low"), F.col("t_high")
    titles = [x for w in (low, high) for x in (w.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(w, TITLE_BITS // TITLE_BLOCKS))]
    row = lambda kind, *xs: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), *xs).alias("group"))
    near = [row(0, F.col("place"), F.col("c")), *[row(1 + i, F.col("place"), x) for i, x in enumerate(titles)], row(5, F.col("place"), low, high)]
    wide = [row(6, low, high), row(7, F.col("c"))]
    placed = F.col("place") > 0
    rows = profiles.select("vec", *PROFILE[:3], "is_open", placed.alias("placed"), F.explode(F.when(placed, F.array(*near, *wide)).otherwise(F.array(*wide))).alias("at")).select("*", "at.*").drop("at")
    met = _parted(rows, 8 * profiles.count()).mapInArrow(_open_kernel, "a long, b long")
    return met.unionByName(profiles.where("is_open").select(F.col("vec").alias("a"), F.col("vec").alias("b")))


def counted(pairs: DataFrame, heads: DataFrame, agreed: DataFrame | None = None) -> DataFrame:
    """(score, n, k) of each scored pair of profiles (a, b, score): the pairs of records of different sources that show both numbers, and those of them with equal numbers.

    Neither expands the pairs of records with different numbers: n comes from the counts of each source, k from the pairs of ``numbered_pairs``
    (profiles that share a key of ``open_pairs`` share a fine block of title or company as well, so that none of theirs is missing there).
    """
    agreed = numbered_pairs(heads) if agreed is None else agreed
    numbered = heads.where("number is not null").select("vec", "source", "number")
    by_source = numbered.groupBy("vec", "source").agg(F.count(F.lit(1)).alias("n"))
    totals = by_source.groupBy("vec").agg(F.sum("n").alias("n"))
    of = lambda d, p: d.select(*[F.col(x).alias(p if x == "vec" else f"{p}_{x}") for x in d.columns])
    both = pairs.select("a", "b")
    within = joined(joined(both, of(by_source, "a"), "a"), of(by_source, "b").withColumnRenamed("b_source", "a_source"), ["b", "a_source"]).groupBy("a", "b").agg(F.sum(F.col("a_n") * F.col("b_n")).alias("within"))
    equal = agreed.groupBy(F.col("u").alias("a"), F.col("v").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    every = F.col("a_n") * F.col("b_n") - F.coalesce("within", F.lit(0))
    half = lambda x: F.when(F.col("a") == F.col("b"), x / 2).otherwise(x).cast("long")
    out = joined(joined(joined(pairs, of(totals, "a"), "a"), of(totals, "b"), "b"), within, ["a", "b"], "left").withColumn("n", half(every)).where("n > 0")
    out = joined(out, equal, ["a", "b"], "left")
    return out.select("score", "same_words", "n", F.coalesce("k", F.lit(0)).alias("k"))


def _near(u, v):
    letters = lambda x: F.array_sort(F.split(x, ""))
    return (F.levenshtein(u, v) <= F.when(F.least(F.length(u), F.length(v)) < 5, 1).otherwise(2)) | ((F.levenshtein(u, v) <= 2) & (letters(u) == letters(v)))


def _one_name(a, b):
    """Whether two companies' words are spellings of each other, one by one: shortened, left out at the end, or within two edits (one, or a swap, in words under five letters)."""
    pairs = F.arrays_zip(F.split(a, " ").alias("u"), F.split(b, " ").alias("v"))
    return (a == b) | (a == "") | (b == "") | F.forall(pairs, lambda p: p["u"].isNull() | p["v"].isNull() | p["u"].startswith(p["v"]) | p["v"].startswith(p["u"]) | _near(p["u"], p["v"]))


def _one_title(a, b):
    """Whether two titles have the same words but for spelling: what only one has stands against a word within edits that only the other has."""
    x, y = F.split(a, " "), F.split(b, " ")
    mine, theirs = F.array_except(x, y), F.array_except(y, x)
    return (a == b) | (F.size(mine) == F.size(theirs)) & F.forall(mine, lambda u: F.exists(theirs, lambda v: _near(u, v))) & F.forall(theirs, lambda v: F.exists(mine, lambda u: _near(u, v)))


def scored(pairs: DataFrame, heads: DataFrame, by: str) -> DataFrame:
    """(a, b) of records or profiles (``by``) with the Dice coefficients of their fields; pairs of different known places or companies are left out."""
    rows = heads.select(by, *PROFILE).dropDuplicates([by])  # shuffled as the joins need it
    a, b = (rows.select(F.col(by).alias(p), *[F.col(x).alias(f"{p}_{x}") for x in PROFILE]) for p in "ab")
    both = joined(joined(pairs, a, "a"), b, "b").where("a_place = b_place or a_place = 0 or b_place = 0").where(_one_name(F.col("a_name"), F.col("b_name")))
    bits = lambda *xs: sum((F.bit_count(F.col(x)) for x in xs), F.lit(0))
    common = lambda x: F.bit_count(F.col(f"a_{x}").bitwiseAND(F.col(f"b_{x}")))
    t_a, t_b, c_a, c_b = bits("a_t_low", "a_t_high"), bits("b_t_low", "b_t_high"), bits("a_c"), bits("b_c")
    title = F.when((t_a > 0) & (t_b > 0), 2 * (common("t_low") + common("t_high")) / (t_a + t_b))
    company = F.when((c_a > 0) & (c_b > 0), 2 * common("c") / (c_a + c_b))
    score = F.coalesce(WEIGHTS["title"] * title + WEIGHTS["company"] * company, title, company)
    whole = title.isNotNull() & company.isNotNull()
    return both.withColumn("score", score).where("score is not null").select("a", "b", "score", whole.alias("whole"), (whole & _one_title(F.col("a_words"), F.col("b_words"))).alias("same_words"), ((F.col("a_place") > 0) & (F.col("a_place") == F.col("b_place"))).alias("same_place"))


def _bin():
    """The bin of a score, those of pairs with the same words behind the others."""
    return F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int") + F.when(F.col("same_words"), BINS).otherwise(0)


def reliability(counts: DataFrame) -> list[tuple[int, int, int, float]]:
    """(bin, n, k, confidence): the share of pairs with agreeing numbers, made monotone in the score (pool adjacent violators), apart for pairs with the same words."""
    rows = counts.groupBy(_bin().alias("bin")).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()  # two rows a bin
    found = {r.bin: (r.n, r.k) for r in rows}
    out = []
    for base in (0, BINS):
        pools: list[list[float]] = []
        for i in range(BINS):
            n, k = found.get(base + i, (0, 0))
            prior = (i / BINS) ** (1 if base else 8)
            pools.append([n + 1.0, k + prior, 1])  # one virtual pair holds empty bins: at the score for the same words, far below it for others
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] > pools[-1][1] / pools[-1][0]:
                n2, k2, m2 = pools.pop()
                pools[-1] = [pools[-1][0] + n2, pools[-1][1] + k2, pools[-1][2] + m2]
        confidence = [k / n for n, k, m in pools for _ in range(int(m))]
        out += [(base + i, *found.get(base + i, (0, 0)), confidence[i]) for i in range(BINS)]
    return out


def _released(df: DataFrame) -> DataFrame:
    """``df``, a cut plan. Spark deletes the shuffle files of what it was made from once the driver's garbage is collected, which else may not happen before the end."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def _prepared(items: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list]:
    """(records, membership, pairs of records with one number, scored pairs of profiles, reliability table)."""
    heads, membership = records(items, places)
    profiles = cut(_released(heads).groupBy("vec").agg(*[F.any_value(x).alias(x) for x in PROFILE], F.max(F.col("number").isNull()).alias("is_open")))
    pairs = cut(scored(open_pairs(_released(profiles)), profiles, "vec").where(F.col("whole") & (F.col("score") >= THRESHOLD)).drop("whole"))
    agreed = cut(numbered_pairs(_released(heads)))
    table = reliability(counted(pairs, heads, _released(agreed)))
    return _released(heads), membership, agreed, pairs, table


def match(items: DataFrame, places: DataFrame) -> DataFrame:
    """(ord_a, ord_b, score, confidence, same_number, same_place) of each pair of rows of the same opening."""
    heads, membership, agreed, pairs, table = _prepared(items, places)
    confidence = F.element_at(F.array(*[F.lit(x[3]) for x in table]), _bin() + 1)
    # where both show a number it is one more agreeing field; the score says how far the others bear it out
    agreeing = scored(agreed, heads, "rec").withColumns({"confidence": 1 - (1 - confidence) * (1 - F.col("score")), "same_number": F.lit(True)})
    likely = pairs.withColumn("confidence", confidence).where(F.col("confidence") >= DECIDED)
    side = lambda p: heads.select(F.col("vec").alias(p), F.col("rec").alias(f"{p}_rec"), F.col("source").alias(f"{p}_source"), F.col("number").isNull().alias(f"{p}_open"))
    spread = joined(joined(likely, side("a"), "a"), side("b"), "b").where("(a_open or b_open) and a_source <> b_source and (a <> b or a_rec < b_rec)")
    columns = ["a", "b", "score", "same_place", "confidence", "same_number"]
    spread = spread.select(F.col("a_rec").alias("a"), F.col("b_rec").alias("b"), "score", "same_place", "confidence", F.lit(None).cast("boolean").alias("same_number"))
    rated = agreeing.where(F.col("confidence") >= DECIDED).select(*columns).unionByName(spread)
    left, right = membership.select(F.col("rec").alias("a"), F.col("ord").alias("x")), membership.select(F.col("rec").alias("b"), F.col("ord").alias("y"))
    out = joined(joined(rated, left, "a"), right, "b")
    return out.select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"), "score", "confidence", "same_number", "same_place")


def reliability_table(items: DataFrame, places: DataFrame) -> DataFrame:
    """(same_words, from_score, n_pairs, n_agreeing, share, confidence): what the confidences were read from, and how they bear it out."""
    rows = [(i >= BINS, i % BINS / BINS, int(n), int(k), k / n if n else None, c) for i, n, k, c in _prepared(items, places)[4]]
    return items.sparkSession.createDataFrame(rows, "same_words boolean, from_score double, n_pairs long, n_agreeing long, share double, confidence double")
