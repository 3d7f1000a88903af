"""Free-entered values mapped to a canonical list (problem 1).

Method: a symmetric-delete dictionary of the folded reference names is broadcast (its size is
checked); each value's deletes are looked up in it, so that every entry within the edit bound is
found without comparing against the list. Names in scripts without spaces and the ends of compounds
are looked up the same way, by the parts of the value that are as long as some name. Candidates are
ranked by weighted Damerau-Levenshtein distance, agreement with the region and country written beside
the name, and the frequency with which the entry is named exactly in the data. A value without a
candidate is reported as id 0. Each distinct value is matched once, in one pass; its candidates that
only the frequency can tell apart are settled by a join with the counts. A list of over MAX_ENTRIES
rows is not broadcast: ``resolve_large`` joins the deletes of names and values in a shuffle.

Two readings of a value exist: ``window`` (any run of words may name the entry; the longest exact
run wins) and ``segment`` (a part between separators must be the name as a whole once words of
office, remote work and the like are taken off; the other parts may say region and country).

Defined cases: null and blank values have no row; repeated values repeat their result; a tie after
all ranks goes to the smaller id; an empty reference list leaves all values unmatched (0).
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tideglass.plans.tables import bounded_rows, cut

MAX_ENTRIES = 50_000
SHORTEST_END = 6

# Usual names of the employment types that a reference list may lack.
EMPLOYMENT_NAMES = {
    "Full-time": ["full time", "fulltime", "f/t", "permanent full time", "tiempo completo", "jornada completa", "tempo integral", "正社員", "フルタイム", "정규직", "全日制", "plein temps", "permanent"],
    "Part-time": ["part time", "p/t", "tiempo parcial", "media jornada", "meio período", "パート", "시간제", "temps partiel"],
    "Internship": ["intern", "pflichtpraktikum", "praktikant", "prácticas", "estágio", "インターン", "인턴", "实习生", "stagiaire", "trainee internship"],
    "Contract": ["contractor", "contractors", "contract", "契約社員", "合同工"],
    "Temporary": ["temp", "temporary", "临时工", "aushilfe", "temporaire", "temporal", "intérim"],
    "Fixed-term": ["fixed term", "cdd", "befristet", "有期雇用", "contrat à durée déterminée"],
    "Apprenticeship": ["apprentice", "ausbildung", "auszubildende", "azubi", "alternance", "apprentissage", "学徒"],
    "Freelance": ["freelance", "freelancer", "freiberuflich", "self employed", "自由职业", "フリーランス", "autónomo"],
    "Working student": ["werkstudent", "werkstudentin", "student assistant", "working student"],
    "Graduate programme": ["graduate program", "trainee program", "graduate scheme", "new grad", "校招", "校园招聘", "新卒"],
    "Seasonal": ["season work", "saisonarbeit", "seasonal", "saisonnier", "季节工", "temporero"],
    "Volunteer": ["ehrenamt", "bénévolat", "bénévole", "voluntary", "volunteering", "volunteer", "志愿者", "voluntariado", "voluntario"],
}
# Other names and codes of countries.
COUNTRY_NAMES = {
    "Canada": ["ca", "can", "kanada", "加拿大", "カナダ"], "United Kingdom": ["uk", "u.k.", "gb", "gbr", "great britain", "england", "vereinigtes königreich", "royaume-uni", "reino unido", "英国"],
    "Australia": ["au", "aus", "australien", "australie", "澳大利亚"], "Germany": ["de", "deu", "ger", "deutschland", "allemagne", "alemania", "德国"], "France": ["fr", "fra", "frankreich", "francia", "法国"],
    "Spain": ["es", "esp", "españa", "spanien", "espagne", "西班牙"], "Brazil": ["br", "bra", "brasil", "brasilien", "brésil", "巴西"], "Japan": ["jp", "jpn", "日本", "nippon", "japon"],
    "China": ["cn", "chn", "中国", "prc", "p.r. china", "chine"], "United States": ["us", "usa", "u.s.", "u.s.a.", "美国"], "India": ["in", "ind", "bharat"], "Singapore": ["sg", "sgp", "新加坡"],
}
# Words beside a place name that are not part of it.
PLACE_WORDS = frozenset(
    "remote hybrid onsite on site office offices hq headquarters headquarter campus area greater metro metropolitan region downtown city centre center central floor building bldg based near working work home from in at the optional possible first flexible wfh homeoffice büro standort zentrum ville innenstadt umgebung raum und or and location locations branch main st nd rd th".split()
)
_DECOR_CJK = re.compile("リモート可|リモート|在宅|混合办公|可远程|远程|本社|支社|办公室|总部|勤務|市内")
_SEPARATOR = re.compile(r"[,;/|()\[\]{}:·•、，；（）：＋+]|\s[-–—]+\s|[–—]|^\s*[-*]+\s|\s[-–—]+$")
_WORD = re.compile(r"\w+", re.UNICODE)
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)?")


def fold(text: str) -> str:
    """Compatibility form, case folded, without marks on Latin letters; other marks are kept."""
    text = unicodedata.normalize("NFKC", text).replace("ß", "s").casefold()
    out = []
    for c in unicodedata.normalize("NFD", text):
        if not (unicodedata.combining(c) and out and out[-1].isascii()):
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out)).replace("‑", "-").replace("‐", "-")


_UMLAUTS = str.maketrans({"ß": "ss", "ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe", "æ": "ae"})


def keys_of(name: str) -> set[str]:
    """The compact keys of a name: folded, and with umlauts written out."""
    whole = unicodedata.normalize("NFKC", name).lower()
    return {k for k in ("".join(_WORD.findall(fold(name))).replace("_", ""), "".join(_WORD.findall(fold(whole.translate(_UMLAUTS)))).replace("_", "")) if k}


def bound(length: int) -> int:
    """Edits allowed for a key of this length."""
    return 0 if length < 5 else 1 if length < 12 else 2


def deletes(key: str, depth: int) -> set[str]:
    out, level = {key}, {key}
    for _ in range(depth):
        level = {k[:i] + k[i + 1 :] for k in level for i in range(len(k))}
        out |= level
    return out


@lru_cache(maxsize=200_000)
def weighted_distance(a: str, b: str) -> tuple[int, float]:
    """(edits, weight): optimal string alignment, where a swap or a doubled letter weighs less."""
    n, m = len(a), len(b)
    rows = [[(0, 0.0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        rows[i][0] = (i, float(i))
    for j in range(m + 1):
        rows[0][j] = (j, float(j))
    step = lambda x, w: (x[0] + 1, x[1] + w)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if a[i - 1] == b[j - 1]:
                best = rows[i - 1][j - 1]
            else:
                best = step(rows[i - 1][j - 1], 0.9 if a[i - 1] in "aeiouy" and b[j - 1] in "aeiouy" else 1.0)
            best = min(best, step(rows[i - 1][j], 0.6 if i > 1 and a[i - 1] == a[i - 2] else 1.0), step(rows[i][j - 1], 0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
                best = min(best, step(rows[i - 2][j - 2], 0.7))
            rows[i][j] = best
    return rows[n][m]


class Dictionary:
    """Names -> ids, with the deletes of every name; ``context`` has the keys of each id's surroundings."""

    def __init__(self, names: Iterable[tuple[str, int]], context: dict[int, set[str]] | None = None):
        self.exact: dict[str, set[int]] = defaultdict(set)
        for name, ref in names:
            for key in keys_of(name):
                self.exact[key].add(ref)
        self.index: dict[str, set[str]] = defaultdict(set)
        for key in self.exact:
            if not _CJK.search(key):
                for d in deletes(key, bound(len(key))):
                    self.index[d].add(key)
        self.exact, self.index = dict(self.exact), dict(self.index)
        self.cjk_lengths = sorted({len(k) for k in self.exact if _CJK.search(k)}, reverse=True)
        self.longest = max(map(len, self.exact), default=0)
        self.context = context or {}
        self.surroundings = set().union(*self.context.values()) if self.context else set()

    def inside(self, text: str) -> list[str]:
        """The longest name of a script without spaces that stands in ``text``, the first of these; at most one."""
        for n in self.cjk_lengths:
            for i in range(len(text) - n + 1):
                if (k := text[i : i + n]) in self.exact and _CJK.search(k):
                    return [k]
        return []

    def ends(self, word: str) -> set[str]:
        """The names that begin or end a word which is up to eight letters longer."""
        sizes = range(max(SHORTEST_END, len(word) - 8), len(word) + 1)
        return {k for n in sizes for k in (word[:n], word[-n:]) if k in self.exact}

    def near(self, key: str) -> list[tuple[float, str]]:
        """All names within the edit bound of ``key``, with their weights."""
        if key in self.exact:
            return [(0.0, key)]
        depth = bound(len(key) + 1)
        if not depth or len(key) > self.longest + 2:
            return []
        found = {k for d in deletes(key, depth) for k in self.index.get(d, ())}
        out = []
        for k in found:
            edits, weight = weighted_distance(key, k)
            if edits <= min(bound(len(k)), depth):
                out.append((weight, k))
        return sorted(out)

    def best(self, candidates: list[tuple[float, int, str]], beside: set[str]) -> tuple[list[int], float]:
        """candidates: (weight, -length, name). The best entries, several where only frequency can tell; agreement with what stands beside outranks it."""
        ranked = [(w, n, -len(self.context.get(r, set()) & beside), r) for w, n, k in candidates for r in self.exact[k]]
        if not ranked:
            return [0], 0.0
        # an entry of the written country goes before a nearer name of another
        order = (lambda x: (x[2] == 0, *x[:3])) if beside else (lambda x: x[:3])
        first = min(map(order, ranked))
        return sorted({x[3] for x in ranked if order(x) == first}), first[-3]


def match_window(value: str, d: Dictionary) -> tuple[list[int], float]:
    words = [w.replace("_", "") for w in _WORD.findall(fold(value).replace("_", " "))]
    camel = [w.replace("_", "") for w in _WORD.findall(fold(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value)).replace("_", " "))]
    found: list[tuple[float, int, str]] = []
    for ws in ([words] if words == camel else [words, camel]):
        for i in range(len(ws)):
            run = ""
            for j in range(i, len(ws)):
                run += ws[j]
                if len(run) > d.longest + 2:  # no name is within two edits of a longer run
                    break
                found += [(w, -len(k), k) for w, k in d.near(run)]
    found += [(0.0, -len(k) * 3, k) for k in d.inside("".join(words))]
    if not found:  # compounds: the name ends or begins a longer word
        found += [(0.5, -len(k), k) for w in words for k in d.ends(w)]
    exact = [f for f in found if f[0] == 0.0]
    if exact:
        longest = min(exact, key=lambda f: f[1])
        rivals = [f for f in found if -f[1] > 1.5 * -longest[1] and f[0] <= 1.0]  # "temps plien" is not "temps"
        found = rivals or [f for f in exact if f[1] == longest[1]]
    return d.best(found, set())


def segments_of(value: str) -> list[str]:
    """The compact parts of a value between separators, without words that stand beside place names."""
    parts = []
    for part in _SEPARATOR.split(_DECOR_CJK.sub(" ", fold(value))):
        words = [w for w in _WORD.findall(part or "") if w not in PLACE_WORDS and not _ORDINAL.fullmatch(w)]
        if words:
            parts.append("".join(words).replace("_", ""))
    return parts


def match_segment(value: str, d: Dictionary) -> tuple[list[int], float]:
    parts = segments_of(value)
    surrounding = {p for p in parts if p in d.surroundings}
    named = [p for p in parts if p not in d.surroundings or p in d.exact]
    found: list[tuple[float, int, str]] = []
    for p in named:
        found += [(w, -len(k), k) for w, k in d.near(p)]
        if _CJK.search(p):
            found += [(0.1, -len(k), k) for k in d.inside(p)]
    return d.best(found, surrounding)


def employment_dictionary(ref: DataFrame) -> Dictionary:
    rows = bounded_rows(ref.select("ref_id", "label", "aliases"), MAX_ENTRIES, "ref_employment")
    extra = {k.casefold(): v for k, v in EMPLOYMENT_NAMES.items()}
    names = [(n, r.ref_id) for r in rows if r.ref_id is not None for n in [r.label, *(r.aliases or [])] if n]
    taken = {k for n, _ in names for k in keys_of(n)}
    names += [(n, r.ref_id) for r in rows if r.ref_id is not None and r.label for n in extra.get(r.label.casefold(), []) if not keys_of(n) & taken]
    return Dictionary(names)


def location_dictionary(ref: DataFrame) -> Dictionary:
    rows = bounded_rows(ref.select("ref_id", "city", "region", "region_code", "country", "aliases"), MAX_ENTRIES, "ref_location")
    names, context = [], {}
    for r in rows:
        if r.ref_id is None:
            continue
        names += [(n, r.ref_id) for n in [r.city, *(r.aliases or [])] if n]
        around = [r.region, r.region_code, r.country, *COUNTRY_NAMES.get(r.country or "", [])]
        context[r.ref_id] = {k for n in around if n for k in keys_of(n)}
    return Dictionary(names, context)


_MATCH = StructType([StructField("refs", ArrayType(LongType())), StructField("weight", DoubleType())])


def matcher(spark, dictionary: Dictionary, mode: str):
    """A pandas UDF value -> (refs, weight) over the broadcast dictionary."""
    shared = spark.sparkContext.broadcast(dictionary)
    match = {"window": match_window, "segment": match_segment}[mode]

    def run(values: pd.Series) -> pd.DataFrame:
        out = [match(v, shared.value) for v in values]
        return pd.DataFrame({"refs": [x[0] for x in out], "weight": [x[1] for x in out]})

    return pandas_udf(run, _MATCH)


def _named(values: DataFrame) -> DataFrame:
    return values.where(F.col("value").isNotNull() & F.col("value").rlike(r"(?U)[^\s\u001c-\u001f]"))


def _settled(named: DataFrame, matched: DataFrame) -> DataFrame:
    """Rows with the entry of their value; ``matched`` (value, n, refs, weight) has each distinct value once, n is its number of rows."""
    seen = matched.where("weight = 0 and refs[0] > 0").groupBy(F.col("refs")[0].alias("ref_id")).agg(F.sum("n").alias("seen"))
    open_ = matched.where(F.size("refs") > 1).select("value", F.explode("refs").alias("ref_id")).join(seen, "ref_id", "left")
    chosen = open_.groupBy("value").agg(F.max_by("ref_id", F.struct(F.coalesce("seen", F.lit(0)), -F.col("ref_id"))).alias("chosen"))
    final = matched.join(chosen, "value", "left").select("value", F.coalesce("chosen", F.col("refs")[0]).alias("ref_id"), "weight")
    return named.join(final, "value").select("field", "row_id", "value", "ref_id", "weight")


def resolve(values: DataFrame, dictionary: Dictionary, mode: str) -> DataFrame:
    """``values`` (field, row_id, value) -> (field, row_id, value, ref_id, weight) for each value neither null nor blank."""
    named = _named(values)
    udf = matcher(values.sparkSession, dictionary, mode)
    matched = cut(named.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("m", udf("value")).select("value", "n", "m.refs", "m.weight"))
    return _settled(named, matched)


def resolve_large(values: DataFrame, names: DataFrame) -> DataFrame:
    """``resolve`` by segments for a list of any size: ``names`` (ref_id, name, context array<string>) stays a table.

    Parts of values meet names that share a delete with them; then the same distance, agreement and ranks
    hold. Names inside longer texts of scripts without spaces are met by all runs as long as some name.
    """
    named = _named(values)
    keyed = names.where("ref_id is not null and name is not null").select("ref_id", F.explode(_keys_udf("name")).alias("k"), F.coalesce(_folded_all("context"), F.array().cast("array<string>")).alias("context")).where("k <> ''")
    sizes = keyed.agg(F.max(F.length("k")).alias("longest"), F.array_sort(F.collect_set(F.when(F.col("k").rlike(_CJK.pattern), F.length("k")))).alias("cjk")).first()  # one row: a length and a few lengths
    index = keyed.select("ref_id", "k", "context", F.explode(_deletes("k", F.lit(0))).alias("d"))
    distinct = cut(named.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    asked = distinct.select("value", F.explode(_asked_udf(sizes.longest or 0, sizes.cjk or [])("value")).alias("a")).select("value", "a.*")
    met = asked.withColumn("d", F.explode(F.when(F.col("inside"), F.array("part")).otherwise(_deletes("part", F.lit(1))))).join(index, "d").where("not inside or part = k").dropDuplicates(["value", "part", "whole", "inside", "ref_id", "k"])
    # a part that is a name stands for it alone; of the names inside a part the longest
    length = F.when(F.col("inside"), F.length("k")).when(F.col("part") == F.col("k"), F.lit(1)).otherwise(0)
    most = met.groupBy("value", "whole", "inside").agg(F.max(length).alias("most"))
    met = met.join(most, ["value", "whole", "inside"]).where((length == F.col("most")) | (~F.col("inside") & (F.col("most") == 0)))
    rated = met.withColumn("w", F.when(F.col("inside"), F.lit(0.1)).otherwise(_weight("part", "k"))).where("w is not null")
    agree = F.size(F.array_intersect("context", "beside"))
    rank = F.struct(((F.size("beside") > 0) & (agree == 0)).alias("far"), "w", (-F.length("k")).alias("l"), (-agree).alias("a"))
    ranked = rated.groupBy("value", "ref_id").agg(F.min(rank).alias("r"))
    best = ranked.groupBy("value").agg(F.min("r").alias("r"))
    refs = ranked.join(best, ["value", "r"]).groupBy("value").agg(F.array_sort(F.collect_set("ref_id")).alias("refs"), F.min("r.w").alias("weight"))
    matched = cut(distinct.join(refs, "value", "left").select("value", "n", F.coalesce("refs", F.array(F.lit(0).cast("long"))).alias("refs"), F.coalesce("weight", F.lit(0.0)).alias("weight")))
    return _settled(named, matched)


@pandas_udf(ArrayType(StringType()))
def _keys_udf(names: pd.Series) -> pd.Series:
    return pd.Series([sorted(keys_of(n)) for n in names])


@pandas_udf(ArrayType(StringType()))
def _folded_all(lists: pd.Series) -> pd.Series:
    return pd.Series([None if xs is None else sorted({k for x in xs if x for k in keys_of(x)}) for xs in lists])


@pandas_udf(ArrayType(StringType()))
def _deletes(keys: pd.Series, more: pd.Series) -> pd.Series:
    return pd.Series([sorted(deletes(k, 0 if _CJK.search(k) else bound(len(k) + int(m)))) for k, m in zip(keys, more, strict=True)])


@pandas_udf(DoubleType())
def _weight(parts: pd.Series, keys: pd.Series) -> pd.Series:
    def one(a: str, k: str) -> float | None:
        edits, weight = weighted_distance(a, k)
        return weight if edits <= min(bound(len(k)), bound(len(a) + 1)) else None

    return pd.Series([one(a, k) for a, k in zip(parts, keys, strict=True)], dtype="Float64")


_ASKED = ArrayType(StructType([StructField("part", StringType()), StructField("whole", StringType()), StructField("inside", BooleanType()), StructField("beside", ArrayType(StringType()))]))


def _asked_udf(longest: int, cjk: list[int]):
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            parts = sorted(set(segments_of(v)))
            rows = [{"part": p, "whole": p, "inside": False, "beside": parts} for p in parts if len(p) <= longest + 2]
            out.append(rows + [{"part": r, "whole": p, "inside": True, "beside": parts} for p in parts if _CJK.search(p) for r in sorted({p[i : i + n] for n in cjk for i in range(len(p) - n + 1)})])
        return pd.Series(out)

    return pandas_udf(run, _ASKED)


def location_names(ref: DataFrame) -> DataFrame:
    """(ref_id, name, context) of a list of places, for ``resolve_large``."""
    others = F.create_map(*[x for k, v in COUNTRY_NAMES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    texts = F.array().cast("array<string>")
    return ref.where("ref_id is not null").select("ref_id", F.explode(F.concat(F.array("city"), F.coalesce("aliases", texts))).alias("name"), F.concat(F.array("region", "region_code", "country"), F.coalesce(F.try_element_at(others, F.col("country")), texts)).alias("context")).where("name is not null")


def workspace(spark, load) -> DataFrame:
    """All three fields of a workspace; ``load(name)`` gives a table. A long list of places stays a table, with the same results."""
    employment = load("ashby_job").select(F.lit("ashby_job.employment_type").alias("field"), F.col("ashby_row").alias("row_id"), F.col("employment_type").alias("value")).unionByName(
        load("lever_posting").select(F.lit("lever_posting.categories.commitment").alias("field"), F.col("lever_row").alias("row_id"), F.col("categories.commitment").alias("value")))
    places = load("job_item").select(F.lit("job_item.location").alias("field"), F.col("ord").alias("row_id"), F.col("location").alias("value"))
    ref = load("ref_location")
    placed = resolve_large(places, location_names(ref)) if ref.count() > MAX_ENTRIES else resolve(places, location_dictionary(ref), "segment")
    return resolve(employment, employment_dictionary(load("ref_employment")), "window").unionByName(placed)
