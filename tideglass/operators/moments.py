"""Times written in mixed notations and zones, brought to one UTC moment (problem 2).

Method: expectation-maximisation over format mixtures per source. Each value is parsed under every
reading that is valid for it (day first, month first, or the single reading its notation allows).
Values with one valid reading are the evidence, values with two share theirs between both in
proportion to the current mixture of their source and notation. The posterior chooses the reading;
a value whose two readings differ while neither posterior reaches ``RESOLVED`` is marked
``unresolved`` (its likelier reading is still given).

The mixture is hierarchical: notation x declared order of the source, pooled over all sources, is
the prior of notation x source. Counts come from all rows; only their aggregate (one row for each
source and notation) takes part in the iteration, whose fixed point is taken in closed form.

Defined cases: null, blank and non-time text have no reading and no row in ``resolve``; impossible
dates (2025-02-30, 31/31/2025) neither; repeated rows are kept; an unknown source counts as UTC
without a declared order; a null zone means UTC; of a local time that occurs twice the first, a
skipped one is moved on by the length of the skip; digits beyond microseconds are cut off.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

RESOLVED = 0.95
PRIOR_STRENGTH = 4.0

# Month names (English, German, French, Spanish, Portuguese), first three letters without marks where that is unique.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "janner": 1, "februar": 2, "marz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12, "okt": 10, "dez": 12, "mrz": 3,
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "janv": 1, "fevr": 2, "avr": 4, "juil": 7,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "janeiro": 1, "fevereiro": 2, "marco": 3, "maio": 5, "junho": 6, "julho": 7, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
}
# Zone abbreviations in minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "ist": 330, "sgt": 480, "hkt": 480, "awst": 480,
    "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "brt": -180, "brst": -120, "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
}

_EPOCH = dt.datetime(1970, 1, 1)
_TIME = r"(?:(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?\s?m\b\.?)?(?:\s*(?:uhr|h))?(?P<z>.*))?"
_PATTERNS = [
    ("ymd", re.compile(r"(?P<y>\d{4})-(?P<mo>\d{1,2})-(?P<d>\d{1,2})(?:(?:t|\s+|,\s*)(?=\d))?" + _TIME)),
    ("ymd", re.compile(r"(?P<y>\d{4})(?P<sep>[/.])(?P<mo>\d{1,2})(?P=sep)(?P<d>\d{1,2})\.?(?:(?:t|\s+|,\s*)(?=\d))?" + _TIME)),
    ("ymd", re.compile(r"(?P<y>\d{4})\s*[年년]\s*(?P<mo>\d{1,2})\s*[月월]\s*(?P<d>\d{1,2})\s*[日일]?(?:\s+|(?=\d))?" + _TIME)),
    ("slash", re.compile(r"(?P<n1>\d{1,2})/(?P<n2>\d{1,2})/(?P<y>\d{4})(?:,?\s+(?:at\s+)?(?=\d))?" + _TIME)),
    ("dot", re.compile(r"(?P<n1>\d{1,2})\.(?P<n2>\d{1,2})\.(?P<y>\d{4})(?:,?\s+(?:um\s+)?(?=\d))?" + _TIME)),
    ("dash", re.compile(r"(?P<n1>\d{1,2})-(?P<n2>\d{1,2})-(?P<y>\d{4})(?:,?\s+(?=\d))?" + _TIME)),
    ("named", re.compile(r"(?:[^\W\d_]{2,10}\.?,?\s+)?(?P<d>\d{1,2})(?:st|nd|rd|th|\.|er)?(?:\s+de|\s+of)?[\s-]+(?P<mon>[^\W\d_]{3,10})\.?(?:\s+de)?,?[\s-]+(?P<y>\d{4})(?:,?\s+(?:at\s+|um\s+|à\s+)?(?=\d))?" + _TIME)),
    ("named", re.compile(r"(?:[^\W\d_]{2,10}\.?,\s+)?(?P<mon>[^\W\d_]{3,10})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})(?:,?\s+(?:at\s+)?(?=\d))?" + _TIME)),
]
_OFFSET = re.compile(r"(?:utc|gmt)?\s*(?P<sign>[+\-−])(?P<oh>\d{1,2})(?::?(?P<om>\d{2}))?(?:\s*\[(?P<name>[^\]]+)\])?$")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})?(z)?)?$")
_DIGITS_TO_US = {10: 10**6, 13: 10**3, 16: 1}


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any unknown or malformed name
        return None


@lru_cache(maxsize=1024)
def _zone_any_case(name: str) -> ZoneInfo | None:
    """The zone of a name in any letter case; ``america/sao_paulo`` works as well."""
    if "/" not in name:
        return None
    parts = ["_".join(w.capitalize() if w not in ("of", "es") else w for w in p.split("_")) for p in name.split("/")]
    return _zone(name) or _zone("/".join(parts))


def _to_us(moment: dt.datetime) -> int:
    delta = moment - _EPOCH
    return (delta.days * 86400 + delta.seconds) * 10**6 + delta.microseconds


def _local_to_us(moment: dt.datetime, zone: ZoneInfo | None) -> int:
    """fold=0 is the first of two occurrences, and moves a skipped time on by the skip."""
    offset = moment.replace(tzinfo=zone, fold=0).utcoffset() if zone is not None else dt.timedelta(0)
    return _to_us(moment - offset)


def _build(y: int, mo: int, d: int, clock: tuple[int, int, int, int]) -> dt.datetime | None:
    try:
        return dt.datetime(y, mo, d, *clock)
    except ValueError:
        return None


def read_value(value: str | None, zone_name: str | None) -> tuple[str | None, int | None, int | None]:
    """(notation, day-first or only reading, month-first reading) of one value, as UTC microseconds."""
    nothing = (None, None, None)
    if value is None:
        return nothing
    text = " ".join(unicodedata.normalize("NFKC", value).split()).lower()
    if not text or not any(c.isdigit() for c in text):
        return nothing
    own = _zone(zone_name) if zone_name else None
    if text.isdigit():
        if (scale := _DIGITS_TO_US.get(len(text))) is not None:
            return "epoch", int(text) * scale, None
        if len(text) == 19:
            return "epoch", int(text) // 1000, None
    if m := _COMPACT.fullmatch(text):
        y, mo, d, h, mi, s, z = m.groups()
        moment = _build(int(y), int(mo), int(d), (int(h or 0), int(mi or 0), int(s or 0), 0))
        return nothing if moment is None else ("compact", _local_to_us(moment, None if z else own), None)
    for family, pattern in _PATTERNS:
        m = pattern.fullmatch(text)
        if m is None:
            continue
        g = m.groupdict()
        clock = _clock(g)
        shift = _shift(g["z"], own) if clock is not None else None
        if clock is None or shift is None:
            return nothing
        fixed, zone = shift
        y = int(g["y"])

        def us(mo: int, d: int) -> int | None:
            moment = _build(y, mo, d, clock)
            if moment is None:
                return None
            return _to_us(moment) - fixed * 60 * 10**6 if fixed is not None else _local_to_us(moment, zone)

        if family == "named":
            mon = "".join(c for c in unicodedata.normalize("NFKD", g["mon"]) if not unicodedata.combining(c))
            number = MONTHS.get(mon)
            first = us(number, int(g["d"])) if number else None
            return nothing if first is None else (family, first, None)
        if family == "ymd":
            first = us(int(g["mo"]), int(g["d"]))
            return nothing if first is None else (family, first, None)
        n1, n2 = int(g["n1"]), int(g["n2"])
        first, second = us(n2, n1), us(n1, n2)
        return nothing if first is None and second is None else (family, first, second)
    return nothing


def _clock(g: dict) -> tuple[int, int, int, int] | None:
    if g["h"] is None:
        return 0, 0, 0, 0
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if g["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"] == "p" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    return h, mi, s, int((g["f"] or "0")[:6].ljust(6, "0"))


def _shift(rest: str | None, own: ZoneInfo | None) -> tuple[int | None, ZoneInfo | None] | None:
    """(minutes east, None) for a written offset, (None, zone) for a named or missing one, None for anything else."""
    rest = (rest or "").strip()
    if not rest:
        return None, own
    if rest.startswith("(") and rest.endswith(")") or rest.startswith("[") and rest.endswith("]"):
        rest = rest[1:-1].strip()
    if rest in ABBREVIATIONS:
        return ABBREVIATIONS[rest], None
    if rest.startswith("z[") and rest.endswith("]"):
        return 0, None
    if m := _OFFSET.fullmatch(rest):
        oh, om = int(m["oh"]), int(m["om"] or 0)
        if oh > 18 or om > 59:
            return None
        return (oh * 60 + om) * (1 if m["sign"] == "+" else -1), None
    zone = _zone_any_case(rest)
    return None if zone is None else (None, zone)


_READING = StructType([StructField("family", StringType()), StructField("first_us", LongType()), StructField("second_us", LongType())])


@pandas_udf(_READING)
def readings(value: pd.Series, zone: pd.Series) -> pd.DataFrame:
    rows = [read_value(v, z) for v, z in zip(value, zone, strict=True)]
    return pd.DataFrame({"family": [r[0] for r in rows], "first_us": pd.array([r[1] for r in rows], dtype="Int64"), "second_us": pd.array([r[2] for r in rows], dtype="Int64")})


def mixture(only_first: Column, only_second: Column, prior: Column, strength: float) -> Column:
    """The share of day-first values where expectation-maximisation comes to rest.

    A round gives ``(only_first + either * p + prior * strength) / (only_first + only_second + either + strength)``;
    its only fixed point is the value below, whatever the number of ambiguous values (``either``): they share
    themselves out in the proportion of the others.
    """
    return (only_first + prior * F.lit(strength)) / (only_first + only_second + F.lit(strength))


def read_all(values: DataFrame, sources: DataFrame) -> DataFrame:
    """``values`` (field, row_id, source, value) with every valid reading."""
    known = sources.select(F.col("name").alias("source"), F.coalesce("zone", F.lit("UTC")).alias("zone"), "date_order")
    known = known.groupBy("source").agg(F.min("zone").alias("zone"), F.min("date_order").alias("date_order"))
    joined = values.join(known, "source", "left").withColumn("r", readings("value", F.coalesce("zone", F.lit("UTC"))))
    return joined.select("field", "row_id", "source", "value", F.coalesce("date_order", F.lit("none")).alias("date_order"), "r.*").where(F.col("family").isNotNull())


def estimate(read: DataFrame) -> DataFrame:
    """One row for each source and notation with two readings: counts and the day-first share."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    a, b = F.col("first_us"), F.col("second_us")
    counts = read.where(F.col("family").isin("slash", "dot", "dash")).groupBy("source", "date_order", "family").agg(
        one(a.isNotNull() & b.isNull()).alias("only_first"), one(a.isNull() & b.isNotNull()).alias("only_second"), one(a.isNotNull() & b.isNotNull() & (a != b)).alias("either"), F.count(F.lit(1)).alias("n"))
    declared = F.when(F.col("date_order") == "dmy", 0.9).when(F.col("date_order") == "mdy", 0.1).otherwise(0.5)
    pooled = counts.groupBy("date_order", "family").agg(*[F.sum(c).alias(c) for c in ("only_first", "only_second", "either")])
    pooled = pooled.select("date_order", "family", mixture(F.col("only_first"), F.col("only_second"), declared, PRIOR_STRENGTH).alias("prior"))
    share = mixture(F.col("only_first"), F.col("only_second"), F.col("prior"), PRIOR_STRENGTH)
    return counts.join(pooled, ["date_order", "family"]).select("source", "family", "date_order", "n", "only_first", "only_second", "either", share.alias("day_first"))


def resolve(values: DataFrame, sources: DataFrame) -> DataFrame:
    """(field, row_id, source, value, family, utc_us, posterior, status) of each value that names a moment.

    status: ``single`` (one reading), ``chosen`` (two readings, one posterior reaches RESOLVED) or ``unresolved``.
    """
    read = read_all(values, sources)
    share = estimate(read).select(F.col("source").alias("s"), F.col("family").alias("f"), "day_first")
    a, b = F.col("first_us"), F.col("second_us")
    both = a.isNotNull() & b.isNotNull() & (a != b)
    day_first = F.coalesce(F.col("day_first"), F.lit(0.5))
    chosen = read.join(share, F.col("source").eqNullSafe(F.col("s")) & (F.col("family") == F.col("f")), "left")
    return chosen.select(
        "field", "row_id", "source", "value", "family",
        F.when(both, F.when(day_first >= 0.5, a).otherwise(b)).otherwise(F.coalesce(a, b)).alias("utc_us"),
        F.when(both, F.greatest(day_first, 1 - day_first)).otherwise(F.lit(1.0)).alias("posterior"),
        F.when(~both, "single").when(F.greatest(day_first, 1 - day_first) >= RESOLVED, "chosen").otherwise("unresolved").alias("status"),
    )


def workspace_values(items: DataFrame, verifications: DataFrame) -> DataFrame:
    """The three time fields of a workspace in long form (field, row_id, source, value)."""
    stacked = items.select("ord", "source", F.explode(F.create_map(F.lit("job_item.published"), "published", F.lit("job_item.expires"), "expires")).alias("field", "value"))
    return stacked.select("field", F.col("ord").alias("row_id"), "source", "value").unionByName(
        verifications.select(F.lit("job_verification.checked_at").alias("field"), F.col("verification_id").alias("row_id"), "source", F.col("checked_at").alias("value"))
    ).where(F.col("value").isNotNull())
