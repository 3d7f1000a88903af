"""Text functions as Column expressions; Arrow UDFs only where Spark has no primitive.

Nulls give nulls unless stated otherwise; an empty text stays empty.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# What counts as white space: the Unicode spaces and the four separators that Java's \s leaves out.
SPACE = r"(?U:[\s\x{1c}-\x{1f}])"

# Substrings of links and titles that look like recruiting.
LINK_SIGNALS = ["job", "career", "position", "campus", "graduate", "intern", "recruit", "招聘", "校招", "岗位", "职位", "实习"]
TITLE_SIGNALS = ["招聘", "校招", "校园招聘", "实习", "岗位", "职位", "内推", "投递", "网申", "提前批", "宣讲", "秋招", "春招", "offer"]
# Terms of the requirement kinds, in the order in which they are tried.
KIND_TERMS = {
    "nice_to_have": ["nice to have", "nice-to-have", "bonus", "a plus", "plus but not required", "加分项", "加分"],
    "preferred": ["preferred", "ideally", "优先考虑", "优先"],
    "required": ["required", "must have", "must be", "minimum", "at least", "requirement", "任职要求", "岗位要求", "必须", "需具备", "至少"],
}
# Words that make a line a requirement sentence.
REQUIREMENT_WORDS = ["experience", "proficiency", "familiar", "knowledge", "ability", "sql", "python", "llm", "agent", "requirement", "work authorization", "right to work", "work permit", "sponsorship", "visa", "要求", "经验", "熟悉", "能力", "工签", "签证", "工作许可"]
# Phrases of required years; the first group is the number.
YEARS_PATTERNS = [
    r"(?:at least|minimum(?: of)?|min\.?|more than|over)\s+(\d+)\+?\s+years",
    r"(\d+)(?:\s*-\s*\d+)?\+?\s+years(?:'|\s+of)?\s+(?:relevant\s+|professional\s+|work\s+|industry\s+)?experience",
    r"(?:经验|工作经验)\s*(\d+)\s*年(?:以上|及以上)",
    r"(\d+)\s*年(?:以上|及以上)(?:相关)?(?:工作)?经验",
]
# Legal forms that are taken off company names.
LEGAL_FORMS = [r"\bpte\.?\s*ltd\.?\b", r"\bprivate\s+limited\b", r"\blimited\b", r"\bltd\.?\b", r"\binc\.?\b", r"\bllc\b", "股份有限公司", "有限责任公司", "有限公司"]


def _strings(f):
    """A pandas UDF from a function of one text; nulls stay null."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in values], dtype=object)

    return pandas_udf(run, StringType())


def unescape(text: Column) -> Column:
    """HTML character references to characters."""
    return _strings(html.unescape)(text)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean(text: Column) -> Column:
    return squeeze(unescape(text))


def ascii_quotes(text: Column) -> Column:
    return F.translate(text, "’‘“”–—", "''\"\"--")


def match_form(text: Column) -> Column:
    """Normaliser A: for term matching."""
    return F.lower(ascii_quotes(clean(text)))


def squeezed_match_form(text: Column) -> Column:
    """Normaliser A for texts without character references; stays in the JVM."""
    return F.lower(ascii_quotes(squeeze(text)))


def _compat(v: str) -> str:
    return unicodedata.normalize("NFKC", " ".join(html.unescape(v).split())).casefold()


def compat_form(text: Column) -> Column:
    """Normaliser B: references resolved, white space squeezed, NFKC, case folded."""
    return _strings(_compat)(text)


def ledger_form(text: Column) -> Column:
    """Normaliser C: NFKC, case folded, white space squeezed; references stay."""
    return _strings(lambda v: " ".join(unicodedata.normalize("NFKC", v).casefold().split()))(text)


def quote_regex(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


_WHOLE = r"[a-z0-9][a-z0-9 +.,/-]*"


def plain_term(term: str) -> str:
    return " ".join(html.unescape(term).split()).translate(str.maketrans("’‘“”–—", "''\"\"--")).lower()


def has_term(haystack: Column, term: str) -> Column:
    """Whether a normalised text holds a term: plain ASCII terms as whole words, others anywhere."""
    t = plain_term(term)
    if not t:
        return F.lit(False)
    if re.fullmatch(_WHOLE, t):
        return haystack.contains(t) & haystack.rlike(rf"(?<![a-z0-9]){quote_regex(t)}(?![a-z0-9])")
    return haystack.contains(t)


def hits(haystack: Column, terms: list[str]) -> Column:
    """The terms that a normalised text holds, in the order of the list."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(has_term(haystack, t), F.lit(t)) for t in terms]))


def any_term(haystack: Column, terms: list[str]) -> Column:
    """One literal pattern for all terms, so that the text is scanned once; no terms means no condition."""
    if not terms:
        return F.lit(True)
    plain = [t for t in map(plain_term, terms) if t]
    whole = [quote_regex(t) for t in plain if re.fullmatch(_WHOLE, t)]
    parts = [quote_regex(t) for t in plain if not re.fullmatch(_WHOLE, t)]
    patterns = [rf"(?<![a-z0-9])(?:{'|'.join(whole)})(?![a-z0-9])"] * bool(whole) + parts
    if not patterns:
        return F.lit(False)
    near = reduce(Column.__or__, [haystack.contains(t) for t in plain])  # a plain search first: most texts hold none
    return near & haystack.rlike("|".join(patterns)) if whole else near


def all_terms(haystack: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & has_term(haystack, t)
    return out


def contains_any(haystack: Column, words: list[str]) -> Column:
    return haystack.rlike("|".join(quote_regex(w) for w in words))


def strip_tags(markup: Column) -> Column:
    """Markup to lines of text without resolving references: scripts and the like go, blocks end lines, other tags are spaces."""
    x = F.regexp_replace(markup, r"(?is)<(script|style|noscript|svg).*?</\1>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?i)</(?:p|div|section|article|li|ul|ol|h[1-6])>", "\n")
    return F.regexp_replace(x, r"(?s)<[^>]+>", " ")


def tidy_lines(text: Column) -> Column:
    x = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    x = F.regexp_replace(x, r"\n" + SPACE + "+", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def markup_text(markup: Column) -> Column:
    return tidy_lines(unescape(strip_tags(markup)))


def excerpt(text: Column, limit: int) -> Column:
    """A cleaned text of at most ``limit`` characters, ending in dots where it was cut."""
    return let(squeeze(text), lambda x: F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, limit - 3)), F.lit("..."))))


def snippet(company: Column, location: Column, employment: Column, description: Column, limit: int = 1200) -> Column:
    """The non-empty parts joined by "; "."""
    parts = F.array(*[F.coalesce(squeeze(c), F.lit("")) for c in (company, location, employment)], F.coalesce(excerpt(description, limit), F.lit("")))
    return squeeze(F.array_join(F.filter(parts, lambda p: p != ""), "; "))


def search_text(*columns: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns])


def segments(text: Column) -> Column:
    """Requirement segments of a text: lines, sentences and labelled parts, without bullets."""
    x = ascii_quotes(markup_text(F.coalesce(text, F.lit(""))))
    x = F.regexp_replace(x, r"(?i)(?=\b(?:minimum|required|preferred|nice to have|nice-to-have|bonus)\s+(?:qualifications?|requirements?)\b)", "\n")
    parts = F.filter(F.transform(F.split(x, r"[\n\r]+|(?<=[.;。；])" + SPACE + "+"), squeeze), lambda p: p != "")
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^[-*• ]+", ""))


def kind(segment: Column) -> Column:
    """nice_to_have, preferred, required or unclassified: the first kind with a term in the segment."""

    def named(form: Column) -> Column:
        out = F
        for name, terms in KIND_TERMS.items():
            out = out.when(any_term(form, terms), name)
        return out.otherwise("unclassified")

    return let(squeezed_match_form(segment), named)


def requirement_buckets(text: Column) -> Column:
    """A struct with the segments of each kind, in order."""
    found = segments(text)
    of = lambda name: F.filter(found, lambda s: kind(s) == name)
    return F.struct(*[of(k).alias(k) for k in (*reversed(KIND_TERMS), "unclassified")])


def minimum_years(text: Column) -> Column:
    """The least number of years that a required or unclassified segment names."""
    forms = F.transform(F.filter(segments(text), lambda s: ~kind(s).isin("preferred", "nice_to_have")), squeezed_match_form)
    numbers = F.flatten(F.transform(forms, lambda s: F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in YEARS_PATTERNS])))
    return F.array_min(F.transform(numbers, lambda n: n.try_cast("int")))


def requirement_sentences(text: Column, most: int = 8) -> Column:
    """The first lines of at least 25 characters that hold a requirement word."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]"), squeeze)
    return F.array_join(F.slice(F.filter(lines, lambda x: (F.length(x) >= 25) & contains_any(F.lower(x), REQUIREMENT_WORDS)), 1, most), "\n")


def section(text: Column, starts: list[str], stops: list[str], longest: int = 2500) -> Column:
    """The text between the first start heading and the next stop heading."""
    low = F.lower(ascii_quotes(text))
    fold = lambda s: s.translate(str.maketrans("’‘“”–—", "''\"\"--")).lower()
    places = F.filter(F.array(*[F.struct(F.locate(fold(s), low).alias("at"), F.lit(len(s)).alias("size")) for s in starts]), lambda p: p.at > 0)
    first = F.array_min(places)
    begin = first.at + first.size
    rest_low = F.substring(low, begin, F.length(low))
    ends = F.filter(F.array(*[F.locate(fold(s), rest_low) for s in stops]) if stops else F.array().cast("array<int>"), lambda p: p > 1)
    size = F.coalesce(F.array_min(ends) - 1, F.lit(longest))
    body = F.substring(text, begin, size)
    return F.when(F.size(places) == 0, F.lit("")).otherwise(F.regexp_replace(body, r"^[ :\-\n\t]+|[ :\-\n\t]+$", ""))


def generic_title(title: Column, terms: list[str]) -> Column:
    """The terms that a title equals, or ``template text`` where braces were left in it."""
    form = squeezed_match_form(title)
    equal = F.array_compact(F.array(*[F.when(form == F.lit(t.lower()), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")
    return F.when(form.contains("{{") | form.contains("}}"), F.array(F.lit("template text"))).otherwise(equal)


def likely_link(title: Column, url: Column) -> Column:
    """Whether the title or the address's path, never its host, looks like recruiting."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return contains_any(squeezed_match_form(F.concat_ws(" ", title, path)), LINK_SIGNALS)


def likely_title(title: Column) -> Column:
    return contains_any(squeezed_match_form(title), TITLE_SIGNALS)


def letters(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def company_form(name: Column) -> Column:
    x = compat_form(name)
    for form in LEGAL_FORMS:
        x = F.regexp_replace(x, form, " ")
    return letters(x)


def fingerprint(company: Column, title: Column, location: Column) -> Column:
    """company, title and place as one text with NULs between; empty where one of them is empty."""
    c, p = company_form(company), letters(compat_form(location))
    t = compat_form(title)
    for part in (compat_form(company), compat_form(location)):
        t = F.when(part != "", F.replace(t, part, F.lit(" "))).otherwise(t)
    t = letters(t)
    full = (c != "") & (p != "") & (t != "")
    return F.when(full, F.concat_ws("\0", c, t, p)).otherwise(F.lit(""))


def title_on_page(title: Column, company: Column, location: Column, page: Column) -> Column:
    """Whether a title of at least five letters, without company and place, stands on the page."""
    t = compat_form(title)
    for part in (compat_form(company), compat_form(location)):
        t = F.when(part != "", F.replace(t, part, F.lit(" "))).otherwise(t)
    t = letters(t)
    return (F.length(t) >= 5) & letters(compat_form(page)).contains(t)


def markdown_unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")


def markdown_escape(text: Column) -> Column:
    """One line that Markdown shows as it is."""
    return F.regexp_replace(squeeze(text), r"([\\`*_{}\[\]<>()#+!|])", r"\\$1")


def labelled_ids(text: Column, label: str = r"(?:job|req(?:uisition)?)\s*id|编号|岗位编号") -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i)(?:^|[；;]\s*)(?:{label})\s*[:：]?\s*`?([A-Za-z0-9][A-Za-z0-9_-]*)"), F.lit(1)))


def title_ids(text: Column) -> Column:
    """Ids in parentheses: with a digit, and with a letter or of five characters at least."""
    found = F.regexp_extract_all(text, F.lit(r"[（(]`?([A-Za-z0-9][A-Za-z0-9_-]*)`?[）)]"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(r"\d") & (x.rlike("[A-Za-z]") | (F.length(x) >= 5))))


def holds_id(text: Column, job_id: Column) -> Column:
    """Whether an id stands in a text as a whole; the id may differ by row."""
    quoted = F.regexp_replace(job_id, r"([^\w])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9_-])"), quoted, F.lit(r"(?![A-Za-z0-9_-])")))


def holds_label(text: Column, label: str) -> Column:
    """Names as tokens: "US" is not in "Australia"; both in ledger form."""
    form = " ".join(unicodedata.normalize("NFKC", label).casefold().split())
    return ledger_form(text).rlike(rf"(?U)(?<!\w){quote_regex(form)}(?!\w)")
