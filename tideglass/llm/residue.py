"""Template residue, filler and error pages in short fields (problem 6).

Method: records of the same template are aligned to find their slots. A field is cut into parts
(between semicolons, lines, sentences). A part with a name within template delimiters, a serialiser's
default or a label without a value is a skeleton: its words outside of that place. The place is a slot
if parts of the same source and field with an equal skeleton hold at least RECURS other values there;
a name that is a part by itself is compared with the parts at its position. A name that a template
never fills varies nowhere: it is in a slot if its whole part belongs to the template's frame, that is,
to at least half of the different texts (and FRAME of them) of its source and field, or of those of
them with as many separators. Besides, over all records each name is counted by delimiter style and
by surroundings: a variable name that templates left behind stands in several styles or surroundings
(it fills slots), a literal that a sentence is about always stands in the same one. Names of the schema
(title, company, location ...) count as variables where alignment and counts cannot decide. Fields with
defaults or blanks of a serialiser (nan, null, [object Object]) for values and filler phrases are flagged
as well. Whole pages are found against the template of their source: where TEMPLATE of a source's snippets hold
a value of their own record (company, place, kind of employment), those are the template's slots, and a
snippet that holds none of them is another page. What such pages say is looked for elsewhere: a title
that stands in one as a run of words, a part of another snippet that does (and not more often there than
in pages), and four words in a row that mostly stand in pages (dummy text in any order). Snippets of one
shape that recur over several companies and hold no slot are repeated pages. Beside that, lists of
usual fillers, error messages and script notices find fields that occur once (``lists=False`` leaves
them out). An empty part between two semicolons
is a blank value and no residue; a null source is a source of its own.

Defined cases: null and blank fields are no residue; a field that merely talks about such things is
none; repeated rows are flagged alike; one row for each flagged field, with its reasons elsewhere.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tideglass.llm.matching import signed
from tideglass.plans.tables import cut

RECURS = 3
# The different texts that must share a part of a template's frame, the words a slot's value may have, and the table size up to which a join is a broadcast.
FRAME, SLOT_WORDS, SMALL = 6, 6, 100_000
# The share of a source's snippets that must hold values of their records, and the words of a run by which pages are looked up.
TEMPLATE, RUN = 0.9, 12

_ID = r"[A-Za-z][A-Za-z0-9]*(?:[._][A-Za-z0-9]+)*"
# The delimiters of common template languages.
STYLES = {
    "double_brace": rf"\{{\{{[>#/&^!]?\s*(?:each\s+)?({_ID})\s*\}}\}}", "dollar_brace": rf"\$\{{\s*({_ID})\s*\}}", "hash_brace": rf"#\{{\s*({_ID})\s*\}}", "brace_percent": rf"\{{%-?\s*({_ID})\s*-?%\}}",
    "angle_percent": rf"<%[=-]?\s*({_ID})\s*%>", "double_bracket": rf"\[\[\s*({_ID})\s*\]\]", "percent": rf"(?<![\w%])%({_ID})%(?![\w%])", "underscores": rf"(?<!\w)__({_ID}?)__(?!\w)", "angle": rf"(?<![<\w])<({_ID})>",
    "escaped_angle": rf"&lt;\s*({_ID})\s*&gt;", "insert": rf"\[(?:insert|enter|add|put)\s+({_ID}(?: \w+)?)\s+here\]", "your": rf"\[(?:Your|your|YOUR)\s+({_ID})\]", "stars": rf"\*{{2,3}}({_ID}) goes here\*{{2,3}}",
    "model": rf"@Model\.({_ID})", "dollar_paren": rf"\$\(({_ID})\)", "brace": rf"(?<![$#{{%\w])\{{({_ID})\}}(?!\}})", "bracket": r"(?<![\[\w])\[((?:[A-Z]\w+)(?: [A-Z]\w+)?)\](?!\])",
}
# The words that names of a posting's fields are made of.
SCHEMA_WORDS = frozenset("job title company name location dept department team role position summary req id candidate city country salary date employer description text lists skills manager recruiter start email phone address client product month year number".split())
# Filler phrases and defaults.
FILLER = re.compile(
    r"(?i)(?<![\w'’])(?:x{4,}|(?:asdf|qwerty|blah|foo|bar)(?:[ ,]+(?:asdf|qwerty|blah|foo|bar))+|test test \d+|headline \d+|sample job title|placeholder for final wording|untitled draft(?: \(copy \d+\))?|description coming soon"
    r"|click to edit text|posting text goes here|dummy posting - do not publish|test - please ignore|hier steht der anzeigentext|todo: write \w+|\#n/a|\#ref!|\[object object\]|your text here|insert text here)(?![\w'’])|此处填写职位名称|ここに職種名を入力"
)
_DEFAULT = r"(?:nan|null|undefined|none|\(null\)|n/a)"
DEFAULT_SLOTS = re.compile(rf"(?i)^\s*(?:{_DEFAULT}\s*(?:[;|,-]\s*|\s*$)){{1,}}(?:$|(?<=[;|,-] ))|;\s*(?:nan|null|undefined)\s*(?:;|$)")
DEFAULT_ALONE = re.compile(r"(?i)^\s*(?:nan|null|undefined|none|\(null\)|#n/a|#ref!)(?:\s*[-;|,]\s*(?:nan|null|undefined|none))*\s*$")
POSITIONAL = re.compile(r"\W*(?:(?:%[sd]|\{\d\})\W*(?:at|in|for|of|and|by)?\W*)+")
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud".split())

_REASON = r"(?:bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|request timeout|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
_SCRIPT = r"(?:java ?script|js|(?:client-side )?script(?:s|ing)?)"
# Messages of error pages, and what stands beside them.
ERRORS = re.compile(
    rf"(?i)(?:http(?: status)? \d{{3}}(?: ?[-–:] ?.{{0,40}})?|error \d{{3}}(?: ?[-–:] ?.{{0,40}})?|\d{{3}}[ -–:]+{_REASON}|{_REASON}(?: \(\d{{3}}\))?|page not found|access denied|zugriff verweigert|seite nicht gefunden|页面不存在或已被删除|ページが見つかりません"
    r"|(?:sorry, )?this page is no longer available|unable to load (?:the )?\w+|something went wrong|oops!?|we can['’]t find that (?:job|page)|(?:oops! )?we can['’]t find that (?:job|page)|we are down for maintenance|your session has expired(?:, please sign in again)?"
    r"|are you a robot\??|checking your browser before access…?|the server took too long to respond|typeerror: .{3,60}|syntaxerror: .{3,60}|unexpected token .{1,40}|sqlstate: .{3,40}|page introuvable|accès refusé|página no encontrada)"
)
TAILS = re.compile(r"(?i)(?:(?:please )?try again(?: later)?|return to the home ?page|then reload|and reload|reload|complete the check to continue|reference: ?[0-9a-f]+|please wait|loading…?|.{0,12}\bif nothing happens, switch on scripts)")
# A demand for scripts: one of the words before and the scripts behind it, or the other way round, or a beginning.
DEMANDS = (
    (re.compile(r"(?i)\b(?:enable|enabled|turn on|switch on|activate|allow|allowed|need|requires?)\b"), re.compile(rf"(?i)\b{_SCRIPT}\b")),
    (re.compile(rf"(?i)\b{_SCRIPT}\b"), re.compile(r"(?i)\b(?:must|enabled|disabled|allowed|to run|required|switched off|turned off)\b")),
    (re.compile(rf"(?i)does not support {_SCRIPT}"), re.compile("")),
)
SCRIPTS = re.compile(r"(?i)(?:no-script mode|bitte aktivieren sie javascript$|veuillez activer javascript$|请启用 ?javascript|javascriptを有効に|active javascript|to use the careers site)")
_PLAIN_SCRIPTS = r"(?:scripts must be allowed for this page|please enable javascript to view this (?:job|page)|this site requires scripts to run|your browser does not support scripts|javascript is disabled in your browser|no-script mode: content can['’]t be shown|this app works best with javascript enabled|you need to turn on javascript to continue|bitte aktivieren sie javascript|veuillez activer javascript|请启用 ?javascript ?后重试)"
NOTICE = re.compile(rf"(?i)(?:{ERRORS.pattern[4:]}|{_PLAIN_SCRIPTS}|{TAILS.pattern[4:]})[\s.!。…]*")
LONGEST = 120  # letters of the longest single message that NOTICE describes
_BORDER = re.compile(r"\b|(?<=[\s.!。…])|$")
_SENTENCE = re.compile(r"(?<=[.!?…。])\s+|\n+|(?<=[.!?…])(?=[A-Z])")


def _clean(part: str) -> str:
    return part.strip().rstrip(".!。 ").strip()


def is_script_demand(part: str) -> bool:
    return bool(SCRIPTS.match(part)) or any((m := first.search(part)) is not None and then.search(part, m.end()) is not None for first, then in DEMANDS)


def all_notices(text: str) -> bool:
    """Whether a text is a row of messages: the places a message can end at are followed from the beginning."""
    if not NOTICE.match(text):
        return False
    borders = [m.start() for m in _BORDER.finditer(text)]
    reached, at = {0}, 0
    for at, start in enumerate(borders):
        if start in reached:
            for end in borders[at + 1 :]:
                if end - start > LONGEST:
                    break
                if end not in reached and NOTICE.fullmatch(text, start, end):
                    reached.add(end)
    return len(text) in reached


def is_notice(text: str) -> bool:
    """Whether a field consists of error and script notices alone."""
    whole = _clean(text)
    if not whole:
        return False
    if all_notices(whole) and not TAILS.fullmatch(whole):
        return True
    hits, tails = False, 0
    for part in _SENTENCE.split(whole):
        p = _clean(part)
        if not p:
            continue
        tail = bool(TAILS.fullmatch(p))
        hit = not tail and all_notices(p) or ";" not in p and len(p.split()) >= 3 and is_script_demand(p)
        if not hit and not tail:
            return False
        hits, tails = hits or hit, tails + tail
    return hits


def is_lorem(text: str) -> bool:
    """Four words of dummy Latin in a row, in any order, that are not just the name of the filler."""
    run = 0
    for w in re.findall(r"[A-Za-z]+", text):
        run = run + 1 if w.lower() in LOREM else 0
        if run >= 4:
            return True
    return False


def placeholders(text: str) -> list[tuple[str, str, str]]:
    """(style, name, surroundings) of every name within template delimiters."""
    out: list[tuple[str, str, str]] = []
    if not _DELIMITER.search(text):
        return out
    for style, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            before, after = text[: m.start()].split()[-2:], text[m.end() :].split()[:2]
            out.append((style, m[1], " ".join([*before, "\0", *after]).lower()))
    return out


_DELIMITER = re.compile(r"[\[{<%&*@]|__|\$\(")
_COMPILED = {k: re.compile(v) for k, v in STYLES.items()}


def words_of(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def own_reasons(text: str | None) -> tuple[list[str], list[tuple[str, str, str]]]:
    """What one field shows by itself: (reasons, placeholder candidates)."""
    if text is None or not text.strip():
        return [], []
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    reasons = []
    if FILLER.search(text):
        reasons.append("filler")
    if is_lorem(text):
        reasons.append("lorem")
    if DEFAULT_ALONE.match(text) or DEFAULT_SLOTS.search(text):
        reasons.append("default")
    if POSITIONAL.fullmatch(text):
        reasons.append("positional")
    if is_notice(text):
        reasons.append("notice")
    found = placeholders(text)
    if any(all(w in SCHEMA_WORDS for w in words_of(name)) for _, name, _ in found):
        reasons.append("field_name")
    return reasons, found


_PART = re.compile(r"\s*[;|\n]\s*|(?<=[.!?…])\s+|(?<=。)")
_TOKEN = re.compile(r"[^\W\d]+|\d+|[^\w\s]|_")
_BLANK = re.compile(r"(?<![\w#(])(?:nan|NaN|null|NULL|undefined|\(null\))(?!\w)")
_EDGE = ("\1", "\2")


def _tokens(text: str) -> list[str]:
    return ["0" if t.isdigit() else t.lower() for t in _TOKEN.findall(text)]


def _places(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of delimited names and defaults that do not overlap; the name of a default is empty."""
    found = sorted(((m.start(), -m.end(), m[1].lower()) for p in _COMPILED.values() for m in p.finditer(text)), key=lambda x: x[:2]) if _DELIMITER.search(text) else []
    out: list[tuple[int, int, str]] = []
    for start, end, name in [*found, *((m.start(), -m.end(), "") for m in _BLANK.finditer(text))]:
        if all(-end <= s or start >= e for s, e, _ in out):
            out.append((start, -end, name))
    return sorted(out)


def parts_of(text: str) -> list[tuple[int, list[str], list[tuple[int, str]], str]]:
    """(position, words, (index among the words, name) of delimited names and defaults, text) of each part that is not blank; such a name is the word \\0."""
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).replace("&lt;", "<").replace("&gt;", ">")
    places = _places(text) if _DELIMITER.search(text) or _BLANK.search(text) else []
    names = [n for *_, n in places]
    for start, end, _ in reversed(places):
        text = f"{text[:start]}\0{text[end:]}"
    out, used = [], 0
    for position, part in enumerate(_PART.split(text)):
        words = _tokens(part)
        here = [k for k, w in enumerate(words) if w == "\0"]
        if words:
            own = names[used : used + len(here)]
            out.append((position, words, list(zip(here, own, strict=True)), " ".join([*words, *own])))
        used += len(here)
    return out


def _skeleton(before: list[str], after: list[str]) -> int:
    return signed(xxhash.xxh64_intdigest(" ".join([*before, "\0\0", *after])))


def _edge(before: list[str], after: list[str]) -> int:
    """What a part of the same skeleton is looked up by: its first and last word outside of the slot."""
    return signed(xxhash.xxh64_intdigest(f"{before[0] if before else _EDGE[0]} {after[-1] if after else _EDGE[1]}"))


def _at(position: int) -> int:
    return signed(xxhash.xxh64_intdigest(f"#{position}"))


def skeletons(text: str | None) -> list[dict]:
    """The places of a field that may be slots, as (edge, skeleton, part, named)."""
    out: list[dict] = []
    for position, words, here, whole in parts_of(text or ""):
        part = signed(xxhash.xxh64_intdigest(whole))
        spans = [(k, k + 1, bool(n)) for k, n in here]
        if len(here) > 1:
            spans.append((here[0][0], here[-1][0] + 1, any(n for _, n in here)))
        if words[-1] == ":" and len(words) > 1:
            spans.append((len(words), len(words), False))
        for i, j, named in spans:
            before, after = words[:i], words[j:]
            if before or after:
                out.append({"edge": _edge(before, after), "skeleton": _skeleton(before, after), "part": part, "named": named})
            elif named:
                out.append({"edge": _at(position), "skeleton": _at(position), "part": part, "named": True})
    return out


_OWN = StructType([StructField("reasons", ArrayType(StringType())), StructField("found", ArrayType(StructType([StructField("style", StringType()), StructField("name", StringType()), StructField("around", StringType())]))),
                   StructField("places", ArrayType(StructType([StructField("edge", LongType()), StructField("skeleton", LongType()), StructField("part", LongType()), StructField("named", BooleanType())])))])


def _judge(texts: pd.Series) -> pd.DataFrame:
    rows = [own_reasons(t) for t in texts]
    return _judged(texts, rows)


def _judge_names(texts: pd.Series) -> pd.DataFrame:
    """Without lists: only the names within delimiters are taken down."""
    return _judged(texts, [([], placeholders(t if t.isascii() else unicodedata.normalize("NFKC", t)) if t else []) for t in texts])


def _judged(texts: pd.Series, rows: list) -> pd.DataFrame:
    places = [skeletons(t) if f or not r and (_BLANK.search(t or "") or ":" in (t or "")) else [] for t, (r, f) in zip(texts, rows, strict=True)]
    return pd.DataFrame({"reasons": [r for r, _ in rows], "found": [[{"style": s, "name": n, "around": a} for s, n, a in f] for _, f in rows], "places": places})


_LOOKED_UP = ArrayType(StructType([StructField("edge", LongType()), StructField("words", StringType()), StructField("part", LongType())]))


@pandas_udf(_LOOKED_UP)
def _edges(texts: pd.Series) -> pd.Series:
    """Each part under its ends (either of which may be the slot) and under its position, without words where the part itself is the value."""
    out = []
    for text in texts:
        rows = []
        for position, words, _, whole in parts_of(text or ""):
            part, line = signed(xxhash.xxh64_intdigest(whole)), " ".join(words)
            rows += [{"edge": e, "words": line, "part": part} for e in {_edge(words, words), _edge([], words), _edge(words, [])}]
            rows.append({"edge": _at(position), "words": None if "\0" not in line else "\0", "part": part})
        out.append(rows)
    return pd.Series(out)


_SPANS = ArrayType(StructType([StructField("skeleton", LongType()), StructField("value", LongType())]))


@pandas_udf(_SPANS)
def _spans(lines: pd.Series) -> pd.Series:
    """Every skeleton of a part with the value in its slot: up to SLOT_WORDS words, none of them a delimited name or default."""
    out = []
    for line in lines:
        words, rows = line.split(" "), []
        for i in range(len(words)):
            for j in range(i + 1, min(i + SLOT_WORDS, len(words)) + 1):
                if words[j - 1] == "\0":
                    break
                if i or j < len(words):
                    rows.append({"skeleton": _skeleton(words[:i], words[j:]), "value": signed(xxhash.xxh64_intdigest(" ".join(words[i:j])))})
        out.append(rows)
    return pd.Series(out)


def _small(df: DataFrame) -> DataFrame:
    """``df`` written, and broadcast where it is counted to be small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def aligned(long: DataFrame, judged: DataFrame) -> DataFrame:
    """(ord, field, reason) of the fields with a name, default or nothing in a slot of the template of their source."""
    places = cut(judged.select("ord", "source", "field", F.explode("places").alias("p")).select("ord", "source", "field", "p.*"))
    fields = long.join(_small(places.select("source", "field").distinct()), ["source", "field"], "left_semi")
    # parts that may share a skeleton, or are the frame's
    edges = _small(places.select("source", "field", "edge").distinct())
    looked = fields.select("source", "field", F.explode(_edges("text")).alias("e")).select("source", "field", "e.*").join(edges, ["source", "field", "edge"], "left_semi").distinct()
    looked = cut(looked)
    values = looked.where("words is null").select("source", "field", F.col("edge").alias("skeleton"), F.col("part").alias("value"))
    spans = looked.where("words <> '\0'").select("source", "field", "words").distinct().select("source", "field", F.explode(_spans("words")).alias("s")).select("source", "field", "s.*")
    varied = values.unionByName(spans).join(_small(places.select("source", "field", "skeleton").distinct()), ["source", "field", "skeleton"], "left_semi").distinct()
    varied = varied.groupBy("source", "field", "skeleton").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RECURS).select("source", "field", "skeleton")
    slots = places.join(varied, ["source", "field", "skeleton"], "left_semi").select("ord", "field")
    # the frame: parts of half of the different texts, by the source and by the number of separators
    shape, parts = F.length("text") - F.length(F.translate("text", ";|\n", "")), places.where("named").select("ord", "field", "part").distinct()
    texts = fields.select("source", "field", shape.alias("shape"), F.xxhash64("text").alias("text")).distinct()
    by_shape = texts.groupBy("source", "field", "shape").agg(F.count(F.lit(1)).alias("of"))
    by_source = by_shape.groupBy("source", "field").agg(F.sum("of").alias("of_all"))
    holders = parts.join(fields.select("ord", "source", "field", shape.alias("shape"), F.xxhash64("text").alias("text")), ["ord", "field"])
    held = holders.select("source", "field", "shape", "part", "text").distinct().groupBy("source", "field", "shape", "part").agg(F.count(F.lit(1)).alias("n"))
    every = held.groupBy("source", "field", "part").agg(F.sum("n").alias("n_all")).join(by_source, ["source", "field"])
    shares = held.join(by_shape, ["source", "field", "shape"]).join(every, ["source", "field", "part"])
    frame = shares.where((F.col("n") >= FRAME) & (2 * F.col("n") >= F.col("of")) | (F.col("n_all") >= FRAME) & (2 * F.col("n_all") >= F.col("of_all"))).select("source", "field", "shape", "part")
    framed = holders.join(frame, ["source", "field", "shape", "part"], "left_semi").select("ord", "field")
    return slots.unionByName(framed).select("ord", "field", F.lit("variable").alias("reason"))


SLOT_VALUES = ("company", "location", "employment_type")


def _words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def _shape(text):
    """Words of a text, numbers (hexadecimal ones too) as 0."""
    return _words(F.regexp_replace(text, r"(?iU)(?<!\w)[0-9a-f]*\d[0-9a-f]*(?!\w)", "0"))


def templates(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, n_records, n_filled, is_template) of each source, (ord, source, company, snippet, filled, n_values) of each snippet).

    A snippet is filled if it holds a value of its own record: the value's first word, or half of its words.
    """
    values = [c for c in SLOT_VALUES if c in items.columns]
    here = _words(F.col("snippet"))

    def held(name: str):
        own = _words(F.coalesce(F.col(name), F.lit("")))
        return F.coalesce((F.size(own) > 0) & (F.array_contains("_here", F.get(own, F.lit(0))) | (2 * F.size(F.filter(own, lambda w: F.array_contains("_here", w))) >= F.size(own))), F.lit(False))

    rows = items.where(F.length(F.trim("snippet")) > 0).withColumn("_here", here)
    given = sum(((F.size(_words(F.coalesce(F.col(c), F.lit("")))) > 0).cast("int") for c in values), F.lit(0))
    filled = F.lit(False)
    for c in values:
        filled = filled | held(c)
    source = F.coalesce("source", F.lit("")) if "source" in items.columns else F.lit("")
    rows = rows.select("ord", source.alias("source"), F.coalesce(F.lower(F.trim("company")), F.lit("")).alias("maker"), "snippet", filled.alias("filled"), given.alias("n_values"))
    by_source = rows.where("n_values > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("filled").alias("n_filled"))
    return by_source.withColumn("is_template", (F.col("n_records") >= FRAME) & (F.col("n_filled") >= TEMPLATE * F.col("n_records"))), rows


def other_pages(items: DataFrame, long: DataFrame) -> DataFrame:
    """(ord, field, reason) of snippets off their source's template, and of fields that say what such pages say."""
    by_source, rows = templates(items)
    off = cut(rows.where("n_values > 0 and not filled").join(by_source.where("is_template").select("source"), "source", "left_semi").select("ord", "maker", _shape(F.col("snippet")).alias("w")))
    pages = off.select("ord", F.lit("snippet").alias("field"), F.lit("other_page").alias("reason"))
    # runs of up to RUN words of those pages, and the whole pages
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(i, F.least(F.size("w"), i + RUN - 1)), lambda j: F.array_join(F.slice("w", i, j - i + 1), " "))))
    said = off.where(F.size("w") > 0).distinct().select("ord", F.explode(F.array_distinct(F.array_append(runs, F.array_join("w", " ")))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n_off"))
    said = _small(said)
    elsewhere = long.join(off.select("ord", F.lit("snippet").alias("field")).distinct(), ["ord", "field"], "left_anti")
    titles = elsewhere.where("field = 'title'").select("ord", "field", F.array_join(_shape(F.col("text")), " ").alias("run")).where("run <> ''").join(said, "run", "left_semi")
    parts = elsewhere.where("field = 'snippet'").select("ord", "field", F.explode(F.split("text", _PART.pattern)).alias("part")).select("ord", "field", F.array_join(_shape(F.col("part")), " ").alias("run")).where("run <> ''").join(said, "run", "left_semi").distinct()
    parts = cut(parts)
    held = parts.groupBy("run").agg(F.count(F.lit(1)).alias("n_on")).join(said, "run").where("n_off >= n_on").select("run")
    # words that mostly stand in such pages, four in a row
    mine = _small(off.distinct().select("ord", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_off")).where(F.col("n_off") >= RECURS))
    standing = cut(elsewhere.select("ord", "field", F.posexplode(_shape(F.col("text"))).alias("at", "word")).join(mine.select("word"), "word", "left_semi"))
    on = standing.select("ord", "field", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n_on"))
    common = mine.join(on, "word", "left").where(F.col("n_off") >= F.coalesce("n_on", F.lit(0))).select("word")
    spots = standing.join(common, "word", "left_semi").groupBy("ord", "field").agg(F.array_sort(F.collect_set("at")).alias("spots")).where(F.size("spots") > 3)
    rows_of = spots.where(F.exists(F.sequence(F.lit(0), F.size("spots") - 4), lambda i: F.get("spots", i + 3) == F.get("spots", i) + 3)).select("ord", "field")
    telling = titles.select("ord", "field").unionByName(parts.join(held, "run", "left_semi").select("ord", "field")).unionByName(rows_of)
    # snippets of one shape over several companies that hold no value of their record
    shaped = rows.where("not filled").select("ord", "maker", F.xxhash64(F.array_join(_shape(F.col("snippet")), " ")).alias("shape"))
    again = shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("maker").alias("a"), F.max("maker").alias("b")).where((F.col("n") >= RECURS) & (F.col("a") != F.col("b"))).select("shape")
    repeated = shaped.join(again, "shape", "left_semi").select("ord", F.lit("snippet").alias("field"), F.lit("repeated_page").alias("reason"))
    return pages.unionByName(telling.select("ord", "field", F.lit("page_text").alias("reason"))).unionByName(repeated)


def flag(items: DataFrame, lists: bool = True) -> DataFrame:
    """(ord, title, snippet, company, ...) -> (ord, field, reasons) of each field that is residue or holds some.

    ``lists=False`` judges by alignment and counts alone.
    """
    source = F.coalesce("source", F.lit("")) if "source" in items.columns else F.lit("")
    long = items.select("ord", source.alias("source"), F.explode(F.create_map(F.lit("title"), "title", F.lit("snippet"), "snippet")).alias("field", "text")).where(F.length(F.trim("text")) > 0)
    # three readers need the judgement, which few fields have anything in: it is written once, without the others
    judge = pandas_udf(_judge if lists else _judge_names, _OWN)
    judged = cut(long.withColumn("own", judge("text")).select("ord", "source", "field", "own.reasons", "own.found", "own.places").where("size(reasons) > 0 or size(found) > 0 or size(places) > 0"))
    own = judged.where(F.size("reasons") > 0).select("ord", "field", F.explode("reasons").alias("reason"))
    # names that stand in several styles and surroundings are variables
    seen = judged.where(F.size("found") > 0).select("ord", "field", F.explode("found").alias("p")).select("ord", "field", F.lower("p.name").alias("name"), "p.style", F.xxhash64("p.around").alias("around"))
    kinds = seen.groupBy("name", "style", "around").agg(F.count(F.lit(1)).alias("n"))
    styles = kinds.groupBy("name", "style").agg(F.count(F.lit(1)).alias("places")).groupBy("name").agg(F.count(F.lit(1)).alias("n_styles"), F.sum("places").alias("n_places"))
    variables = styles.where((F.col("n_styles") >= RECURS) & (F.col("n_places") >= 2 * RECURS)).select("name")
    slots = seen.where(F.length("name") > 0).join(variables, "name", "left_semi").select("ord", "field", F.lit("variable").alias("reason"))
    found = own.unionByName(slots).unionByName(aligned(long, judged.where("size(reasons) = 0"))).unionByName(other_pages(items, long))
    return found.groupBy("ord", "field").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
