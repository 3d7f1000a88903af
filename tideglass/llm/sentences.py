"""Sentence units of documents in any language and script (problem 9).

Method: boundary rules are compiled into a finite transducer over a tape of symbols. A scanner with
bounded context turns a text into the tape (end marks already judged by the words beside them,
opening and closing quotation marks, block and item borders, spaces between Thai letters). The
transducer's states say which kind of quotation is open; its output says where a unit ends. The
tapes of a batch are laid end to end and cut into blocks of equal length; every block is run from
all states at once, which gives its state-transition function; the functions are composed by a
parallel prefix scan, and a second run emits the borders from the known start states. A document of
any length is so processed in blocks, never by a prefix.

Defined cases: null, empty and blank texts have no units; units never begin or end with white
space; all other characters belong to exactly one unit; offsets are code points; repeated rows give
repeated units; an unpaired quotation mark within a paragraph is an ordinary character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 2048

# Abbreviations after which a sentence goes on whatever follows.
NEVER = frozenset(
    """dr mr mrs ms prof st fig figs sec ch vol no nos nr hr fr tel ext ref resp max min approx e.g i.e eg ie vs cf viz ca cap art p pp ph ph.d m.d b.a m.a sr sra srta ud uds d dña dn lic ing
    aprox ej p.ej env ex p.ex mme mlle mm mme z.b d.h u.a o.ä bzw zzgl inkl vgl abs str evtl ggf usw.u mio mrd jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc enero dez okt
    gen col sgt capt rev hon gov sen rep mt ft av bd dept est n.º núm pág डॉ श्री प्रो د م أ""".split()
)
# Titles, which are short forms only where they begin with a capital ("Ms. Osk", but "5 ms.").
TITLES = frozenset("dr mr mrs ms prof st hr fr sr sra srta mme mlle gen col sgt capt rev hon gov sen rep".split())
# Abbreviations that may end a sentence; the next word decides.
MAYBE = frozenset("inc ltd corp co llc plc gmbh ag s.a sa kk k.k pty jr sr.jr u.s e.u u.k u.n u.s.a a.m p.m p.a etc al usw etcétera a.d b.c bros".split())
# Words written small that begin a sentence all the same.
SMALL_STARTERS = re.compile(r"(?:[a-z]{1,2}[A-Z]\w|npm\b|e-?mail\b|git\b)")
MONTH_WORDS = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Stock|Etage|Quartal|Jahrhundert|Klasse|Kapitel|Semester|Geburtstag)\b")
ORDINAL_BEFORE = frozenset("im am zum vom dem den der das die des ab bis ins seit beim jeden jeder jedes jedem ein einem einen eines".split())
CONNECTIVE = re.compile(r"(?:然后|并|接着|随后|便|就|后|的|说|問|问|道|地|和|और|फिर|तो|कहकर|ऐसा|पर|ثم|وقال|وقالت|قال|قالت|فقال)")

MARKS = ".!?…。！？｡．।॥؟۔՞։"
CLOSERS = ")]}）】］〕〉》"
_ITEM = re.compile(r"[ \t 　]*(?:[-*•·‣▪◦●○■]|\(?\d{1,3}[.)]|[a-zA-Z]\)|[①-⑳]|（[一二三四五六七八九十\d]+）)[ \t 　]+(?=\S)")
_LINE = re.compile(r"\r\n|[\n\r  \u0085\f\v]")
_THAI_SPACE = r"(?<=[฀-๿])[  ]+(?=[฀-๿])"
_POINT = re.compile(rf"(?P<marks>[{re.escape(MARKS)}]+(?:[   ]?[!?]+)*)|(?P<quote>[“”„«»「」『』\"])|(?P<thai>{_THAI_SPACE})|(?P<spaced>[   ][!?]+)")

# The tape's symbols.
NOP, RESET, END, OPEN_CURLY, OPEN_LOW, OPEN_ANGLE, OPEN_CORNER, OPEN_DOUBLE_CORNER, CLOSE_CURLY, CLOSE_CURLY_END, CLOSE_ANGLE, CLOSE_ANGLE_END, CLOSE_CORNER, CLOSE_CORNER_END, CLOSE_DOUBLE_CORNER, CLOSE_DOUBLE_CORNER_END, OPEN_CURLY_END, STRAIGHT, STRAIGHT_END = range(19)
SYMBOLS = 19
# The states: the quotation that is open.
OUT, CURLY, LOW, ANGLE, CORNER, DOUBLE_CORNER, STRAIGHT_OPEN = range(7)
STATES = 7


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, border after the symbol) for each state and symbol."""
    step = np.tile(np.arange(STATES, dtype=np.int8)[:, None], (1, SYMBOLS))
    emit = np.zeros((STATES, SYMBOLS), dtype=bool)
    step[:, RESET], emit[:, RESET], emit[OUT, END] = OUT, True, True
    for opener, state in ((OPEN_CURLY, CURLY), (OPEN_LOW, LOW), (OPEN_ANGLE, ANGLE), (OPEN_CORNER, CORNER), (OPEN_DOUBLE_CORNER, DOUBLE_CORNER), (STRAIGHT, STRAIGHT_OPEN), (OPEN_CURLY_END, CURLY), (STRAIGHT_END, STRAIGHT_OPEN)):
        step[OUT, opener] = state
    for state, plain, after_end in ((CURLY, CLOSE_CURLY, CLOSE_CURLY_END), (ANGLE, CLOSE_ANGLE, CLOSE_ANGLE_END), (CORNER, CLOSE_CORNER, CLOSE_CORNER_END), (DOUBLE_CORNER, CLOSE_DOUBLE_CORNER, CLOSE_DOUBLE_CORNER_END), (LOW, OPEN_CURLY, OPEN_CURLY_END), (LOW, CLOSE_CURLY, CLOSE_CURLY_END), (STRAIGHT_OPEN, STRAIGHT, STRAIGHT_END)):
        step[state, [plain, after_end]] = OUT
        emit[state, after_end] = True
    return step, emit


STEP, EMIT = compile_transducer()


def compose_prefix(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state functions (rows), by doubling: log2(n) rounds over all rows at once."""
    out = functions.copy()
    reach = 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].copy(), axis=1)
        reach *= 2
    return out


def run_transducer(tape: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For each symbol whether a unit ends after it, starting outside of quotations."""
    n = len(tape)
    if n == 0:
        return np.zeros(0, dtype=bool)
    rows = -(-n // block)
    width = min(block, n)
    padded = np.full(rows * width if rows == 1 else rows * block, NOP, dtype=np.int8)
    padded[:n] = tape
    blocks = padded.reshape(rows, -1)
    states = np.tile(np.arange(STATES, dtype=np.int8), (rows, 1))
    if rows > 1:
        for t in range(blocks.shape[1]):
            states = STEP[states, blocks[:, t][:, None]]
        functions = compose_prefix(states)
        state = np.concatenate([[OUT], functions[:-1, OUT]]).astype(np.int8)
    else:
        state = np.array([OUT], dtype=np.int8)
    ends = np.zeros(blocks.shape, dtype=bool)
    for t in range(blocks.shape[1]):
        column = blocks[:, t]
        ends[:, t] = EMIT[state, column]
        state = STEP[state, column]
    return ends.reshape(-1)[:n]


def _starts_small(text: str, i: int) -> bool:
    return bool(SMALL_STARTERS.match(text, i))


def _word_before(text: str, i: int) -> str:
    """The run of letters, digits and inner points that ends at i, at most 24 characters."""
    j, low = i, max(0, i - 24)
    while j > low and (text[j - 1].isalnum() or text[j - 1] in ".º" or "ऀ" <= text[j - 1] <= "ॿ"):
        j -= 1
    return text[j:i]


def _joined(text: str, i: int) -> str:
    """The word before i with the short abbreviation before it ("z. B", "p. ex", "d. h")."""
    word = _word_before(text, i)
    j = i - len(word)
    if word and len(word) <= 3 and j >= 2 and text[j - 1] in "   " and text[j - 2] == ".":
        first = _word_before(text, j - 2)
        if len(first) == 1 and first.isalpha() and word[0].isalpha():
            return f"{first}.{word}"
    return word


def _after_point(text: str, start: int, end: int) -> bool:
    """Whether a single point at text[start:end] ends a sentence (outside of quotations)."""
    n = len(text)
    k = end
    while k < n and (text[k] in CLOSERS or text[k] in "”»」』"):
        k += 1
    if k >= n:
        return True
    closed = k > end
    j = k
    while j < n and text[j].isspace():
        j += 1
    if j >= n:
        return True
    gap, nxt = j > k, text[j]
    word = _joined(text, start)
    low = word.lower().strip(".")
    if "." in low and low not in NEVER and low not in MAYBE and low.rsplit(".", 1)[1] in (TITLES | MAYBE):
        low = low.rsplit(".", 1)[1]  # "The task.Dr. Osk"
    if low in TITLES and word.rsplit(".", 1)[-1].islower():
        low = ""
    if not gap:
        if closed:
            return False if nxt.islower() or nxt in ",;:.!?" else not nxt.isdigit()
        if nxt in ",;:-/_@%&=+'’" or not word:
            return False
        last = re.split(r"[.\d]", word)[-1]
        if word[-1].isdigit():
            return nxt.isupper() and j + 1 < n and (text[j + 1].islower() or text[j + 1] == " ")
        if "฀" <= nxt <= "๿" or "぀" <= nxt <= "鿿" or "가" <= nxt <= "힣":
            return not word.isascii() or len(last) > 3
        if low in NEVER or len(last) < 2 and low not in MAYBE:
            return False
        if nxt.isupper():
            return j + 1 < n and (text[j + 1].islower() or text[j + 1] in " .") and (last.islower() or low in MAYBE or last[:1].isupper() and last[1:].islower())
        if nxt.isdigit():
            return last.islower() and len(last) > 2 and bool(re.match(r"\d+ [a-zA-Z]", text[j : j + 12]))
        return nxt in "“„«\"¿¡" and len(last) > 1
    small = nxt.islower() and not _starts_small(text, j)
    if low in MAYBE:
        return not (small or nxt in ",;:)–—-/&")
    if low in NEVER:
        if low in ("no", "nr", "sec", "ref") and not nxt.isdigit() and low == "no":
            return nxt.isupper() and not nxt.isdigit() and word.islower() and not text[j : j + 2].isupper()
        return False
    last = _word_before(text, start)
    if len(last) == 1 and last.isalpha() and not ("฀" <= last <= "๿" or "぀" <= last <= "鿿" or "가" <= last <= "힣"):
        return False  # an initial or a part of a short form
    if word.isdigit() and len(word) <= 4:
        if nxt.isdigit() and re.search(r"\d{4}\. \d{1,2}$|\d{4}$", text[max(0, start - 12) : start]) and re.match(r"\d{1,2}\.", text[j : j + 3]):
            return False
        if re.search(r"\d{4}\. ?\d{1,2}\. ?\d{1,2}$", text[max(0, start - 16) : start]):
            return False
        if len(word) <= 2 and nxt.isalpha():
            if MONTH_WORDS.match(text, j):
                return False
            before = _word_before(text, start - len(word) - 1)
            if before.lower() in ORDINAL_BEFORE and nxt.isupper():
                return False
    return nxt not in ",;:"


def _mark_ends(text: str, start: int, end: int) -> bool:
    marks = text[start:end]
    if marks == "." or marks == "．":
        return _after_point(text, start, end)
    n = len(text)
    k = end
    while k < n and (text[k] in CLOSERS or text[k] in "”»」』"):
        k += 1
    j = k
    while j < n and text[j].isspace():
        j += 1
    if j >= n:
        return True
    nxt = text[j]
    if set(marks) <= set(".…．"):  # dots of an omission
        if "⺀" <= nxt <= "鿿" or "가" <= nxt <= "힣" or "ऀ" <= nxt <= "ॿ" or "؀" <= nxt <= "ۿ":
            return j > k and marks != "……" and not ("⺀" <= nxt <= "鿿")
        return j > k and not (nxt.islower() and not _starts_small(text, j) or nxt in ",;:.!?)")
    if marks[-1] in "!?" and j == k:  # no space: an address or a sign within a word
        return nxt.isupper() or nxt in "“„«\"¿¡(" or not (nxt.isascii() or nxt.islower())
    if nxt in ",;:，；：、" and not (nxt == ":" and j > k):
        return False
    if k > end and nxt.islower() and not _starts_small(text, j):  # "(Really?) he said"
        return False
    return True


def _quote_goes_on(text: str, i: int) -> bool:
    """Whether the sentence goes on after a closing quotation mark that follows an end mark; i is behind the mark."""
    n = len(text)
    k = i
    while k < n and text[k] in CLOSERS:
        k += 1
    j = k
    while j < n and text[j].isspace():
        j += 1
    if j >= n:
        return False
    nxt = text[j]
    if nxt in ",;:.!?…，；：。！？、)–—-" or nxt.islower() and not _starts_small(text, j):
        return True
    if j == k and ("぀" <= nxt <= "ヿ" or "가" <= nxt <= "힣"):
        return True
    return bool(CONNECTIVE.match(text, j))


_CLOSE = {"”": (CLOSE_CURLY, CLOSE_CURLY_END), "»": (CLOSE_ANGLE, CLOSE_ANGLE_END), "」": (CLOSE_CORNER, CLOSE_CORNER_END), "』": (CLOSE_DOUBLE_CORNER, CLOSE_DOUBLE_CORNER_END), "“": (OPEN_CURLY, OPEN_CURLY_END), '"': (STRAIGHT, STRAIGHT_END)}
_OPEN = {"„": OPEN_LOW, "«": OPEN_ANGLE, "「": OPEN_CORNER, "『": OPEN_DOUBLE_CORNER}


def scan(text: str) -> tuple[list[int], list[int]]:
    """(positions behind which a unit may end, their symbols) of one text."""
    positions, symbols = [], []
    for start, end, skip in blocks(text):
        piece = text[start:end]
        paired = {
            '"': piece.count('"') % 2 == 0,
            "”": piece.count("”") == piece.count("“") or "„" in piece,
            "»": piece.count("«") == piece.count("»"),
            "」": piece.count("「") == piece.count("」"),
            "』": piece.count("『") == piece.count("』"),
        }
        paired["“"] = paired["„"] = paired["”"]
        paired["«"], paired["「"], paired["『"] = paired["»"], paired["」"], paired["』"]
        for m in _POINT.finditer(piece, skip - start):
            kind, a, b = m.lastgroup, m.start(), m.end()
            if kind == "quote":
                c = piece[a]
                if not paired[c]:
                    continue
                if c in _OPEN:
                    symbol = _OPEN[c]
                else:
                    p = a
                    while p > 0 and piece[p - 1] in "   ":
                        p -= 1
                    after_end = p > 0 and (piece[p - 1] in MARKS or p > 1 and piece[p - 1] in ")）" and piece[p - 2] in MARKS)
                    symbol = _CLOSE[c][1 if after_end and not _quote_goes_on(piece, b) else 0]
                while b < len(piece) and piece[b] in CLOSERS and symbol in (CLOSE_CURLY_END, CLOSE_ANGLE_END, CLOSE_CORNER_END, CLOSE_DOUBLE_CORNER_END, OPEN_CURLY_END, STRAIGHT_END):
                    b += 1
            elif kind == "thai":
                symbol = END
            else:
                if not _mark_ends(piece, a, b):
                    continue
                while b < len(piece) and (piece[b] in CLOSERS or piece[b] in "”»」』" and not paired[piece[b]]):
                    b += 1
                symbol = END
            positions.append(start + b)
            symbols.append(symbol)
        positions.append(end)
        symbols.append(RESET)
    return positions, symbols


def blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, end of the item's marker) of paragraphs, headings and list items."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    group: list[tuple[int, int]] = []
    for start, end in [*lines, (len(text), len(text))]:
        if end > start and not text[start:end].isspace():
            group.append((start, end))
            continue
        if group:
            yield from _paragraph(text, group)
        group = []


def _paragraph(text: str, lines: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    markers = [_ITEM.match(text, a, b) for a, b in lines]
    bullets = sum(1 for m in markers if m and m[0].strip() in "-*•·‣▪◦●○■")
    listed = markers[0] is not None or bullets >= 2 or bullets == 1 and len(lines) == 2
    start, skip = lines[0][0], markers[0].end() if markers[0] and listed else lines[0][0]
    for (a, _), m, (_, before) in zip(lines[1:], markers[1:], lines[:-1], strict=True):
        if listed and m:
            yield start, before, skip
            start, skip = a, m.end()
    yield start, lines[-1][1], skip


def units_of(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """The units of each text; one run of the transducer for all of them."""
    scanned = [scan(t) if t else ([], []) for t in texts]
    ends = run_transducer(np.array([s for _, symbols in scanned for s in symbols], dtype=np.int8))
    out, at = [], 0
    for text, (positions, symbols) in zip(texts, scanned, strict=True):
        units, start = [], 0
        for p, e in zip(positions, ends[at : at + len(symbols)], strict=True):
            if e and p > start:
                a, b = start, p
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if b > a:
                    units.append((a, b))
                start = p
        out.append(units)
        at += len(symbols)
    return out


def split(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, start_char, end_char), one row for each unit; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = units_of(list(batch["text"]))
            counts = [len(u) for u in units]
            flat = [x for u in units for x in u]
            yield pd.DataFrame({"doc_id": np.repeat(batch["doc_id"].to_numpy(), counts), "start_char": np.array([a for a, _ in flat], dtype=np.int32), "end_char": np.array([b for _, b in flat], dtype=np.int32)})

    return documents.select("doc_id", "text").where("text is not null and doc_id is not null").mapInPandas(run, "doc_id long, start_char int, end_char int")
